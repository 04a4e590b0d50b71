"""Queries over documents: blocks, similarity, keywords, formats, rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.functions import format as fmt
from tesseral.functions import keywords as kw
from tesseral.operators import compare, rules, similarity
from tesseral.plans.common import strip
from tesseral.plans.flows import calls
from tesseral.plans.sessions import assistant_segments, prompts
from tesseral.session import table
from tesseral.sources import documents as docs

#: Checks for the queries; patterns that Python and SQL read alike.
CHECKS = [
    {"id": "no-hook", "kind": "forbidden_pattern", "pattern": "hook", "applies_to": ["**/*.*"], "confidence": "high", "self_test": {"should_match": ["a hook b"], "should_not_match": ["nothing"]}},
    {"id": "order", "kind": "required_order", "first_pattern": "range", "second_pattern": "token", "applies_to": ["**/*.*"], "confidence": "medium", "self_test": {"should_match": ["token range"], "should_not_match": ["range token"]}},
    {"id": "no-lint", "kind": "forbidden_command", "pattern": "^lint", "confidence": "high", "self_test": {"should_match": ["lint x"], "should_not_match": ["build x"]}},
    {"id": "build-first", "kind": "required_command", "pattern": "^build", "trigger_pattern": "^test", "confidence": "high", "self_test": {"should_match": ["test x"], "should_not_match": ["build x"]}},
    {"id": "no-config", "kind": "forbidden_path", "pattern": "^config/", "confidence": "high", "self_test": {"should_match": ["config/a"], "should_not_match": ["lib/a"]}},
]


def _docs(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents")


def markdown_blocks(spark: SparkSession, root: str) -> DataFrame:
    b = docs.markdown_blocks(_docs(spark, root), "doc_id", "text")
    return b.withColumn("kind", docs.block_kind(F.col("title"), F.col("content"))).select("doc_id", "block_idx", "title", "level", "kind", "start_line", "end_line", F.length("content").alias("chars"))


def block_ids(spark: SparkSession, root: str) -> DataFrame:
    b = docs.markdown_blocks(_docs(spark, root), "doc_id", "text").join(_docs(spark, root).select("doc_id", "path"), "doc_id")
    return b.select("doc_id", "block_idx", F.concat_ws("-", F.coalesce(fmt.file_slug(F.col("path")), F.concat(F.lit("doc"), F.col("doc_id").cast("string"))), F.col("block_idx").cast("string"), fmt.title_slug(F.col("title"))).alias("id"), fmt.text_key(F.col("title"), F.col("content")).alias("rule_key"))


def block_cost_share(spark: SparkSession, root: str) -> DataFrame:
    """A document's characters as cost over its blocks by their lines."""
    from tesseral.operators.allocate import largest_remainder

    b = docs.markdown_blocks(_docs(spark, root), "doc_id", "text").select("doc_id", "block_idx", F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(1)).alias("lines"))
    cost = _docs(spark, root).select("doc_id", F.col("n_chars").alias("cost"))
    return largest_remainder(b.join(cost, "doc_id"), ["doc_id"], ["block_idx"], "lines", "cost", "tokens").select("doc_id", "block_idx", "tokens")


def md_references(spark: SparkSession, root: str) -> DataFrame:
    return docs.references(_docs(spark, root), "doc_id", "text", docs.MD_NAME)


def resolved_references(spark: SparkSession, root: str) -> DataFrame:
    files = _docs(spark, root).where("path is not null").select("path")
    return docs.resolve(md_references(spark, root), files, ["docs", "lib", "src"])


def shingle_counts(spark: SparkSession, root: str) -> DataFrame:
    return _docs(spark, root).where("text is not null").select("doc_id", F.size(similarity.shingles(F.col("text"), 3)).alias("shingles"))


def near_copies(spark: SparkSession, root: str) -> DataFrame:
    return similarity.near_copies(_docs(spark, root).select("doc_id", "text"), "doc_id", "text")


def similar_pairs(spark: SparkSession, root: str) -> DataFrame:
    d = _docs(spark, root).select("doc_id", "text")
    reps = d.join(similarity.classes(d, "doc_id", "text").select(F.col("class_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    p = similarity.similar_pairs(reps, "doc_id", "text")
    a, b = d.select(F.col("doc_id").alias("doc_a"), F.col("text").alias("a")), d.select(F.col("doc_id").alias("doc_b"), F.col("text").alias("b"))
    return p.join(a, "doc_a").join(b, "doc_b").select("doc_a", "doc_b", "shared", F.round("similarity", 3).alias("similarity"), similarity.shared_phrase(F.col("a"), F.col("b")).alias("phrase"))


def keyword_lists(spark: SparkSession, root: str) -> DataFrame:
    return _docs(spark, root).where("text is not null").select("doc_id", F.array_join(kw.keywords(F.col("text")), ",").alias("words"))


#: Points of a text beside those for keywords: for a reason given, and for naming the rules.
TOPICAL = {kw.CAUSAL: 2, "(?i)the rule|global rules": 1}


def topical_topk(spark: SparkSession, root: str) -> DataFrame:
    """The assistant texts most about the documents captured in their session, three a document; of these those of two points or more.

    Texts and documents meet by the first characters of a keyword, so only pairs that share one are made.
    """
    words = kw.keywords(F.col("text"))
    d = _docs(spark, root).where("text is not null and session_key is not null").select("session_key", "doc_id", F.explode(words).alias("word")).withColumn("gram", F.left("word", F.lit(5)))
    t = assistant_segments(spark, root).select("session_key", "event_idx", "item_idx", F.lower("text").alias("text"), kw.bonus(F.col("text"), TOPICAL).alias("bonus"), kw.grams(F.col("text")).alias("grams"))
    met = d.join(t.withColumn("gram", F.explode("grams")).drop("grams"), ["session_key", "gram"]).where(F.contains("text", "word"))
    scored = met.groupBy("doc_id", "session_key", "event_idx", "item_idx", "bonus").agg(F.count("*").alias("hits")).withColumn("score", F.col("hits") + F.col("bonus"))
    return compare.top_k(scored, ["doc_id"], [F.desc("score"), "session_key", "event_idx", "item_idx"], 3).where("score >= 2").select("doc_id", "session_key", "event_idx", "item_idx", "score")


def reason_sentences(spark: SparkSession, root: str) -> DataFrame:
    return prompts(spark, root).select("session_key", "event_idx", kw.reason_sentence(F.col("prompt")).alias("reason"))


def backticks(spark: SparkSession, root: str) -> DataFrame:
    return _docs(spark, root).select("doc_id", F.posexplode(kw.backticked(F.col("text"))).alias("place", "token"))


def formats(spark: SparkSession, root: str) -> DataFrame:
    r = table(spark, root, "agent_return")
    return r.select(
        "return_row", fmt.short_count(F.col("subagent_tokens")).alias("tokens"), fmt.duration(F.floor(F.col("duration_ms") / 1000)).alias("took"), fmt.when(F.col("ts")).alias("minute"), fmt.preview(F.col("result_text"), 140).alias("preview"),
        fmt.slug(F.col("summary")).alias("slug"), fmt.same_text(F.col("summary")).alias("same"),
    )


def path_parts(spark: SparkSession, root: str) -> DataFrame:
    h = table(spark, root, "hook_record").where("path is not null")
    return h.select("hook_row", fmt.normal_path(F.col("path")).alias("path"), fmt.base_name(F.col("path")).alias("name"), fmt.file_slug(F.col("path")).alias("slug"))


def rule_findings(spark: SparkSession, root: str) -> DataFrame:
    return rules.findings(calls(spark, root), rules.load_checks({"checks": CHECKS})[0])


def rule_states(spark: SparkSession, root: str) -> DataFrame:
    c = calls(spark, root)
    used = rules.written_files(c).select("session_key").union(rules.shell_commands(c).select("session_key"))
    return rules.states(rule_findings(spark, root), c.select("session_key").distinct(), used)


def written_files(spark: SparkSession, root: str) -> DataFrame:
    return rules.written_files(calls(spark, root)).select("session_key", "path", F.length("text").alias("chars"))


_ALL = (markdown_blocks, block_ids, block_cost_share, md_references, resolved_references, shingle_counts, near_copies, similar_pairs, keyword_lists, topical_topk, reason_sentences, backticks, formats, path_parts, rule_findings, rule_states, written_files)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_LINES = r"""WITH l AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS n, unnest(s) AS line FROM (SELECT doc_id, string_split_regex(text, '\r\n|\n|\r') AS s FROM documents WHERE text IS NOT NULL)),
f AS (SELECT *, regexp_matches(line, '^[\t\n\x0B\f\r ]*(```|~~~)') AS fence FROM l), g AS (SELECT *, fence OR sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY n) % 2 = 1 AS inside FROM f),
h AS (SELECT *, NOT inside AND regexp_matches(line, '^(#{1,2})[\t\n\x0B\f\r ]+(.*?)[\t\n\x0B\f\r ]*$') AS head FROM g), b AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY n) - 1 AS block_idx FROM h),
blocks AS (SELECT doc_id, CAST(block_idx AS INT) AS block_idx, regexp_extract(arg_min(line, n), '^(#{1,2})[\t\n\x0B\f\r ]+(.*?)[\t\n\x0B\f\r ]*$', 2) AS title, length(regexp_extract(arg_min(line, n), '^(#{1,2})', 1)) AS level, min(n) AS start_line, max(n) AS end_line FROM b WHERE block_idx >= 0 GROUP BY 1, 2)
"""
_STOPS = ", ".join(f"'{w}'" for w in similarity.STOP)
_SHINGLES = rf"""WITH n AS (SELECT doc_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), '`[^`]+`', ' ', 'g'), 'https?://\S+', ' ', 'g'), '\s+', ' ', 'g'))) AS t FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, list_filter(regexp_extract_all(t, '[a-z][a-z0-9-]{{2,}}'), lambda x: x NOT IN ({_STOPS})) AS w FROM n),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) ELSE [] END AS s FROM w)
"""
_CALLS = "WITH c AS (SELECT * FROM tool_call QUALIFY row_number() OVER (PARTITION BY session_key, event_idx, item_idx ORDER BY arrived_at, call_row) = 1)"
_SLUG = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_FOUND = r"SELECT DISTINCT doc_id, ref FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '([^\pL\pN_./-])', '\1\1', 'g'), '(?:^|[^\pL\pN_])([A-Za-z0-9_][\w./-]*\.md)(?:[^\pL\pN_]|$)', 1)) AS ref FROM documents)"
ORACLES: dict[str, str] = {
    "md_references": _FOUND,
    "resolved_references": f"WITH r AS ({_FOUND}), t AS (SELECT doc_id, ref, unnest([{{'r': -1, 'p': ref}}, {{'r': 0, 'p': 'docs/' || ref}}, {{'r': 1, 'p': 'lib/' || ref}}, {{'r': 2, 'p': 'src/' || ref}}]) AS t FROM r) SELECT doc_id, ref, arg_min(t.p, t.r) AS path FROM t WHERE t.p IN (SELECT path FROM documents WHERE path IS NOT NULL) GROUP BY 1, 2",
    "block_ids": _LINES + f""", body AS (SELECT b.doc_id, b.block_idx, {strip("coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE n > start_line), '')")} AS content FROM b JOIN blocks k ON k.doc_id = b.doc_id AND k.block_idx = b.block_idx GROUP BY 1, 2)
SELECT k.doc_id, k.block_idx, coalesce(right({_SLUG.format('path')}, 40), 'doc' || k.doc_id) || '-' || k.block_idx || '-' || coalesce(nullif({_SLUG.format('title')}, ''), 'block') AS id,
  left(sha256(lower(trim(regexp_replace(title, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) || chr(0) || lower(trim(regexp_replace(content, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))), 16) AS rule_key FROM blocks k JOIN body d ON d.doc_id = k.doc_id AND d.block_idx = k.block_idx JOIN documents o ON o.doc_id = k.doc_id""",
    "markdown_blocks": _LINES + f""", body AS (SELECT b.doc_id, b.block_idx, {strip("coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE n > start_line), '')")} AS content FROM b JOIN blocks k ON k.doc_id = b.doc_id AND k.block_idx = b.block_idx GROUP BY 1, 2)
SELECT k.doc_id, k.block_idx, title, level, start_line, end_line, length(content) AS chars,
  CASE WHEN contains(lower(title), 'rules') AND contains(lower(title), 'global') THEN 'overview' WHEN contains(lower(title), 'skill') OR contains(lower(content), 'trigger:') OR regexp_matches(content, '`/[a-z]+`') THEN 'skill'
    WHEN regexp_matches(content, '(?i)\\brule:\\b') OR regexp_matches(lower(content), 'always|never|must') THEN 'rule' WHEN contains(lower(content), 'see ') OR contains(content, '@') OR contains(content, '.md)') THEN 'reference' ELSE 'instruction' END AS kind
FROM blocks k JOIN body d ON d.doc_id = k.doc_id AND d.block_idx = k.block_idx""",
    "block_cost_share": _LINES + """, x AS (SELECT doc_id, block_idx, CAST(end_line - start_line + 1 AS DOUBLE) AS lines, n_chars AS cost FROM blocks JOIN documents USING (doc_id)), e AS (SELECT *, cost * lines / sum(lines) OVER (PARTITION BY doc_id) AS exact FROM x),
z AS (SELECT *, floor(exact) AS fl, cost - sum(floor(exact)) OVER (PARTITION BY doc_id) AS rest, row_number() OVER (PARTITION BY doc_id ORDER BY exact - floor(exact) DESC, block_idx) AS place FROM e)
SELECT doc_id, block_idx, CAST(fl + CASE WHEN place <= rest THEN 1 ELSE 0 END AS BIGINT) AS tokens FROM z""",
    "near_copies": _SHINGLES + """, c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS class_id FROM n), r AS (SELECT doc_id AS d, len(s) AS n, unnest(s) AS h FROM s WHERE doc_id IN (SELECT class_id FROM c)),
p AS (SELECT a.d AS a, b.d AS b FROM r a JOIN r b ON a.h = b.h AND a.d < b.d GROUP BY a.d, b.d HAVING count(*) / least(any_value(a.n), any_value(b.n)) >= 0.8),
k AS (SELECT d, count(*) AS links FROM (SELECT a AS d FROM p UNION ALL SELECT b FROM p) GROUP BY 1)
SELECT c.doc_id, class_id, coalesce(links, 0) AS links FROM c LEFT JOIN k ON k.d = c.class_id""",
    "similar_pairs": _SHINGLES + """, c AS (SELECT DISTINCT min(doc_id) OVER (PARTITION BY t) AS d FROM n), r AS (SELECT doc_id AS d, len(s) AS n, unnest(s) AS h FROM s WHERE doc_id IN (SELECT d FROM c)),
p AS (SELECT a.d AS doc_a, b.d AS doc_b, count(*) AS shared, any_value(a.n) AS n, arg_min(a.h, (-length(a.h), a.h)) AS phrase FROM r a JOIN r b ON a.h = b.h AND (a.n < b.n OR a.n = b.n AND a.d < b.d) GROUP BY 1, 2)
SELECT doc_a, doc_b, shared, round(shared / n, 3) AS similarity, phrase FROM p WHERE shared / n >= 0.8""",
    "shingle_counts": _SHINGLES.replace("len(w) >= 5", "len(w) >= 3").replace("len(w) - 3", "len(w) - 1").replace("i + 4", "i + 2") + "SELECT doc_id, len(s) AS shingles FROM s",
    "backticks": r"SELECT doc_id, unnest(range(len(t))) AS place, unnest(t) AS token FROM (SELECT doc_id, regexp_extract_all(text, '`([^`\n]+)`', 1) AS t FROM documents)",
    "formats": f"""SELECT return_row, CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) WHEN n < 10000 THEN printf('%.1fk', n / 1e3) WHEN n < 1000000 THEN printf('%.0fk', n / 1e3) ELSE printf('%.1fM', n / 1e6) END AS tokens,
  CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN printf('%dm%02ds', s // 60, s % 60) ELSE printf('%dh%02dm', s // 3600, s % 3600 // 60) END AS took, replace(left(ts, 16), 'T', ' ') AS minute,
  CASE WHEN length(result_text) > 140 THEN left(result_text, 140) || '…' ELSE result_text END AS preview, {_SLUG.format("summary")} AS slug, lower(trim(regexp_replace(summary, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS same
FROM (SELECT *, subagent_tokens AS n, duration_ms // 1000 AS s FROM agent_return)""",
    "path_parts": f"SELECT hook_row, regexp_replace(regexp_replace(path, '/+', '/', 'g'), '(.)/$', '\\1') AS path, string_split(path, '/')[-1] AS name, right({_SLUG.format('path')}, 40) AS slug FROM hook_record WHERE path IS NOT NULL",
    "written_files": _CALLS + """, e AS (SELECT session_key, input->>'$.file_path' AS path, event_idx, item_idx, coalesce(CASE WHEN name = 'MultiEdit' THEN array_to_string(list_transform(CAST(input->'$.edits' AS JSON[]), lambda e: e->>'$.new_string'), chr(10)) END, input->>'$.new_string', input->>'$.content') AS text
  FROM c WHERE name IN ('Edit', 'Write', 'MultiEdit') AND json_valid(input)) SELECT session_key, path, length(string_agg(text, chr(10) ORDER BY event_idx, item_idx)) AS chars FROM e WHERE path IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2""",
}
