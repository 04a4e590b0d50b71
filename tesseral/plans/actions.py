"""Queries over what sessions did: actions, traces, and what stood before a read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesseral.functions import format as fmt
from tesseral.functions import keywords as kw
from tesseral.functions.messages import wrapper_name
from tesseral.operators.blocks import numbered
from tesseral.plans.common import EVENTS, TURNS, micros, strip
from tesseral.plans.flows import DETAILS, calls
from tesseral.plans.sessions import assistant_segments, events, items, listed_names, turned
from tesseral.session import table
from tesseral.sources import transcripts as tr

#: Characters of an action's detail and of a turn's preview, texts looked back at for a reason, and characters that make a narration.
DETAIL, PREVIEW, LOOK_BACK, NARRATION = 120, 140, 6, 20
EDITS = ("Edit", "Write", "MultiEdit", "NotebookEdit")


def _detail(of: Column) -> Column:
    return F.substring(F.coalesce(*(F.get_json_object(of, f"$.{k}") for k in DETAILS), F.lit("")), 1, DETAIL)


def _actions(spark: SparkSession, root: str) -> DataFrame:
    return calls(spark, root).select("session_key", "event_idx", "item_idx", "name", _detail(F.col("input")).alias("detail"))


def session_actions(spark: SparkSession, root: str) -> DataFrame:
    """Each session's tool uses as steps."""
    return numbered(_actions(spark, root), ["session_key"], ["event_idx", "item_idx"], "step").select("session_key", "step", "name", "detail")


def turn_actions(spark: SparkSession, root: str) -> DataFrame:
    """Each turn's tool uses as steps; a session without turns is one list, with a null turn."""
    t = turned(spark, root).select("session_key", "event_idx", "turn_idx")
    w = Window.partitionBy("session_key", "turn_idx").orderBy("event_idx", "item_idx")
    return _actions(spark, root).join(t, ["session_key", "event_idx"], "left").withColumn("step", (F.row_number().over(w) - 1).cast("bigint")).select("session_key", "turn_idx", "step", "name", "detail")


def session_trace(spark: SparkSession, root: str) -> DataFrame:
    """What a session comes to: commands, edits, texts, the last text, where it ran, commands typed."""
    c = calls(spark, root).groupBy("session_key").agg(F.count_if(F.col("name") == "Bash").alias("commands"), F.count_if(F.col("name").isin(*EDITS)).alias("edits"), F.count_if(F.col("name") == "Read").alias("reads"))
    t = assistant_segments(spark, root).groupBy("session_key").agg(F.count("*").alias("texts"), F.max(F.struct("event_idx", "item_idx", "text"))["text"].alias("last_text"))
    e = tr.prompts(events(spark, root, "cwd"))
    s = e.groupBy("session_key").agg(F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("event_idx"))).alias("cwd"), F.count_if(wrapper_name(F.col("user_text")) != "").alias("wrappers"))
    zero = lambda k: F.coalesce(k, F.lit(0)).alias(k)
    return s.join(c, "session_key", "left").join(t, "session_key", "left").select("session_key", "cwd", "wrappers", zero("commands"), zero("edits"), zero("reads"), zero("texts"), "last_text")


def session_counts(spark: SparkSession, root: str) -> DataFrame:
    """Events by speaker and distinct files read and edited."""
    e = tr.prompts(events(spark, root)).groupBy("session_key").agg(F.count("*").alias("events"), F.count("prompt").alias("user_messages"), F.count_if(F.col("type") == "assistant").alias("assistant_messages"))
    path = F.get_json_object("input", "$.file_path")
    c = calls(spark, root).groupBy("session_key").agg(F.count_distinct(F.when(F.col("name") == "Read", path)).alias("files_read"), F.count_distinct(F.when(F.col("name").isin(*EDITS), path)).alias("files_edited"))
    return e.join(c, "session_key", "left").select(*e.columns, F.coalesce("files_read", F.lit(0)).alias("files_read"), F.coalesce("files_edited", F.lit(0)).alias("files_edited"))


def turn_briefs(spark: SparkSession, root: str) -> DataFrame:
    """A line a turn: the beginning of its prompt, its events and calls."""
    t = turned(spark, root).where("turn_idx is not null")
    uses = F.size(F.filter("items", lambda i: i["kind"] == "tool_use"))
    g = t.groupBy("session_key", "turn_idx").agg(F.min_by("turn_prompt", "event_idx").alias("prompt"), F.count("*").alias("events"), F.sum(uses).alias("calls"))
    return g.select("session_key", "turn_idx", fmt.preview(F.col("prompt"), PREVIEW).alias("preview"), "events", "calls")


def session_starts(spark: SparkSession, root: str) -> DataFrame:
    """The first readable time of each session, in the order of its events."""
    return events(spark, root).groupBy("session_key").agg(F.min_by("us", F.when(F.col("us").isNotNull(), F.col("event_idx"))).alias("start_us"))


def used_names(spark: SparkSession, root: str) -> DataFrame:
    """The distinct agent types, skills and typed commands of each session; names in lower case but for types."""
    bare = lambda c: F.lower(F.regexp_replace(c, "^/+", ""))
    c = calls(spark, root)
    j = lambda k: F.get_json_object("input", f"$.{k}")
    agents = c.where("name = 'Agent'").select("session_key", F.lit("agent").alias("kind"), j("subagent_type").alias("name"))
    skills = c.where("name = 'Skill'").select("session_key", F.lit("skill").alias("kind"), bare(j("skill")).alias("name"))
    typed = tr.prompts(events(spark, root)).select("session_key", F.lit("command").alias("kind"), bare(wrapper_name(F.col("user_text"))).alias("name"))
    return agents.unionByName(skills).unionByName(typed).where("name <> ''").distinct()


def loaded_names(spark: SparkSession, root: str) -> DataFrame:
    """The names a session was offered, and whether it used them: by a call, as a typed command, or by ``/name`` in a prompt."""
    offered = listed_names(spark, root).select("session_key", F.lower("name").alias("name")).distinct()
    called = used_names(spark, root).where("kind <> 'agent'").select("session_key", "name")
    # A mention ends where no name goes on; a dot may end it or be part of it, so each beginning up to a dot counts.
    text = tr.prompts(events(spark, root)).where("prompt is not null").select("session_key", F.explode(F.regexp_extract_all(F.lower("prompt"), F.lit(r"(?<![\w./:-])/([\w:.-]+)"), F.lit(1))).alias("m"))
    parts = F.split("m", r"\.")
    begins = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    said = text.select("session_key", F.explode(begins).alias("name"))
    hit = called.unionByName(said).distinct().withColumn("loaded", F.lit(True))
    return offered.join(hit, ["session_key", "name"], "left").select("session_key", "name", F.coalesce("loaded", F.lit(False)).alias("loaded"))


def _told(spark: SparkSession, root: str) -> DataFrame:
    """Prompts, assistant texts, thinking and reads in one order: (session_key, event_idx, item_idx, us, what, text)."""
    ev = tr.prompts(events(spark, root))
    said = ev.where("prompt is not null").select("session_key", "event_idx", F.lit(-1).alias("item_idx"), "us", F.lit("prompt").alias("what"), F.lit(None).cast("string").alias("text"))
    parts = ev.select("session_key", "event_idx", "type", "us", F.posexplode("items").alias("item_idx", "i")).select("session_key", "event_idx", "type", "us", "item_idx", "i.kind", "i.text", "i.name")
    what = F.when((F.col("kind") == "text") & (F.col("type") == "assistant") & F.col("text").isNotNull(), "text").when(F.col("kind") == "thinking", "thinking").when((F.col("kind") == "tool_use") & (F.col("name") == "Read"), "read")
    return said.unionByName(parts.withColumn("what", what).where("what is not null").select("session_key", "event_idx", "item_idx", "us", "what", F.when(F.col("what") == "text", F.col("text")).alias("text")))


def intent_before(spark: SparkSession, root: str) -> DataFrame:
    """For each read the nearest of the six assistant texts before it that gives a reason."""
    w = Window.partitionBy("session_key").orderBy("event_idx", "item_idx").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(F.when(F.col("what") == "text", 1).otherwise(0)).over(w)
    x = _told(spark, root).select("session_key", "event_idx", "item_idx", "what", F.coalesce(F.col("text").rlike(kw.CAUSAL), F.lit(False)).alias("reason")).withColumn("n", n)
    last = F.last(F.when(F.col("reason"), F.struct("n", F.col("event_idx").alias("event"), F.col("item_idx").alias("item"))), ignorenulls=True).over(w)
    near = F.col("n") - F.col("l.n") < LOOK_BACK
    return x.withColumn("l", last).where("what = 'read'").select("session_key", "event_idx", "item_idx", F.when(near, F.col("l.event")).alias("intent_event"), F.when(near, F.col("l.item")).alias("intent_item"))


def before_reads(spark: SparkSession, root: str) -> DataFrame:
    """For each read the prompt it follows, the last narration since, and the silent thinking since if nothing much was said."""
    w = Window.partitionBy("session_key").orderBy("event_idx", "item_idx").rowsBetween(Window.unboundedPreceding, 0)
    x = _told(spark, root).withColumn("p", F.sum(F.when(F.col("what") == "prompt", 1).otherwise(0)).over(w)).withColumn("prompt_event", F.last(F.when(F.col("what") == "prompt", F.col("event_idx")), ignorenulls=True).over(w))
    since = Window.partitionBy("session_key", "p").orderBy("event_idx", "item_idx").rowsBetween(Window.unboundedPreceding, 0)
    thinks = F.col("what") == "thinking"
    x = x.withColumns({
        "said": F.last(F.when(F.col("what") == "text", F.struct("event_idx", F.length(F.trim("text")).alias("chars"))), ignorenulls=True).over(since),
        "thoughts": F.sum(F.when(thinks, 1).otherwise(0)).over(since), "begun": F.first(F.when(thinks, F.struct("us")), ignorenulls=True).over(since),
    })
    silent = (F.col("thoughts") > 0) & (F.coalesce(F.col("said.chars"), F.lit(0)) < NARRATION)
    return x.where("what = 'read'").select(
        "session_key", "event_idx", "item_idx", "prompt_event", F.col("said.event_idx").alias("narration_event"), F.when(silent, F.col("thoughts")).otherwise(0).alias("silent_thoughts"),
        F.when(silent, F.greatest(F.lit(0), F.expr("(us - begun.us) div 1000000"))).alias("silent_seconds"),
    )


_ALL = (session_actions, turn_actions, session_trace, session_counts, turn_briefs, session_starts, used_names, loaded_names, intent_before, before_reads)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

CALLS = ", c AS (SELECT * FROM tool_call QUALIFY row_number() OVER (PARTITION BY session_key, event_idx, item_idx ORDER BY arrived_at, call_row) = 1)"
_DETAIL = "left(coalesce(" + ", ".join(f"input->>'$.{k}'" for k in DETAILS) + f", ''), {DETAIL})"
_EDITS = ", ".join(f"'{e}'" for e in EDITS)
_WRAPPED = r"coalesce(regexp_extract(user_text, '(?s)<command-name>(.*?)</command-name>', 1), '')"
_LISTED = r""", la AS (SELECT session_key, CAST(attachment AS JSON) AS a FROM ev WHERE json_valid(attachment) AND json_type(attachment) = 'OBJECT'),
ln AS (SELECT DISTINCT session_key, lower(n) AS name FROM (SELECT session_key, unnest(list_filter(list_transform(string_split(a->>'$.content', chr(10)), lambda x: regexp_extract(trim(x), '^-\s+([A-Za-z0-9][\w:.-]*?)(?::\s+.*)?$', 1)), lambda x: x <> '')) AS n FROM la WHERE a->>'$.type' = 'skill_listing'))"""
_USED = rf""", un AS (SELECT session_key, 'agent' AS kind, input->>'$.subagent_type' AS name FROM c WHERE name = 'Agent'
  UNION SELECT session_key, 'skill', lower(regexp_replace(input->>'$.skill', '^/+', '')) FROM c WHERE name = 'Skill'
  UNION SELECT session_key, 'command', lower(regexp_replace({strip(_WRAPPED)}, '^/+', '')) FROM pr)"""
_TOLD = """, told AS (
  SELECT session_key, event_idx, -1 AS item_idx, us, 'prompt' AS what, NULL AS text FROM pr WHERE prompt IS NOT NULL
  UNION ALL SELECT * FROM (SELECT i.session_key, i.event_idx, item_idx, us, CASE WHEN kind = 'text' AND i.type = 'assistant' AND json_type(i, '$.text') = 'VARCHAR' THEN 'text' WHEN kind = 'thinking' THEN 'thinking' WHEN kind = 'tool_use' AND i->>'$.name' = 'Read' THEN 'read' END AS what,
    i->>'$.text' AS text FROM item i JOIN (SELECT session_key, event_idx, us FROM ev) e ON e.session_key = i.session_key AND e.event_idx = i.event_idx) WHERE what IS NOT NULL)"""
_CAUSAL = kw.CAUSAL.replace("'", "''")
ORACLES: dict[str, str] = {
    "session_actions": "WITH " + CALLS[2:] + f" SELECT session_key, row_number() OVER (PARTITION BY session_key ORDER BY event_idx, item_idx) - 1 AS step, name, {_DETAIL} AS detail FROM c",
    "turn_actions": TURNS + CALLS + f" SELECT c.session_key, turn_idx, row_number() OVER (PARTITION BY c.session_key, turn_idx ORDER BY c.event_idx, c.item_idx) - 1 AS step, name, {_DETAIL} AS detail FROM c LEFT JOIN turned t ON t.session_key = c.session_key AND t.event_idx = c.event_idx",
    "session_trace": EVENTS + CALLS + f""", tx AS (SELECT session_key, event_idx, item_idx, i->>'$.text' AS text FROM item WHERE type = 'assistant' AND kind = 'text' AND json_type(i, '$.text') = 'VARCHAR' UNION ALL SELECT session_key, event_idx, 0, line FROM parts WHERE type = 'assistant' AND line IS NOT NULL),
n AS (SELECT session_key, count(*) FILTER (WHERE name = 'Bash') AS commands, count(*) FILTER (WHERE name IN ({_EDITS})) AS edits, count(*) FILTER (WHERE name = 'Read') AS reads FROM c GROUP BY 1), t AS (SELECT session_key, count(*) AS texts, arg_max(text, (event_idx, item_idx)) AS last_text FROM tx GROUP BY 1),
s AS (SELECT session_key, arg_min(cwd, event_idx) FILTER (WHERE cwd IS NOT NULL) AS cwd, count(*) FILTER (WHERE {_WRAPPED} <> '') AS wrappers FROM pr GROUP BY 1)
SELECT s.session_key, cwd, wrappers, coalesce(commands, 0) AS commands, coalesce(edits, 0) AS edits, coalesce(reads, 0) AS reads, coalesce(texts, 0) AS texts, last_text FROM s LEFT JOIN n ON n.session_key = s.session_key LEFT JOIN t ON t.session_key = s.session_key""",
    "session_counts": EVENTS + CALLS + f""", n AS (SELECT session_key, count(DISTINCT CASE WHEN name = 'Read' THEN input->>'$.file_path' END) AS files_read, count(DISTINCT CASE WHEN name IN ({_EDITS}) THEN input->>'$.file_path' END) AS files_edited FROM c GROUP BY 1),
s AS (SELECT session_key, count(*) AS events, count(prompt) AS user_messages, count(*) FILTER (WHERE type = 'assistant') AS assistant_messages FROM pr GROUP BY 1)
SELECT s.*, coalesce(files_read, 0) AS files_read, coalesce(files_edited, 0) AS files_edited FROM s LEFT JOIN n ON n.session_key = s.session_key""",
    "turn_briefs": TURNS + f"""SELECT session_key, turn_idx, CASE WHEN length(p) > {PREVIEW} THEN left(p, {PREVIEW}) || '…' ELSE p END AS preview, events, calls FROM (SELECT session_key, turn_idx, arg_min(turn_prompt, event_idx) AS p, count(*) AS events,
  CAST(sum(len(list_filter(items, lambda i: i->>'$.type' = 'tool_use'))) AS BIGINT) AS calls FROM turned WHERE turn_idx IS NOT NULL GROUP BY 1, 2)""",
    "session_starts": f"SELECT session_key, arg_min(us, event_idx) FILTER (WHERE us IS NOT NULL) AS start_us FROM (SELECT session_key, event_idx, {micros('ts')} AS us FROM transcript_event QUALIFY row_number() OVER (PARTITION BY session_key, event_idx ORDER BY arrived_at, line_id) = 1) GROUP BY 1",
    "used_names": EVENTS + CALLS + _USED + " SELECT * FROM un WHERE name <> ''",
    "loaded_names": EVENTS + CALLS + _USED + _LISTED + r""" SELECT n.session_key, n.name, EXISTS (SELECT 1 FROM un WHERE kind <> 'agent' AND un.session_key = n.session_key AND un.name = n.name)
  OR EXISTS (SELECT 1 FROM pr p WHERE p.session_key = n.session_key AND regexp_matches(lower(p.prompt), '(^|[^\w./:-])/' || regexp_escape(n.name) || '($|[^\w:-])')) AS loaded FROM ln n""",
    "intent_before": EVENTS + _TOLD + f""", x AS (SELECT session_key, event_idx, item_idx, what, coalesce(regexp_matches(text, '{_CAUSAL}'), false) AS reason, sum(CASE WHEN what = 'text' THEN 1 ELSE 0 END) OVER (PARTITION BY session_key ORDER BY event_idx, item_idx ROWS UNBOUNDED PRECEDING) AS n FROM told),
r AS (SELECT a.session_key, a.event_idx, a.item_idx, (SELECT max((b.event_idx, b.item_idx)) FROM x b WHERE b.session_key = a.session_key AND b.reason AND (b.event_idx, b.item_idx) < (a.event_idx, a.item_idx) AND b.n > a.n - {LOOK_BACK}) AS l FROM x a WHERE what = 'read')
SELECT session_key, event_idx, item_idx, l[1] AS intent_event, l[2] AS intent_item FROM r""",
    "before_reads": EVENTS + _TOLD + f""", r AS (SELECT *, (SELECT max(b.event_idx) FROM told b WHERE b.session_key = a.session_key AND b.what = 'prompt' AND (b.event_idx, b.item_idx) < (a.event_idx, a.item_idx)) AS prompt_event FROM told a WHERE what = 'read'),
z AS (SELECT r.*, list(t ORDER BY t.event_idx, t.item_idx) FILTER (WHERE t.what = 'text') AS texts, list(t ORDER BY t.event_idx, t.item_idx) FILTER (WHERE t.what = 'thinking') AS thoughts FROM r LEFT JOIN told t ON t.session_key = r.session_key AND (t.event_idx, t.item_idx) < (r.event_idx, r.item_idx) AND t.event_idx >= coalesce(r.prompt_event, -1) GROUP BY ALL),
y AS (SELECT *, coalesce(len(thoughts), 0) > 0 AND coalesce(length(trim(texts[-1].text)), 0) < {NARRATION} AS silent FROM z)
SELECT session_key, event_idx, item_idx, prompt_event, texts[-1].event_idx AS narration_event, CASE WHEN silent THEN len(thoughts) ELSE 0 END AS silent_thoughts, CASE WHEN silent THEN greatest(0, CAST(trunc((us - thoughts[1].us) / 1000000) AS BIGINT)) END AS silent_seconds FROM y""",
}
