"""Queries over session transcripts: events, items, prompts, turns, usage and allocation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesseral.functions.messages import NOTIFICATION_FIELDS, result_text
from tesseral.functions.text import iso_micros
from tesseral.functions.variant import text_at
from tesseral.operators import allocate, sessions
from tesseral.operators.blocks import numbered
from tesseral.plans.common import EVENTS, NAMES, TURNS, USAGE, strip
from tesseral.session import cut, table
from tesseral.sources import transcripts as tr

#: Characters a tool result is clipped to in a segment.
CLIP = 600


def events(spark: SparkSession, root: str, *keep: str) -> DataFrame:
    return tr.events(table(spark, root, "transcript_event"), keep)


def compactions(spark: SparkSession, root: str) -> DataFrame:
    log = tr.hook_facts(table(spark, root, "hook_record"))[1]
    return log.where("session_id is not null").select(F.col("session_id").alias("session_key"), iso_micros(F.col("ts")).alias("us"))


def turned(spark: SparkSession, root: str) -> DataFrame:
    """Events with their turn. Turns are found on a narrow table of places and prompts; the events meet them by their own key."""
    ev = events(spark, root)
    narrow = cut(tr.prompts(ev).select("session_key", "event_idx", "us", "prompt"))
    return ev.join(sessions.split_turns(narrow, compactions(spark, root)).drop("us"), ["session_key", "event_idx"])


def _series(ev: DataFrame, *carry: str) -> DataFrame:
    return sessions.usage_series(ev.where(F.schema_of_variant("usage").startswith("OBJECT")), "session_key", "event_idx", "request_id", "usage", carry)


def items(ev: DataFrame) -> DataFrame:
    return ev.select("session_key", "event_idx", "type", "ts", F.posexplode("items").alias("item_idx", "i")).select("session_key", "event_idx", "type", "ts", "item_idx", "i.*")


def events_parsed(spark: SparkSession, root: str) -> DataFrame:
    return tr.prompts(events(spark, root)).select("session_key", "event_idx", "type", "us", F.coalesce("is_meta", F.lit(False)).alias("is_meta"), "request_id", "user_text", F.size("items").alias("n_items"))


def tool_calls(spark: SparkSession, root: str) -> DataFrame:
    return items(events(spark, root)).where("kind = 'tool_use'").select("session_key", "event_idx", "item_idx", "ts", "name", "id")


def assistant_segments(spark: SparkSession, root: str) -> DataFrame:
    ev = events(spark, root).where("type = 'assistant'")
    listed = items(ev).where("kind = 'text' and text is not null").select("session_key", "event_idx", "item_idx", "ts", "text")
    plain = ev.select("session_key", "event_idx", F.lit(0).alias("item_idx"), "ts", text_at(F.col("v"), "content").alias("text")).where("text is not null")
    return listed.unionByName(plain)


def segments(spark: SparkSession, root: str) -> DataFrame:
    """Every item that shows, in order: texts, calls, clipped results and thinking."""
    ev = events(spark, root)
    x = items(ev)
    body = F.when(F.col("kind") == "tool_result", result_text(F.col("content"))).otherwise(F.col("text"))
    shown = x.where("kind in ('text', 'tool_use', 'tool_result', 'thinking') and type in ('user', 'assistant')").withColumn("body", F.coalesce(body, F.lit("")))
    plain = ev.where("type = 'user'").select("session_key", "event_idx", "type", "ts", F.lit(0).alias("item_idx"), F.lit("text").alias("kind"), text_at(F.col("v"), "content").alias("body")).where("body is not null")
    both = shown.select("session_key", "event_idx", "type", "item_idx", "kind", "body", "name", "id", "tool_use_id").unionByName(plain.drop("ts"), allowMissingColumns=True)
    # In a user's list the words come before the results.
    late = F.when((F.col("type") == "user") & (F.col("kind") == "tool_result"), 1).otherwise(0)
    both = numbered(both.withColumn("_late", late), ["session_key"], ["event_idx", "_late", "item_idx"], "seg_idx")
    lines = F.when(F.col("body") == "", 0).otherwise(F.length("body") - F.length(F.replace("body", F.lit("\n"))) + 1)
    return both.select("session_key", "seg_idx", "event_idx", F.col("type").alias("role"), "kind", F.when(F.col("kind") == "tool_result", F.substring("body", 1, CLIP)).otherwise(F.col("body")).alias("text"), F.length("body").alias("full_text_len"), lines.alias("line_count"), "name", "id", "tool_use_id")


def prompts(spark: SparkSession, root: str) -> DataFrame:
    return tr.prompts(events(spark, root)).where("prompt is not null").select("session_key", "event_idx", "prompt")


def prompt_counts(spark: SparkSession, root: str) -> DataFrame:
    p = tr.prompts(events(spark, root))
    return p.groupBy("session_key").agg(F.count("prompt").alias("prompts"), F.min_by("prompt", F.when(F.col("prompt").isNotNull(), F.col("event_idx"))).alias("first_prompt"))


def task_notifications(spark: SparkSession, root: str) -> DataFrame:
    from tesseral.functions.messages import notification

    return tr.prompts(events(spark, root)).select("session_key", "event_idx", notification(F.col("user_text")).alias("n")).where("n is not null").select("session_key", "event_idx", "n.*")


def turn_split(spark: SparkSession, root: str) -> DataFrame:
    t = turned(spark, root).withColumnRenamed("turn_prompt", "turn_carry")
    return sessions.turns(t, "session_key", "event_idx")


def event_to_turn(spark: SparkSession, root: str) -> DataFrame:
    return turned(spark, root).select("session_key", "event_idx", "turn_idx", "after_compaction")


def usage_series(spark: SparkSession, root: str) -> DataFrame:
    return _series(events(spark, root))


def usage_session_totals(spark: SparkSession, root: str) -> DataFrame:
    return sessions.usage_totals(_series(events(spark, root)), ["session_key"])


def turn_usage_totals(spark: SparkSession, root: str) -> DataFrame:
    return sessions.usage_totals(_series(turned(spark, root), "turn_idx"), ["session_key", "turn_idx"])


def usage_session_and_turn(spark: SparkSession, root: str) -> DataFrame:
    """Both grains in one pass."""
    s = _series(turned(spark, root), "turn_idx").where("turn_idx is not null")
    return s.groupingSets([["session_key"], ["session_key", "turn_idx"]], "session_key", "turn_idx").agg(F.grouping("turn_idx").cast("int").alias("is_session"), F.count("*").alias("requests"), F.sum("input").alias("input"), F.sum("output").alias("output"))


def cache_breaks(spark: SparkSession, root: str) -> DataFrame:
    return sessions.cache_breaks(_series(events(spark, root)), "session_key", "event_idx")


def history_chars(spark: SparkSession, root: str) -> DataFrame:
    """For each request the characters of the messages before it."""
    ev = events(spark, root)
    sized = sessions.prefix_sum(table_rows(spark, root).select("session_key", "event_idx", F.coalesce(F.length("message"), F.lit(0)).alias("chars")), ["session_key"], ["event_idx"], "chars", "history_chars")
    return _series(ev).select("session_key", "event_idx").join(sized, ["session_key", "event_idx"]).select("session_key", "event_idx", "chars", "history_chars")


def table_rows(spark: SparkSession, root: str) -> DataFrame:
    return tr.first_copies(table(spark, root, "transcript_event"), ["session_key", "event_idx"], ["arrived_at", "line_id"])


def first_event_at_or_after(spark: SparkSession, root: str) -> DataFrame:
    c = compactions(spark, root).where("us is not null").distinct().withColumn("mark", F.col("us"))
    return sessions.first_at_or_after(events(spark, root), c, "session_key", "event_idx", "us", "mark")


def session_summary(spark: SparkSession, root: str) -> DataFrame:
    ev = tr.prompts(events(spark, root, "session_id", "git_branch", "cwd", "version"))
    firsts = {c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("event_idx"))).alias(c) for c in ("session_id", "git_branch", "cwd", "version")}
    us = lambda f: f("us", F.when(F.col("us").isNotNull(), F.col("event_idx")))
    a = ev.groupBy("session_key").agg(
        F.count("*").alias("events"), F.count("prompt").alias("user_messages"), F.count_if(F.col("type") == "assistant").alias("assistant_messages"), F.sum(F.size(F.filter("items", lambda i: i["kind"] == "tool_use"))).alias("tool_calls"),
        us(F.min_by).alias("start_us"), us(F.max_by).alias("end_us"), *firsts.values(),
    )
    return a.select("session_key", F.coalesce("session_id", "session_key").alias("id"), "events", "user_messages", "assistant_messages", "tool_calls", F.expr("greatest(0, (end_us - start_us) div 1000000)").alias("duration_sec"), "git_branch", "cwd", "version")


def tool_counts(spark: SparkSession, root: str) -> DataFrame:
    """Calls a tool in the order of the most common, ties by first appearance."""
    calls = tr.first_copies(table(spark, root, "tool_call"), ["session_key", "event_idx", "item_idx"], ["arrived_at", "call_row"])
    c = calls.groupBy("session_key", "name").agg(F.count("*").alias("calls"), F.min(F.struct("event_idx", "item_idx")).alias("_at"))
    w = Window.partitionBy("session_key").orderBy(F.desc("calls"), "_at")
    return c.select("session_key", "name", "calls", F.row_number().over(w).alias("place"))


def tool_mix_top3(spark: SparkSession, root: str) -> DataFrame:
    t = tool_counts(spark, root).where("place <= 3")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "name", "calls"))), lambda x: F.concat_ws(" ", x["calls"].cast("string"), x["name"]))
    return t.groupBy("session_key").agg(F.array_join(parts, ", ").alias("mix"))


def file_activity(spark: SparkSession, root: str) -> DataFrame:
    calls = tr.first_copies(table(spark, root, "tool_call"), ["session_key", "event_idx", "item_idx"], ["arrived_at", "call_row"])
    path = F.get_json_object("input", "$.file_path")
    c = calls.where("name in ('Read', 'Edit', 'Write', 'MultiEdit')").select("session_key", "name", path.alias("path")).where("path is not null")
    return c.groupBy("session_key", "path").agg(F.count_if(F.col("name") == "Read").alias("reads"), F.count_if(F.col("name") != "Read").alias("edits"))


def latest_instructions(spark: SparkSession, root: str) -> DataFrame:
    loads = tr.hook_facts(table(spark, root, "hook_record"))[0].where("session_id is not null and path is not null")
    return tr.latest_by(loads.select("session_id", "path", "hook_row", "load_reason", "memory_type"), ["session_id", "path"], ["hook_row"])


def attachments(spark: SparkSession, root: str) -> DataFrame:
    return tr.attachments(events(spark, root, "attachment")).select("session_key", "event_idx", "kind", "path", "count", "drift", F.length("content").alias("chars"))


def listed_names(spark: SparkSession, root: str) -> DataFrame:
    a = tr.attachments(events(spark, root, "attachment")).where("kind = 'skill_listing'")
    return a.select("session_key", "event_idx", F.posexplode(tr.listed_names(F.col("content"))).alias("place", "name"))


def allocate_largest_remainder(spark: SparkSession, root: str) -> DataFrame:
    """Each order's total in cents over its lines by quantity."""
    o = table(spark, root, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    line = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return allocate.largest_remainder(line.join(o, "l_orderkey"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "l_quantity", "cents", "share").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "share")


def attribute_with_history(spark: SparkSession, root: str) -> DataFrame:
    """Each request's prompt tokens over the items of its own event and the history before; an item without a text weighs 20 characters."""
    t = events(spark, root)
    s = _series(t).withColumn("total", F.col("input") + F.col("cache_read") + F.col("cache_creation")).select("session_key", "event_idx", "total")
    h = history_chars(spark, root).select("session_key", "event_idx", "history_chars")
    req = s.join(h, ["session_key", "event_idx"])
    parts = items(t).where("kind in ('text', 'thinking', 'tool_use')").select("session_key", "event_idx", "item_idx", F.coalesce(F.length("text"), F.lit(20)).cast("bigint").alias("chars"))
    out = allocate.with_history(parts.join(req.select("session_key", "event_idx"), ["session_key", "event_idx"], "left_semi"), req, ["session_key", "event_idx"], ["item_idx"], "chars", "total", "history_chars")
    return out.select("session_key", "event_idx", "item_idx", "is_history", "tokens")


def cost_by_turn(spark: SparkSession, root: str) -> DataFrame:
    """Attributed tokens a turn, of items and of history; together exactly the turn's prompt tokens."""
    t = turned(spark, root).select("session_key", "event_idx", "turn_idx")
    a = attribute_with_history(spark, root).join(t, ["session_key", "event_idx"])
    return a.groupBy("session_key", "turn_idx").agg(F.sum(F.when(F.col("is_history"), F.col("tokens")).otherwise(0)).alias("history"), F.sum(F.when(F.col("is_history"), 0).otherwise(F.col("tokens"))).alias("own"))


_ALL = (events_parsed, tool_calls, assistant_segments, segments, prompts, prompt_counts, task_notifications, turn_split, event_to_turn, usage_series, usage_session_totals, turn_usage_totals, usage_session_and_turn, cache_breaks, history_chars, first_event_at_or_after, session_summary, tool_counts, tool_mix_top3, file_activity, latest_instructions, attachments, listed_names, allocate_largest_remainder, attribute_with_history, cost_by_turn)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_TAG = "regexp_extract(t, '(?s)<{0}>(.*?)</{0}>', 1)"
_SUMS = ", ".join(f"sum({n}) AS {n}" for n in NAMES)
_CALLS = "WITH c AS (SELECT * FROM tool_call QUALIFY row_number() OVER (PARTITION BY session_key, event_idx, item_idx ORDER BY arrived_at, call_row) = 1)"
_HISTORY = ", hist AS (SELECT session_key, event_idx, coalesce(length(message), 0) AS chars, coalesce(sum(coalesce(length(message), 0)) OVER (PARTITION BY session_key ORDER BY event_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS history_chars FROM ev)"
_ATTRIBUTE = TURNS + _HISTORY + """
, req AS (SELECT s.session_key, s.event_idx, input + cache_read + cache_creation AS total, history_chars FROM series s JOIN hist h ON h.session_key = s.session_key AND h.event_idx = s.event_idx)
, w AS (
  SELECT i.session_key, i.event_idx, i.item_idx, 0 AS h, CAST(coalesce(length(CASE WHEN json_type(i, '$.text') = 'VARCHAR' THEN i->>'$.text' END), 20) AS DOUBLE) AS weight, total FROM item i JOIN req r ON r.session_key = i.session_key AND r.event_idx = i.event_idx WHERE kind IN ('text', 'thinking', 'tool_use')
  UNION ALL SELECT session_key, event_idx, NULL, 1, history_chars, total FROM req
), x AS (
  SELECT *, CASE WHEN sum(weight) OVER g > 0 AND total > 0 THEN CAST(total AS DOUBLE) * weight / sum(weight) OVER g ELSE 0 END AS exact FROM w WINDOW g AS (PARTITION BY session_key, event_idx)
), y AS (
  SELECT *, floor(exact) AS fl, CASE WHEN sum(exact) OVER g > 0 THEN total - sum(floor(exact)) OVER g ELSE 0 END AS rest, row_number() OVER (PARTITION BY session_key, event_idx ORDER BY exact - floor(exact) DESC, h, item_idx) AS place FROM x WINDOW g AS (PARTITION BY session_key, event_idx)
), z AS (
  SELECT *, CAST(fl + CASE WHEN place <= rest THEN 1 ELSE 0 END AS BIGINT) AS part FROM y
), attributed AS (
  SELECT session_key, event_idx, item_idx, h = 1 AS is_history, CASE WHEN h = 1 AND sum(part) OVER (PARTITION BY session_key, event_idx) = 0 THEN greatest(total, 0) ELSE part END AS tokens FROM z
)
"""
ORACLES: dict[str, str] = {
    "events_parsed": EVENTS + "SELECT session_key, event_idx, type, us, is_meta, request_id, user_text, len(items) AS n_items FROM ut",
    "tool_calls": EVENTS + "SELECT session_key, event_idx, item_idx, ts, i->>'$.name' AS name, i->>'$.id' AS id FROM item WHERE kind = 'tool_use'",
    "assistant_segments": EVENTS + "SELECT session_key, event_idx, item_idx, ts, i->>'$.text' AS text FROM item WHERE type = 'assistant' AND kind = 'text' AND json_type(i, '$.text') = 'VARCHAR' UNION ALL SELECT session_key, event_idx, 0, ts, line FROM parts WHERE type = 'assistant' AND line IS NOT NULL",
    "segments": EVENTS + f""", sg AS (
  SELECT session_key, event_idx, type, item_idx, kind, CASE WHEN kind = 'tool_result' THEN coalesce(CASE WHEN json_type(i, '$.content') = 'VARCHAR' THEN i->>'$.content' WHEN json_type(i, '$.content') = 'ARRAY' THEN array_to_string(list_transform(CAST(i->'$.content' AS JSON[]), lambda x: coalesce(CASE WHEN json_type(x, '$.text') = 'VARCHAR' THEN x->>'$.text' END, '')), chr(10)) END, '')
    ELSE coalesce(CASE WHEN json_type(i, '$.text') = 'VARCHAR' THEN i->>'$.text' END, '') END AS body, i->>'$.name' AS name, i->>'$.id' AS id, i->>'$.tool_use_id' AS tool_use_id
  FROM item WHERE kind IN ('text', 'tool_use', 'tool_result', 'thinking') AND type IN ('user', 'assistant')
  UNION ALL SELECT session_key, event_idx, type, 0, 'text', line, NULL, NULL, NULL FROM parts WHERE type = 'user' AND line IS NOT NULL)
SELECT session_key, row_number() OVER (PARTITION BY session_key ORDER BY event_idx, CASE WHEN type = 'user' AND kind = 'tool_result' THEN 1 ELSE 0 END, item_idx) - 1 AS seg_idx, event_idx, type AS role, kind, CASE WHEN kind = 'tool_result' THEN left(body, {CLIP}) ELSE body END AS text, length(body) AS full_text_len,
  CASE WHEN body = '' THEN 0 ELSE length(body) - length(replace(body, chr(10), '')) + 1 END AS line_count, name, id, tool_use_id FROM sg""",
    "prompts": EVENTS + "SELECT session_key, event_idx, prompt FROM pr WHERE prompt IS NOT NULL",
    "prompt_counts": EVENTS + "SELECT session_key, count(prompt) AS prompts, arg_min(prompt, event_idx) FILTER (WHERE prompt IS NOT NULL) AS first_prompt FROM pr GROUP BY 1",
    "task_notifications": EVENTS + ", n AS (SELECT session_key, event_idx, user_text AS t FROM ut WHERE starts_with(" + strip("user_text") + ", '<task-notification>')) SELECT session_key, event_idx, "
    + ", ".join(f"nullif({strip(_TAG.format(t))}, '') AS {t.replace('-', '_')}" for t in NOTIFICATION_FIELDS[:5]) + ", " + ", ".join(f"try_cast(nullif({strip(_TAG.format(t))}, '') AS BIGINT) AS {t}" for t in NOTIFICATION_FIELDS[5:]) + " FROM n",
    "turn_split": TURNS + "SELECT session_key, turn_idx, min(event_idx) AS start_event, max(event_idx) + 1 AS end_event, arg_min(turn_prompt, event_idx) AS prompt FROM turned WHERE turn_idx IS NOT NULL GROUP BY 1, 2",
    "event_to_turn": TURNS + "SELECT session_key, event_idx, turn_idx, compacted AND NOT first_row AS after_compaction FROM turned",
    "usage_series": USAGE + "SELECT * FROM series",
    "usage_session_totals": USAGE + f"SELECT session_key, count(*) AS requests, {_SUMS}, sum(input + cache_read + cache_creation) AS prompt_tokens FROM series GROUP BY 1",
    "turn_usage_totals": TURNS + f"SELECT s.session_key, turn_idx, count(*) AS requests, {_SUMS}, sum(input + cache_read + cache_creation) AS prompt_tokens FROM series s JOIN turned t ON t.session_key = s.session_key AND t.event_idx = s.event_idx GROUP BY 1, 2",
    "usage_session_and_turn": TURNS + "SELECT s.session_key, turn_idx, CAST(grouping(turn_idx) AS INT) AS is_session, count(*) AS requests, sum(input) AS input, sum(output) AS output FROM series s JOIN turned t ON t.session_key = s.session_key AND t.event_idx = s.event_idx WHERE turn_idx IS NOT NULL GROUP BY GROUPING SETS ((s.session_key), (s.session_key, turn_idx))",
    "cache_breaks": USAGE + ", l AS (SELECT *, lag(cache_read) OVER (PARTITION BY session_key ORDER BY event_idx) AS prior_cache_read FROM series) SELECT session_key, event_idx, prior_cache_read, cache_read, cache_creation FROM l WHERE prior_cache_read >= 5000 AND cache_read <= 0.2 * prior_cache_read AND cache_creation >= 0.5 * prior_cache_read",
    "history_chars": USAGE + _HISTORY + " SELECT h.* FROM hist h JOIN series s ON s.session_key = h.session_key AND s.event_idx = h.event_idx",
    "first_event_at_or_after": TURNS + "SELECT c.session_key, c.t AS mark, min(e.event_idx) AS event_idx FROM (SELECT * FROM comp WHERE t IS NOT NULL) c LEFT JOIN ev e ON e.session_key = c.session_key AND e.us >= c.t GROUP BY 1, 2",
    "session_summary": EVENTS + """, a AS (SELECT session_key, count(*) AS events, count(prompt) AS user_messages, count(*) FILTER (WHERE type = 'assistant') AS assistant_messages,
  sum(len(list_filter(items, lambda i: i->>'$.type' = 'tool_use'))) AS tool_calls, arg_min(us, event_idx) FILTER (WHERE us IS NOT NULL) AS s, arg_max(us, event_idx) FILTER (WHERE us IS NOT NULL) AS e,
  arg_min(session_id, event_idx) FILTER (WHERE session_id IS NOT NULL) AS session_id, arg_min(git_branch, event_idx) FILTER (WHERE git_branch IS NOT NULL) AS git_branch, arg_min(cwd, event_idx) FILTER (WHERE cwd IS NOT NULL) AS cwd, arg_min(version, event_idx) FILTER (WHERE version IS NOT NULL) AS version FROM pr GROUP BY 1)
SELECT session_key, coalesce(session_id, session_key) AS id, events, user_messages, assistant_messages, CAST(tool_calls AS BIGINT) AS tool_calls, CAST(greatest(0, trunc((e - s) / 1000000)) AS BIGINT) AS duration_sec, git_branch, cwd, version FROM a""",
    "tool_counts": _CALLS + ", n AS (SELECT session_key, name, count(*) AS calls, min((event_idx, item_idx)) AS f FROM c GROUP BY 1, 2) SELECT session_key, name, calls, row_number() OVER (PARTITION BY session_key ORDER BY calls DESC, f) AS place FROM n",
    "tool_mix_top3": _CALLS + ", n AS (SELECT session_key, name, count(*) AS calls, min((event_idx, item_idx)) AS f FROM c GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY calls DESC, f) AS place FROM n) SELECT session_key, string_agg(calls || ' ' || name, ', ' ORDER BY place) AS mix FROM r WHERE place <= 3 GROUP BY 1",
    "file_activity": _CALLS + " SELECT session_key, input->>'$.file_path' AS path, count(*) FILTER (WHERE name = 'Read') AS reads, count(*) FILTER (WHERE name <> 'Read') AS edits FROM c WHERE name IN ('Read', 'Edit', 'Write', 'MultiEdit') AND json_valid(input) AND input->>'$.file_path' IS NOT NULL GROUP BY 1, 2",
    "latest_instructions": "SELECT session_id, path, max(hook_row) AS hook_row, arg_max(load_reason, hook_row) AS load_reason, any_value(memory_type) AS memory_type FROM (SELECT *, row_number() OVER (PARTITION BY session_id, path ORDER BY hook_row DESC) AS n FROM hook_record WHERE event = 'InstructionsLoaded' AND coalesce(agent_id, '') = '' AND session_id IS NOT NULL AND path IS NOT NULL) WHERE n = 1 GROUP BY 1, 2",
    "allocate_largest_remainder": """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
e AS (SELECT *, CAST(cents AS DOUBLE) * CAST(l_quantity AS DOUBLE) / sum(CAST(l_quantity AS DOUBLE)) OVER (PARTITION BY l_orderkey) AS exact FROM x),
f AS (SELECT *, floor(exact) AS fl, cents - sum(floor(exact)) OVER (PARTITION BY l_orderkey) AS rest, row_number() OVER (PARTITION BY l_orderkey ORDER BY exact - floor(exact) DESC, l_linenumber, l_partkey, l_suppkey, l_quantity) AS place FROM e)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(fl + CASE WHEN place <= rest THEN 1 ELSE 0 END AS BIGINT) AS share FROM f""",
    "attribute_with_history": _ATTRIBUTE + "SELECT * FROM attributed",
    "cost_by_turn": _ATTRIBUTE + "SELECT a.session_key, turn_idx, CAST(sum(CASE WHEN is_history THEN tokens ELSE 0 END) AS BIGINT) AS history, CAST(sum(CASE WHEN is_history THEN 0 ELSE tokens END) AS BIGINT) AS own FROM attributed a JOIN turned t ON t.session_key = a.session_key AND t.event_idx = a.event_idx GROUP BY 1, 2",
    "attachments": """WITH ev AS (SELECT * FROM transcript_event QUALIFY row_number() OVER (PARTITION BY session_key, event_idx ORDER BY arrived_at, line_id) = 1), a AS (SELECT session_key, event_idx, CAST(attachment AS JSON) AS a FROM ev WHERE json_valid(attachment) AND json_type(attachment) = 'OBJECT')
SELECT session_key, event_idx, a->>'$.type' AS kind, coalesce(a->>'$.content.path', a->>'$.content.file.filePath') AS path, CAST(a->>'$.skillCount' AS BIGINT) AS count, CAST(a->>'$.content.contentDiffersFromDisk' AS BOOLEAN) AS drift, length(coalesce(a->>'$.content.file.content', a->>'$.content.content', a->>'$.content')) AS chars FROM a""",
    "listed_names": r"""WITH ev AS (SELECT * FROM transcript_event QUALIFY row_number() OVER (PARTITION BY session_key, event_idx ORDER BY arrived_at, line_id) = 1), a AS (SELECT session_key, event_idx, CAST(attachment AS JSON) AS a FROM ev WHERE json_valid(attachment) AND json_type(attachment) = 'OBJECT'),
n AS (SELECT session_key, event_idx, list_filter(list_transform(string_split(a->>'$.content', chr(10)), lambda x: regexp_extract(trim(x), '^-\s+([A-Za-z0-9][\w:.-]*?)(?::\s+.*)?$', 1)), lambda x: x <> '') AS l FROM a WHERE a->>'$.type' = 'skill_listing')
SELECT session_key, event_idx, unnest(range(len(l))) AS place, unnest(l) AS name FROM n""",
}
