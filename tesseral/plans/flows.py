"""Queries over intervals, residency, subagents, timelines and comparisons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesseral.functions.text import iso_micros
from tesseral.functions.messages import AGENT_TOOLS, result_text
from tesseral.operators import agents, compare, intervals, sessions
from tesseral.operators.blocks import numbered
from tesseral.plans.common import TURNS, micros
from tesseral.plans.sessions import compactions, events, turned
from tesseral.session import table
from tesseral.sources import transcripts as tr

# Fixed value: lines a read without limit delivers.
READ_CAP = 2000
#: Statuses of subagents from the one that shows to the one that hides.
STATUS_RANKS = ["failed", "killed", "cancelled", "running", "completed"]
#: The place of what stands after all events.
END = (1 << 63) - 1
#: Characters of a timeline row by kind.
CLIPS = {"user": 300, "tool-result": 200, "assistant-text": 400, "tool-use": 160}
#: Inputs that tell what a call is about, the first one it has.
DETAILS = ("file_path", "command", "pattern", "description", "glob")


def calls(spark: SparkSession, root: str) -> DataFrame:
    return tr.first_copies(table(spark, root, "tool_call"), ["session_key", "event_idx", "item_idx"], ["arrived_at", "call_row"])


def read_ranges(spark: SparkSession, root: str) -> DataFrame:
    """(session_key, path, s, e): the lines each read delivered."""
    j = lambda k: F.get_json_object("input", f"$.{k}")
    r = calls(spark, root).where("name = 'Read'").select("session_key", j("file_path").alias("path"), F.coalesce(j("offset").try_cast("bigint"), F.lit(1)).alias("s"), F.coalesce(j("limit").try_cast("bigint"), F.lit(READ_CAP)).alias("n"))
    return r.where("path is not null").select("session_key", "path", "s", (F.col("s") + F.col("n") - 1).alias("e"))


def merged_ranges(spark: SparkSession, root: str) -> DataFrame:
    return intervals.merge_intervals(read_ranges(spark, root), ["session_key", "path"], "s", "e")


def range_gaps(spark: SparkSession, root: str) -> DataFrame:
    return intervals.gaps(merged_ranges(spark, root), ["session_key", "path"], "s", "e")


def undelivered_points(spark: SparkSession, root: str) -> DataFrame:
    """Lines asked about (here: made from the calls' places) that no read delivered, with their neighbours."""
    p = calls(spark, root).where("name = 'Edit'").select("session_key", F.get_json_object("input", "$.file_path").alias("path"), "call_row", (F.col("event_idx") * 37 % 2600 + 1).alias("line")).where("path is not null")
    return intervals.uncovered(p, merged_ranges(spark, root), ["session_key", "path"], "line", "s", "e")


def instruction_changes(spark: SparkSession, root: str) -> DataFrame:
    loads, comp = tr.hook_facts(table(spark, root, "hook_record"))
    us = iso_micros(F.col("ts")).alias("us")
    a = loads.where("path is not null").select(F.col("session_id").alias("session_key"), F.col("path").alias("key"), us, F.col("load_reason").alias("reason"))
    b = comp.select(F.col("session_id").alias("session_key"), F.lit(None).cast("string").alias("key"), us, F.lit(None).cast("string").alias("reason"))
    return a.unionByName(b).where("session_key is not null and us is not null")


def residency_asof(spark: SparkSession, root: str) -> DataFrame:
    t = turned(spark, root).where("turn_idx is not null and us is not null").groupBy("session_key", "turn_idx").agg(F.min("us").alias("us")).withColumnRenamed("turn_idx", "probe")
    return intervals.residency(instruction_changes(spark, root), t, "session_key", "key", "us")


def spawns(spark: SparkSession, root: str) -> DataFrame:
    c = calls(spark, root).where(F.col("name").isin(*AGENT_TOOLS))
    return c.select("session_key", "event_idx", F.col("id").alias("spawn"), iso_micros(F.col("ts")).alias("spawn_us"), F.get_json_object("input", "$.description").alias("description"), F.get_json_object("input", "$.subagent_type").alias("subagent_type"))


def reports(spark: SparkSession, root: str) -> DataFrame:
    r = table(spark, root, "agent_return")
    return r.select("session_key", "return_row", "task_id", "tool_use_id", "status", "summary", "subagent_tokens", "tool_uses", "duration_ms", iso_micros(F.col("ts")).alias("return_us"))


def spawn_return_pairs(spark: SparkSession, root: str) -> DataFrame:
    p = agents.pair_by_id(spawns(spark, root), reports(spark, root).withColumnRenamed("status", "report_status"), "session_key", "spawn", "tool_use_id")
    return p.select("session_key", "event_idx", "spawn", "status", "return_row", "report_status", "subagent_tokens", "duration_ms")


def open_spawns(spark: SparkSession, root: str) -> DataFrame:
    r = reports(spark, root).select("session_key", F.col("tool_use_id").alias("spawn"))
    return spawns(spark, root).join(r, ["session_key", "spawn"], "left_anti").select("session_key", "event_idx", "spawn", "subagent_type")


def placed_reports(spark: SparkSession, root: str) -> DataFrame:
    """Reports with ``place``: the first event at or after their time; those without a readable time, or after all events, stand at the end."""
    r = reports(spark, root)
    marks = r.where("session_key is not null and return_us is not null").select("session_key", F.col("return_us").alias("us"), F.col("return_row").alias("mark"))
    hit = sessions.first_at_or_after(events(spark, root).select("session_key", "event_idx", "us"), marks, "session_key", "event_idx", "us", "mark")
    return r.join(hit.select("session_key", F.col("mark").alias("return_row"), F.col("event_idx").alias("_p")), ["session_key", "return_row"], "left").withColumn("place", F.coalesce("_p", F.lit(END))).drop("_p")


def spawn_return_by_name(spark: SparkSession, root: str) -> DataFrame:
    s = spawns(spark, root).select(F.col("session_key").alias("session"), F.col("event_idx").alias("at"), "spawn", F.col("description").alias("name"))
    known = calls(spark, root).select(F.col("session_key").alias("session"), F.col("id").alias("ref"), F.lit(True).alias("_c")).where("ref is not null").distinct()
    r = placed_reports(spark, root).select(F.col("session_key").alias("session"), F.col("place").alias("at"), F.col("return_row").cast("string").alias("report"), F.col("tool_use_id").alias("ref"), F.col("summary").alias("name"))
    r = r.join(known, ["session", "ref"], "left").withColumn("foreign", F.col("_c").isNotNull()).drop("_c")
    return agents.pair_with_names(s, r)


def agent_steps(spark: SparkSession, root: str) -> DataFrame:
    """Openings and, where an agent ever reports, its closing at the last report, by their place among the events.

    An agent without an id, or one whose only reports stand before it, is open; of equal ids the first counts.
    """
    last = placed_reports(spark, root).where("tool_use_id is not null").groupBy("session_key", F.col("tool_use_id").alias("spawn")).agg(F.max("place").alias("place"))
    first = spawns(spark, root).groupBy("session_key", F.coalesce("spawn", F.concat(F.lit("#"), F.col("event_idx").cast("string"))).alias("spawn")).agg(F.min("event_idx").alias("place"))
    opens = first.select("session_key", "place", F.lit(0).alias("k"), "spawn", F.lit(True).alias("opens"))
    closes = last.join(first.select("session_key", "spawn", F.col("place").alias("from_place")), ["session_key", "spawn"]).where("place >= from_place").select("session_key", "place", F.lit(1).alias("k"), "spawn", F.lit(False).alias("opens"))
    return opens.unionByName(closes)


def lane_assignment(spark: SparkSession, root: str) -> DataFrame:
    return agents.lanes(agent_steps(spark, root), "session_key", ["place", "k", "spawn"], "spawn", "opens")


def agents_in_flight(spark: SparkSession, root: str) -> DataFrame:
    return agents.in_flight(agent_steps(spark, root), "session_key", ["place", "k", "spawn"], "opens").select("session_key", "place", "spawn", "opens", "in_flight")


def fanout_groups(spark: SparkSession, root: str) -> DataFrame:
    """Runs of consecutive spawns that all report before the next turn."""
    steps = agent_steps(spark, root).select("session_key", "place", F.when(F.col("opens"), 1).otherwise(2).alias("k"), F.when(F.col("opens"), "spawn").otherwise("return").alias("kind"), F.col("spawn").alias("ref"))
    t = tr.prompts(events(spark, root)).where("prompt is not null").select("session_key", F.col("event_idx").alias("place"), F.lit(0).alias("k"), F.lit("turn").alias("kind"), F.col("event_idx").cast("string").alias("ref"))
    return agents.fan_outs(t.unionByName(steps), "session_key", ["place", "k", "ref"], "kind", "ref")


def agent_group_totals(spark: SparkSession, root: str) -> DataFrame:
    """Of each session's subagents by type: how many, tokens and the slowest."""
    p = spawns(spark, root).join(reports(spark, root).groupBy("session_key", F.col("tool_use_id").alias("spawn")).agg(F.sum("subagent_tokens").alias("tokens"), F.max("duration_ms").alias("ms")), ["session_key", "spawn"], "left")
    return p.groupBy("session_key", "subagent_type").agg(F.count("*").alias("agents"), F.sum("tokens").alias("tokens"), F.max("ms").alias("slowest_ms"))


def timeline_rows(spark: SparkSession, root: str) -> DataFrame:
    """Texts, calls and results as rows of a timeline, clipped by kind; a call's detail is the first of its telling inputs."""
    ev = tr.prompts(events(spark, root))
    said = ev.where("prompt is not null").select("session_key", "event_idx", F.lit(-1).alias("item_idx"), F.lit("user").alias("kind"), F.lit("prompt").alias("label"), F.col("prompt").alias("text"), F.lit("").alias("detail"))
    i = ev.select("session_key", "event_idx", "type", F.posexplode("items").alias("item_idx", "i")).select("session_key", "event_idx", "type", "item_idx", "i.*")
    kinds = F.when((F.col("kind") == "text") & (F.col("type") == "assistant"), "assistant-text").when(F.col("kind") == "tool_use", "tool-use").when(F.col("kind") == "tool_result", "tool-result")
    detail = F.coalesce(*(F.when(F.col("kind") == "tool_use", F.try_variant_get("input", f"$.{k}", "string")) for k in DETAILS), F.lit(""))
    text = F.when(F.col("kind") == "tool_result", result_text(F.col("content"))).otherwise(F.coalesce("text", "id", F.lit("")))
    rows = i.select("session_key", "event_idx", "item_idx", kinds.alias("kind"), F.coalesce("name", F.lit("")).alias("label"), text.alias("text"), F.substring(detail, 1, CLIPS["tool-use"]).alias("detail")).where("kind is not null")
    clip = F.col("text")
    for k, n in CLIPS.items():
        clip = F.when(F.col("kind") == k, F.substring("text", 1, n)).otherwise(clip)
    return numbered(said.unionByName(rows).withColumn("text", clip), ["session_key"], ["event_idx", "item_idx"], "place").select("session_key", "place", "event_idx", "item_idx", "kind", "label", "text", "detail")


def timeline_markers(spark: SparkSession, root: str) -> DataFrame:
    """Events with the compactions spliced in at their time."""
    rows = events(spark, root).select("session_key", "event_idx", "us", F.lit("event").alias("kind"))
    m = table(spark, root, "hook_record").where("event in ('PreCompact', 'PostCompact') and session_id is not null").select(F.col("session_id").alias("session_key"), F.col("hook_row").alias("mark"), iso_micros(F.col("ts")).alias("us"), F.lit("compaction").alias("kind"))
    out = intervals.insert_markers(rows, m, "session_key", "event_idx", "us")
    return out.select("session_key", "place", "kind", "event_idx", "mark", "us")


def context_first_wins(spark: SparkSession, root: str) -> DataFrame:
    """The files a session knew, from attachments, loads and reads, each once by the source of highest priority."""
    a = tr.attachments(events(spark, root, "attachment")).where("path is not null and kind = 'nested_memory'").select("session_key", "path", F.col("event_idx").alias("seq"), F.lit("attachment").alias("source"))
    h = table(spark, root, "hook_record").where("event = 'InstructionsLoaded' and path is not null and session_id is not null").select(F.col("session_id").alias("session_key"), "path", F.col("hook_row").alias("seq"), F.lit("load").alias("source"))
    r = calls(spark, root).where("name = 'Read'").select("session_key", F.get_json_object("input", "$.file_path").alias("path"), F.col("call_row").alias("seq"), F.lit("read").alias("source")).where("path is not null")
    return compare.union_first_wins([a, h, r], ["session_key", "path"]).select("session_key", "path", "priority", "seq", "source")


def _loads(spark: SparkSession, root: str) -> DataFrame:
    h = table(spark, root, "hook_record").where("event = 'InstructionsLoaded' and path is not null and session_id is not null")
    return h.select("session_id", "path", "hook_row", F.get_json_object("stats", "$.size_bytes").try_cast("bigint").alias("size_bytes"))


def instruction_diff(spark: SparkSession, root: str) -> DataFrame:
    """Paths whose size differs between a project's two memory types, or that only one has."""
    h = table(spark, root, "hook_record").where("event = 'InstructionsLoaded' and path is not null")
    size = h.select("path", "memory_type", F.get_json_object("stats", "$.size_bytes").try_cast("bigint").alias("size_bytes"))
    side = lambda m: size.where(F.col("memory_type") == m).groupBy("path").agg(F.max("size_bytes").alias("size_bytes"))
    return compare.block_diff(side("Project"), side("User"), ["path"], "size_bytes")


def path_presence(spark: SparkSession, root: str) -> DataFrame:
    h = table(spark, root, "hook_record").where("path is not null")
    return compare.presence(h.where("coalesce(agent_id, '') = ''"), h.where("coalesce(agent_id, '') <> ''"), ["path"])


def session_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Each session with the next of its branch."""
    s = events(spark, root, "git_branch").groupBy("session_key").agg(F.min_by("git_branch", F.when(F.col("git_branch").isNotNull(), F.col("event_idx"))).alias("git_branch"))
    return s.withColumn("other", F.lead("session_key").over(Window.partitionBy("git_branch").orderBy("session_key"))).where("other is not null and git_branch is not null").select("session_key", "other")


def _sides(spark: SparkSession, root: str, rows: DataFrame) -> DataFrame:
    """Rows of sessions as the sides of their pairs; the pair is named by its first session."""
    p = session_pairs(spark, root)
    a = rows.join(p.select("session_key", F.col("session_key").alias("pair")), "session_key").withColumn("side", F.lit("a"))
    b = rows.join(p.select(F.col("other").alias("session_key"), F.col("session_key").alias("pair")), "session_key").withColumn("side", F.lit("b"))
    return a.unionByName(b)


def tool_delta(spark: SparkSession, root: str) -> DataFrame:
    n = calls(spark, root).groupBy("session_key", "name").agg(F.count("*").alias("n"))
    return compare.deltas(_sides(spark, root, n), ["pair", "name"], "side", "n")


def turn_pairs(spark: SparkSession, root: str) -> DataFrame:
    t = turned(spark, root).where("turn_idx is not null").groupBy("session_key", "turn_idx").agg(F.min_by("turn_prompt", "event_idx").alias("prompt"), F.count("*").alias("events"))
    s = _sides(spark, root, t)
    out = compare.pair_by_ordinal(s.where("side = 'a'"), s.where("side = 'b'"), ["pair", "turn_idx"], ["prompt", "events"])
    return out.select("pair", "turn_idx", F.col("prompt_a").eqNullSafe(F.col("prompt_b")).alias("same_prompt"), "events_a", "events_b")


def align_steps(spark: SparkSession, root: str) -> DataFrame:
    steps = calls(spark, root).select("session_key", F.struct("event_idx", "item_idx").alias("o"), "name")
    w = Window.partitionBy("session_key").orderBy("o")
    ordered = steps.select("session_key", F.row_number().over(w).alias("n"), F.coalesce("name", F.lit("")).alias("name"))
    return compare.align(_sides(spark, root, ordered), "pair", "side", "n", "name")


def task_status(spark: SparkSession, root: str) -> DataFrame:
    return compare.fold_status(table(spark, root, "agent_return").where("task_id is not null"), ["task_id"], "status", STATUS_RANKS, "unknown")


def status_histogram(spark: SparkSession, root: str) -> DataFrame:
    r = table(spark, root, "agent_return").groupBy("session_key").agg(*(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUS_RANKS), F.count("*").alias("reports"))
    return r.withColumn("summary", F.when(F.col("n_failed") > 0, "failed").when(F.col("n_completed") == F.col("reports"), "all completed").otherwise("mixed"))


def longest_results_topk(spark: SparkSession, root: str) -> DataFrame:
    """The five longest results of each session."""
    r = tr.first_copies(table(spark, root, "result_segment"), ["session_key", "event_idx", "item_idx"], ["arrived_at", "result_row"])
    return compare.top_k(r.where("full_text_len is not null").select("session_key", "result_row", "full_text_len"), ["session_key"], [F.desc("full_text_len"), "result_row"], 5)


def call_results(spark: SparkSession, root: str) -> DataFrame:
    """Calls with their result, the last one if there are several."""
    r = tr.first_copies(table(spark, root, "result_segment"), ["session_key", "event_idx", "item_idx"], ["arrived_at", "result_row"]).where("tool_use_id is not null")
    last = tr.latest_by(r.select("session_key", F.col("tool_use_id").alias("id"), "event_idx", "item_idx", "full_text_len", "line_count"), ["session_key", "id"], ["event_idx", "item_idx"])
    c = calls(spark, root).select("session_key", F.col("event_idx").alias("call_event"), F.col("item_idx").alias("call_item"), "name", "id")
    return c.join(last.select("session_key", "id", F.col("event_idx").alias("result_event"), "full_text_len", "line_count"), ["session_key", "id"], "left")


_ALL = (merged_ranges, range_gaps, undelivered_points, residency_asof, spawn_return_pairs, open_spawns, spawn_return_by_name, lane_assignment, agents_in_flight, fanout_groups, agent_group_totals, timeline_rows, timeline_markers, context_first_wins, instruction_diff, path_presence, tool_delta, turn_pairs, align_steps, task_status, status_histogram, longest_results_topk, call_results)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_CALLS = "WITH c AS (SELECT * FROM tool_call QUALIFY row_number() OVER (PARTITION BY session_key, event_idx, item_idx ORDER BY arrived_at, call_row) = 1)"
_RANGES = _CALLS + f""", r AS (
  SELECT session_key, input->>'$.file_path' AS path, coalesce(try_cast(input->>'$.offset' AS BIGINT), 1) AS s, coalesce(try_cast(input->>'$.limit' AS BIGINT), {READ_CAP}) AS n FROM c WHERE name = 'Read' AND json_valid(input) AND input->>'$.file_path' IS NOT NULL
), rr AS (SELECT session_key, path, s, s + n - 1 AS e FROM r WHERE n >= 1), g AS (
  SELECT *, CASE WHEN max(e) OVER w IS NULL OR s > max(e) OVER w + 1 THEN 1 ELSE 0 END AS fresh FROM rr WINDOW w AS (PARTITION BY session_key, path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), k AS (SELECT *, sum(fresh) OVER (PARTITION BY session_key, path ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM g), merged AS (SELECT session_key, path, min(s) AS s, max(e) AS e FROM k GROUP BY session_key, path, island)
"""
_AGENTS = _CALLS + f""", aev AS (SELECT session_key, event_idx, {micros("ts")} AS us FROM transcript_event QUALIFY row_number() OVER (PARTITION BY session_key, event_idx ORDER BY arrived_at, line_id) = 1),
sp AS (SELECT session_key, event_idx, id AS spawn, {micros("ts")} AS spawn_us, input->>'$.subagent_type' AS subagent_type FROM c WHERE name IN ('Agent', 'Task', 'Workflow')),
rp AS (SELECT *, {micros("ts")} AS return_us FROM agent_return),
pl AS (SELECT r.*, coalesce((SELECT min(e.event_idx) FROM aev e WHERE e.session_key = r.session_key AND e.us >= r.return_us), {END}) AS place FROM rp r),
fi AS (SELECT session_key, coalesce(spawn, '#' || event_idx) AS spawn, min(event_idx) AS place FROM sp GROUP BY 1, 2),
la AS (SELECT session_key, tool_use_id AS spawn, max(place) AS place FROM pl WHERE tool_use_id IS NOT NULL GROUP BY 1, 2),
steps AS (SELECT session_key, place, 0 AS k, spawn, true AS opens FROM fi UNION ALL SELECT l.session_key, l.place, 1, l.spawn, false FROM la l JOIN fi f ON f.session_key = l.session_key AND f.spawn = l.spawn WHERE l.place >= f.place)
"""
_PAIRS = TURNS + """, br AS (SELECT session_key, arg_min(git_branch, event_idx) FILTER (WHERE git_branch IS NOT NULL) AS git_branch FROM ev GROUP BY 1),
p AS (SELECT * FROM (SELECT session_key, lead(session_key) OVER (PARTITION BY git_branch ORDER BY session_key) AS other FROM br WHERE git_branch IS NOT NULL) WHERE other IS NOT NULL)
"""
OCCUPANCY = _AGENTS.replace("WITH c AS", "WITH RECURSIVE c AS", 1) + """, ord AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY place, k, spawn) AS n FROM steps),
lane AS (
  SELECT session_key, 0 AS n, CAST([] AS STRUCT(a VARCHAR, l BIGINT)[]) AS used, CAST(NULL AS VARCHAR) AS spawn, CAST(NULL AS BOOLEAN) AS opens, CAST(NULL AS BIGINT) AS lane, CAST(NULL AS VARCHAR) AS through FROM ord GROUP BY 1
  UNION ALL
  SELECT o.session_key, o.n, CASE WHEN o.opens THEN list_append(p.used, {'a': o.spawn, 'l': f}) ELSE list_filter(p.used, lambda u: u.a <> o.spawn) END, o.spawn, o.opens, CASE WHEN o.opens THEN f ELSE list_filter(p.used, lambda u: u.a = o.spawn)[1].l END,
    array_to_string(list_sort(list_transform(list_filter(p.used, lambda u: u.a <> o.spawn), lambda u: u.l)), ',')
  FROM (SELECT *, list_min(list_filter(range(len(used) + 1), lambda x: NOT list_contains(list_transform(used, lambda u: u.l), x))) AS f FROM lane) p JOIN ord o ON o.session_key = p.session_key AND CAST(o.n AS INT) = p.n + 1
) SELECT session_key, n - 1 AS step, spawn, opens, CAST(lane AS INT) AS lane, through FROM lane WHERE n > 0"""
ORACLES: dict[str, str] = {
    "merged_ranges": _RANGES + "SELECT * FROM merged",
    "range_gaps": _RANGES + ", l AS (SELECT *, lag(e) OVER (PARTITION BY session_key, path ORDER BY s) AS b FROM merged) SELECT session_key, path, b + 1 AS gap_start, s - 1 AS gap_end FROM l WHERE b IS NOT NULL",
    "undelivered_points": _RANGES + """, pt AS (SELECT session_key, input->>'$.file_path' AS path, call_row, event_idx * 37 % 2600 + 1 AS line FROM c WHERE name = 'Edit' AND json_valid(input) AND input->>'$.file_path' IS NOT NULL)
SELECT pt.session_key, pt.path, call_row, line, max(e) FILTER (WHERE s <= line) AS end_before, min(s) FILTER (WHERE s > line) AS start_after FROM pt LEFT JOIN merged m ON m.session_key = pt.session_key AND m.path = pt.path
GROUP BY ALL HAVING NOT coalesce(bool_or(line BETWEEN s AND e), false)""",
    "residency_asof": TURNS + f"""
, ld AS (SELECT session_id AS session_key, path AS key, {micros("ts")} AS us, load_reason AS reason FROM hook_record WHERE event = 'InstructionsLoaded' AND coalesce(agent_id, '') = '' AND path IS NOT NULL AND session_id IS NOT NULL),
pb AS (SELECT session_key, turn_idx AS probe, min(us) AS us FROM turned WHERE turn_idx IS NOT NULL AND us IS NOT NULL GROUP BY 1, 2),
q AS (SELECT pb.session_key, probe, k.key, pb.us, max(l.us) AS loaded FROM pb JOIN (SELECT DISTINCT session_key, key FROM ld WHERE us IS NOT NULL) k ON k.session_key = pb.session_key LEFT JOIN ld l ON l.session_key = pb.session_key AND l.key = k.key AND l.us <= pb.us GROUP BY ALL),
z AS (SELECT q.*, (SELECT max(reason) FROM ld l WHERE l.session_key = q.session_key AND l.key = q.key AND l.us = q.loaded) AS reason, (SELECT min(t) FROM comp c WHERE c.session_key = q.session_key AND c.t > q.loaded AND c.t <= q.us) AS cut FROM q)
SELECT session_key, probe, key, NOT (coalesce(reason = 'path_glob_match', false) AND cut IS NOT NULL) AS resident, CASE WHEN reason = 'path_glob_match' THEN cut END AS evicted_at FROM z""",
    "spawn_return_pairs": _AGENTS + "SELECT s.session_key, s.event_idx, spawn, CASE WHEN r.return_row IS NULL THEN 'open' ELSE 'returned' END AS status, return_row, r.status AS report_status, subagent_tokens, duration_ms FROM sp s LEFT JOIN rp r ON r.session_key = s.session_key AND r.tool_use_id = s.spawn",
    "open_spawns": _AGENTS + "SELECT session_key, event_idx, spawn, subagent_type FROM sp s WHERE NOT EXISTS (SELECT 1 FROM rp r WHERE r.session_key = s.session_key AND r.tool_use_id = s.spawn)",
    "lane_assignment": _AGENTS.replace("WITH c AS", "WITH RECURSIVE c AS", 1) + """, ord AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY place, k, spawn) AS n FROM steps),
lane AS (
  SELECT session_key, 0 AS n, CAST([] AS STRUCT(a VARCHAR, l BIGINT)[]) AS used, CAST(NULL AS VARCHAR) AS spawn, CAST(NULL AS BIGINT) AS lane FROM ord GROUP BY 1
  UNION ALL
  SELECT o.session_key, o.n, CASE WHEN o.opens THEN list_append(p.used, {'a': o.spawn, 'l': f}) ELSE list_filter(p.used, lambda u: u.a <> o.spawn) END, o.spawn, CASE WHEN o.opens THEN f END
  FROM (SELECT *, list_min(list_filter(range(len(used) + 1), lambda x: NOT list_contains(list_transform(used, lambda u: u.l), x))) AS f FROM lane) p JOIN ord o ON o.session_key = p.session_key AND CAST(o.n AS INT) = p.n + 1
) SELECT session_key, spawn, CAST(lane AS INT) AS lane FROM lane WHERE lane IS NOT NULL""",
    "spawn_return_by_name": _AGENTS.replace("WITH c AS", "WITH RECURSIVE c AS", 1) + """, al AS (
  SELECT session_key AS session, event_idx AS t, 0 AS k, id, input->>'$.description' AS name, CAST(NULL AS VARCHAR) AS report, false AS far FROM c WHERE name IN ('Agent', 'Task', 'Workflow')
  UNION ALL SELECT session_key, place, 1, tool_use_id, summary, CAST(return_row AS VARCHAR), tool_use_id IS NOT NULL AND EXISTS (SELECT 1 FROM c WHERE c.session_key = pl.session_key AND c.id = pl.tool_use_id) FROM pl),
ord AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t, k, report NULLS LAST, id NULLS LAST) AS n FROM al),
st AS (
  SELECT session, 0 AS n, CAST([] AS STRUCT(i VARCHAR, w VARCHAR, c BOOLEAN)[]) AS l, CAST(NULL AS VARCHAR) AS report, CAST(NULL AS VARCHAR) AS spawn, CAST(NULL AS VARCHAR) AS matched_by FROM ord GROUP BY 1
  UNION ALL
  SELECT session, n, CASE WHEN k = 0 THEN list_append(l, {'i': id, 'w': name, 'c': false}) ELSE list_transform(l, lambda x: {'i': x.i, 'w': x.w, 'c': x.c OR coalesce(x.i = hit, false)}) END, report, CASE WHEN k = 1 THEN hit END, CASE WHEN k = 1 THEN how END
  FROM (
    SELECT *, CASE WHEN known THEN id WHEN NOT far THEN free.i END AS hit, CASE WHEN known THEN 'id' WHEN NOT far AND free IS NOT NULL THEN 'name' ELSE 'unmatched' END AS how
    FROM (SELECT o.*, p.l, list_contains(list_transform(p.l, lambda x: x.i), o.id) AND o.id IS NOT NULL AS known, list_filter(p.l, lambda x: x.w IS NOT DISTINCT FROM o.name AND NOT x.c)[1] AS free FROM st p JOIN ord o ON o.session = p.session AND CAST(o.n AS INT) = p.n + 1)
  )
) SELECT session, report, spawn, matched_by FROM st WHERE matched_by IS NOT NULL""",
    "agents_in_flight": _AGENTS + "SELECT session_key, place, spawn, opens, sum(CASE WHEN opens THEN 1 ELSE -1 END) OVER (PARTITION BY session_key ORDER BY place, k, spawn ROWS UNBOUNDED PRECEDING) AS in_flight FROM steps",
    "fanout_groups": TURNS + _AGENTS.replace("WITH c AS", ", c AS", 1) + """, rw AS (SELECT session_key, event_idx AS place, 0 AS k, 'turn' AS kind, CAST(event_idx AS VARCHAR) AS ref FROM pr WHERE prompt IS NOT NULL UNION ALL SELECT session_key, place, CASE WHEN opens THEN 1 ELSE 2 END, CASE WHEN opens THEN 'spawn' ELSE 'return' END, spawn FROM steps),
n AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY place, k, ref) AS n FROM rw),
t AS (SELECT *, min(n) FILTER (WHERE kind = 'turn') OVER (PARTITION BY session_key ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_turn, n - sum(CASE WHEN kind = 'spawn' THEN 1 ELSE 0 END) OVER (PARTITION BY session_key ORDER BY n) AS island FROM n),
b AS (SELECT session_key, ref, min(n) AS back FROM t WHERE kind = 'return' GROUP BY 1, 2)
SELECT t.session_key, min(n) AS first_row, count(*) AS size, string_agg(t.ref, ',' ORDER BY t.ref) AS members FROM t LEFT JOIN b ON b.session_key = t.session_key AND b.ref = t.ref WHERE kind = 'spawn' GROUP BY t.session_key, island
HAVING count(*) > 1 AND count(*) = count(*) FILTER (WHERE back IS NOT NULL AND (next_turn IS NULL OR back < next_turn))""",
    "agent_group_totals": _AGENTS + ", t AS (SELECT session_key, tool_use_id AS spawn, sum(subagent_tokens) AS tokens, max(duration_ms) AS ms FROM rp GROUP BY 1, 2) SELECT s.session_key, subagent_type, count(*) AS agents, CAST(sum(tokens) AS BIGINT) AS tokens, max(ms) AS slowest_ms FROM sp s LEFT JOIN t ON t.session_key = s.session_key AND t.spawn = s.spawn GROUP BY 1, 2",
    "timeline_rows": TURNS + """, u AS (
  SELECT session_key, event_idx, -1 AS item_idx, 'user' AS kind, 'prompt' AS label, prompt AS text, '' AS detail FROM pr WHERE prompt IS NOT NULL
  UNION ALL SELECT session_key, event_idx, item_idx, CASE WHEN kind = 'text' AND type = 'assistant' THEN 'assistant-text' WHEN kind = 'tool_use' THEN 'tool-use' WHEN kind = 'tool_result' THEN 'tool-result' END, coalesce(i->>'$.name', ''),
    CASE WHEN kind = 'tool_result' THEN coalesce(CASE WHEN json_type(i, '$.content') = 'VARCHAR' THEN i->>'$.content' WHEN json_type(i, '$.content') = 'ARRAY' THEN array_to_string(list_transform(CAST(i->'$.content' AS JSON[]), lambda x: coalesce(CASE WHEN json_type(x, '$.text') = 'VARCHAR' THEN x->>'$.text' END, '')), chr(10)) END, '')
      ELSE coalesce(CASE WHEN json_type(i, '$.text') = 'VARCHAR' THEN i->>'$.text' END, i->>'$.id', '') END, CASE WHEN kind = 'tool_use' THEN left(coalesce(""" + ", ".join(f"i->>'$.input.{k}'" for k in DETAILS) + """, ''), 160) ELSE '' END FROM item)
SELECT session_key, row_number() OVER (PARTITION BY session_key ORDER BY event_idx, item_idx) - 1 AS place, event_idx, item_idx, kind, label, left(text, CASE kind WHEN 'user' THEN 300 WHEN 'tool-result' THEN 200 WHEN 'assistant-text' THEN 400 ELSE 160 END) AS text, detail FROM u WHERE kind IS NOT NULL""",
    "timeline_markers": TURNS + f""", mk AS (SELECT session_id AS session_key, hook_row AS mark, {micros("ts")} AS us FROM hook_record WHERE event IN ('PreCompact', 'PostCompact') AND session_id IS NOT NULL),
mp AS (SELECT m.session_key, mark, m.us, min(e.event_idx) AS pos FROM mk m LEFT JOIN ev e ON e.session_key = m.session_key AND e.us >= m.us GROUP BY 1, 2, 3),
al AS (SELECT session_key, coalesce(pos, 9223372036854775807) AS pos, 0 AS k, 'compaction' AS kind, NULL AS event_idx, mark, us FROM mp UNION ALL SELECT session_key, event_idx, 1, 'event', event_idx, NULL, us FROM ev)
SELECT session_key, row_number() OVER (PARTITION BY session_key ORDER BY pos, k, CASE WHEN k = 0 THEN us END NULLS LAST, mark DESC) - 1 AS place, kind, event_idx, mark, us FROM al""",
    "context_first_wins": TURNS + _CALLS.replace("WITH c AS", ", c AS", 1) + """, src AS (
  SELECT session_key, CAST(attachment AS JSON)->>'$.content.path' AS path, 0 AS priority, event_idx AS seq, 'attachment' AS source FROM ev WHERE json_valid(attachment) AND CAST(attachment AS JSON)->>'$.type' = 'nested_memory'
  UNION ALL SELECT session_id, path, 1, hook_row, 'load' FROM hook_record WHERE event = 'InstructionsLoaded' AND session_id IS NOT NULL
  UNION ALL SELECT session_key, input->>'$.file_path', 2, call_row, 'read' FROM c WHERE name = 'Read' AND json_valid(input))
SELECT session_key, path, priority, seq, source FROM src WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_key, path ORDER BY priority, seq) = 1""",
    "instruction_diff": """WITH h AS (SELECT path, memory_type, max(try_cast(stats->>'$.size_bytes' AS BIGINT)) AS size FROM hook_record WHERE event = 'InstructionsLoaded' AND path IS NOT NULL AND memory_type IN ('Project', 'User') GROUP BY 1, 2),
j AS (SELECT coalesce(a.path, b.path) AS path, a.path AS pa, b.path AS pb, a.size AS value_a, b.size AS value_b FROM (FROM h WHERE memory_type = 'Project') a FULL JOIN (FROM h WHERE memory_type = 'User') b ON a.path = b.path)
SELECT path, CASE WHEN pa IS NULL THEN 'added' WHEN pb IS NULL THEN 'removed' ELSE 'changed' END AS change, value_a, value_b FROM j WHERE pa IS NULL OR pb IS NULL OR value_a IS DISTINCT FROM value_b""",
    "path_presence": "SELECT path, CASE WHEN bool_or(m) AND bool_or(NOT m) THEN 'both' WHEN bool_or(m) THEN 'a-only' ELSE 'b-only' END AS presence FROM (SELECT path, coalesce(agent_id, '') = '' AS m FROM hook_record WHERE path IS NOT NULL) GROUP BY 1",
    "tool_delta": _PAIRS + _CALLS.replace("WITH c AS", ", c AS", 1) + ", n AS (SELECT session_key, name, count(*) AS n FROM c GROUP BY 1, 2), d AS (SELECT p.session_key AS pair, name, -n AS n FROM p JOIN n ON n.session_key = p.session_key UNION ALL SELECT p.session_key, name, n FROM p JOIN n ON n.session_key = p.other) SELECT pair, name, CAST(sum(n) AS BIGINT) AS delta FROM d GROUP BY 1, 2 HAVING sum(n) <> 0",
    "turn_pairs": _PAIRS + """, t AS (SELECT session_key, turn_idx, arg_min(turn_prompt, event_idx) AS prompt, count(*) AS events FROM turned WHERE turn_idx IS NOT NULL GROUP BY 1, 2),
a AS (SELECT p.session_key AS pair, turn_idx, prompt, events FROM p JOIN t ON t.session_key = p.session_key), b AS (SELECT p.session_key AS pair, turn_idx, prompt, events FROM p JOIN t ON t.session_key = p.other)
SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.turn_idx, b.turn_idx) AS turn_idx, a.prompt IS NOT DISTINCT FROM b.prompt AS same_prompt, a.events AS events_a, b.events AS events_b FROM a FULL JOIN b ON a.pair = b.pair AND a.turn_idx = b.turn_idx""",
    "task_status": "SELECT task_id, coalesce(arg_min(status, list_position(['failed', 'killed', 'cancelled', 'running', 'completed'], status)) FILTER (WHERE list_position(['failed', 'killed', 'cancelled', 'running', 'completed'], status) > 0), 'unknown') AS status FROM agent_return WHERE task_id IS NOT NULL GROUP BY 1",
    "status_histogram": "SELECT session_key, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS n_{s}" for s in STATUS_RANKS) + ", count(*) AS reports, CASE WHEN count(*) FILTER (WHERE status = 'failed') > 0 THEN 'failed' WHEN count(*) FILTER (WHERE status = 'completed') = count(*) THEN 'all completed' ELSE 'mixed' END AS summary FROM agent_return GROUP BY 1",
    "longest_results_topk": "WITH r AS (SELECT * FROM result_segment QUALIFY row_number() OVER (PARTITION BY session_key, event_idx, item_idx ORDER BY arrived_at, result_row) = 1) SELECT session_key, result_row, full_text_len FROM r WHERE full_text_len IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_key ORDER BY full_text_len DESC, result_row) <= 5",
    "call_results": _CALLS + """, r AS (SELECT * FROM result_segment QUALIFY row_number() OVER (PARTITION BY session_key, event_idx, item_idx ORDER BY arrived_at, result_row) = 1),
l AS (SELECT session_key, tool_use_id AS id, event_idx AS result_event, full_text_len, line_count FROM r WHERE tool_use_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_key, tool_use_id ORDER BY event_idx DESC, item_idx DESC) = 1)
SELECT c.session_key, c.id, c.event_idx AS call_event, c.item_idx AS call_item, name, result_event, full_text_len, line_count FROM c LEFT JOIN l ON l.session_key = c.session_key AND l.id = c.id""",
}
