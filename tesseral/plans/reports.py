"""Listings, look-ups by address and the report over a hook log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesseral.functions import format as fmt
from tesseral.operators import compare
from tesseral.plans.common import TURNS, micros
from tesseral.plans.flows import calls, spawns
from tesseral.plans.sessions import ORACLES as SESSIONS
from tesseral.plans.sessions import events, session_summary, turn_usage_totals, turned
from tesseral.session import table
from tesseral.sources import transcripts as tr

#: Rows and characters that a listing shows before it says how many more there are.
ROWS, CHARS = 60, 1500
#: Sessions that the listing of the newest shows.
SESSIONS_SHOWN = 20


class QueryError(Exception):
    """An address that names nothing, or more than one thing; the message says which listing has the valid ones."""


def resolve_prefix(keys: DataFrame, column: str, prefix: str) -> str:
    """The one key that begins with the prefix; two are looked up, no more."""
    hit = [r[0] for r in keys.where(F.col(column).startswith(prefix)).select(column).distinct().orderBy(column).limit(2).collect()]
    if not hit:
        raise QueryError(f"no session begins with {prefix!r}; list them with: sessions")
    if len(hit) > 1:
        raise QueryError(f"{prefix!r} is ambiguous: {hit[0]}, {hit[1]}, ...; list them with: sessions")
    return hit[0]


def session_lines(spark: SparkSession, root: str) -> DataFrame:
    """A line a session as a listing shows it."""
    s = session_summary(spark, root)
    line = F.concat_ws("  ", F.left("session_key", F.lit(8)), F.col("events").cast("string"), F.coalesce(fmt.duration(F.col("duration_sec")), F.lit("-")), F.coalesce("git_branch", F.lit("-")))
    return s.select("session_key", line.alias("line"))


def newest_sessions(spark: SparkSession, root: str) -> DataFrame:
    """The twenty newest sessions by their last event, a top-k report; those without a readable time come last.

    The active session, whose row arrived last, is always among them: if need be in the last place.
    """
    e = events(spark, root).groupBy("session_key").agg(F.max("us").alias("last_us"))
    top = e.orderBy(F.desc_nulls_last("last_us"), "session_key").limit(SESSIONS_SHOWN)
    now = table(spark, root, "transcript_event").agg(F.max(F.struct("arrived_at", "line_id", "session_key"))["session_key"].alias("now"))
    # One row of at most twenty sessions, and the active one beside it.
    seen = top.agg(F.sort_array(F.collect_list(F.struct((-F.coalesce("last_us", F.lit(-(1 << 62)))).alias("o"), "session_key", "last_us"))).alias("l"), F.lit(1).alias("one")).join(now.withColumn("one", F.lit(1)), "one")
    has = F.exists("l", lambda x: x["session_key"] == F.col("now"))
    kept = F.when(has | F.col("now").isNull(), F.col("l")).otherwise(F.slice("l", 1, SESSIONS_SHOWN - 1))
    shown = seen.select(F.explode(F.concat(F.transform(kept, lambda x: x["session_key"]), F.when(has | F.col("now").isNull(), F.array().cast("array<string>")).otherwise(F.array("now")))).alias("session_key"), "now")
    return shown.join(e, "session_key").select("session_key", "last_us", (F.col("session_key") == F.col("now")).alias("active"))


def prefix_lookup(spark: SparkSession, root: str) -> DataFrame:
    """For every prefix of two characters how many sessions it names and the one it resolves to."""
    s = table(spark, root, "transcript_event").select("session_key").distinct()
    g = s.groupBy(F.left("session_key", F.lit(2)).alias("prefix")).agg(F.count("*").alias("n"), F.min("session_key").alias("_k"))
    return g.select("prefix", "n", F.when(F.col("n") == 1, F.col("_k")).alias("session_key"))


def session_links(spark: SparkSession, root: str) -> DataFrame:
    """Sessions of the hook log with the transcript they belong to, or none."""
    h = table(spark, root, "hook_record").where("session_id is not null").groupBy("session_id").agg(F.count("*").alias("records"), F.min("hook_row").alias("first_row"))
    t = table(spark, root, "transcript_event").select("session_key").distinct()
    return h.join(t, h.session_id == t.session_key, "left").select("session_id", "records", "first_row", F.col("session_key").isNotNull().alias("has_transcript"))


def report_loads(spark: SparkSession, root: str) -> DataFrame:
    return tr.hook_facts(table(spark, root, "hook_record"))[0].groupBy("session_id", "load_reason").agg(F.count("*").alias("loads"), F.count_distinct("path").alias("paths"))


def report_reads(spark: SparkSession, root: str) -> DataFrame:
    """Reads a path of main agent and subagents, with the largest response."""
    h = table(spark, root, "hook_record").where("event = 'PostToolUse' and tool = 'Read' and path is not null")
    return h.groupBy("path", (F.coalesce("agent_id", F.lit("")) != "").alias("by_subagent")).agg(F.count("*").alias("reads"), F.max("response_chars").alias("largest"))


def report_tools(spark: SparkSession, root: str) -> DataFrame:
    h = table(spark, root, "hook_record").where("tool is not null")
    return h.groupBy("tool").agg(F.count("*").alias("uses"), F.count_if(F.col("event") == "PostToolUseFailure").alias("failures"), F.count_distinct("session_id").alias("sessions"))


def report_searches(spark: SparkSession, root: str) -> DataFrame:
    """The twenty commonest search patterns of each session, ties by first use: a top-k report."""
    c = calls(spark, root).where("name in ('Grep', 'Glob')").select("session_key", "name", F.get_json_object("input", "$.pattern").alias("pattern"), F.struct("event_idx", "item_idx").alias("at")).where("pattern is not null")
    g = c.groupBy("session_key", "name", "pattern").agg(F.count("*").alias("times"), F.min("at").alias("first"))
    return compare.top_k(g, ["session_key"], [F.desc("times"), "first"], 20).select("session_key", "name", "pattern", "times")


def report_compactions(spark: SparkSession, root: str) -> DataFrame:
    return tr.hook_facts(table(spark, root, "hook_record"))[1].groupBy("session_id").agg(F.count_if(F.col("event") == "PreCompact").alias("begun"), F.count_if(F.col("event") == "PostCompact").alias("done"))


def report_subagents(spark: SparkSession, root: str) -> DataFrame:
    return spawns(spark, root).groupBy("subagent_type").agg(F.count("*").alias("spawns"), F.count_distinct("session_key").alias("sessions"))


def guides_never_touched(spark: SparkSession, root: str) -> DataFrame:
    """Documents whose path no record of the hook log ever names."""
    d = table(spark, root, "documents").where("path like '%.md'").select("path").distinct()
    return d.join(table(spark, root, "hook_record").where("path is not null").select("path"), "path", "left_anti")


def active_first(spark: SparkSession, root: str) -> DataFrame:
    """Files of each session, those that were edited before those only read, each by first touch."""
    f = calls(spark, root).select("session_key", F.get_json_object("input", "$.file_path").alias("path"), (F.col("name") != "Read").alias("edit"), F.struct("event_idx", "item_idx").alias("at")).where("path is not null")
    g = f.groupBy("session_key", "path").agg(F.max("edit").alias("active"), F.min("at").alias("_at"))
    return g.select("session_key", "path", "active", F.row_number().over(Window.partitionBy("session_key").orderBy(F.desc("active"), "_at")).alias("place"))


def sibling_turns(spark: SparkSession, root: str) -> DataFrame:
    """Each turn with the one before and after it, clamped at the ends."""
    t = turned(spark, root).where("turn_idx is not null").select("session_key", "turn_idx").distinct()
    w = Window.partitionBy("session_key").orderBy("turn_idx")
    return t.select("session_key", "turn_idx", F.coalesce(F.lag("turn_idx").over(w), F.col("turn_idx")).alias("before"), F.coalesce(F.lead("turn_idx").over(w), F.col("turn_idx")).alias("after"))


def cached_share(spark: SparkSession, root: str) -> DataFrame:
    u = turn_usage_totals(spark, root)
    return u.select("session_key", "turn_idx", F.floor(F.try_divide(F.col("cache_read") * 100, F.col("prompt_tokens")) + 0.5).cast("bigint").alias("percent"), fmt.short_count(F.col("prompt_tokens")).alias("prompt"))


def payload_sessions(spark: SparkSession, root: str) -> DataFrame:
    """A JSON document a session: its summary and turns; what is unknown is absent. ``</`` and ``<!--`` are escaped for pages."""
    t = turn_usage_totals(spark, root).where("turn_idx is not null").groupBy("session_key").agg(F.array_sort(F.collect_list(F.struct("turn_idx", "requests", "input", "output", "prompt_tokens"))).alias("turns"))
    s = session_summary(spark, root).join(t, "session_key", "left")
    body = F.to_json(F.struct(*(c for c in s.columns)))
    return s.select("session_key", F.regexp_replace(F.regexp_replace(body, "</", r"<\\\\/"), "<!--", r"<\\\\!--").alias("payload"))


def combined_by_session(spark: SparkSession, root: str) -> DataFrame:
    """Statuses of subagents folded over a session."""
    from tesseral.plans.flows import STATUS_RANKS

    return compare.fold_status(table(spark, root, "agent_return").where("session_key is not null"), ["session_key"], "status", STATUS_RANKS, "unknown")


_ALL = (session_lines, newest_sessions, prefix_lookup, session_links, report_loads, report_reads, report_tools, report_searches, report_compactions, report_subagents, guides_never_touched, active_first, sibling_turns, cached_share, payload_sessions, combined_by_session)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_CALLS = "WITH c AS (SELECT * FROM tool_call QUALIFY row_number() OVER (PARTITION BY session_key, event_idx, item_idx ORDER BY arrived_at, call_row) = 1)"
SUMMARY = SESSIONS["session_summary"]
_MAIN = "coalesce(agent_id, '') = ''"
_TURN_USE = ", tu AS (SELECT s.session_key, turn_idx, sum(cache_read) AS cache_read, sum(input + cache_read + cache_creation) AS p FROM series s JOIN turned t ON t.session_key = s.session_key AND t.event_idx = s.event_idx GROUP BY 1, 2)"
ORACLES: dict[str, str] = {
    "session_lines": "SELECT session_key, left(session_key, 8) || '  ' || events || '  ' || coalesce(CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN printf('%dm%02ds', s // 60, s % 60) ELSE printf('%dh%02dm', s // 3600, s % 3600 // 60) END, '-') || '  ' || coalesce(git_branch, '-') AS line FROM (SELECT *, duration_sec AS s FROM (" + SUMMARY + "))",
    "newest_sessions": f"""WITH e AS (SELECT session_key, max({micros('ts')}) AS last_us FROM (SELECT * FROM transcript_event QUALIFY row_number() OVER (PARTITION BY session_key, event_idx ORDER BY arrived_at, line_id) = 1) GROUP BY 1),
n AS (SELECT session_key AS now FROM transcript_event ORDER BY arrived_at DESC, line_id DESC LIMIT 1), r AS (SELECT *, row_number() OVER (ORDER BY last_us DESC NULLS LAST, session_key) AS r FROM e), i AS (SELECT now, (SELECT r FROM r WHERE session_key = now) <= {SESSIONS_SHOWN} AS inside FROM n)
SELECT session_key, last_us, session_key = now AS active FROM r, i WHERE r < {SESSIONS_SHOWN} OR (r = {SESSIONS_SHOWN} AND inside) OR (session_key = now)""",
    "prefix_lookup": "SELECT left(session_key, 2) AS prefix, count(DISTINCT session_key) AS n, CASE WHEN count(DISTINCT session_key) = 1 THEN min(session_key) END AS session_key FROM transcript_event GROUP BY 1",
    "session_links": "SELECT session_id, count(*) AS records, min(hook_row) AS first_row, session_id IN (SELECT session_key FROM transcript_event) AS has_transcript FROM hook_record WHERE session_id IS NOT NULL GROUP BY 1",
    "report_loads": f"SELECT session_id, load_reason, count(*) AS loads, count(DISTINCT path) AS paths FROM hook_record WHERE event = 'InstructionsLoaded' AND {_MAIN} GROUP BY 1, 2",
    "report_reads": f"SELECT path, NOT ({_MAIN}) AS by_subagent, count(*) AS reads, max(response_chars) AS largest FROM hook_record WHERE event = 'PostToolUse' AND tool = 'Read' AND path IS NOT NULL GROUP BY 1, 2",
    "report_tools": "SELECT tool, count(*) AS uses, count(*) FILTER (WHERE event = 'PostToolUseFailure') AS failures, count(DISTINCT session_id) AS sessions FROM hook_record WHERE tool IS NOT NULL GROUP BY 1",
    "report_searches": _CALLS + ", g AS (SELECT session_key, name, input->>'$.pattern' AS pattern, count(*) AS times, min((event_idx, item_idx)) AS f FROM c WHERE name IN ('Grep', 'Glob') AND json_valid(input) AND input->>'$.pattern' IS NOT NULL GROUP BY 1, 2, 3) SELECT session_key, name, pattern, times FROM g QUALIFY row_number() OVER (PARTITION BY session_key ORDER BY times DESC, f) <= 20",
    "report_compactions": f"SELECT session_id, count(*) FILTER (WHERE event = 'PreCompact') AS begun, count(*) FILTER (WHERE event = 'PostCompact') AS done FROM hook_record WHERE event IN ('PreCompact', 'PostCompact') AND {_MAIN} GROUP BY 1",
    "report_subagents": _CALLS + " SELECT input->>'$.subagent_type' AS subagent_type, count(*) AS spawns, count(DISTINCT session_key) AS sessions FROM c WHERE name IN ('Agent', 'Task', 'Workflow') GROUP BY 1",
    "guides_never_touched": "SELECT DISTINCT path FROM documents WHERE path LIKE '%.md' AND path NOT IN (SELECT path FROM hook_record WHERE path IS NOT NULL)",
    "active_first": _CALLS + ", g AS (SELECT session_key, input->>'$.file_path' AS path, bool_or(name <> 'Read') AS active, min((event_idx, item_idx)) AS f FROM c WHERE json_valid(input) AND input->>'$.file_path' IS NOT NULL GROUP BY 1, 2) SELECT session_key, path, active, row_number() OVER (PARTITION BY session_key ORDER BY active DESC, f) AS place FROM g",
    "sibling_turns": TURNS + ", d AS (SELECT DISTINCT session_key, turn_idx FROM turned WHERE turn_idx IS NOT NULL) SELECT session_key, turn_idx, coalesce(lag(turn_idx) OVER w, turn_idx) AS before, coalesce(lead(turn_idx) OVER w, turn_idx) AS after FROM d WINDOW w AS (PARTITION BY session_key ORDER BY turn_idx)",
    "cached_share": TURNS + _TURN_USE + " SELECT session_key, turn_idx, CAST(floor(cache_read * 100 / nullif(p, 0) + 0.5) AS BIGINT) AS percent, CASE WHEN p < 1000 THEN CAST(p AS VARCHAR) WHEN p < 10000 THEN printf('%.1fk', p / 1e3) WHEN p < 1000000 THEN printf('%.0fk', p / 1e3) ELSE printf('%.1fM', p / 1e6) END AS prompt FROM tu",
    "combined_by_session": "SELECT session_key, coalesce(arg_min(status, list_position(['failed', 'killed', 'cancelled', 'running', 'completed'], status)) FILTER (WHERE list_position(['failed', 'killed', 'cancelled', 'running', 'completed'], status) > 0), 'unknown') AS status FROM agent_return WHERE session_key IS NOT NULL GROUP BY 1",
}
