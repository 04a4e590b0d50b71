"""Queries over what a session was given and asked: sources, coverage, context, blocks, agents, comparisons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesseral.functions import format as fmt
from tesseral.functions.text import iso_micros
from tesseral.functions.variant import parse_object
from tesseral.operators import agents, compare
from tesseral.plans import flows, reports
from tesseral.plans.actions import CALLS
from tesseral.plans.common import EVENTS, TURNS, WS, micros
from tesseral.plans.flows import _AGENTS, agent_steps, calls, fanout_groups, placed_reports, residency_asof, session_pairs, spawns, timeline_rows
from tesseral.plans.reports import ROWS, session_lines
from tesseral.plans.sessions import events, listed_names, prompt_counts, turned, usage_session_totals
from tesseral.plans.texts import _LINES, markdown_blocks
from tesseral.session import table
from tesseral.sources import documents as docs
from tesseral.sources import transcripts as tr

# Words in a response that tell of a partial view; folders that hold no guides; lines a read without limit delivers; words that are no commands.
PARTIAL = ("partial view", "partial]", "truncated", "exceeds maximum")
SKIP = (".git", "node_modules", "vendor", "dist", "build")
CAP = 2000
NO_COMMANDS = "the a an and or if see use any all rule always never must i you we it is are was were this that these those trigger yaml json md ts tsx py argparse".split()
#: Roots a name is looked for under, in this order, after the name as it stands.
ROOTS = ("docs", "lib", "src")
#: Folders whose units are listed.
FOLDERS = ("api", "config", "core", "docs", "lib", "src", "store", "tests", "util", "views", "web")
#: What is said of a load by its reason.
NOTES = {
    "path_glob_match": "loaded because a file it watches was touched", "session_start": "loaded at session start", "nested_traversal": "loaded while walking the directory tree",
    "include": "pulled in by another instruction file", "compact": "reloaded after the context was compacted",
}


def _docs(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents")


def _hooks(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "hook_record")


def newest_transcripts(spark: SparkSession, root: str) -> DataFrame:
    """The newest session of each project folder, by its last event; sessions without a readable time are the oldest."""
    e = events(spark, root, "cwd").groupBy("session_key").agg(F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("event_idx"))).alias("cwd"), F.max("us").alias("last_us"))
    best = F.max(F.struct(F.coalesce("last_us", F.lit(-(1 << 62))).alias("t"), "session_key", "last_us")).alias("b")
    return e.where("cwd is not null").groupBy(tr.project_folder(F.col("cwd")).alias("folder")).agg(best, F.count("*").alias("sessions")).select("folder", "b.session_key", "b.last_us", "sessions")


def hook_logs(spark: SparkSession, root: str) -> DataFrame:
    """Each session of the transcripts with what its hook log holds: no log at all is not the same as an empty one."""
    h = _hooks(spark, root).where("session_id is not null")
    main = F.coalesce("agent_id", F.lit("")) == ""
    g = h.groupBy("session_id").agg(F.count_if(main & (F.col("event") == "InstructionsLoaded")).alias("loads"), F.count_if(main & F.col("event").isin("PreCompact", "PostCompact")).alias("compactions"), F.lit(True).alias("log"))
    t = table(spark, root, "transcript_event").select("session_key").distinct()
    return t.join(g, t.session_key == g.session_id, "left").select("session_key", F.coalesce("log", F.lit(False)).alias("has_log"), "loads", "compactions")


def at_references(spark: SparkSession, root: str) -> DataFrame:
    """The files documents refer to by ``@name.md``, each by the first root under which it exists; null if under none."""
    refs = docs.references(_docs(spark, root), "doc_id", "text")
    files = _docs(spark, root).where("path is not null").select("path")
    return refs.join(docs.resolve(refs, files, list(ROOTS)), ["doc_id", "ref"], "left").select("doc_id", "ref", "path")


def named_files(spark: SparkSession, root: str) -> DataFrame:
    """The file names that documents and commands mention, with the listed file of that path: as it stands, else under the project's roots."""
    names = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(c, F.lit(r"((?:[\w.-]+/)+[\w-]+\.\w+)"), F.lit(1))))
    d = _docs(spark, root).where("text is not null").select(F.lit("document").alias("source"), F.col("doc_id").alias("row_id"), names(F.col("text")).alias("ref"))
    c = calls(spark, root).where("name = 'Bash'").select(F.lit("command").alias("source"), F.col("call_row").alias("row_id"), names(F.get_json_object("input", "$.command")).alias("ref"))
    files = _docs(spark, root).where("path is not null").select("path")
    return docs.resolve(d.unionByName(c), files, list(ROOTS)).select("source", "row_id", "ref", "path")


def folder_units(spark: SparkSession, root: str) -> DataFrame:
    """The units of each folder of documents: ``<name>.md``, or ``<name>/SKILL.md``."""
    files = _docs(spark, root).where("path is not null").select("path")
    first, *rest = (docs.units(files, f).withColumn("folder", F.lit(f)) for f in FOLDERS)
    for x in rest:
        first = first.unionByName(x)
    return first.select("folder", "name", "path")


def newest_documents(spark: SparkSession, root: str) -> DataFrame:
    """Of the documents of one file name the one captured last."""
    files = _docs(spark, root).where("path is not null").select("path", F.col("captured_at").alias("modified"))
    return docs.newest(files, r"([^/]+)$").select("key", "path")


def check_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """The file of checks beside each document; null if there is none."""
    d = _docs(spark, root).where("path is not null").select("path").distinct()
    return docs.sidecars(d, d)


def find_guides(spark: SparkSession, root: str) -> DataFrame:
    """Documents that guide: markdown, or of a guiding kind, and not below a folder to skip."""
    skip = "(^|/)(" + "|".join(s.replace(".", r"\.") for s in SKIP) + ")/"
    return _docs(spark, root).where((F.col("path").endswith(".md") | F.col("doc_kind").isin("rule", "global", "project", "skill")) & F.col("path").isNotNull() & ~F.col("path").rlike(skip)).select("path", "doc_kind").distinct()


def hook_payloads(spark: SparkSession, root: str) -> DataFrame:
    """Hook payloads of the raw logs in one shape: the response under whichever key it came, as text."""
    log = table(spark, root, "log_line").join(table(spark, root, "log_file").where("kind = 'hook'").select("file_id").distinct(), "file_id")
    v = log.select("line_id", parse_object(F.col("line")).alias("v")).where("v is not null")
    keys = ("tool_response", "tool_result", "response")
    x = [F.try_variant_get("v", f"$.{k}", "variant") for k in keys]
    which = F.coalesce(*(F.when(F.coalesce(F.schema_of_variant(c), F.lit("VOID")) != "VOID", k) for c, k in zip(x, keys)))
    kind = F.coalesce(*(F.when(F.schema_of_variant(c) != "VOID", F.regexp_extract(F.schema_of_variant(c), "^([A-Z]+)", 1)) for c in x))
    text = F.coalesce(*(F.when(F.schema_of_variant(c) == "STRING", F.try_variant_get(c, "$", "string")) for c in x))
    s = lambda k: F.try_variant_get("v", f"$.{k}", "string")
    return v.select("line_id", s("hook_event_name").alias("event"), s("session_id").alias("session_id"), s("tool_name").alias("tool"), s("tool_use_id").alias("tool_use_id"), which.alias("response_key"), F.when(kind == "STRING", "text").when(kind.isNotNull(), "json").alias("response_kind"), F.length(text).alias("text_chars"))


def read_coverage(spark: SparkSession, root: str) -> DataFrame:
    """What each read delivered: a part by request, cut at the cap, reported as partial, or all; with a label."""
    j = lambda k: F.get_json_object("input", f"$.{k}").try_cast("bigint")
    stats = _hooks(spark, root).where("stats is not null and tool_use_id is not null").groupBy(F.col("tool_use_id").alias("id")).agg(F.max(F.get_json_object("stats", "$.lines").try_cast("bigint")).alias("total"))
    ev = events(spark, root).select("session_key", F.explode("items").alias("i")).where("i.kind = 'tool_result' and i.tool_use_id is not null").select(F.col("i.tool_use_id").alias("id"), F.lower(F.to_json("i.content")).alias("said"))
    told = F.lit(False)
    for p in PARTIAL:
        told = told | F.col("said").contains(p)
    reported = ev.groupBy("id").agg(F.max(F.coalesce(told, F.lit(False))).alias("reported"))
    c = calls(spark, root).where("name = 'Read'").select("call_row", "id", j("offset").alias("o"), j("limit").alias("l")).join(stats, "id", "left").join(reported, "id", "left")
    kind = F.when(F.col("o").isNotNull() | F.col("l").isNotNull(), "partial_by_request").when(F.col("total") > CAP, "likely_truncated").when(F.col("reported"), "reported_partial").otherwise("full")
    total, start = F.col("total").cast("string"), F.coalesce("o", F.lit(1))
    label = (
        F.when(F.col("kind") == "partial_by_request", F.concat(F.lit("lines "), start.cast("string"), F.lit("-"), F.coalesce((start + F.col("l") - 1).cast("string"), F.lit("?")), F.lit(" of "), F.coalesce(total, F.lit("?"))))
        .when(F.col("kind") == "likely_truncated", F.concat(F.lit(f"lines 1-{CAP} of "), total))
        .when(F.col("kind") == "reported_partial", "reported as a partial view")
        .when(F.col("total").isNotNull(), F.concat(F.lit("full ("), total, F.lit(" lines)")))
        .otherwise("full")
    )
    return c.withColumn("kind", kind).select("call_row", "kind", label.alias("label"))


def coverage_totals(spark: SparkSession, root: str) -> DataFrame:
    """How many reads of each session were covered how."""
    return read_coverage(spark, root).join(calls(spark, root).select("call_row", "session_key"), "call_row").groupBy("session_key", "kind").agg(F.count("*").alias("reads"))


def timeline_shown(spark: SparkSession, root: str) -> DataFrame:
    """The timeline as it opens: without results."""
    return timeline_rows(spark, root).where("kind <> 'tool-result'").groupBy("session_key", "kind").agg(F.count("*").alias("n_rows"), F.min("place").alias("first_place"))


def nonresident_requests(spark: SparkSession, root: str) -> DataFrame:
    """The requests made in turns at whose start a file was not resident."""
    gone = residency_asof(spark, root).where("not resident").select("session_key", F.col("probe").alias("turn_idx"), "key")
    asks = turned(spark, root).where("turn_idx is not null and request_id is not null").select("session_key", "turn_idx", "request_id").distinct()
    return gone.join(asks, ["session_key", "turn_idx"]).select("session_key", "turn_idx", "key", "request_id")


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """The names a session was offered with the file each is: ``<name>.md`` before ``<name>/SKILL.md``; one without a file has a null path."""
    names = listed_names(spark, root).select("session_key", "name").distinct()
    stem = F.regexp_extract("path", r"(?:^|/)([^/]+?)(?:/SKILL)?\.[^./]+$", 1)
    files = _docs(spark, root).where("path is not null").select(stem.alias("name"), F.struct(F.col("path").endswith("/SKILL.md").alias("_s"), "path").alias("p")).where("name <> ''").groupBy("name").agg(F.min("p")["path"].alias("path"))
    return names.join(files, "name", "left").select("session_key", "name", "path")


def loads_in_context(spark: SparkSession, root: str) -> DataFrame:
    """Each load of the hook log with the document of the same path, as normalised."""
    loads = _hooks(spark, root).where("event = 'InstructionsLoaded' and path is not null").select("hook_row", fmt.normal_path(F.col("path")).alias("path"))
    d = _docs(spark, root).where("path is not null").groupBy(fmt.normal_path(F.col("path")).alias("path")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("documents"))
    return loads.join(d, "path", "left").select("hook_row", "path", "doc_id", F.coalesce("documents", F.lit(0)).alias("documents"))


def load_notes(spark: SparkSession, root: str) -> DataFrame:
    """What is said of each load by its reason and memory."""
    reason: Column = F.coalesce(*(F.when(F.col("load_reason") == k, v) for k, v in NOTES.items()), F.when(F.col("load_reason") != "", F.concat(F.lit("loaded ("), "load_reason", F.lit(")"))), F.lit("recorded as loaded"))
    memory = F.when(F.coalesce("memory_type", F.lit("")) != "", F.concat(F.lit(", "), "memory_type", F.lit(" memory"))).otherwise("")
    return _hooks(spark, root).where("event = 'InstructionsLoaded'").select("hook_row", F.concat(reason, memory).alias("note"))


def agent_rows(spark: SparkSession, root: str) -> DataFrame:
    """Turns, spawns and reports of a session in one order; a spawn that never reports dangles."""
    steps = agent_steps(spark, root).select("session_key", "place", F.when(F.col("opens"), 1).otherwise(2).alias("k"), F.when(F.col("opens"), "spawn").otherwise("return").alias("kind"), F.col("spawn").alias("ref"))
    t = tr.prompts(events(spark, root)).where("prompt is not null").select("session_key", F.col("event_idx").alias("place"), F.lit(0).alias("k"), F.lit("turn").alias("kind"), F.col("event_idx").cast("string").alias("ref"))
    back = steps.where("kind = 'return'").select("session_key", "ref", F.lit(True).alias("back"))
    w = Window.partitionBy("session_key").orderBy("place", "k", "ref")
    x = t.unionByName(steps).withColumn("step", (F.row_number().over(w) - 1).cast("bigint")).join(back, ["session_key", "ref"], "left")
    return x.select("session_key", "step", "kind", "ref", ((F.col("kind") == "spawn") & F.col("back").isNull()).alias("dangling"))


def agent_groups(spark: SparkSession, root: str) -> DataFrame:
    """Each agent with the fan-out it was part of; null if it was on its own."""
    g = fanout_groups(spark, root).select("session_key", "first_row", "size", F.explode(F.split("members", ",")).alias("spawn"))
    s = agent_steps(spark, root).where("opens").select("session_key", "spawn")
    return s.join(g, ["session_key", "spawn"], "left").select("session_key", "spawn", "first_row", "size")


def agent_details(spark: SparkSession, root: str) -> DataFrame:
    """One row an agent: what it was, its last report's figures as labels; what never came is a dash."""
    last = placed_reports(spark, root).where("tool_use_id is not null").groupBy("session_key", F.col("tool_use_id").alias("spawn")).agg(F.max(F.struct("place", "return_row", "status", "subagent_tokens", "duration_ms")).alias("r"), F.count("*").alias("reports"))
    s = spawns(spark, root).where("spawn is not null").groupBy("session_key", "spawn").agg(F.min(F.struct("event_idx", "description", "subagent_type")).alias("s"))
    dash = lambda c: F.coalesce(c, F.lit("-"))
    return s.join(last, ["session_key", "spawn"], "left").select(
        "session_key", "spawn", dash(F.col("s.subagent_type")).alias("agent_type"), dash(F.col("s.description")).alias("description"), F.when(F.col("reports").isNull(), "no reply").otherwise("returned").alias("label"), dash(F.col("r.status")).alias("status"),
        dash(fmt.short_count(F.col("r.subagent_tokens"))).alias("tokens"), dash(fmt.duration(F.round(F.col("r.duration_ms") / 1000))).alias("took"), F.coalesce("reports", F.lit(0)).alias("reports"),
    )


def lane_occupancy(spark: SparkSession, root: str) -> DataFrame:
    """At each opening and closing the agent's own lane and the lanes that run through."""
    return agents.occupancy(agent_steps(spark, root), "session_key", ["place", "k", "spawn"], "spawn", "opens")


def session_blocks(spark: SparkSession, root: str) -> DataFrame:
    """The blocks of the documents each session captured, in the order a listing shows them."""
    d = _docs(spark, root).where("session_key is not null").select("doc_id", "session_key", F.coalesce("path", F.lit("")).alias("path"))
    b = markdown_blocks(spark, root).join(d, "doc_id")
    w = Window.partitionBy("session_key").orderBy("path", "doc_id", "block_idx")
    return b.select("session_key", (F.row_number().over(w) - 1).cast("bigint").alias("place"), "path", "doc_id", "block_idx", "title", "start_line", "end_line")


def block_changes(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of sessions: the blocks that only one captured, or that differ in size, by path and title."""
    d = _docs(spark, root).where("session_key is not null").select("doc_id", "session_key", F.coalesce("path", F.lit("")).alias("path"))
    b = markdown_blocks(spark, root).join(d, "doc_id").groupBy("session_key", "path", "title").agg(F.sum("chars").alias("chars"))
    s = flows._sides(spark, root, b)
    return compare.block_diff(s.where("side = 'a'"), s.where("side = 'b'"), ["pair", "path", "title"], "chars")


def block_details(spark: SparkSession, root: str) -> DataFrame:
    """One row a block: its document, size, and how many of its lines are blank or items."""
    b = docs.markdown_blocks(_docs(spark, root), "doc_id", "text").select("doc_id", "block_idx", "title", "level", "start_line", "end_line", F.split("content", "\n").alias("l"), F.length("content").alias("chars"))
    filled = lambda x: F.trim(x) != ""
    return b.select("doc_id", "block_idx", "title", "level", "start_line", "end_line", "chars", F.size(F.filter("l", filled)).alias("filled_lines"), F.size(F.filter("l", lambda x: F.ltrim(x).rlike("^[-*+] "))).alias("item_lines"))


def file_details(spark: SparkSession, root: str) -> DataFrame:
    """One row a session and file: reads, edits, loads, and whether it counts as active."""
    j = F.get_json_object("input", "$.file_path")
    c = calls(spark, root).where("name in ('Read', 'Edit', 'Write', 'MultiEdit')").select("session_key", j.alias("path"), (F.col("name") == "Read").cast("int").alias("r"), (F.col("name") != "Read").cast("int").alias("e"), F.lit(0).alias("l"))
    h = _hooks(spark, root).where("event = 'InstructionsLoaded' and session_id is not null").select(F.col("session_id").alias("session_key"), "path", F.lit(0).alias("r"), F.lit(0).alias("e"), F.lit(1).alias("l"))
    g = c.unionByName(h).where("path is not null").groupBy("session_key", F.expr("path").alias("path")).agg(F.sum("r").alias("reads"), F.sum("e").alias("edits"), F.sum("l").alias("loads"))
    return g.withColumn("use", F.when(F.col("edits") > 0, "active").otherwise("quiet")).withColumn("loaded", F.col("loads") > 0)


def compare_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of sessions: whether they began with one task, and what differs in calls, edits and tokens."""
    p = session_pairs(spark, root)
    first = prompt_counts(spark, root).select("session_key", F.coalesce(fmt.same_text(F.col("first_prompt")), F.lit("")).alias("task"))
    n = calls(spark, root).groupBy("session_key").agg(F.count("*").alias("calls"), F.count_distinct(F.when(F.col("name").isin("Edit", "Write", "MultiEdit", "NotebookEdit"), F.get_json_object("input", "$.file_path"))).alias("edited"))
    u = usage_session_totals(spark, root).select("session_key", "prompt_tokens", F.col("output").alias("output_tokens"))
    s = first.join(n, "session_key", "left").join(u, "session_key", "left").na.fill(0)
    cols = ("calls", "edited", "prompt_tokens", "output_tokens")
    side = lambda key, tag: s.select(F.col("session_key").alias(key), F.col("task").alias(f"task_{tag}"), *(F.col(c).alias(f"{c}_{tag}") for c in cols))
    x = p.join(side("session_key", "a"), "session_key").join(side("other", "b"), "other")
    same = F.col("task_a") == F.col("task_b")
    return x.select("session_key", "other", same.alias("same_task"), F.when(same, "").otherwise("different tasks: the differences may mislead").alias("note"), *((F.col(f"{c}_b") - F.col(f"{c}_a")).alias(f"{c}_delta") for c in cols))


def command_words(spark: SparkSession, root: str) -> DataFrame:
    """The distinct words of each command that may name commands: words of letters, without those of a stop list."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.get_json_object("input", "$.command")), F.lit(r"\b([a-z][a-z0-9_-]+)\b"), F.lit(1)))
    kept = F.array_except(words, F.array(*map(F.lit, NO_COMMANDS)))
    return calls(spark, root).where("name = 'Bash'").select("call_row", F.array_join(F.array_sort(kept), " ").alias("words")).where("words is not null")


def text_counts(spark: SparkSession, root: str) -> DataFrame:
    """Words of each document, and when it was captured as an offset from its session's first document."""
    d = _docs(spark, root).where("text is not null")
    at = F.unix_micros(F.col("captured_at").cast("timestamp"))
    start = F.min(at).over(Window.partitionBy("session_key"))
    return d.select("doc_id", F.regexp_count("text", F.lit(r"[\p{L}\p{N}_]+")).alias("words"), F.when(F.col("session_key").isNotNull(), fmt.offset(start, at)).alias("after"))


def event_sizes(spark: SparkSession, root: str) -> DataFrame:
    """The characters of each message as compact JSON text, as it was delivered where it is no JSON."""
    e = events(spark, root).select("session_key", "event_idx", F.to_json("v").alias("j"))
    return e.where("j is not null").select("session_key", "event_idx", F.length("j").alias("chars"))


def bounded_listing(spark: SparkSession, root: str) -> DataFrame:
    """The first sixty lines of the listing of sessions, and one that says how many more there are."""
    return _bounded(session_lines(spark, root), "session_key", "line")


def _bounded(df: DataFrame, order: str, line: str) -> DataFrame:
    top = df.orderBy(order).limit(ROWS).select(order, line)
    more = df.agg((F.count("*") - ROWS).alias("_m")).where("_m > 0").select(F.lit("~").alias(order), F.format_string("... and %d more", F.col("_m")).alias(line))
    return top.unionByName(more)


def hook_sessions(spark: SparkSession, root: str) -> DataFrame:
    """The sessions of the hook log: records, first and last time, and the prompt first recorded."""
    us = iso_micros(F.col("ts"))
    h = _hooks(spark, root).where("session_id is not null").select("session_id", "hook_row", us.alias("us"), "prompt_id")
    return h.groupBy("session_id").agg(F.count("*").alias("records"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.min_by("prompt_id", F.when(F.col("prompt_id").isNotNull(), F.col("hook_row"))).alias("label"))


_ALL = (
    newest_transcripts, hook_logs, at_references, named_files, folder_units, newest_documents, check_sidecars, find_guides, hook_payloads, read_coverage, coverage_totals, timeline_shown, nonresident_requests, listed_files, loads_in_context, load_notes, agent_rows, agent_groups, agent_details, lane_occupancy,
    session_blocks, block_changes, block_details, file_details, compare_sessions, command_words, text_counts, event_sizes, bounded_listing, hook_sessions,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_EV = f"SELECT session_key, event_idx, cwd, {micros('ts')} AS us FROM transcript_event QUALIFY row_number() OVER (PARTITION BY session_key, event_idx ORDER BY arrived_at, line_id) = 1"
_RESOLVED = "FROM (SELECT {keys}, ref, unnest([{{'r': 0, 'p': ref}}, " + ", ".join(f"{{{{'r': {i}, 'p': '{r}/' || ref}}}}" for i, r in enumerate(ROOTS, 1)) + "]) AS t FROM refs) WHERE t.p IN (SELECT path FROM documents WHERE path IS NOT NULL)"
_C = "WITH " + CALLS[2:]
_COVER = EVENTS + CALLS + f""", st AS (SELECT tool_use_id AS id, max(try_cast(stats->>'$.lines' AS BIGINT)) AS total FROM hook_record WHERE stats IS NOT NULL AND tool_use_id IS NOT NULL GROUP BY 1),
rp AS (SELECT i->>'$.tool_use_id' AS id, bool_or({" OR ".join(f"contains(lower(CAST(i->'$.content' AS VARCHAR)), '{p}')" for p in PARTIAL)}) AS reported FROM item WHERE kind = 'tool_result' GROUP BY 1),
cv AS (SELECT session_key, call_row, try_cast(input->>'$.offset' AS BIGINT) AS o, try_cast(input->>'$.limit' AS BIGINT) AS l, total, coalesce(reported, false) AS reported FROM c LEFT JOIN st ON st.id = c.id LEFT JOIN rp ON rp.id = c.id WHERE name = 'Read'),
ck AS (SELECT *, CASE WHEN o IS NOT NULL OR l IS NOT NULL THEN 'partial_by_request' WHEN total > {CAP} THEN 'likely_truncated' WHEN reported THEN 'reported_partial' ELSE 'full' END AS kind FROM cv)"""
_FAN = """, rw AS (SELECT session_key, event_idx AS place, 0 AS k, 'turn' AS kind, CAST(event_idx AS VARCHAR) AS ref FROM pr WHERE prompt IS NOT NULL UNION ALL SELECT session_key, place, CASE WHEN opens THEN 1 ELSE 2 END, CASE WHEN opens THEN 'spawn' ELSE 'return' END, spawn FROM steps),
n AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY place, k, ref) AS n FROM rw)"""
_AG = _AGENTS.replace("WITH c AS", ", c AS", 1)
_SHORT = lambda n: f"CASE WHEN {n} < 1000 THEN CAST({n} AS VARCHAR) WHEN {n} < 10000 THEN printf('%.1fk', {n} / 1e3) WHEN {n} < 1000000 THEN printf('%.0fk', {n} / 1e3) ELSE printf('%.1fM', {n} / 1e6) END"
_TOOK = lambda s: f"CASE WHEN {s} < 60 THEN {s} || 's' WHEN {s} < 3600 THEN printf('%dm%02ds', {s} // 60, {s} % 60) ELSE printf('%dh%02dm', {s} // 3600, {s} % 3600 // 60) END"
_NORM = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(path, '^{WS}+|{WS}+$', '', 'g'), '/+', '/', 'g'), '(/\.)+(/|$)', '\2', 'g'), '(.)/$', '\1')"
_BODY = f", body AS (SELECT b.doc_id, b.block_idx, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE n > start_line), ''), '^{WS}+|{WS}+$', '', 'g') AS content FROM b JOIN blocks k ON k.doc_id = b.doc_id AND k.block_idx = b.block_idx GROUP BY 1, 2)"
ORACLES: dict[str, str] = {
    "newest_transcripts": f"WITH s AS (SELECT session_key, arg_min(cwd, event_idx) FILTER (WHERE cwd IS NOT NULL) AS cwd, max(us) AS last_us FROM ({_EV}) GROUP BY 1) SELECT translate(cwd, '/.', '--') AS folder, arg_max(session_key, (coalesce(last_us, -4611686018427387904), session_key)) AS session_key, max(last_us) AS last_us, count(*) AS sessions FROM s WHERE cwd IS NOT NULL GROUP BY 1",
    "hook_logs": "WITH g AS (SELECT session_id, count(*) FILTER (WHERE coalesce(agent_id, '') = '' AND event = 'InstructionsLoaded') AS loads, count(*) FILTER (WHERE coalesce(agent_id, '') = '' AND event IN ('PreCompact', 'PostCompact')) AS compactions FROM hook_record WHERE session_id IS NOT NULL GROUP BY 1) SELECT session_key, session_id IS NOT NULL AS has_log, loads, compactions FROM (SELECT DISTINCT session_key FROM transcript_event) LEFT JOIN g ON session_id = session_key",
    "at_references": r"WITH refs AS (SELECT DISTINCT doc_id, ref FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|\W)@([A-Za-z0-9_./-]+\.md)\b', 1)) AS ref FROM documents)), h AS (SELECT doc_id, ref, arg_min(t.p, t.r) AS path " + _RESOLVED.format(keys="doc_id") + " GROUP BY 1, 2) SELECT r.doc_id, r.ref, path FROM refs r LEFT JOIN h ON h.doc_id = r.doc_id AND h.ref = r.ref",
    "named_files": _C + r""", refs AS (SELECT DISTINCT source, row_id, ref FROM (SELECT 'document' AS source, doc_id AS row_id, unnest(regexp_extract_all(text, '((?:[\w.-]+/)+[\w-]+\.\w+)', 1)) AS ref FROM documents
  UNION ALL SELECT 'command', call_row, unnest(regexp_extract_all(input->>'$.command', '((?:[\w.-]+/)+[\w-]+\.\w+)', 1)) FROM c WHERE name = 'Bash' AND json_valid(input)))
SELECT source, row_id, ref, arg_min(t.p, t.r) AS path """ + _RESOLVED.format(keys="source, row_id") + " GROUP BY 1, 2, 3",
    "folder_units": r"SELECT folder, name, arg_min(path, (ends_with(path, '/SKILL.md'), path)) AS path FROM (SELECT path, split_part(path, '/', 1) AS folder, regexp_extract(path, '^[^/]+/([^/]+?)(?:\.md|/SKILL\.md)$', 1) AS name FROM documents WHERE path IS NOT NULL) WHERE name <> '' AND folder IN (" + ", ".join(f"'{f}'" for f in FOLDERS) + ") GROUP BY 1, 2",
    "newest_documents": "SELECT string_split(path, '/')[-1] AS key, arg_max(path, (captured_at, path)) AS path FROM documents WHERE path IS NOT NULL AND string_split(path, '/')[-1] <> '' GROUP BY 1",
    "check_sidecars": r"WITH p AS (SELECT DISTINCT path FROM documents WHERE path IS NOT NULL) SELECT path, coalesce((SELECT min(path) FROM p b WHERE b.path = a.path || '.checks.json'), (SELECT min(path) FROM p b WHERE b.path = regexp_replace(a.path, '\.[^./]*$', '') || '.checks.json')) AS sidecar FROM p a",
    "find_guides": "SELECT DISTINCT path, doc_kind FROM documents WHERE path IS NOT NULL AND (ends_with(path, '.md') OR doc_kind IN ('rule', 'global', 'project', 'skill')) AND NOT regexp_matches(path, '(^|/)(\\.git|node_modules|vendor|dist|build)/')",
    "hook_payloads": r"""WITH v AS (SELECT line_id, CAST(line AS JSON) AS j FROM log_line WHERE file_id IN (SELECT file_id FROM log_file WHERE kind = 'hook') AND json_valid(line) AND json_type(line) = 'OBJECT'),
k AS (SELECT *, CASE WHEN coalesce(json_type(j, '$.tool_response'), 'NULL') <> 'NULL' THEN 'tool_response' WHEN coalesce(json_type(j, '$.tool_result'), 'NULL') <> 'NULL' THEN 'tool_result' WHEN coalesce(json_type(j, '$.response'), 'NULL') <> 'NULL' THEN 'response' END AS response_key FROM v),
s AS (SELECT *, json_type(j, '$.' || response_key) AS t FROM k)
SELECT line_id, j->>'$.hook_event_name' AS event, j->>'$.session_id' AS session_id, j->>'$.tool_name' AS tool, j->>'$.tool_use_id' AS tool_use_id, response_key, CASE WHEN t = 'VARCHAR' THEN 'text' WHEN t IS NOT NULL THEN 'json' END AS response_kind,
  CASE WHEN t = 'VARCHAR' THEN length(json_extract_string(j, '$.' || response_key)) END AS text_chars FROM s""",
    "read_coverage": _COVER + f" SELECT call_row, kind, CASE kind WHEN 'partial_by_request' THEN 'lines ' || coalesce(o, 1) || '-' || coalesce(CAST(coalesce(o, 1) + l - 1 AS VARCHAR), '?') || ' of ' || coalesce(CAST(total AS VARCHAR), '?') WHEN 'likely_truncated' THEN 'lines 1-{CAP} of ' || total WHEN 'reported_partial' THEN 'reported as a partial view' ELSE coalesce('full (' || total || ' lines)', 'full') END AS label FROM ck",
    "coverage_totals": _COVER + " SELECT session_key, kind, count(*) AS reads FROM ck GROUP BY 1, 2",
    "agent_rows": TURNS + _AG + _FAN + " SELECT session_key, n - 1 AS step, kind, ref, kind = 'spawn' AND NOT EXISTS (SELECT 1 FROM n b WHERE b.session_key = n.session_key AND b.kind = 'return' AND b.ref = n.ref) AS dangling FROM n",
    "agent_details": _AGENTS + f""", sd AS (SELECT session_key, id AS spawn, arg_min(coalesce(input->>'$.subagent_type', '-'), event_idx) AS agent_type, arg_min(coalesce(input->>'$.description', '-'), event_idx) AS description FROM c WHERE name IN ('Agent', 'Task', 'Workflow') AND id IS NOT NULL GROUP BY 1, 2),
ls AS (SELECT session_key, tool_use_id AS spawn, arg_max({{'status': status, 't': subagent_tokens, 's': CAST(round(duration_ms / 1000) AS BIGINT)}}, (place, return_row)) AS r, count(*) AS reports FROM pl WHERE tool_use_id IS NOT NULL GROUP BY 1, 2)
SELECT sd.session_key, sd.spawn, agent_type, description, CASE WHEN reports IS NULL THEN 'no reply' ELSE 'returned' END AS label, coalesce(r.status, '-') AS status, coalesce(CASE WHEN r.t IS NOT NULL THEN {_SHORT('r.t')} END, '-') AS tokens, coalesce(CASE WHEN r.s IS NOT NULL THEN {_TOOK('r.s')} END, '-') AS took, coalesce(reports, 0) AS reports
FROM sd LEFT JOIN ls ON ls.session_key = sd.session_key AND ls.spawn = sd.spawn""",
    "listed_files": EVENTS + r""", la AS (SELECT session_key, CAST(attachment AS JSON) AS a FROM ev WHERE json_valid(attachment) AND json_type(attachment) = 'OBJECT'),
ln AS (SELECT DISTINCT session_key, n AS name FROM (SELECT session_key, unnest(list_filter(list_transform(string_split(a->>'$.content', chr(10)), lambda x: regexp_extract(trim(x), '^-\s+([A-Za-z0-9][\w:.-]*?)(?::\s+.*)?$', 1)), lambda x: x <> '')) AS n FROM la WHERE a->>'$.type' = 'skill_listing')),
f AS (SELECT regexp_extract(path, '(?:^|/)([^/]+?)(?:/SKILL)?\.[^./]+$', 1) AS name, arg_min(path, (ends_with(path, '/SKILL.md'), path)) AS path FROM documents WHERE path IS NOT NULL GROUP BY 1)
SELECT session_key, ln.name, path FROM ln LEFT JOIN f ON f.name = ln.name AND f.name <> ''""",
    "loads_in_context": f"WITH d AS (SELECT {_NORM} AS p, min(doc_id) AS doc_id, count(*) AS documents FROM documents WHERE path IS NOT NULL GROUP BY 1), l AS (SELECT hook_row, {_NORM} AS path FROM hook_record WHERE event = 'InstructionsLoaded' AND path IS NOT NULL) SELECT hook_row, path, doc_id, coalesce(documents, 0) AS documents FROM l LEFT JOIN d ON p = path",
    "load_notes": "SELECT hook_row, CASE load_reason " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NOTES.items()) + " ELSE CASE WHEN load_reason <> '' THEN 'loaded (' || load_reason || ')' ELSE 'recorded as loaded' END END || CASE WHEN coalesce(memory_type, '') <> '' THEN ', ' || memory_type || ' memory' ELSE '' END AS note FROM hook_record WHERE event = 'InstructionsLoaded'",
    "session_blocks": _LINES + " SELECT session_key, row_number() OVER (PARTITION BY session_key ORDER BY coalesce(path, ''), doc_id, block_idx) - 1 AS place, coalesce(path, '') AS path, doc_id, block_idx, title, start_line, end_line FROM blocks JOIN documents USING (doc_id) WHERE session_key IS NOT NULL",
    "block_changes": flows._PAIRS + f""", b AS (SELECT session_key, coalesce(path, '') AS path, title, sum(chars) AS chars FROM ({_LINES + _BODY} SELECT k.doc_id, title, length(content) AS chars FROM blocks k JOIN body d ON d.doc_id = k.doc_id AND d.block_idx = k.block_idx) x JOIN documents d ON d.doc_id = x.doc_id WHERE session_key IS NOT NULL GROUP BY 1, 2, 3),
x AS (SELECT p.session_key AS pair, path, title, chars FROM p JOIN b ON b.session_key = p.session_key), y AS (SELECT p.session_key AS pair, path, title, chars FROM p JOIN b ON b.session_key = p.other)
SELECT coalesce(x.pair, y.pair) AS pair, coalesce(x.path, y.path) AS path, coalesce(x.title, y.title) AS title, CASE WHEN x.pair IS NULL THEN 'added' WHEN y.pair IS NULL THEN 'removed' ELSE 'changed' END AS change, CAST(x.chars AS BIGINT) AS value_a, CAST(y.chars AS BIGINT) AS value_b
FROM x FULL JOIN y ON x.pair = y.pair AND x.path = y.path AND x.title = y.title WHERE x.pair IS NULL OR y.pair IS NULL OR x.chars <> y.chars""",
    "block_details": _LINES + _BODY + " SELECT k.doc_id, k.block_idx, title, level, start_line, end_line, length(content) AS chars, len(list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '')) AS filled_lines, len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(ltrim(x), '^[-*+] '))) AS item_lines FROM blocks k JOIN body d ON d.doc_id = k.doc_id AND d.block_idx = k.block_idx",
    "file_details": _C + """, u AS (SELECT session_key, input->>'$.file_path' AS path, (name = 'Read')::INT AS r, (name <> 'Read')::INT AS e, 0 AS l FROM c WHERE name IN ('Read', 'Edit', 'Write', 'MultiEdit') AND json_valid(input)
  UNION ALL SELECT session_id, path, 0, 0, 1 FROM hook_record WHERE event = 'InstructionsLoaded' AND session_id IS NOT NULL), g AS (SELECT session_key, path, CAST(sum(r) AS BIGINT) AS reads, CAST(sum(e) AS BIGINT) AS edits, CAST(sum(l) AS BIGINT) AS loads FROM u WHERE path IS NOT NULL GROUP BY 1, 2)
SELECT *, CASE WHEN edits > 0 THEN 'active' ELSE 'quiet' END AS use, loads > 0 AS loaded FROM g""",
    "compare_sessions": TURNS + CALLS + """, br AS (SELECT session_key, arg_min(git_branch, event_idx) FILTER (WHERE git_branch IS NOT NULL) AS git_branch FROM ev GROUP BY 1),
p AS (SELECT * FROM (SELECT session_key, lead(session_key) OVER (PARTITION BY git_branch ORDER BY session_key) AS other FROM br WHERE git_branch IS NOT NULL) WHERE other IS NOT NULL),
f AS (SELECT session_key, coalesce(lower(trim(regexp_replace(arg_min(prompt, event_idx) FILTER (WHERE prompt IS NOT NULL), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))), '') AS task FROM pr GROUP BY 1),
n AS (SELECT session_key, count(*) AS calls, count(DISTINCT CASE WHEN name IN ('Edit', 'Write', 'MultiEdit', 'NotebookEdit') THEN input->>'$.file_path' END) AS edited FROM c GROUP BY 1),
u AS (SELECT session_key, sum(input + cache_read + cache_creation) AS prompt_tokens, sum(output) AS output_tokens FROM series GROUP BY 1),
s AS (SELECT f.session_key, task, coalesce(calls, 0) AS calls, coalesce(edited, 0) AS edited, coalesce(prompt_tokens, 0) AS prompt_tokens, coalesce(output_tokens, 0) AS output_tokens FROM f LEFT JOIN n ON n.session_key = f.session_key LEFT JOIN u ON u.session_key = f.session_key)
SELECT p.session_key, other, a.task = b.task AS same_task, CASE WHEN a.task = b.task THEN '' ELSE 'different tasks: the differences may mislead' END AS note, b.calls - a.calls AS calls_delta, b.edited - a.edited AS edited_delta, CAST(b.prompt_tokens - a.prompt_tokens AS BIGINT) AS prompt_tokens_delta, CAST(b.output_tokens - a.output_tokens AS BIGINT) AS output_tokens_delta
FROM p JOIN s a ON a.session_key = p.session_key JOIN s b ON b.session_key = other""",
    "timeline_shown": f"SELECT session_key, kind, count(*) AS n_rows, min(place) AS first_place FROM ({flows.ORACLES['timeline_rows']}) WHERE kind <> 'tool-result' GROUP BY 1, 2",
    "nonresident_requests": f"SELECT r.session_key, probe AS turn_idx, key, request_id FROM ({flows.ORACLES['residency_asof']}) r JOIN ({TURNS} SELECT DISTINCT session_key, turn_idx, request_id FROM turned WHERE turn_idx IS NOT NULL AND request_id IS NOT NULL) t ON t.session_key = r.session_key AND t.turn_idx = probe WHERE NOT resident",
    "agent_groups": f"SELECT s.session_key, s.spawn, first_row, size FROM ({_AGENTS} SELECT session_key, spawn FROM fi) s LEFT JOIN (SELECT session_key, first_row, size, unnest(string_split(members, ',')) AS spawn FROM ({flows.ORACLES['fanout_groups']})) g ON g.session_key = s.session_key AND g.spawn = s.spawn",
    "lane_occupancy": flows.OCCUPANCY,
    "event_sizes": EVENTS + " SELECT session_key, event_idx, length(CAST(json(message) AS VARCHAR)) AS chars FROM ev WHERE m IS NOT NULL",
    "bounded_listing": f"WITH l AS ({reports.ORACLES['session_lines']}) SELECT * FROM (SELECT session_key, line FROM l ORDER BY session_key LIMIT {ROWS}) UNION ALL SELECT '~', '... and ' || (count(*) - {ROWS}) || ' more' FROM l HAVING count(*) > {ROWS}",
    "command_words": _C + " SELECT call_row, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(input->>'$.command'), '\\b([a-z][a-z0-9_-]+)\\b', 1)), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in NO_COMMANDS) + "))), ' ') AS words FROM c WHERE name = 'Bash' AND json_valid(input) AND input->>'$.command' IS NOT NULL",
    "text_counts": f"WITH d AS (SELECT doc_id, session_key, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS words, greatest(0, (epoch_us(captured_at) - min(epoch_us(captured_at)) OVER (PARTITION BY session_key)) // 1000000) AS s FROM documents WHERE text IS NOT NULL) SELECT doc_id, words, CASE WHEN session_key IS NOT NULL THEN '+' || {_TOOK('s')} END AS after FROM d",
    "hook_sessions": f"SELECT session_id, count(*) AS records, min({micros('ts')}) AS first_us, max({micros('ts')}) AS last_us, arg_min(prompt_id, hook_row) FILTER (WHERE prompt_id IS NOT NULL) AS label FROM hook_record WHERE session_id IS NOT NULL GROUP BY 1",
}
