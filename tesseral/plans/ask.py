"""The query language: an address names a listing, a session, or a part of one; the answer is lines.

    sessions
    <session> | <session> turns | <session> turn-N | <session> blocks | <session> files | <session> agents
    <session> <block id> | <session> <file id> | <session> agent-<id>

``--all`` lifts the bound on rows, ``--field NAME`` gives one field whole. A session is named by any
prefix that only it has; it is resolved first and pushed down, so nothing else is worked on. What
names nothing is an error that says which listing has the valid names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesseral.functions import format as fmt
from tesseral.plans import lookups, reports, sessions
from tesseral.plans.reports import CHARS, ROWS, QueryError, resolve_prefix
from tesseral.session import table

#: The fields of each kind of thing that ``--field`` may name.
FIELDS = {
    "session": ("id", "events", "user_messages", "assistant_messages", "tool_calls", "duration_sec", "git_branch", "cwd", "version"),
    "turn": ("prompt", "events", "calls"),
    "block": ("title", "path", "start_line", "end_line", "chars", "content"),
    "file": ("path", "reads", "edits", "loads", "use"),
    "agent": ("agent_type", "description", "label", "status", "tokens", "took", "reports"),
}


def bound_text(c: Column, more: str, keep: int = CHARS) -> Column:
    """A text up to the bound, with how much is left out and the address that gives it whole."""
    rest = F.format_string(f" … [%d more chars, full value: {more.replace('%', '%%')}]", F.length(c) - keep)
    return F.when(F.length(c) > keep, F.concat(F.substring(c, 1, keep), rest)).otherwise(c)


def bound_rows(lines: DataFrame, more: str, show_all: bool, keep: int = ROWS) -> DataFrame:
    """(place, line) in the order of ``place``, which counts from 0: all, or the first and how many more there are."""
    if show_all:
        return lines.select("place", "line")
    rest = lines.agg(F.count("*").alias("n")).where(F.col("n") > keep).select(F.lit(keep).cast("bigint").alias("place"), F.format_string(f"… %d more rows, full listing: {more.replace('%', '%%')}", F.col("n") - keep).alias("line"))
    return lines.where(F.col("place") < keep).select("place", "line").unionByName(rest)


def _text(c: str | Column) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("-"))


def _details(row: DataFrame, fields: tuple[str, ...], address: str) -> DataFrame:
    """A line a field of the one row."""
    lines = F.array(*(F.struct(F.lit(i).cast("bigint").alias("place"), F.concat(F.lit(f"{f}  "), bound_text(_text(f), f"{address} --field {f}")).alias("line")) for i, f in enumerate(fields)))
    return row.select(F.explode(lines).alias("l")).select("l.*")


def _one(rows: DataFrame, what: str, address: str, listing: str, field: str | None) -> DataFrame:
    """The details of what an address names, or one field of it; an error if it names nothing."""
    if field is not None and field not in FIELDS[what]:
        raise QueryError(f"unknown field {field!r}; valid fields: {', '.join(FIELDS[what])}")
    row = rows.limit(1)
    if row.isEmpty():
        raise QueryError(f"{address!r} names no {what}; list them with: {listing}")
    return row.select(F.lit(0).cast("bigint").alias("place"), _text(field).alias("line")) if field else _details(row, FIELDS[what], address)


def _numbered(df: DataFrame, order: list[str | Column], line: Column) -> DataFrame:
    return df.withColumn("place", (F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint")).select("place", line.alias("line"))


def blocks_of(spark: SparkSession, root: str, sid: str) -> DataFrame:
    """The blocks of a session's documents with their ids."""
    from tesseral.sources import documents as docs

    mine = table(spark, root, "documents").where(F.col("session_key") == sid)
    b = docs.markdown_blocks(mine, "doc_id", "text").join(mine.select("doc_id", "path"), "doc_id")
    name = F.coalesce(fmt.file_slug(F.col("path")), F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
    return b.select(F.concat_ws("-", name, F.col("block_idx").cast("string"), fmt.title_slug(F.col("title"))).alias("id"), "doc_id", "block_idx", "path", "title", "start_line", "end_line", F.length("content").alias("chars"), "content")


def ask(spark: SparkSession, root: str, address: str) -> DataFrame:
    """(place, line): the answer to an address."""
    words = address.split()
    show_all = "--all" in words
    field = None
    if "--field" in words:
        at = words.index("--field")
        if at + 1 >= len(words):
            raise QueryError("--field needs a name")
        field = words[at + 1]
        del words[at : at + 2]
    parts = [w for w in words if w != "--all"]
    if not parts:
        raise QueryError("empty address; list sessions with: sessions")
    if parts == ["sessions"]:
        return bound_rows(_numbered(reports.session_lines(spark, root), ["session_key"], F.col("line")), "sessions --all", show_all)
    sid = resolve_prefix(table(spark, root, "transcript_event"), "session_key", parts[0])
    if len(parts) > 2:
        raise QueryError(f"too many parts in {address!r}; use: {sid[:8]} turns|blocks|files|agents, or one id")
    mine, what = F.col("session_key") == sid, parts[1] if len(parts) > 1 else ""
    full = f"{sid[:8]} {what}".strip()
    if not what:
        return _one(sessions.session_summary(spark, root).where(mine), "session", full, "sessions", field)
    if what == "turns":
        from tesseral.plans.actions import turn_briefs

        t = turn_briefs(spark, root).where(mine)
        line = F.concat_ws("  ", F.concat(F.lit("turn-"), F.col("turn_idx").cast("string")), F.concat(_text("events"), F.lit(" events")), F.concat(_text("calls"), F.lit(" calls")), "preview")
        return bound_rows(t.select(F.col("turn_idx").alias("place"), line.alias("line")), f"{full} --all", show_all)
    if what.startswith("turn-"):
        number = int(what[5:]) if what[5:].isdigit() else -1
        t = sessions.turned(spark, root).where(mine & (F.col("turn_idx") == number))
        uses = F.size(F.filter("items", lambda i: i["kind"] == "tool_use"))
        g = t.groupBy("session_key").agg(F.min_by("turn_prompt", "event_idx").alias("prompt"), F.count("*").alias("events"), F.sum(uses).alias("calls"))
        return _one(g, "turn", full, f"{sid[:8]} turns", field)
    if what == "blocks":
        b = blocks_of(spark, root, sid)
        return bound_rows(_numbered(b, [F.coalesce("path", F.lit("")), "doc_id", "block_idx"], F.concat_ws("  ", "id", _text("path"), "title")), f"{full} --all", show_all)
    if what == "files":
        f = lookups.file_details(spark, root).where(mine)
        return bound_rows(_numbered(f, ["use", "path"], F.concat_ws("  ", fmt.file_slug(F.col("path")), F.concat(F.lit("["), "use", F.lit("]")), "path", F.format_string("%d reads, %d edits", "reads", "edits"))), f"{full} --all", show_all)
    if what == "agents":
        a = lookups.agent_details(spark, root).where(mine)
        return bound_rows(_numbered(a, ["spawn"], F.concat_ws("  ", F.concat(F.lit("agent-"), "spawn"), "agent_type", "label", "tokens", "took")), f"{full} --all", show_all)
    if what.startswith("agent-"):
        return _one(lookups.agent_details(spark, root).where(mine & (F.col("spawn") == what[6:])), "agent", full, f"{sid[:8]} agents", field)
    block = blocks_of(spark, root, sid).where(F.col("id") == what)
    if not block.isEmpty():
        return _one(block, "block", full, f"{sid[:8]} blocks", field)
    return _one(lookups.file_details(spark, root).where(mine & (fmt.file_slug(F.col("path")) == what)), "file", full, f"{sid[:8]} blocks, or: {sid[:8]} files", field)
