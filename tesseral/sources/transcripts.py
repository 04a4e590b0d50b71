"""Session transcripts and hook logs as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesseral.functions.messages import is_stdout, items, prompt_text, user_text
from tesseral.functions.text import iso_micros, strip
from tesseral.functions.variant import parse_object
from tesseral.operators.blocks import _carried, block_of

LINE_END = r"\r\n|\n|\r"


def project_folder(cwd: Column) -> Column:
    """The folder name a working directory's sessions are kept under."""
    return F.translate(cwd, "/.", "--")


def list_files(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> DataFrame:
    """(path, stem, modified, length) of a folder's own files, newest first; contents are not read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return df.select("path", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stem"), F.col("modificationTime").alias("modified"), "length").orderBy(F.desc("modified"), "path")


def read_jsonl(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(session_key, event_idx, v, file): the objects of JSONL files in order; blank and broken lines are left out.

    A row's number counts the surviving lines of its own file. A large file is read in blocks by
    several tasks: lines are numbered inside their block, after those of the blocks before.
    """
    at = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    lines = spark.read.text(paths).select(*at, "value", F.monotonically_increasing_id().alias("pos")).select("file", "block", "pos", parse_object(F.col("value")).alias("v")).where("v is not null")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.groupBy("file", "block").agg(F.count("*").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = lines.withColumn("n", F.row_number().over(Window.partitionBy("file", "block").orderBy("pos")) - 1)
    key = F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("session_key")
    return inside.join(starts, ["file", "block"]).select(key, (F.col("start") + F.col("n")).cast("bigint").alias("event_idx"), "v", "file")


def transcript_rows(raw: DataFrame) -> DataFrame:
    """The raw objects of :func:`read_jsonl` with the columns of a delivered table."""
    s = lambda p: F.try_variant_get("v", p, "string")
    return raw.select(
        "session_key", "event_idx", s("$.type").alias("type"), s("$.timestamp").alias("ts"), F.try_variant_get("v", "$.isMeta", "boolean").alias("is_meta"), s("$.sessionId").alias("session_id"), s("$.gitBranch").alias("git_branch"),
        s("$.cwd").alias("cwd"), s("$.version").alias("version"), s("$.requestId").alias("request_id"), s("$.message").alias("message"), s("$.attachment").alias("attachment"),
    )


def first_copies(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the first by ``order``: a partial aggregation, so hot keys shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_k")).select(*keys, *(f"_k.{c}" for c in [*order, *rest]))


EVENT_COLUMNS = ("session_id", "git_branch", "cwd", "version", "attachment")


def events(delivered: DataFrame, keep: tuple[str, ...] = EVENT_COLUMNS) -> DataFrame:
    """One parsed row an event: time in microseconds, message ``v``, its usage and its items.

    Of the columns that not every operator needs those to ``keep`` are carried; the others are
    neither read nor shuffled. The usage stands beside the message, so that operators on usage
    leave the message behind before they sort.
    """
    cols = ["session_key", "event_idx", "type", "ts", "is_meta", "request_id", *keep]
    copies = [c for c in ("arrived_at", "line_id") if c in delivered.columns]
    one = delivered.select(*cols, "message", *copies)
    one = first_copies(one, ["session_key", "event_idx"], copies) if copies else one
    v = parse_object(F.col("message")).alias("v")
    parsed = one.select(*cols, iso_micros(F.col("ts")).alias("us"), v)
    return parsed.withColumns({"items": items(F.col("v")), "usage": F.try_variant_get("v", "$.usage", "variant")})


def prompts(ev: DataFrame) -> DataFrame:
    """Adds user_text and prompt (null where the event states none)."""
    t = ev.withColumn("user_text", F.when(F.col("type") == "user", user_text(F.col("v"), F.col("items")))).withColumn("_b", block_of("event_idx"))
    # The event after a block's last is the first of the next block, which a table of one row a block knows.
    output = is_stdout(F.col("user_text"))
    first = t.groupBy("session_key", "_b").agg(F.min(F.struct("event_idx", output.alias("o")))["o"].alias("_o")).select("session_key", "_b", F.lead("_o").over(Window.partitionBy("session_key").orderBy("_b")).alias("_after"))
    inside = Window.partitionBy("session_key", "_b").orderBy("event_idx")
    x = _carried(t.withColumn("_next", F.lead(output).over(inside)), first, ["session_key"])
    return x.withColumn("prompt", prompt_text(F.col("type"), F.col("is_meta"), F.col("user_text"), F.coalesce("_next", "_after", F.lit(False)))).drop("_b", "_next", "_after")


def hook_facts(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(instruction loads, compactions) of a hook log's main agent: rows with an agent_id are dropped."""
    main = log.where(F.coalesce(F.col("agent_id"), F.lit("")) == "")
    return main.where("event = 'InstructionsLoaded'"), main.where("event in ('PreCompact', 'PostCompact')")


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the given order."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_k")).select(*keys, *(f"_k.{c}" for c in [*order, *rest]))


def file_stats(spark: SparkSession, paths: str | list[str], limit: int = 20 << 20) -> DataFrame:
    """(path, size_bytes, lines, sha256): lines and the first 16 digits of the hash, null above ``limit`` bytes."""
    f = spark.read.format("binaryFile").load(paths)
    text = F.decode("content", "ISO-8859-1")
    n = F.length(text) - F.length(F.replace(text, F.lit("\n"))) + F.when((F.length(text) > 0) & ~text.endswith("\n"), 1).otherwise(0)
    small = F.col("length") <= limit
    return f.select("path", F.col("length").alias("size_bytes"), F.when(small, n).alias("lines"), F.when(small, F.substring(F.sha2("content", 256), 1, 16)).alias("sha256"))


def attachments(ev: DataFrame) -> DataFrame:
    """(session_key, event_idx, kind, path, content, count): the attachments in one table, whatever their kind."""
    a = ev.select("session_key", "event_idx", parse_object(F.col("attachment")).alias("a")).where("a is not null")
    s = lambda p: F.try_variant_get("a", p, "string")
    return a.select(
        "session_key", "event_idx", s("$.type").alias("kind"), F.coalesce(s("$.content.path"), s("$.content.file.filePath")).alias("path"),
        F.coalesce(s("$.content.file.content"), s("$.content.content"), s("$.content")).alias("content"), F.try_variant_get("a", "$.skillCount", "bigint").alias("count"), F.try_variant_get("a", "$.content.contentDiffersFromDisk", "boolean").alias("drift"),
    )


def listed_names(content: Column) -> Column:
    """The names of a listing's lines ``- name: description``."""
    return F.filter(F.transform(F.split(content, LINE_END), lambda x: F.regexp_extract(strip(x), r"^-\s+([A-Za-z0-9][\w:.-]*?)(?::\s+.*)?$", 1)), lambda x: x != "")
