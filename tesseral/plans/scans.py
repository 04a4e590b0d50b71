"""Queries that scan raw JSONL files: the lines of the log tables, written as the files they came from."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.session import _cuts, shared_folder, table
from tesseral.sources import transcripts as tr


def export_logs(spark: SparkSession, root: str, kind: str) -> str:
    """Writes the lines of one kind of log as text, a folder a file, in order; returns the folder in the shared folder.

    A file's lines are sorted in one task, as a file on disk is one sequence.
    """
    files = table(spark, root, "log_file").where(F.col("kind") == kind).select("file_id").distinct()
    lines = table(spark, root, "log_line").where("line is not null").join(files, "file_id").select("file_id", "line_no", "line_id", F.col("line").alias("value"))
    path = f"{shared_folder(spark)}/tesseral-{uuid.uuid4().hex}"
    lines.repartition("file_id").sortWithinPartitions("file_id", "line_no", "line_id").select("value", "file_id").write.partitionBy("file_id").text(path)
    _cuts.append(path)
    return path


def _of_folder(column: str) -> Column:
    return F.regexp_extract(column, r"file_id=(\d+)/", 1).cast("bigint")


def scan_transcripts(spark: SparkSession, root: str) -> DataFrame:
    raw = tr.read_jsonl(spark, export_logs(spark, root, "transcript"))
    rows = tr.transcript_rows(raw.withColumn("session_key", F.col("file")))
    return rows.select(_of_folder("session_key").alias("file_id"), "event_idx", "type", "session_id", "request_id")


def scan_hook_logs(spark: SparkSession, root: str) -> DataFrame:
    s = lambda k: F.try_variant_get("v", f"$.{k}", "string")
    raw = tr.read_jsonl(spark, export_logs(spark, root, "hook"))
    return raw.select(_of_folder("file").alias("file_id"), "event_idx", s("hook_event_name").alias("event"), s("session_id").alias("session_id"), s("tool_name").alias("tool"))


def scan_file_stats(spark: SparkSession, root: str) -> DataFrame:
    """Size, lines and hash of each file."""
    s = tr.file_stats(spark, f"{export_logs(spark, root, 'hook')}/file_id=*/*.txt")
    return s.select(_of_folder("path").alias("file_id"), "size_bytes", "lines", "sha256")


def scan_listing(spark: SparkSession, root: str) -> DataFrame:
    """The files there are, by folder; contents are not read."""
    found = tr.list_files(spark, f"{export_logs(spark, root, 'transcript')}/file_id=*", "*.txt")
    return found.groupBy(_of_folder("path").alias("file_id")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


_ALL = (scan_transcripts, scan_hook_logs, scan_file_stats, scan_listing)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_LINES = "WITH f AS (SELECT DISTINCT file_id FROM log_file WHERE kind = '{}'), l AS (SELECT file_id, line_no, line_id, line FROM log_line JOIN f USING (file_id) WHERE line IS NOT NULL), v AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY line_no, line_id) - 1 AS event_idx, CAST(line AS JSON) AS j FROM l WHERE json_valid(line) AND json_type(line) = 'OBJECT')"
ORACLES: dict[str, str] = {
    "scan_transcripts": _LINES.format("transcript") + " SELECT file_id, event_idx, j->>'$.type' AS type, j->>'$.sessionId' AS session_id, j->>'$.requestId' AS request_id FROM v",
    "scan_hook_logs": _LINES.format("hook") + " SELECT file_id, event_idx, j->>'$.hook_event_name' AS event, j->>'$.session_id' AS session_id, j->>'$.tool_name' AS tool FROM v",
    "scan_file_stats": _LINES.format("hook") + " SELECT file_id, CAST(sum(octet_length(encode(line)) + 1) AS BIGINT) AS size_bytes, CAST(count(*) AS INT) AS lines, left(sha256(string_agg(line, chr(10) ORDER BY line_no, line_id) || chr(10)), 16) AS sha256 FROM l GROUP BY 1",
    "scan_listing": _LINES.format("transcript") + " SELECT file_id, 1 AS files, CAST(sum(octet_length(encode(line)) + 1) AS BIGINT) AS bytes FROM l GROUP BY 1",
}
