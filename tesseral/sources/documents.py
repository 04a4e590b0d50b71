"""Markdown documents as blocks, and what they refer to."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesseral.functions.text import strip
from tesseral.sources.transcripts import LINE_END

# Patterns of headings, fences, references and file names in markdown.
HEADING = r"^(#{1,2})\s+(.*?)\s*$"
FENCE = r"^\s*(```|~~~)"
AT_REFERENCE = r"(?<!\w)@([A-Za-z0-9_./-]+\.md)\b"
MD_NAME = r"\b([A-Za-z0-9_][\w./-]*\.md)\b"


def lines(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, line_no from 1, line)."""
    return df.where(F.col(text).isNotNull()).select(F.col(doc), F.posexplode(F.split(F.col(text), LINE_END)).alias("_p", "line")).select(doc, (F.col("_p") + 1).alias("line_no"), "line")


def markdown_blocks(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, block_idx, title, level, content, start_line, end_line): a block from each first or second level heading.

    Headings inside fences are text; what stands before the first heading is no block. Whether a
    line is in a fence and in which block are running counts over the document's lines.
    """
    w = Window.partitionBy(doc).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = lines(df, doc, text).withColumn("_f", F.col("line").rlike(FENCE))
    x = x.withColumn("_in", (F.sum(F.when(F.col("_f"), 1).otherwise(0)).over(w) % 2 == 1) | F.col("_f"))
    x = x.withColumn("_h", ~F.col("_in") & F.col("line").rlike(HEADING)).withColumn("block_idx", F.sum(F.when(F.col("_h"), 1).otherwise(0)).over(w))
    g = x.where("block_idx > 0").groupBy(doc, "block_idx").agg(
        F.min(F.struct("line_no", "line"))["line"].alias("_head"), F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_l")
    )
    body = F.array_join(F.transform(F.slice("_l", 2, F.greatest(F.size("_l") - 1, F.lit(0))), lambda r: r["line"]), "\n")
    return g.select(doc, (F.col("block_idx") - 1).cast("int").alias("block_idx"), F.regexp_extract("_head", HEADING, 2).alias("title"), F.length(F.regexp_extract("_head", HEADING, 1)).alias("level"), strip(body).alias("content"), "start_line", "end_line")


def references(df: DataFrame, doc: str, text: str, pattern: str = AT_REFERENCE) -> DataFrame:
    """(doc, ref): the distinct files a document names, in no order."""
    return df.select(doc, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)))).alias("ref"))


def resolve(refs: DataFrame, files: DataFrame, roots: list[str]) -> DataFrame:
    """(…, path): each reference by the first root under which the file exists; absolute ones as they are.

    ``files`` (path) lists what exists; the roots are few.
    """
    tries = F.explode(F.array(F.struct(F.lit(-1).alias("_r"), F.col("ref").alias("path")), *(F.struct(F.lit(i).alias("_r"), F.concat(F.lit(r.rstrip("/") + "/"), F.col("ref")).alias("path")) for i, r in enumerate(roots))))
    x = refs.select("*", tries.alias("_t")).select(*refs.columns, "_t.*").join(files.select("path").distinct(), "path", "left_semi")
    return x.groupBy(*refs.columns).agg(F.min(F.struct("_r", "path"))["path"].alias("path"))


def units(files: DataFrame, folder: str) -> DataFrame:
    """(name, path): the units of a folder, ``<name>.md`` or ``<name>/SKILL.md``; a file wins over a folder of its name."""
    inside = F.regexp_extract("path", "^" + _quoted(folder.rstrip("/") + "/") + r"([^/]+?)(?:\.md|/SKILL\.md)$", 1)
    x = files.select(inside.alias("name"), "path").where("name <> ''")
    return x.groupBy("name").agg(F.min(F.struct(F.col("path").endswith("/SKILL.md").alias("_s"), "path"))["path"].alias("path"))


def newest(files: DataFrame, pattern: str) -> DataFrame:
    """(key, path): of the files whose path matches, the one modified last for each first group of the pattern."""
    x = files.select(F.regexp_extract("path", pattern, 1).alias("key"), "path", "modified").where("key <> ''")
    return x.groupBy("key").agg(F.max(F.struct("modified", "path"))["path"].alias("path"))


def sidecars(documents: DataFrame, files: DataFrame, suffix: str = ".checks.json") -> DataFrame:
    """(path, sidecar): the file of checks beside each document, by its full name first, then by its stem; null if none."""
    names = F.array(F.struct(F.lit(0).alias("_r"), F.concat("path", F.lit(suffix)).alias("sidecar")), F.struct(F.lit(1).alias("_r"), F.concat(F.regexp_replace("path", r"\.[^./]*$", ""), F.lit(suffix)).alias("sidecar")))
    tries = documents.select("path", F.explode(names).alias("_t")).select("path", "_t.*")
    hit = tries.join(files.select(F.col("path").alias("sidecar")).distinct(), "sidecar", "left_semi").groupBy("path").agg(F.min(F.struct("_r", "sidecar"))["sidecar"].alias("sidecar"))
    return documents.select("path").join(hit, "path", "left")


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


# The kinds of blocks with the patterns of their titles and of their contents, any of which will do; the first kind that fits counts.
KINDS = [
    ("overview", r"(?is)^(?=.*rules)(?=.*global)", None),
    ("skill", r"(?i)skill", r"(?i:trigger:)|`/[a-z]+`"),
    ("rule", None, r"(?i)\brule:\b|always|never|must"),
    ("reference", None, r"(?i:see )|@|\.md\)"),
]


def block_kind(title: Column, content: Column, kinds: list[tuple[str, str | None, str | None]] = KINDS, other: str = "instruction") -> Column:
    """The first of ``kinds`` (name, title pattern, content pattern) that a block fits, else ``other``."""
    fits = [(name, [c.rlike(p) for c, p in ((title, of_title), (content, of_content)) if p]) for name, of_title, of_content in kinds]
    return F.coalesce(*(F.when(reduce(or_, tests), name) for name, tests in fits), F.lit(other))
