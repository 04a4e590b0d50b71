"""References to records that do not exist.

Keys become integers by their place in a sorted dictionary, a hash block of keys each. Parent keys
alone are compressed: to contiguous runs, broken only where a key is referred to and missing. A
reference is matched as-of to the run that starts at or before it; a key beyond that run's end
exists nowhere, which is the only place where existence is decided. The times a parent answers at
come along by the same match and are those of the key itself only inside a run.

Defined cases
- null or blank reference keys are no references; null parent keys are no parents;
- a parent without a start counts from the beginning, without an end for ever;
- a reference without a time is taken to come after everything;
- repeated rows on either side count each for itself (parents: as once);
- empty tables: no parents makes every reference ``missing``; no references makes no rows;
- columns beyond those named are ignored, so their names cannot clash.

Hot keys: keys are made distinct on each side before the sort, by partial aggregation; the rows of
a key that holds a large share meet its verdict through a broadcast of at most HEAVY_ONE_IN rows.
Blocks are as many as keys / BLOCK_KEYS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesseral.functions.text import is_blank
from tesseral.operators.skew import lookup
from tesseral.session import cut

#: Distinct keys a block is planned for.
BLOCK_KEYS = 200_000
MISSING, LATE, DELETED = "missing", "late", "deleted"
_FIRST = "timestamp '0001-01-01 00:00:00'"
_LAST = "timestamp '9999-12-31 23:59:59'"


def key_codes(keys: DataFrame, blocks: int, key: str = "key") -> DataFrame:
    """Adds ``block`` and ``code``: equal keys have equal codes, contiguous from 1 in the sorted dictionary of a block."""
    w = Window.partitionBy("block").orderBy(key)
    return keys.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks))).withColumn("code", F.dense_rank().over(w))


def contiguous_runs(codes: DataFrame) -> DataFrame:
    """Distinct (block, code) as runs: (block, run_start, run_end), no gap inside a run."""
    w = Window.partitionBy("block").orderBy("code")
    return (
        codes.select("block", "code", (F.col("code") - F.row_number().over(w)).alias("island"))
        .groupBy("block", "island")
        .agg(F.min("code").alias("run_start"), F.max("code").alias("run_end"))
        .drop("island")
    )


def against_runs(probes: DataFrame, runs: DataFrame, parents: DataFrame) -> DataFrame:
    """The probe rows with ``run_end`` of the run that starts at or before their code and ``span`` of the last parent up to it.

    A code beyond ``run_end``, or before every run, is no parent's; for any other, the last parent is its own.
    All three tables have block and code, ``parents`` has span.
    """
    names = [c for c in probes.columns if c not in ("block", "code")]
    empty = lambda t: F.lit(None).cast(t)
    span, row = parents.schema["span"].dataType, F.struct(*names)
    a = probes.select("block", "code", F.lit(2).alias("kind"), empty("int").alias("end"), empty(span).alias("own"), row.alias("row"))
    row_type = a.schema["row"].dataType
    b = runs.select("block", F.col("run_start").alias("code"), F.lit(0).alias("kind"), F.col("run_end").alias("end"), empty(span).alias("own"), empty(row_type).alias("row"))
    c = parents.select("block", "code", F.lit(1).alias("kind"), empty("int").alias("end"), F.col("span").alias("own"), empty(row_type).alias("row"))
    w = Window.partitionBy("block").orderBy("code", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = a.unionByName(b).unionByName(c).withColumn("run_end", F.last("end", ignorenulls=True).over(w)).withColumn("span", F.last("own", ignorenulls=True).over(w))
    return seen.where("kind = 2").select("block", "code", "row.*", "run_end", "span")


def covered(probes: DataFrame, intervals: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """Of distinct (key, at): those inside some half-open [lo, hi) of the key.

    The greatest end among the intervals begun is carried from time bucket to time bucket, so a
    window holds one key and one bucket, however many rows the key has.
    """
    bucket = lambda c: F.floor(F.unix_micros(c) / (bucket_seconds * 1_000_000))
    p = probes.select("key", F.col("at").alias("t"), F.lit(2).alias("kind"), F.lit(None).cast("timestamp").alias("hi")).distinct()
    i = intervals.groupBy("key", F.col("lo").alias("t")).agg(F.max("hi").alias("hi")).withColumn("kind", F.lit(1))
    events = p.unionByName(i).withColumn("bucket", bucket(F.col("t")))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        events.groupBy("key", "bucket")
        .agg(F.max("hi").alias("hi"))
        .withColumn("hi", F.max("hi").over(before))
        .where("hi is not null")
        .select("key", F.lit(None).cast("timestamp").alias("t"), F.lit(0).alias("kind"), "hi", "bucket")
    )
    inside = Window.partitionBy("key", "bucket").orderBy(F.col("t").asc_nulls_first(), "kind").rowsBetween(Window.unboundedPreceding, 0)
    return (
        events.unionByName(carry)
        .withColumn("reach", F.max("hi").over(inside))
        .where((F.col("kind") == 2) & (F.col("reach") > F.col("t")))
        .select("key", F.col("t").alias("at"))
    )


def references(df: DataFrame, source: str, row_id: str, key: str, at: str) -> DataFrame:
    """Rows of a table as references: (source_table, row_id, key, at), without null and blank keys."""
    k: Column = F.col(key).cast("string")
    return df.where(k.isNotNull() & ~is_blank(k)).select(F.lit(source).alias("source_table"), F.col(row_id).cast("bigint").alias("row_id"), k.alias("key"), F.col(at).cast("timestamp").alias("at"))


def find_orphans(refs: DataFrame, parents: DataFrame, key: str = "id", lo: str = "arrived_at", hi: str = "deleted_at") -> DataFrame:
    """(source_table, row_id, at, reason) of each reference that no parent answers at its time.

    ``refs`` as from :func:`references`. A parent answers from ``lo`` on and before ``hi``.
    """
    blocks = max(1, -(-(parents.count() + refs.count()) // BLOCK_KEYS))
    par = parents.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(lo).cast("timestamp"), F.expr(_FIRST)).alias("lo"), F.col(hi).cast("timestamp").alias("hi"))
    refs = refs.withColumn("at", F.coalesce("at", F.expr(_LAST)))
    judged = cut(_judged(refs, par, blocks))
    at, span = F.col("at"), F.col("span")
    reason = (
        F.when(F.col("gone"), MISSING)
        .when(at < span["first_at"], LATE)
        .when(at >= span["open_from"], "")
        .when(at >= span["last_end"], DELETED)
        .when(span["parents"] == 1, "")
        .otherwise("?")
    )
    # Only rows that are cases, or may be, go on.
    rows = cut(lookup(refs, judged, ["key"], "n", F.col("row_id")).withColumn("reason", reason).where("reason <> ''").select("source_table", "row_id", "at", "key", "reason"))
    open_ = rows.where("reason = '?'")
    yes = covered(open_.select("key", "at"), par.where("hi is not null")).withColumn("_yes", F.lit(True))
    sure = rows.where("reason <> '?'").select("source_table", "row_id", "at", "reason")
    asked = open_.join(yes, ["key", "at"], "left").where("_yes is null").select("source_table", "row_id", "at", F.lit(DELETED).alias("reason"))
    return sure.unionByName(asked)


def _judged(refs: DataFrame, par: DataFrame, blocks: int) -> DataFrame:
    """(key, n, gone, span): each key referred to, how often, whether it lies beyond the runs of parents, and its parents' times."""
    span = F.struct(F.count("*").alias("parents"), F.min("lo").alias("first_at"), F.min(F.when(F.col("hi").isNull(), F.col("lo"))).alias("open_from"), F.max("hi").alias("last_end"))
    held = par.groupBy("key").agg(span.alias("span"))
    used = refs.groupBy("key").agg(F.count("*").alias("n"))
    coded = key_codes(held.unionByName(used, allowMissingColumns=True), blocks)
    parents = coded.where("span is not null").select("block", "code", "span")
    found = against_runs(coded.where("n is not null").select("block", "code", "key", "n"), contiguous_runs(parents), parents)
    gone = F.coalesce(F.col("code") > F.col("run_end"), F.lit(True))
    return found.select("key", "n", gone.alias("gone"), "span")
