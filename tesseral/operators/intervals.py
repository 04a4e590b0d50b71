"""Intervals and states in time order, by windows instead of range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesseral.operators.blocks import numbered


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Closed whole-number intervals joined where they overlap or touch; those with end < start are dropped."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = df.where(F.col(end) >= F.col(start)).withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach + 1), 1).otherwise(0))
    x = x.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def gaps(merged: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """What lies between the merged intervals of a key: (keys, gap_start, gap_end)."""
    before = F.lag(end).over(Window.partitionBy(*keys).orderBy(start))
    return merged.withColumn("_b", before).where("_b is not null").select(*keys, (F.col("_b") + 1).alias("gap_start"), (F.col(start) - 1).alias("gap_end"))


def uncovered(points: DataFrame, merged: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """The points in no interval of their key, with the nearest end before and start after.

    As-of over one order of points and interval starts: no pair is made.
    """
    names = [c for c in points.columns if c not in keys]
    a = points.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_k"), F.lit(None).cast("bigint").alias("_s"), F.lit(None).cast("bigint").alias("_e"), F.struct(*names).alias("_row"))
    b = merged.select(*keys, F.col(start).cast(a.schema["_at"].dataType).alias("_at"), F.lit(0).alias("_k"), F.col(start).cast("bigint").alias("_s"), F.col(end).cast("bigint").alias("_e"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy(*keys).orderBy("_at", "_k")
    # What comes after is what went before in the reverse order: both are running values.
    back = Window.partitionBy(*keys).orderBy(F.desc("_at"), F.desc("_k")).rowsBetween(Window.unboundedPreceding, -1)
    x = a.unionByName(b).withColumn("end_before", F.last("_e", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start_after", F.last("_s", ignorenulls=True).over(back))
    return x.where((F.col("_k") == 1) & (F.col("end_before").isNull() | (F.col("_at") > F.col("end_before")))).select(*keys, "_row.*", "end_before", "start_after")


def residency(changes: DataFrame, probes: DataFrame, session: str, key: str, at: str, evictable: str = "path_glob_match") -> DataFrame:
    """Whether each key of a session is resident at each probe time: (session, probe, key, resident, evicted_at).

    ``changes`` (session, key, at, reason): loads have a key and a reason, compactions a null key.
    A compaction evicts a key whose last load had the evictable reason; a load brings it back. At one
    time a load wins over a compaction. Keys are what a session ever loads; before its first load
    a key counts as resident, as nothing says otherwise.
    """
    loads = changes.where(F.col(key).isNotNull()).select(session, key, at, "reason", F.lit(1).alias("_k"))
    evictions = changes.where(F.col(key).isNull()).select(session, at, F.lit(0).alias("_k"))
    # The first compaction after each load: a running value in the reverse order, in which a load comes before a compaction of its time.
    back = Window.partitionBy(session).orderBy(F.desc(at), F.desc("_k")).rowsBetween(Window.unboundedPreceding, -1)
    ended = loads.unionByName(evictions, allowMissingColumns=True).withColumn("_cut", F.last(F.when(F.col("_k") == 0, F.col(at)), ignorenulls=True).over(back)).where("_k = 1")
    known = loads.select(session, key).distinct()
    asked = known.join(probes.select(session, at, "probe"), session).withColumn("_k", F.lit(2))
    state = F.when(F.col("_k") == 1, F.struct(F.coalesce("reason", F.lit("")).alias("reason"), F.col("_cut").alias("cut")))
    w = Window.partitionBy(session, key).orderBy(at, "_k", "reason").rowsBetween(Window.unboundedPreceding, 0)
    x = ended.unionByName(asked, allowMissingColumns=True).withColumn("_s", F.last(state, ignorenulls=True).over(w)).where("_k = 2")
    gone = F.coalesce((F.col("_s.reason") == evictable) & (F.col("_s.cut") <= F.col(at)), F.lit(False))
    return x.select(session, "probe", key, (~gone).alias("resident"), F.when(gone, F.col("_s.cut")).alias("evicted_at"))


def insert_markers(rows: DataFrame, markers: DataFrame, session: str, order: str, at: str) -> DataFrame:
    """Rows and markers in one timeline with ``place``: a marker stands before the first row at or after its time.

    Markers (session, mark, at, ...) at one place are ordered by time, of equal times the later
    inserted first; a marker without time, or after all rows, stands at the end.
    """
    from tesseral.operators.sessions import first_at_or_after

    hit = first_at_or_after(rows, markers.where(F.col(at).isNotNull()).select(session, at, "mark"), session, order, at, "mark").select(session, "mark", F.col(order).alias("_pos"))
    m = markers.join(hit, [session, "mark"], "left").withColumn("_k", F.lit(0)).withColumn("_pos", F.coalesce(F.col("_pos").cast("bigint"), F.lit((1 << 63) - 1)))
    r = rows.withColumn("_pos", F.col(order).cast("bigint")).withColumn("_k", F.lit(1))
    order = ["_pos", "_k", F.when(F.col("_k") == 0, F.col(at)).asc_nulls_last(), F.desc("mark")]
    return numbered(m.unionByName(r, allowMissingColumns=True), [session], order, "place").drop("_pos", "_k")
