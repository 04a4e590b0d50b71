"""Joins that survive keys holding a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy if more than one row in so many carries it; so there are at most so many heavy keys.
HEAVY_ONE_IN = 500


def heavy_keys(counts: DataFrame, n: str, one_in: int = HEAVY_ONE_IN) -> DataFrame:
    """Of a table of one row per key with its row count ``n``: the rows of heavy keys.

    They number at most ``one_in`` whatever the input, which is the proof that they may be
    broadcast.
    """
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0)).alias("_total"))
    return counts.join(F.broadcast(total), F.col(n) * one_in > F.col("_total")).drop("_total")


def lookup(rows: DataFrame, info: DataFrame, on: list[str], n: str, salt: Column) -> DataFrame:
    """Left join ``rows`` to ``info`` (one row per key, ``n`` = rows of that key).

    Rows of heavy keys meet a broadcast copy of at most HEAVY_ONE_IN info rows; all others are
    shuffled by key. ``salt`` spreads the heavy rows over the shuffle they only pass through.
    """
    cols = [c for c in info.columns if c not in on]
    heavy = heavy_keys(info, n).select(*on, F.struct(*cols).alias("_heavy"))
    marked = rows.join(F.broadcast(heavy), on, "left").withColumn(
        "_salt", F.when(F.col("_heavy").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(salt), F.lit(1 << 16)) + 1).cast("int")
    )
    light = info.select(*on, F.struct(*cols).alias("_light"), F.lit(0).alias("_salt"))
    found = F.coalesce("_heavy", "_light")
    return marked.join(light, [*on, "_salt"], "left").select(*rows.columns, *(found[c].alias(c) for c in cols))
