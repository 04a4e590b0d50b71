"""Differences of two tables and alignment of two sequences."""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def block_diff(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows that differ: (keys, change, value_a, value_b) with change added, removed or changed."""
    x = a.select(*keys, F.col(value).alias("value_a"), F.lit(True).alias("_a"))
    y = b.select(*keys, F.col(value).alias("value_b"), F.lit(True).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("value_a").eqNullSafe(F.col("value_b")), "changed")
    return x.join(y, keys, "full").withColumn("change", change).where("change is not null").select(*keys, "change", "value_a", "value_b")


def presence(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, presence): both, a-only or b-only."""
    x, y = a.select(*keys).distinct().withColumn("_a", F.lit(True)), b.select(*keys).distinct().withColumn("_b", F.lit(True))
    return x.join(y, keys, "full").select(*keys, F.when(F.col("_a").isNull(), "b-only").when(F.col("_b").isNull(), "a-only").otherwise("both").alias("presence"))


def pair_by_ordinal(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Rows of both sides side by side by their keys; a missing side is null."""
    x, y = a.select(*keys, *(F.col(c).alias(f"{c}_a") for c in cols)), b.select(*keys, *(F.col(c).alias(f"{c}_b") for c in cols))
    return x.join(y, keys, "full")


def deltas(counts: DataFrame, keys: list[str], side: str, value: str) -> DataFrame:
    """b minus a of each key's value, where it is not 0; ``side`` is 'a' or 'b'."""
    signed = F.sum(F.when(F.col(side) == "b", F.col(value)).otherwise(-F.col(value)))
    return counts.groupBy(*keys).agg(signed.alias("delta")).where("delta <> 0")


def align(pairs: DataFrame, pair: str, side: str, order: str, step: str) -> DataFrame:
    """Steps of two sequences aligned by longest matching blocks: (pair, place, kind, step_a, step_b).

    ``pairs`` has the steps of both sides ('a', 'b') of each pair. Blocks are found recursively
    over the whole two sequences, so a pair is worked at once; sorted partitions are streamed, and
    a task holds one pair's steps.
    """

    def steps_of(name: Any, a: list[str], b: list[str]) -> Iterator[tuple]:
        place = 0
        for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            for k in range(max(i2 - i1, j2 - j1)):
                x, y = (a[i1 + k] if i1 + k < i2 else None), (b[j1 + k] if j1 + k < j2 else None)
                kind = "match" if tag == "equal" else "changed" if x is not None and y is not None else "removed" if y is None else "added"
                yield name, place, kind, x, y
                place += 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sides, out = None, {"a": [], "b": []}, []
        for batch in batches:
            for name, side_, step_ in batch.itertuples(index=False):
                if name != now:
                    if now is not None:
                        out.extend(steps_of(now, sides["a"], sides["b"]))
                    now, sides = name, {"a": [], "b": []}
                sides[side_].append(step_)
            yield pd.DataFrame(out, columns=names)
            out = []
        if now is not None:
            yield pd.DataFrame(list(steps_of(now, sides["a"], sides["b"])), columns=names)

    names = [pair, "place", "kind", "step_a", "step_b"]
    t = dict(pairs.dtypes)[pair]
    rows = pairs.select(pair, side, order, step).repartition(pair).sortWithinPartitions(pair, side, order).select(pair, side, step)
    return rows.mapInPandas(run, f"{pair} {t}, place int, kind string, step_a string, step_b string")


def union_first_wins(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of sources in order of priority; of rows with equal keys the first source's first row stays."""
    out = None
    for i, p in enumerate(parts):
        x = p.withColumn("_p", F.lit(i))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in [*keys, "_p"]]
    return out.groupBy(*keys).agg(F.min(F.struct("_p", *rest)).alias("_k")).select(*keys, F.col("_k._p").alias("priority"), *(f"_k.{c}" for c in rest))


def fold_status(df: DataFrame, keys: list[str], status: str, ranks: list[str], none: str) -> DataFrame:
    """The status of highest priority of each key; ``none`` where there is none."""
    rank = F.array_position(F.array(*map(F.lit, ranks)), F.col(status))
    return df.groupBy(*keys).agg(F.min(F.when(rank > 0, rank)).alias("_r")).select(*keys, F.coalesce(F.get(F.array(*map(F.lit, ranks)), (F.col("_r") - 1).cast("int")), F.lit(none)).alias(status))


def top_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")
