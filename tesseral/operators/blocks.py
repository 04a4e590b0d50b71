"""Running values over long sequences, worked in blocks.

A sequence that holds a large share of all rows would be one task's work as a window. Here it is cut
into blocks by its order; each block is a window of its own, and what the blocks before it come to
is carried by a table of one row a block.

Defined cases: equal orders stand as the window's order has them and are never parted, as they are of
one block; a null order is a block of its own, the first; rows with a null key belong to no sequence,
each of their blocks stands for itself; empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Orders a block spans.
BLOCK = 4096


def block_of(order: str | Column, size: int = BLOCK) -> Column:
    return F.coalesce(F.floor((F.col(order) if isinstance(order, str) else order) / size).cast("bigint"), F.lit(-(1 << 62)))


def earlier(keys: list[str], block: str = "_b") -> WindowSpec:
    """Over a table of one row a block: the blocks before."""
    return Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, own: bool = True, block: Column | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before, and the row itself if ``own``. Blocks are of the first order column."""
    x = df.withColumn("_v", F.coalesce(value, F.lit(0))).withColumn("_b", block_of(order[0]) if block is None else block)
    sums = x.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s")).select(*keys, "_b", F.coalesce(F.sum("_s").over(earlier(keys)), F.lit(0)).alias("_c"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    y = x.withColumn("_i", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return _carried(y, sums, keys).withColumn(name, F.col("_i") + F.coalesce("_c", F.lit(0))).drop("_v", "_b", "_i", "_c")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, block: Column | None = None) -> DataFrame:
    """Adds ``name``: the place of each row in its sequence, from 0. ``order`` must tell all rows apart."""
    return running_sum(df, keys, order, F.lit(1), name, own=False, block=block)


def _carried(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their block's row of ``table``. Both are split by key and block already, so only ``table`` has to move."""
    return rows.join(table, [*keys, "_b"], "left")
