"""Proportional allocation of whole numbers, exact to the unit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def largest_remainder(df: DataFrame, keys: list[str], order: list[str], weight: str, total: str, name: str = "share") -> DataFrame:
    """Adds each row's part of the group's ``total`` in proportion to ``weight``.

    Parts are rounded down; what is left goes, one each, to the largest fractions, ties by order.
    A group without weight, or a total that is not positive, gives 0 to all. Negative weights count as 0.
    """
    g = Window.partitionBy(*keys)
    w = F.greatest(F.col(weight).cast("double"), F.lit(0.0))
    exact = F.when((F.sum(w).over(g) > 0) & (F.col(total) > 0), F.col(total).cast("double") * w / F.sum(w).over(g)).otherwise(0.0)
    x = df.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    some = F.sum("_exact").over(g) > 0
    left = F.when(some, F.col(total) - F.sum("_floor").over(g)).otherwise(0)
    rank = F.row_number().over(g.orderBy(F.desc(F.col("_exact") - F.col("_floor")), *order))
    return x.withColumn(name, (F.col("_floor") + F.when(rank <= left, 1).otherwise(0)).cast("bigint")).drop("_exact", "_floor")


def with_history(items: DataFrame, requests: DataFrame, keys: list[str], order: list[str], weight: str, total: str, history: str) -> DataFrame:
    """Allocates each request's total over its items and a bucket for the history before it.

    The bucket comes last in ties and takes everything where nothing has weight.
    """
    names = [*keys, *order, weight]
    rest = items.select(*names, F.lit(0).alias("_h")).unionByName(requests.select(*keys, *(F.lit(None).cast(items.schema[c].dataType).alias(c) for c in order), F.col(history).cast(items.schema[weight].dataType).alias(weight), F.lit(1).alias("_h")))
    both = rest.join(requests.select(*keys, total), keys)
    out = largest_remainder(both, keys, ["_h", *order], weight, total, "tokens")
    given = F.sum("tokens").over(Window.partitionBy(*keys))
    return out.withColumn("tokens", F.when((F.col("_h") == 1) & (given == 0), F.greatest(F.col(total), F.lit(0))).otherwise(F.col("tokens"))).withColumn("is_history", F.col("_h") == 1).drop("_h")
