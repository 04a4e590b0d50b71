"""Queries run as streams over the tables' files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesseral.operators.redelivery import identity
from tesseral.session import table
from tesseral.streaming.hooks import first_deliveries, run_once


def stream_first_deliveries(spark: SparkSession, root: str) -> DataFrame:
    """The identifiers of usage entries, each once, and the rows that identify nothing, as a stream that drops redeliveries passes them on.

    The delay is that of a replay of the whole table: all its days are open at once.
    """
    schema = table(spark, root, "usage_entry").schema
    # As a pattern the path may be a file or a folder.
    rows = spark.readStream.schema(schema).parquet(f"{root}/usage_entry.parque[t]")
    first = run_once(first_deliveries(rows, "request_id", "received_at", "365 days").select("request_id"))
    return first.select(identity(first.request_id).alias("ident"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"stream_first_deliveries": stream_first_deliveries}
ORACLES: dict[str, str] = {"stream_first_deliveries": r"WITH n AS (SELECT nullif(lower(regexp_replace(request_id, '^\s+|\s+$', '', 'g')), '') AS ident FROM usage_entry) SELECT DISTINCT ident FROM n WHERE ident IS NOT NULL UNION ALL SELECT ident FROM n WHERE ident IS NULL"}
