"""Hook logs and deliveries as streams: activity by window, sessions by gap, first deliveries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.functions.variant import parse_object
from tesseral.operators.redelivery import identity
from tesseral.session import shared_folder


def read_hook_lines(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the hook records appended to JSONL files; broken lines and records without a time are left out."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    v = lines.select(parse_object(F.col("value")).alias("v")).where("v is not null")
    s = lambda k: F.try_variant_get("v", f"$.{k}", "string").alias(k)
    return v.select(F.try_to_timestamp(F.try_variant_get("v", "$.ts", "string")).alias("at"), s("event"), s("session_id"), s("agent_id"), s("tool"), s("tool_use_id"), s("path")).where("at is not null")


def activity(records: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Records a window, session and event; a window is final once ``late`` has passed."""
    return records.withWatermark("at", late).groupBy(F.window("at", window), "session_id", "event").agg(F.count("*").alias("records")).select(F.col("window.start").alias("start"), "session_id", "event", "records")


def sessions(records: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Stretches of a session's records without a pause longer than the gap."""
    w = F.session_window("at", gap)
    return records.withWatermark("at", late).groupBy(w.alias("w"), "session_id").agg(F.count("*").alias("records")).select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "records")


def first_deliveries(rows: DataFrame, ident: str, at: str, late: str = "7 days") -> DataFrame:
    """Each identifier's first arriving row; what comes again within ``late`` is dropped. Rows that identify nothing all pass.

    State is kept an identifier for ``late`` only, so it is bounded by the traffic of that time.
    """
    named = rows.withColumn("_key", identity(F.col(ident))).withColumn(at, F.col(at).cast("timestamp"))
    # Rows that identify nothing go around the state.
    once = named.where("_key is not null").withWatermark(at, late).dropDuplicatesWithinWatermark(["_key"]).drop("_key")
    return once.unionByName(named.where("_key is null").drop("_key"))


def run_once(stream: DataFrame) -> DataFrame:
    """Runs a stream over what is there, exactly once, into files of the shared folder, and reads them."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
