"""Session helpers: building a local session, reading tables, cutting lineage."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session you are given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TESSERAL_DRIVER_MEMORY", "8g"))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the shared folder and read it back: lineage ends here.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and the master is
    local (tests, a laptop) a temporary folder is made; a cluster without it is refused. The data are compressed columns in files all executors
    share, so the loss of an executor loses nothing. :func:`clear_cuts` removes them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tesseral-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _cuts.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_cuts(spark: SparkSession) -> None:
    """Delete the tables that :func:`cut` wrote; DataFrames made from them can't be read any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _cuts:
        path = jvm.org.apache.hadoop.fs.Path(_cuts.pop())
        path.getFileSystem(conf).delete(path, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``; a temporary one only where the driver is the whole cluster."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


@functools.cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="tesseral-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


_cuts: list[str] = []
