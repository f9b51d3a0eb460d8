"""Where the rest of the library cuts lineage and puts files that it reads again: the folder that the session names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; one of our own only where none is set and all tasks run on this machine (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="colophon-")
        atexit.register(shutil.rmtree, own, True)
        named = f"file://{own}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{folder(spark)}/colophon-core-{spark.sparkContext.applicationId}"


def path(spark: SparkSession, label: str) -> str:
    return f"{_own(spark)}/{label}-{uuid.uuid4().hex}"


#: While a table is written, Spark deletes the query's shuffle files when the query ends: a stored table never needs them again.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read from there: no lineage, no shuffle files left, and later plans read the columns they need."""
    spark = df.sparkSession
    at = path(spark, "cut")
    before = spark.conf.get(_CLEAN)
    try:
        spark.conf.set(_CLEAN, "true")
        df.write.option("compression", "zstd").parquet(at)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(at)


def clear(spark: SparkSession) -> None:
    """Delete what this application has put into the folder. Results that were not written or collected yet can't be read after it."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(_own(spark))
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
