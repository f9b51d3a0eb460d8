"""Where intermediate tables live, and how rows get their place in a global order.

Intermediates are Parquet tables in the folder that the session names in
``spark.checkpoint.dir`` (all executors see it), so a lost executor costs a
re-read and never a recomputation from the start.  Only Spark reads or writes
that folder: it may be on any file system.  An operator deletes the tables that
its result doesn't read; the others lie in one folder per application, which
``clear`` deletes once the results are used.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOW_BITS = (1 << 33) - 1


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where none is set and all tasks run on this machine (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="colophon-")
    atexit.register(shutil.rmtree, own, True)
    sc.setCheckpointDir(f"file://{own}")
    return sc.getCheckpointDir().rstrip("/")


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/colophon-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables of this application. Results that were not written or collected yet can't be read after it."""
    _delete(spark, _folder(spark))


#: While a table is written, Spark deletes the query's shuffle files when the query ends (a stored table never needs
#: them again), and sends Python workers batches of at most 8 MB, so that long texts don't fill a task's memory.
_WHILE_STORING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def write(df: DataFrame, path: str) -> None:
    """Write ``df`` as Parquet under ``path``."""
    spark = df.sparkSession
    before = {k: spark.conf.get(k) for k in _WHILE_STORING}
    try:
        for k, v in _WHILE_STORING.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    write(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._colophon_path = path
    return out


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_colophon_path", None)
        if path:
            _delete(df.sparkSession, path)


def named(column: str) -> Column:
    """A column by its very name, also where it holds dots or backticks."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores behind it as it takes to be none of ``taken``, whatever their case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ranked(df: DataFrame, order: list, sums: tuple[str, ...] = (), label: str = "ranked") -> DataFrame:
    """Add ``rank`` (0-based place in the global order) and ``<c>_before`` for each of ``sums``.

    One range shuffle sorts the rows; each row keeps its place within its
    partition, and one row per partition carries the counts and sums of all
    partitions before it.  No task sees more than one partition, whatever the
    number of rows or the size of a tie.  ``order`` must tell rows apart, or
    tied rows must be interchangeable.  Call it on slim rows: they are stored.
    """
    spark = df.sparkSession
    rows = stored(
        df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()),
        label,
    )
    placed = rows.withColumn("__pid", F.shiftrightunsigned("__at", 33))
    per = placed.groupBy("__pid").agg(F.count("*").alias("__n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"__s_{c}") for c in sums])
    # One row per range partition, so the single-task window and the broadcast are bounded by the partition count.
    earlier = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("__pid", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n"), *[F.coalesce(F.sum(f"__s_{c}").over(earlier), F.lit(0)).alias(f"__s_{c}") for c in sums])
    out = placed.join(F.broadcast(base), "__pid").withColumn("rank", F.col("__n") + F.col("__at").bitwiseAND(F.lit(_LOW_BITS)))
    if sums:
        within = Window.partitionBy("__pid").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
        for c in sums:
            out = out.withColumn(f"{c}_before", F.col(f"__s_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0)))
    out = out.drop("__pid", "__at", "__n", *[f"__s_{c}" for c in sums])
    out._colophon_path = rows._colophon_path
    return out
