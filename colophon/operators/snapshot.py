"""Content-addressed, incremental snapshots of tables.

A table's rows are dealt into at most 256 buckets by the digest of their key.  A
bucket's digest is made of sums of its rows' digests, so it needs no order and is
added up before anything is shuffled; equal rows in any order have equal digests.
A snapshot writes only the buckets whose digest the one before it doesn't have,
and a manifest that says for every bucket where its rows are; unchanged buckets
stay where they were written.  The difference of two snapshots is an anti join of
their manifests.  A manifest is there only when all its buckets are, so a
snapshot that dies leaves the earlier ones as they were.

Edge cases: an empty table has a manifest row without a bucket; null keys and
repeated rows are rows like others; a table may gain columns between snapshots,
which changes all its buckets.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "version int, table_name string, bucket string, n_rows long, digest string, folder string, shape string"
_HEX = 15  # hex digits of a word: sums of such words fit a decimal


def with_buckets(table: DataFrame, key: str) -> DataFrame:
    """``table`` with each row's bucket: the first two digits of its key's SHA-256."""
    return table.withColumn("__bucket", F.substring(F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"), 256), 1, 2))


def bucket_digests(table: DataFrame, key: str) -> DataFrame:
    """(bucket, n_rows, digest)."""
    row = F.sha2(F.to_json(F.struct(*table.columns), {"ignoreNullFields": "false"}).cast("binary"), 256)
    words = [F.conv(F.substring("__row", 1 + k * _HEX, _HEX), 16, 10).cast("decimal(20,0)") for k in range(4)]
    summed = with_buckets(table, key).withColumn("__row", row).groupBy(F.col("__bucket").alias("bucket")).agg(F.count("*").alias("n_rows"), *[F.sum(w).cast("string").alias(f"w{k}") for k, w in enumerate(words)])
    return summed.select("bucket", "n_rows", F.sha2(F.concat_ws(":", F.col("n_rows").cast("string"), "w0", "w1", "w2", "w3").cast("binary"), 256).alias("digest"))


def root_digest(buckets: DataFrame, *by: str) -> DataFrame:
    """The digest of all buckets (256 at most of a table) in order, with the number of rows."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "digest"))), lambda b: F.concat(b["bucket"], F.lit(":"), b["digest"])), ",")
    return buckets.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), F.sha2(listed.cast("binary"), 256).alias("root"))


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """The manifest rows of all snapshots."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{root}/manifests")
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], MANIFEST)


def take(root: str, tables: dict[str, tuple[DataFrame, str]]) -> int:
    """A snapshot of ``tables`` (name: table and its key column) under ``root``; its number."""
    spark = next(iter(tables.values()))[0].sparkSession
    known = manifests(spark, root)
    version = (known.agg(F.max("version")).first()[0] or 0) + 1
    last = known.where(F.col("version") == version - 1)
    rows = []
    for name, (table, key) in tables.items():
        here, before = bucket_digests(table, key), last.where((F.col("table_name") == name) & F.col("bucket").isNotNull())
        folder, shape = f"{root}/data/{name}-{version}-{uuid.uuid4().hex}", table.schema.json()
        told = here.join(before.select("bucket", "digest", F.col("folder").alias("__folder")), ["bucket", "digest"], "left").collect()  # 256 rows at most
        changed = [r["bucket"] for r in told if r["__folder"] is None]
        if changed:
            with_buckets(table, key).where(F.col("__bucket").isin(changed)).repartition("__bucket").write.partitionBy("__bucket").parquet(folder)
        rows += [(version, name, r["bucket"], r["n_rows"], r["digest"], r["__folder"] or folder, shape) for r in told] or [(version, name, None, 0, None, None, shape)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifests")
    return version


def restore(spark: SparkSession, root: str, version: int, name: str) -> DataFrame:
    """A table as it was: each folder's buckets that the manifest names."""
    listed = manifests(spark, root).where((F.col("version") == version) & (F.col("table_name") == name)).collect()  # 256 rows at most
    if not listed:
        raise FileNotFoundError(f"no snapshot {version} of {name}")
    shape = StructType.fromJson(json.loads(listed[0]["shape"]))
    out = spark.createDataFrame([], StructType([*shape.fields]))
    folders: dict[str, list[str]] = {}
    for r in listed:
        if r["folder"]:
            folders.setdefault(r["folder"], []).append(r["bucket"])
    for folder, buckets in folders.items():
        kept = spark.read.schema(StructType([*shape.fields]).add("__bucket", "string")).parquet(folder).where(F.col("__bucket").isin(buckets)).drop("__bucket")
        out = out.unionByName(kept)
    return out


def verify(spark: SparkSession, root: str, version: int, name: str, key: str) -> DataFrame:
    """(bucket, valid): whether what is stored still has the manifest's digests; a bucket that is lost or new isn't valid."""
    told = manifests(spark, root).where((F.col("version") == version) & (F.col("table_name") == name) & F.col("bucket").isNotNull()).select("bucket", "digest")
    now = bucket_digests(restore(spark, root, version, name), key).select("bucket", F.col("digest").alias("__now"))
    return told.join(now, "bucket", "full").select("bucket", F.coalesce(F.col("digest") == F.col("__now"), F.lit(False)).alias("valid"))


def changed(spark: SparkSession, root: str, old: int, new: int) -> DataFrame:
    """(table_name, bucket): what differs between two snapshots."""
    at = lambda v: manifests(spark, root).where((F.col("version") == v) & F.col("bucket").isNotNull()).select("table_name", "bucket", "digest")
    key = ["table_name", "bucket", "digest"]
    return at(new).join(at(old), key, "left_anti").union(at(old).join(at(new), key, "left_anti")).select("table_name", "bucket").distinct()


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(version, table_name, n_rows, root) of every snapshot."""
    return root_digest(manifests(spark, root).where("bucket is not null"), "version", "table_name")
