"""Registered keys of entities as versioned, bucketed tables: external identifiers, fingerprints, entities themselves.

An index is a base and what was registered since, both bucketed and sorted by the
key in the same way.  A registration writes only the newer of the two anew;
readers merge on read by a full join of equal buckets, which shuffles neither;
``compact`` makes the merged table the next base.  Every table has a folder of
its own and is taken up once Spark's committer has finished it, so a registration
that dies leaves the index as it was.

The newest version of a key counts, in one version the entry registered last.
(A union of the two tables would do as well, but Spark 4.1 takes a union of
bucketed columnar scans for partitioned by the key although it isn't.)

Edge cases: entries with a null in the key are not registered; registering
nothing makes a version without entries; a lookup of a null key finds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class EntityIndex:
    """Keys to entity ids. ``name`` must be new to the session's catalogue, ``folder`` one that all executors see."""

    def __init__(self, spark: SparkSession, name: str, keys: list[str], folder: str, buckets: int = 16):
        self.spark, self.name, self.keys, self.folder, self.buckets = spark, name, list(keys), folder.rstrip("/"), buckets
        self.version, self._made = 0, 0
        self._base = self._newer = None

    def _write(self, entries: DataFrame) -> str:
        self._made += 1
        table = f"{self.name}_{self._made}"
        entries.write.bucketBy(self.buckets, *self.keys).sortBy(*self.keys).format("parquet").option("path", f"{self.folder}/{table}").saveAsTable(table)
        return table

    def _take_up(self, base: str | None, newer: str | None) -> None:
        old = {self._base, self._newer} - {base, newer, None}
        self._base, self._newer = base, newer
        for table in old:
            self.spark.sql(f"DROP TABLE {table}")

    def register(self, entries: DataFrame, order: str = "ordinal") -> int:
        """Add the entries (keys, entity_id, ``order``) as the next version, and return its number. Of entries with one key the last by ``order`` counts, then the greatest id."""
        last = entries.dropna(subset=self.keys).groupBy(*self.keys).agg(F.max_by("entity_id", F.struct(order, "entity_id")).alias("entity_id")).withColumn("version", F.lit(self.version + 1))
        if self._base is None:
            self._take_up(self._write(last), None)
        elif self._newer is None:
            self._take_up(self._base, self._write(last))
        else:
            self._take_up(self._base, self._write(self._merged(self.spark.table(self._newer), last)))
        self.version += 1
        return self.version

    def _merged(self, base: DataFrame, newer: DataFrame) -> DataFrame:
        over = newer.select(*self.keys, F.col("entity_id").alias("__entity"), F.col("version").alias("__version"))
        known = F.col("__version").isNotNull()
        return base.join(over, self.keys, "full").select(*self.keys, F.when(known, F.col("__entity")).otherwise(F.col("entity_id")).alias("entity_id"), F.coalesce("__version", "version").alias("version"))

    def entries(self) -> DataFrame:
        """(keys, entity_id, version): each key's newest entry."""
        if self._base is None:
            return self.spark.createDataFrame([], ", ".join(f"`{k}` string" for k in self.keys) + ", entity_id string, version int")
        base = self.spark.table(self._base)
        return base if self._newer is None else self._merged(base, self.spark.table(self._newer))

    def find(self, rows: DataFrame) -> DataFrame:
        """``rows``, which have the key columns, with the entity that the index knows for them, if any."""
        return rows.join(self.entries().drop("version"), self.keys, "left")

    def compact(self) -> None:
        """The merged entries as the one table; until it is there, the two before it are read."""
        if self._newer is not None:
            self._take_up(self._write(self.entries()), None)
