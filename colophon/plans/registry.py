"""Named queries over the canonical tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colophon.bindings import table, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """Canonical and driver tables by attribute: ``t.works``, ``t.documents``."""

    _OWN = ("documents", "pages", "conversations", "events", "part", "orders", "lineitem", "customer", "supplier", "nation", "region", "labels", "benchmark", "embeddings")

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in self._OWN:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return table(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under ``name``; ``sql`` may name canonical tables."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = with_tables(sql.strip())
        return f

    return add
