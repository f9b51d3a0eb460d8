"""One wide record per work: every child collection is nested once, then joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nest(parent: DataFrame, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``parent`` with, per child, an array of its rows (ordered by their values; empty if none)."""
    out = parent
    for name, (child, key) in children.items():
        columns = [c for c in child.columns if c != key]
        rows = child.groupBy(F.col(key).alias("id")).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(rows, "id", "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(rows.schema[name].dataType)))
    return out


def flags(assertions: DataFrame, external_ids: DataFrame, works: DataFrame) -> DataFrame:
    """Which kinds of facts and sources a work has."""
    has = lambda c, v: F.max((F.col(c) == v).cast("int")) == 1
    facts = assertions.groupBy(F.col("subject_id").alias("id")).agg(*[has("predicate_uri", p).alias(f"has_{p.lower()}") for p in ("AUTHOR", "TITLE", "LANGUAGE", "DATE", "TRADITION")])
    ids = external_ids.groupBy(F.col("entity_id").alias("id")).agg(*[has("scheme", s).alias(f"has_{s.lower()}") for s in ("GRETIL", "PANDIT", "DOI", "ARCHIVE_ORG")])
    out = works.select("id").join(facts, "id", "left").join(ids, "id", "left")
    return out.select("id", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in out.columns if c != "id"])


def richness(works: DataFrame, assertions: DataFrame, external_ids: DataFrame, id_weight: int = 1) -> DataFrame:
    """Number of facts plus weighted number of identifiers, each side aggregated before the join."""
    a = assertions.groupBy(F.col("subject_id").alias("id")).agg(F.countDistinct("id").alias("n_assertions"))
    e = external_ids.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("n_ids"))
    out = works.select("id", "preferred_title").join(a, "id", "left").join(e, "id", "left").na.fill(0, ["n_assertions", "n_ids"])
    return out.withColumn("richness", F.col("n_assertions") + id_weight * F.col("n_ids"))


def top_richness(works: DataFrame, assertions: DataFrame, external_ids: DataFrame, k: int, id_weight: int = 1) -> DataFrame:
    return richness(works, assertions, external_ids, id_weight).orderBy(F.col("richness").desc(), "id").limit(k)
