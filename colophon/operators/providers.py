"""Provider health, coverage, crosswalks and medians over external identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN_SCHEMES = ("GRETIL", "ARCHIVE_ORG")


def scheme_summary(external_ids: DataFrame) -> DataFrame:
    return external_ids.groupBy("scheme").agg(F.count("*").alias("n_ids"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))


def crosswalk(external_ids: DataFrame) -> DataFrame:
    """Entities by scheme, and how many of them some other scheme knows too.

    One aggregation by entity instead of a self join: an entity with two schemes is crosswalked in both.
    """
    per = external_ids.select("entity_id", "scheme").distinct()
    many = per.groupBy("entity_id").agg(F.collect_set("scheme").alias("schemes"))  # at most one entry per scheme
    return many.select(F.explode("schemes").alias("scheme"), (F.size("schemes") > 1).alias("linked")).groupBy("scheme").agg(F.count("*").alias("n_entities"), F.count_if("linked").alias("n_crosswalked"))


def provider_health(external_ids: DataFrame, works: DataFrame, now: str) -> DataFrame:
    """``now`` is a parameter, so that runs can be compared. Yields and rates are unrounded."""
    total = works.agg(F.count("*").alias("n_works"))
    seen = external_ids.groupBy("scheme").agg(F.count("*").alias("n_ids"), F.countDistinct("entity_id").alias("n_covered"), F.max("created_at").alias("last"))
    hours = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / F.lit(3.6e9)
    out = seen.join(crosswalk(external_ids), "scheme").crossJoin(F.broadcast(total))  # one row
    out = out.withColumn("freshness_hours", hours).withColumn("yield_rate", F.try_divide(F.col("n_covered").cast("double"), F.col("n_works"))).withColumn("crosswalk_rate", F.try_divide(F.col("n_crosswalked").cast("double"), F.col("n_entities")))
    healthy = (F.col("n_ids") > 0) & (F.col("freshness_hours") < 168) & (F.col("yield_rate") > 0.01)
    return out.select("scheme", "n_ids", "freshness_hours", "yield_rate", F.when(F.col("scheme").isin(*OPEN_SCHEMES), "open").otherwise("restricted").alias("rights_class"), "crosswalk_rate", healthy.alias("healthy"))


def provider_coverage(external_ids: DataFrame, works: DataFrame) -> DataFrame:
    total = works.agg(F.count("*").alias("n_works"))
    known = external_ids.join(works.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    out = known.groupBy("scheme").agg(F.countDistinct("entity_id").alias("n_covered")).crossJoin(F.broadcast(total))  # one row
    return out.select("scheme", "n_covered", "n_works", F.try_divide(F.col("n_covered").cast("double"), F.col("n_works")).alias("coverage_rate"), (F.col("n_works") - F.col("n_covered")).alias("n_gaps"))


def provider_gaps(external_ids: DataFrame, works: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` works (by id) that each scheme lacks. The schemes are few; works are ranked within their scheme."""
    schemes = external_ids.select("scheme").distinct()
    lacking = works.select("id").crossJoin(F.broadcast(schemes)).join(external_ids.select("scheme", F.col("entity_id").alias("id")), ["scheme", "id"], "left_anti")
    return lacking.withColumn("place", F.row_number().over(Window.partitionBy("scheme").orderBy("id"))).where(F.col("place") <= n)


def median_providers(external_ids: DataFrame, works: DataFrame) -> DataFrame:
    """Median over all works of the number of schemes that know them; 0.0 without works."""
    per = external_ids.groupBy(F.col("entity_id").alias("id")).agg(F.countDistinct("scheme").alias("n"))
    return works.select("id").join(per, "id", "left").agg(F.coalesce(F.median(F.coalesce("n", F.lit(0))), F.lit(0.0)).alias("median_providers"))


def coverage_gaps(external_ids: DataFrame, works: DataFrame, n: int = 20) -> DataFrame:
    return works.join(external_ids.select(F.col("entity_id").alias("id")), "id", "left_anti").orderBy(F.col("preferred_title").asc_nulls_last(), "id").limit(n).select("id", "preferred_title")
