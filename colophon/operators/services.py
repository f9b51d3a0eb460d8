"""Schema registry, reserved fields, run records, derivations, merges and splits, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def register(registry: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` schemas over the old; a frozen address keeps what it has."""
    frozen = registry.where("frozen").select("uri")
    allowed = new.join(frozen, "uri", "left_anti")
    return registry.join(allowed.select("uri"), "uri", "left_anti").unionByName(allowed)


def freeze(registry: DataFrame, uri: str) -> DataFrame:
    return registry.withColumn("frozen", F.col("frozen") | (F.col("uri") == uri))


def by_family(registry: DataFrame, family: str) -> DataFrame:
    return registry.where(F.col("family") == family).orderBy("version")


def verify_registry(registry: DataFrame, contents: DataFrame) -> DataFrame:
    """Recorded digest against the content's; false where the content is missing."""
    return registry.join(contents, "uri", "left").select("uri", F.coalesce(F.sha2(F.col("content").cast("binary"), 256) == F.col("digest"), F.lit(False)).alias("valid"))


def family_of(uri) -> "F.Column":
    return F.substring_index(uri, "/", -1)


def is_reserved(fields: DataFrame, reserved: DataFrame) -> DataFrame:
    return fields.join(reserved.select("name", F.lit(True).alias("__r")).distinct(), "name", "left").select("name", F.coalesce("__r", F.lit(False)).alias("reserved"))


def run_signature(gold, code, config) -> "F.Column":
    """One digest of three: of their canonical JSON object, members sorted."""
    member = lambda name, value: F.concat(F.lit(f'"{name}": "'), value, F.lit('"'))
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", member("code", code), member("config", config), member("gold", gold)), F.lit("}")).cast("binary"), 256)


def run_of(runs: DataFrame, signature: str) -> DataFrame:
    return runs.where(F.col("signature") == signature)


def record_runs(runs: DataFrame, new: DataFrame) -> DataFrame:
    """Runs keyed by signature: a known one is not recorded again."""
    first = new.withColumn("__k", F.row_number().over(Window.partitionBy("signature").orderBy("ts"))).where("__k = 1").drop("__k")
    return runs.unionByName(first.join(runs.select("signature"), "signature", "left_anti"))


def audit(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Digest of the last 2,000 letters of each output against the baseline: MATCH, CHANGED or NEW."""
    now = current.select("name", F.sha2(F.right("output", F.lit(2000)).cast("binary"), 256).alias("now"))
    status = F.when(F.col("digest").isNull(), "NEW").when(F.col("now") == F.col("digest"), "MATCH").otherwise("CHANGED")
    return now.join(baseline, "name", "left").select("name", "now", status.alias("status"))


def derivations_for(activities: DataFrame, entity: str) -> DataFrame:
    """Activities with the entity among the object ids of their inputs or outputs (JSON arrays)."""
    ids = lambda c: F.from_json(c, "array<struct<object_id:string>>")
    has = lambda c: F.coalesce(F.exists(ids(c), lambda x: x["object_id"] == entity), F.lit(False))
    return activities.where(has("inputs") | has("outputs"))


def merge_pointers(merges: DataFrame) -> DataFrame:
    return merges.select(F.explode("from_ids").alias("from_id"), "into_id")


def split_targets(splits: DataFrame, old_id: str) -> DataFrame:
    return splits.where(F.col("old_id") == old_id)


def candidate_to_entity(facts: DataFrame, key: str, mapping: DataFrame) -> DataFrame:
    """Facts of candidates moved to their resolved entities; unresolved ones stay."""
    return facts.join(mapping.select(F.col("candidate_id").alias(key), "entity_id"), key, "left").withColumn(key, F.coalesce("entity_id", key)).drop("entity_id")


def feature_evidence(candidates: DataFrame) -> DataFrame:
    """Non-empty titles and authors of each cluster, and its size."""
    kept = lambda c: F.sort_array(F.collect_set(F.when(F.col(c) != "", F.col(c))))
    return candidates.groupBy("cluster").agg(kept("title").alias("titles"), kept("author").alias("authors"), F.count("*").alias("n_candidates"))


def enrich_editions(editions: DataFrame, files: DataFrame, scholars: list[str]) -> DataFrame:
    """Editions with their best file kind, total bytes (bad sizes count 0), tier and coverage."""
    from colophon.functions.text import classify_file, coverage_from_title, edition_tier

    per = files.groupBy("edition_id").agg(F.min(F.array_position(F.array(F.lit("ocr_text"), F.lit("pdf"), F.lit("ocr_xml"), F.lit("other")), classify_file(F.col("name")))).alias("rank"), F.sum(F.coalesce(F.expr("try_cast(size as bigint)"), F.lit(0))).alias("bytes"))
    out = editions.join(per, "edition_id", "left").withColumn("tier", edition_tier(F.col("title"), F.col("author"), scholars)).withColumn("coverage", coverage_from_title(F.col("title")))
    return out.withColumn("ladder", F.when(F.col("rank") == 1, 4).when(F.col("rank") == 2, 3).when(F.col("rank") == 3, 2).when(F.col("rank") == 4, 1).otherwise(0)).drop("rank")


def deepfind(hits: DataFrame) -> DataFrame:
    """(work, variant_order, source, url): the hits of each work's first variant that has any, once per address, and their number.

    An address that several sources give counts for the least of them.
    """
    first = hits.groupBy("work").agg(F.min("variant_order").alias("variant_order"))
    kept = hits.join(first, ["work", "variant_order"]).groupBy("work", "url").agg(F.min("source").alias("source"))
    return kept.groupBy("work").agg(F.count("*").alias("n_confirmed"), F.sort_array(F.collect_set("source")).alias("sources"))


def record_derivations(new: DataFrame) -> DataFrame:
    """(activity_type, inputs, outputs, actor_id, software, configuration, at) as activities with a deterministic id."""
    key = F.sha2(F.to_json(F.struct("activity_type", "inputs", "outputs", "actor_id", "software", "configuration", "at")).cast("binary"), 256)
    out = new.withColumn("id", F.concat(F.lit("ACT_"), F.substring(key, 1, 32)))
    return out.select("id", "activity_type", "inputs", "outputs", F.coalesce("actor_id", F.lit("")).alias("actor_id"), F.coalesce("software", F.lit("{}")).alias("software"), F.coalesce("configuration", F.lit("{}")).alias("configuration"), F.col("at").alias("started_at"), F.col("at").alias("completed_at"), F.col("at").alias("created_at"))


def record_model_calls(calls: DataFrame) -> DataFrame:
    """(model, provider, prompt, response, config, at) as activities that keep digests of prompt and response, never the texts."""
    digest = lambda c: F.struct(F.lit("sha256").alias("algorithm"), F.sha2(F.col(c).cast("binary"), 256).alias("value"))
    return record_derivations(
        calls.select(
            F.lit("LLM_CALL").alias("activity_type"), F.to_json(F.array(F.struct(digest("prompt").alias("prompt_digest")))).alias("inputs"), F.to_json(F.array(F.struct(digest("response").alias("response_digest")))).alias("outputs"),
            F.concat(F.lit("provider:"), "provider").alias("actor_id"), F.to_json(F.struct("model")).alias("software"), "config", "at",
        ).withColumnRenamed("config", "configuration")
    )


def gap_cycle(gaps: DataFrame, actions: DataFrame, discoveries: DataFrame) -> DataFrame:
    """One row: how many gaps, actions and discoveries a cycle has."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(gaps, "gaps").crossJoin(n(actions, "actions")).crossJoin(n(discoveries, "discoveries"))  # one row each
