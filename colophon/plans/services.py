"""Scalar functions and services, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from colophon.functions import text as x
from colophon.functions import udfs
from colophon.operators import services as s
from colophon.plans.registry import query

query("merge_chain", "SELECT id AS from_id, concat('M', work_type) AS into_id FROM works")(
    lambda t: s.merge_pointers(t.works.groupBy(F.concat(F.lit("M"), "work_type").alias("into_id")).agg(F.collect_list("id").alias("from_ids")))
)
query("candidate_to_entity", "SELECT id, CASE WHEN CAST(substring(subject_id, 2) AS BIGINT) % 2 = 0 THEN concat('Z', substring(subject_id, 2)) ELSE subject_id END AS subject_id FROM assertions")(
    lambda t: s.candidate_to_entity(t.assertions.select("id", "subject_id"), "subject_id", t.works.where("seq % 2 = 0").select(F.col("id").alias("candidate_id"), F.concat(F.lit("Z"), F.col("seq").cast("string")).alias("entity_id")))
)
query("feature_evidence", "SELECT concat('K', CAST(seq % 300 AS STRING)) AS cluster, array_to_string(list_sort(list(DISTINCT preferred_title)), ',') AS titles, count(*) AS n_candidates FROM works GROUP BY 1")(
    lambda t: s.feature_evidence(t.works.select(F.concat(F.lit("K"), (F.col("seq") % 300).cast("string")).alias("cluster"), F.col("preferred_title").alias("title"), F.col("work_type").alias("author"))).select("cluster", F.array_join("titles", ",").alias("titles"), "n_candidates")
)
query("deepfind", "SELECT entity_id AS work, count(DISTINCT value) AS n_confirmed, min(scheme) AS sources FROM external_identifiers e WHERE scheme = (SELECT min(scheme) FROM external_identifiers f WHERE f.entity_id = e.entity_id) GROUP BY entity_id")(
    lambda t: s.deepfind(t.external_identifiers.select(F.col("entity_id").alias("work"), F.col("scheme").alias("variant_order"), F.col("scheme").alias("source"), F.col("value").alias("url"))).select("work", "n_confirmed", F.array_join("sources", ",").alias("sources"))
)
query("enrich_edition", "SELECT d.id AS edition_id, CASE WHEN regexp_matches(lower(publisher), '\\b(ai|hypertuned|auto)\\b') THEN 'C' WHEN contains(lower(publisher), 'high') THEN 'A' ELSE 'B' END AS tier, CASE WHEN count(f.id) > 0 THEN 4 ELSE 0 END AS ladder, coalesce(CAST(sum(CASE WHEN f.ordinal IS NULL THEN 0 ELSE f.ordinal END) FILTER (WHERE f.id IS NOT NULL) AS BIGINT), NULL) AS bytes FROM editions d LEFT JOIN document_segments f ON substring(f.etext_id, 2) = CAST(CAST(substring(d.id, 2) AS BIGINT) + 1 AS STRING) GROUP BY d.id, publisher")(
    lambda t: s.enrich_editions(
        t.editions.select(F.col("id").alias("edition_id"), F.col("publisher").alias("title"), F.col("publisher").alias("author")),
        t.document_segments.select(F.concat(F.lit("D"), (F.substring_index("etext_id", "E", -1).cast("long") - 1).cast("string")).alias("edition_id"), F.lit("x_djvu.txt").alias("name"), F.col("ordinal").cast("string").alias("size")),
        ["high"],
    ).select("edition_id", "tier", "ladder", "bytes")
)
query("resolution_label", "SELECT id, CASE WHEN x >= 0.95 THEN 'same' WHEN x >= 0.8 THEN 'probably same' WHEN x >= 0.6 THEN 'possibly same' ELSE 'unresolved' END AS label FROM (SELECT id, (seq % 100) / 100.0::DOUBLE AS x FROM works)")(
    lambda t: t.works.select("id", x.resolution_label((F.col("seq") % 100) / F.lit(100.0)).alias("label"))
)
query("epistemic_kind", "SELECT id, CASE WHEN seq % 2 = 0 THEN 'VERIFIED' WHEN seq % 3 = 0 THEN 'DERIVED' WHEN seq % 5 = 0 THEN 'OBSERVED' ELSE 'DECLARED' END AS kind FROM works")(
    lambda t: t.works.select("id", x.epistemic_kind(F.col("seq") % 2 == 0, F.col("seq") % 3 == 0, F.col("seq") % 5 == 0).alias("kind"))
)
query("variant_titles", "SELECT id, CASE WHEN preferred_title = replace(preferred_title, 'sv', 'sw') THEN 1 ELSE 2 END AS n_variants FROM works")(lambda t: t.works.select("id", F.size(x.variant_titles(F.col("preferred_title"))).alias("n_variants")))
query("coverage_from_title", "SELECT id, CASE WHEN regexp_matches(lower(preferred_title), 'excerpt|selection|extract|volume 1|vol\\. 1|part 1') THEN 'partial' ELSE 'full' END AS coverage FROM works")(lambda t: t.works.select("id", x.coverage_from_title(F.col("preferred_title")).alias("coverage")))
query("fp_similarity", "SELECT a.doc_id, (CASE WHEN substring(a.text, 1, 100) = substring(b.text, 1, 100) THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END) + (CASE WHEN right(a.text, 100) = right(b.text, 100) THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END) + 0.2::DOUBLE * coalesce(least(length(a.text), length(b.text))::DOUBLE / nullif(greatest(length(a.text), length(b.text)), 0), 0.0) AS similarity FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")(
    lambda t: t.documents.select("doc_id", x.prefix_suffix_hash(F.col("text")).alias("f")).join(t.documents.select((F.col("doc_id") - 1).alias("doc_id"), x.prefix_suffix_hash(F.col("text")).alias("g")), "doc_id").select("doc_id", x.fp_similarity(F.col("f"), F.col("g")).alias("similarity"))
)
query("semantic_fp", r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS fp FROM documents")(lambda t: t.documents.select("doc_id", F.sha2(x.normalize_sanskrit(udfs.nfc("text")).cast("binary"), 256).alias("fp")))
query("run_signature", """SELECT id, sha256(concat('{"code": "', sha256(preferred_title), '", "config": "', sha256(work_type), '", "gold": "', sha256(id), '"}')) AS signature FROM works""")(
    lambda t: t.works.select("id", s.run_signature(*[F.sha2(F.col(c).cast("binary"), 256) for c in ("id", "preferred_title", "work_type")]).alias("signature"))
)
query("golden_audit", "SELECT CAST(doc_id AS STRING) AS name, sha256(right(text, 2000)) AS now, CASE WHEN doc_id % 3 = 0 THEN 'NEW' WHEN doc_id % 3 = 1 THEN 'MATCH' ELSE 'CHANGED' END AS status FROM documents")(
    lambda t: s.audit(t.documents.select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("output")), t.documents.where("doc_id % 3 > 0").select(F.col("doc_id").cast("string").alias("name"), F.when(F.col("doc_id") % 3 == 1, F.sha2(F.right("text", F.lit(2000)).cast("binary"), 256)).otherwise("x").alias("digest")))
)
query("reserved_ops", "SELECT DISTINCT literal AS name, literal IN (SELECT p_brand FROM part WHERE p_partkey < 10) AS reserved FROM assertions WHERE predicate_uri = 'AUTHOR'")(
    lambda t: s.is_reserved(t.assertions.where("predicate_uri = 'AUTHOR'").select(F.col("literal").alias("name")).distinct(), t.part.where("p_partkey < 10").select(F.col("p_brand").alias("name")))
)
query("registry_ops", "SELECT id AS uri, CASE WHEN seq % 2 = 0 THEN 1 ELSE 2 END AS version FROM works")(
    lambda t: s.register(t.works.select(F.col("id").alias("uri"), F.lit(1).alias("version"), (F.col("seq") % 2 == 0).alias("frozen")), t.works.select(F.col("id").alias("uri"), F.lit(2).alias("version"), F.lit(False).alias("frozen"))).select("uri", "version")
)
query("derivations_for_entity", "SELECT id FROM works WHERE work_type = (SELECT work_type FROM works WHERE seq = 1)")(
    lambda t: s.derivations_for(t.works.join(F.broadcast(t.works.where("seq = 1").select(F.col("work_type").alias("__w"))), F.col("work_type") == F.col("__w")).select("id", F.lit('[{"object_id": "e1"}]').alias("inputs"), F.lit("[]").alias("outputs")), "e1").select("id")
)
query("jcs_canonicalize")(lambda t: t.events.select("event_id", udfs.jcs("props").alias("canonical")))
query("digest_set")(lambda t: t.documents.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.sha2(F.col("text").cast("binary"), 512).alias("sha512"), udfs.blake2b("text").alias("blake2b")))
query("nfc")(lambda t: t.documents.select("doc_id", udfs.nfc("text").alias("text")))
