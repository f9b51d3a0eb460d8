"""Declared schemas of the catalogue's tables, as Spark DDL. No table's schema is ever inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: The table formats of the data model. A trailing ``!`` means NOT NULL; ``json`` is kept as text.
FORMATS = {
    "entity_identity": "id string!, entity_class string!, created_event_id string, lifecycle string!, created_at timestamp!",
    "events": "event_id string!, event_type string!, stream_id string, entity_ids array<string>!, schema_uri string!, actor_id string, occurred_at timestamp, observed_at timestamp, recorded_at timestamp!, payload json!, payload_digest json!, derivation_refs array<string>, run_id string, cursor bigint",
    "schema_registry": "uri string!, family string!, version string!, schema_dialect string!, artifact_id string, digest_set json!, published_at timestamp!, supersedes string, frozen boolean!",
    "source_providers": "id string!, slug string!, name string!, homepage string, provider_type string!, institution_id string, trust_notes string, default_rights_policy_id string, status string!, discovered_at timestamp!, last_checked_at timestamp",
    "source_endpoints": "id string!, provider_id string!, url string!, endpoint_type string!, adapter string!, capabilities array<string>!, crawl_policy_id string, status string!, last_checked_at timestamp",
    "rights_policies": "id string!, provider_id string, resource_id string, license_uri string, copyright_status string, discovery string!, metadata_fetch string!, content_fetch string!, compute string!, derivative_generation string!, redistribution string!, training string!, evidence_refs array<string>, reviewed_by string, reviewed_at timestamp",
    "artifacts": "id string!, digests json!, media_type string!, byte_length bigint!, storage_uri string, compression string, encoding string, rights_assessment_ids array<string>, availability_state string!, created_at timestamp!",
    "raw_observations": "id string!, provider_id string!, endpoint_id string!, source_resource_id string, requested_uri string!, resolved_uri string, observed_at timestamp!, response_metadata_artifact string, payload_artifact_id string!, rights_assessment_id string!, run_id string, source_state json, status string!",
    "entity_candidates": "id string!, candidate_type string!, provider_id string!, external_resource_id string, assertion_ids array<string>!, normalized_fingerprint string, created_at timestamp!",
    "candidate_assertions": "id string!, observation_id string!, subject_candidate_id string, predicate string!, value string, object_id string, source_selector json, extraction_method string!, extractor_version string!, confidence float, created_at timestamp!",
    "assertions": "id string!, subject_id string!, predicate_uri string!, object_id string, literal string, epistemic_mode string!, evidence_use_ids array<string>!, asserted_by string!, actor_ref string, asserted_at timestamp, recorded_at timestamp!, lifecycle string!, created_from_event string!, supersedes string, valid_from timestamp, valid_until timestamp, schema_uri string",
    "external_identifiers": "id string!, entity_id string!, scheme string!, value string!, source_observation_id string, relation_confidence float, created_at timestamp!, schema_uri string",
    "identity_assertions": "id string!, subject_id string!, object_id string!, relation string!, evidence_refs array<string>!, asserted_by string!, confidence float, review_state string!, created_at timestamp!",
    "identity_merges": "id string!, from_ids array<string>!, into_id string!, evidence string!, event_id string!, performed_by string",
    "identity_splits": "id string!, old_id string!, new_ids array<string>!, allocation_evidence string!, unresolved_members array<string>, event_id string!",
    "ledger_checkpoints": "id string!, previous_checkpoint_id string, first_event_cursor bigint!, last_event_cursor bigint!, event_count bigint!, merkle json!, generated_at timestamp!, signatures json!",
    "works": "id string!, preferred_title string!, work_type string!, current_title_assertion_id string, external_ids json!, created_at timestamp!, state_cursor bigint, schema_uri string",
    "people": "id string!, preferred_name string!, external_ids json!, created_at timestamp!, schema_uri string",
    "institutions": "id string!, preferred_name string!, external_ids json!, location string, homepage string, created_at timestamp!, schema_uri string",
    "editions": "id string!, work_id string, title string!, publication_assertions json!, editor_assertions json!, publisher_assertions json!, year_assertions json!, external_ids json!, rights_policy_id string, created_at timestamp!, schema_uri string",
    "witnesses": "id string!, work_id string, holding_institution_id string, shelfmark string, material_type string, external_ids json!, assertion_ids json!, created_at timestamp!",
    "etexts": "id string!, work_id string, edition_id string, witness_id string, provider_id string!, artifact_id string!, text_format string!, script string!, language string!, derivation_assertions json!, quality_state string!, rights_policy_id string, created_at timestamp!",
    "translations": "id string!, work_id string, target_language string!, translator_ids array<string>!, publication_id string, source_edition_id string, source_etext_id string, completeness string!, rights_policy_id string, external_ids json!, provenance_refs array<string>!, created_at timestamp!, schema_uri string",
    "passages": "id string!, work_id string!, citation_scheme string!, citation_value string!, parent_passage_id string, order_key string, created_at timestamp!",
    "evidence_uses": "id string!, assertion_id string!, evidence_entity_id string!, role string!, anchor_id string, interpretation_note string, created_at timestamp!",
    "derivation_activities": "id string!, activity_type string!, inputs json!, outputs json!, actor_id string, software json, configuration json, started_at timestamp, completed_at timestamp, run_id string, created_at timestamp!",
    "document_segments": "id string!, etext_id string!, parent_id string, segment_type string!, ordinal bigint!, text string!, locator string, created_at timestamp!",
    "contained_work_candidates": "id string!, observation_id string!, work_candidate string!, start_locator string, end_locator string, detection_method string, evidence string, created_at timestamp!",
    "relation_definitions": "uri string!, version string!, domain array<string>!, range array<string>!, semantics string!, inverse string, transitive boolean, staleness_policy string, authority_policy string, deprecated boolean, created_at timestamp!",
    "task_candidates": "id string!, task_type string!, target_id string!, priority float!, reason string!, status string!, created_at timestamp!",
    "discovery_leads": "id string!, source_observation string!, target_type string!, candidate_url string, candidate_name string, reason string!, priority float!, status string!, created_at timestamp!",
    "crawl_policies": "id string!, provider_id string!, robots_behavior string, max_requests_per_second float, max_concurrency int, allowed_paths array<string>, denied_paths array<string>, metadata_only boolean, content_fetch_allowed boolean, max_resource_bytes bigint, backoff_policy string, contact_email string, terms_review_ref string, created_at timestamp!",
    "source_utilities": "id string!, provider_id string!, novelty_yield float, works_per_request float, source_quality float, rights_clarity float, structuredness float, authority_value float, target_gap_match float, acquisition_cost float, failure_rate float, computed_at timestamp!",
    "text_quality_observations": "id string!, target_artifact_id string!, metric string!, value float!, method string!, sample_scope string, created_at timestamp!",
}


def schema(name: str) -> StructType:
    """The declared StructType of a table."""
    columns = [c.strip() for c in FORMATS[name].split(", ")]
    return StructType.fromDDL(", ".join(f"`{n}` {kind.rstrip('!').replace('json', 'string')}{' NOT NULL' if kind.endswith('!') else ''}" for n, _, kind in (c.partition(" ") for c in columns)))


def migrate(spark: SparkSession, path: str) -> list[str]:
    """Create the tables that are not there yet under ``path`` as empty Parquet; names of those made."""
    made = []
    for name in FORMATS:
        try:
            spark.read.schema(schema(name)).parquet(f"{path}/{name}").limit(0).count()
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            spark.createDataFrame([], schema(name)).write.parquet(f"{path}/{name}")
            made.append(name)
    return made


def violations(table: DataFrame, name: str) -> DataFrame:
    """Rows with a null where the format has none, with the first such column."""
    from pyspark.sql import functions as F

    needed = [f.name for f in schema(name).fields if not f.nullable]
    first = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(c)) for c in needed])
    return table.withColumn("violation", first).where("violation is not null")
