"""Catalogue queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from colophon.operators import catalogue as c
from colophon.plans.registry import query

HITS = "(SELECT id, preferred_title, work_type FROM works WHERE lower(preferred_title) LIKE '%red%' OR id IN (SELECT subject_id FROM assertions WHERE lower(literal) LIKE '%red%'))"

query("search_like", f"SELECT id, preferred_title, work_type, true AS has_more, (SELECT count(*) FROM {HITS} h) AS total FROM {HITS} g ORDER BY preferred_title, id LIMIT 25")(lambda t: c.search_like(t.works, t.assertions, "red", 25))
query("search_hits", f"SELECT * FROM {HITS} h")(lambda t: c.search_hits(t.works, t.assertions, "RED"))
query("search_page_two", "SELECT id, preferred_title, work_type, true AS has_more FROM works WHERE preferred_title > 'brass' OR (preferred_title = 'brass' AND id > 'W10') ORDER BY preferred_title, id LIMIT 10")(
    lambda t: c.page(t.works.select(*c.WORK), 10, ("brass", "W10"))
)
query("search_literal", "SELECT id, preferred_title, work_type, CAST(1.0 AS DOUBLE) AS score FROM works WHERE contains(lower(preferred_title), 'ee')")(lambda t: c.search_literal(t.works, "EE"))
query("autocomplete", "SELECT id, preferred_title FROM works WHERE lower(preferred_title) LIKE '%al%' ORDER BY preferred_title, id LIMIT 10")(
    lambda t: c.autocomplete(t.works, "al")
)
query("scan_table", "SELECT id, preferred_title, work_type FROM works ORDER BY id LIMIT 100")(lambda t: t.works.orderBy("id").limit(100).select(*c.WORK))
query("scan_surrogates", "SELECT * FROM etexts")(lambda t: t.etexts)
query("point_lookup", "SELECT id, preferred_title, work_type FROM works WHERE id = 'W42'")(lambda t: t.works.where("id = 'W42'").select(*c.WORK))
query("discover_page", "SELECT id, preferred_title FROM works WHERE id > 'W15' ORDER BY id LIMIT 30")(lambda t: t.works.where("id > 'W15'").orderBy("id").limit(30).select("id", "preferred_title"))
query(
    "filter_works",
    """SELECT id, preferred_title, work_type FROM works WHERE id IN (SELECT subject_id FROM assertions WHERE predicate_uri = 'AUTHOR')
       AND id NOT IN (SELECT entity_id FROM external_identifiers WHERE scheme = 'GRETIL') AND id IN (SELECT work_id FROM translations)""",
)(lambda t: c.filter_works(t.works, t.assertions, t.external_identifiers, t.translations, has_author=True, has_scheme=("GRETIL", False), has_translation=True))
query("filter_no_translation", "SELECT id, preferred_title, work_type FROM works WHERE id NOT IN (SELECT work_id FROM translations)")(
    lambda t: c.filter_works(t.works, t.assertions, t.external_identifiers, t.translations, has_translation=False)
)
query("list_assertions_filtered", "SELECT * FROM assertions WHERE predicate_uri LIKE '%TIT%' AND lifecycle = 'ACTIVE' AND asserted_by = 'editor'")(
    lambda t: c.list_assertions(t.assertions, predicate="TIT", lifecycle="ACTIVE", asserted_by="editor")
)
query("list_external_ids", "SELECT * FROM external_identifiers WHERE entity_id = 'W37'")(lambda t: t.external_identifiers.where("entity_id = 'W37'"))
query("observations_like", "SELECT cursor, event_id FROM ledger WHERE event_id LIKE '%77%'")(lambda t: t.ledger.where("event_id like '%77%'").select("cursor", "event_id"))
query("array_membership", "SELECT cursor, event_id FROM ledger WHERE entity_id IN ('W7', 'W8')")(
    lambda t: t.ledger.withColumn("entity_ids", F.array("entity_id")).where(F.array_contains("entity_ids", "W7") | F.array_contains("entity_ids", "W8")).select("cursor", "event_id")
)
query(
    "predicate_partition",
    "SELECT subject_id, count(*) FILTER (WHERE contains(predicate_uri, 'AUTHOR')) AS n_authorship, count(*) FILTER (WHERE contains(predicate_uri, 'DATE')) AS n_date, count(*) FILTER (WHERE contains(predicate_uri, 'TRADITION')) AS n_tradition FROM assertions GROUP BY subject_id",
)(lambda t: t.assertions.groupBy("subject_id").agg(*[F.count_if(F.contains("predicate_uri", F.lit(p))).alias(n) for p, n in (("AUTHOR", "n_authorship"), ("DATE", "n_date"), ("TRADITION", "n_tradition"))]))
query(
    "resolve_title",
    """WITH asked AS (SELECT DISTINCT upper(preferred_title) AS query FROM works UNION ALL SELECT 'nothing of the kind'),
       n AS (SELECT query, count(id) AS n_matches, min(id) AS first_id FROM asked LEFT JOIN works ON lower(query) = lower(preferred_title) GROUP BY query)
       SELECT query, n_matches, CASE WHEN n_matches = 1 THEN 'EXACT' WHEN n_matches > 1 THEN 'AMBIGUOUS' ELSE 'NONE' END AS status, CASE WHEN n_matches = 1 THEN first_id END AS match_id FROM n""",
)(lambda t: c.resolve_title(t.works, t.works.select(F.upper("preferred_title").alias("query")).distinct().union(t.spark.createDataFrame([("nothing of the kind",)], "query string"))))
query("quality_len1", "SELECT count(*) AS n_short FROM assertions WHERE length(literal) <= 1")(lambda t: t.assertions.agg(F.count_if(F.char_length("literal") <= 1).alias("n_short")))
query("filter_expr", "SELECT * FROM assertions WHERE predicate_uri IN ('AUTHOR', 'TITLE') AND lifecycle <> 'DEPRECATED'")(lambda t: c.filter_expr(t.assertions, "predicate_uri:AUTHOR|TITLE,lifecycle:!DEPRECATED"))
query("select_columns", "SELECT id, work_type FROM works")(lambda t: t.works.select("id", "work_type"))
query("sample")(lambda t: c.sample_by_hash(t.works, "id", 10).select(*c.WORK))
query("sort_works", "SELECT id, preferred_title, work_type FROM works")(lambda t: c.sort_works(t.works, "preferred_title", True).select(*c.WORK))
query("group_by_field", "SELECT coalesce(work_type, 'Unknown') AS value, count(*) AS n_works, min(id) AS first_id FROM works GROUP BY 1")(lambda t: c.group_by_field(t.works, "work_type"))
query("group_count_type", "SELECT work_type, count(*) AS n_works FROM works GROUP BY work_type")(lambda t: t.works.groupBy("work_type").agg(F.count("*").alias("n_works")).orderBy(F.desc("n_works"), "work_type"))
query("group_by_api", "SELECT coalesce(literal, 'Unknown') AS value, count(DISTINCT subject_id) AS n_works FROM assertions WHERE predicate_uri = 'TRADITION' GROUP BY 1")(
    lambda t: t.assertions.where("predicate_uri = 'TRADITION'").groupBy(F.coalesce("literal", F.lit("Unknown")).alias("value")).agg(F.countDistinct("subject_id").alias("n_works"))
)
query("join_ext_lookup", "SELECT w.id, preferred_title, work_type FROM works w JOIN external_identifiers e ON e.entity_id = w.id WHERE scheme = 'DOI' AND value = 'v2' ORDER BY w.id LIMIT 1")(
    lambda t: c.lookup(t.works, t.external_identifiers, "DOI", "v2")
)
query(
    "batch_resolve",
    """WITH asked AS (SELECT DISTINCT scheme, value FROM external_identifiers UNION ALL SELECT 'DOI', 'unknown')
       SELECT a.scheme, a.value, min(w.id) AS work_id, min(w.id) IS NOT NULL AS resolved FROM asked a LEFT JOIN external_identifiers e ON e.scheme = a.scheme AND e.value = a.value LEFT JOIN works w ON w.id = e.entity_id GROUP BY a.scheme, a.value""",
)(lambda t: c.batch_resolve(t.external_identifiers.select("scheme", "value").distinct().union(t.spark.createDataFrame([("DOI", "unknown"), ("DOI", None)], "scheme string, value string")), t.works, t.external_identifiers))
query("left_join_assertions", "SELECT w.id, a.predicate_uri, a.literal FROM works w LEFT JOIN assertions a ON a.subject_id = w.id")(
    lambda t: t.works.select("id").join(t.assertions.select(F.col("subject_id").alias("id"), "predicate_uri", "literal"), "id", "left")
)
query("semi_exists", "SELECT id FROM works WHERE id IN (SELECT entity_id FROM external_identifiers WHERE scheme = 'PANDIT')")(
    lambda t: c.having(t.works.select("id"), t.external_identifiers.where("scheme = 'PANDIT'").select(F.col("entity_id").alias("id")), True)
)
query("anti_not_exists", "SELECT id FROM works WHERE id NOT IN (SELECT entity_id FROM external_identifiers)")(lambda t: c.having(t.works.select("id"), t.external_identifiers.select(F.col("entity_id").alias("id")), False))
query("anti_left_null", "SELECT w.id FROM works w LEFT JOIN translations t ON t.work_id = w.id WHERE t.id IS NULL")(lambda t: t.works.select("id").join(t.translations.select(F.col("work_id").alias("id")), "id", "left_anti"))
query("endpoints_by_provider", "SELECT id, name FROM institutions WHERE place = 7")(lambda t: t.institutions.where("place = 7").select("id", "name"))
query("people_scan", "SELECT * FROM people")(lambda t: t.people)
#: The tables whose rows are counted; events are the ledger's.
COUNTED = {n: n for n in ("works", "people", "institutions", "editions", "witnesses", "etexts", "translations", "assertions", "external_identifiers")} | {"events": "ledger"}
query("count_rows", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {source}" for n, source in COUNTED.items()))(lambda t: c.count_rows({n: getattr(t, source) for n, source in COUNTED.items()}))
query("count_distinct", "SELECT count(DISTINCT entity_id) AS n_entities, count(DISTINCT scheme) AS n_schemes FROM external_identifiers")(
    lambda t: t.external_identifiers.agg(F.countDistinct("entity_id").alias("n_entities"), F.countDistinct("scheme").alias("n_schemes"))
)
query("assertion_hist", "SELECT subject_id, predicate_uri, literal, count(*) AS n FROM assertions GROUP BY ALL")(lambda t: t.assertions.groupBy("subject_id", "predicate_uri", "literal").agg(F.count("*").alias("n")))
query("event_hist", "SELECT entity_id, event_type, count(*) AS n FROM ledger GROUP BY ALL")(lambda t: t.ledger.groupBy("entity_id", "event_type").agg(F.count("*").alias("n")))
query("distinct_rows", "SELECT DISTINCT scheme, value FROM external_identifiers")(lambda t: t.external_identifiers.select("scheme", "value").distinct())
query("dedupe_first", "SELECT preferred_title, min(id) AS id FROM works GROUP BY preferred_title")(lambda t: c.dedupe_first(t.works, ["preferred_title"], ["id"]).select("preferred_title", "id"))
query(
    "insert_ignore",
    "SELECT id, preferred_title, work_type FROM works WHERE seq % 2 = 0 UNION ALL SELECT id, min(concat('x', preferred_title)), min(work_type) FROM works WHERE seq % 2 = 1 AND seq % 3 = 0 GROUP BY id",
)(lambda t: c.insert_ignore(t.works.where("seq % 2 = 0").select(*c.WORK), t.works.where("seq % 3 = 0").withColumn("preferred_title", F.concat(F.lit("x"), "preferred_title")), ["id"], "seq"))
query(
    "upsert_work",
    "SELECT id, CASE WHEN seq % 3 = 0 THEN concat('x', preferred_title) ELSE preferred_title END AS preferred_title, CASE WHEN seq % 2 = 0 THEN work_type ELSE 'new' END AS work_type FROM works WHERE seq % 2 = 0 OR seq % 3 = 0",
)(
    lambda t: c.upsert_last(
        t.works.where("seq % 2 = 0").select(*c.WORK), t.works.where("seq % 3 = 0").select("id", F.concat(F.lit("x"), "preferred_title").alias("preferred_title"), F.lit("new").alias("work_type"), "seq"), "id", ["preferred_title"], "seq"
    )
)
query("insert_if_absent", "SELECT entity_id, scheme, value FROM external_identifiers WHERE scheme <> 'DOI'")(
    lambda t: t.external_identifiers.join(t.external_identifiers.where("scheme = 'DOI'").select("entity_id", "scheme", "value"), ["entity_id", "scheme", "value"], "left_anti").select("entity_id", "scheme", "value")
)
query("source_utility", "SELECT p_partkey, p_size * 0.5 * p_retailprice * 0.25 * 2.0 / nullif(p_size % 5, 0) AS utility FROM part")(
    lambda t: c.source_utility(
        t.part.select("p_partkey", F.col("p_size").alias("gap_value"), F.lit(0.5).alias("expected_yield"), F.col("p_retailprice").alias("authority"), F.lit(0.25).alias("rights_usability"), F.lit(2.0).alias("reach"), (F.col("p_size") % 5).alias("cost"))
    ).select("p_partkey", "utility")
)
query("recent_n", "SELECT cursor, event_type FROM ledger ORDER BY recorded_at DESC, cursor DESC LIMIT 10")(lambda t: t.ledger.orderBy(F.desc("recorded_at"), F.desc("cursor")).limit(10).select("cursor", "event_type"))
query("trace_counts", "SELECT event_type, count(*) AS n FROM ledger GROUP BY event_type")(lambda t: t.ledger.groupBy("event_type").agg(F.count("*").alias("n")))
query("trace_search", "SELECT cursor FROM ledger WHERE contains(entity_id, '99') ORDER BY cursor DESC LIMIT 10")(
    lambda t: t.ledger.where(F.contains(F.to_json(F.struct("entity_id")), F.lit("99"))).orderBy(F.desc("cursor")).limit(10).select("cursor")
)
