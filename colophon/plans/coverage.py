"""Coverage, completeness, availability, providers and dossiers, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from colophon.operators import coverage as v
from colophon.operators import dossier as d
from colophon.operators import providers as p
from colophon.plans.registry import query

COUNTS = """facts AS (SELECT subject_id AS id, count(*) FILTER (WHERE predicate_uri = 'AUTHOR') AS a, count(*) FILTER (WHERE predicate_uri = 'TITLE') AS t, count(*) FILTER (WHERE predicate_uri = 'LANGUAGE') AS l, count(*) FILTER (WHERE predicate_uri = 'DATE') AS d,
    count(*) FILTER (WHERE predicate_uri = 'TRADITION') AS r, count(*) AS n, CAST(max(CASE WHEN contains(lower(literal), 'translation') THEN 1 ELSE 0 END) AS BIGINT) AS s FROM (SELECT DISTINCT subject_id, predicate_uri, literal FROM assertions) GROUP BY 1),
  ids AS (SELECT entity_id AS id, count(*) FILTER (WHERE scheme = 'GRETIL') AS cg, count(*) FILTER (WHERE scheme = 'ARCHIVE_ORG') AS ca, count(*) FILTER (WHERE scheme = 'PANDIT') AS cp, count(*) FILTER (WHERE scheme = 'DARSHANA') AS cd,
    count(*) FILTER (WHERE scheme = 'SANSKRITREE') AS cs, count(*) FILTER (WHERE scheme = 'DOI') AS co, count(*) AS c FROM external_identifiers GROUP BY 1),
  k AS (SELECT w.id, coalesce(a, 0) a, coalesce(t, 0) t, coalesce(l, 0) l, coalesce(d, 0) d, coalesce(r, 0) r, coalesce(n, 0) n, coalesce(s, 0) s, coalesce(cg, 0) cg, coalesce(ca, 0) ca, coalesce(cp, 0) cp, coalesce(cd, 0) cd, coalesce(cs, 0) cs, coalesce(co, 0) co, coalesce(c, 0) c
    FROM works w LEFT JOIN facts USING (id) LEFT JOIN ids USING (id))"""


def _case(*cases):
    state = "CASE " + " ".join(f"WHEN {test} THEN '{name}'" for test, name, _ in cases) + " ELSE 'UNKNOWN' END"
    sure = "CASE " + " ".join(f"WHEN {test} THEN {x}" for test, _, x in cases) + " ELSE 0.3 END"
    return state, f"CAST({sure} AS DOUBLE)"


RULES = {
    "identity": (_case(("a > 0 AND t > 0 AND c > 0", "REVIEWED", 0.95), ("a > 0 AND t > 0", "FULL", 0.85), ("c > 0", "PARTIAL", 0.7)), "n + c"), "author": (_case(("a > 1", "MULTIPLE", 0.8), ("a = 1", "FULL", 0.9)), "a"),
    "title": (_case(("t > 1", "MULTIPLE", 0.7), ("t = 1", "FULL", 0.9)), "t"), "language": (_case(("l > 0", "FULL", 0.9)), "l"), "date": (_case(("d > 0", "FULL", 0.8)), "d"), "tradition": (_case(("r > 0", "FULL", 0.8)), "r"),
    "text": (_case(("cg > 0", "FULL", 0.9), ("ca > 0", "PARTIAL", 0.7)), "cg + ca"), "translation": (_case(("s > 0", "PARTIAL", 0.7)), "s"), "edition": (_case(("cp > 0 OR cd > 0", "PARTIAL", 0.7)), "cp + cd"),
    "manuscript": (_case(("cs > 0 OR ca > 0", "PARTIAL", 0.7)), "cs + ca"), "digital": (_case(("c > 0", "PARTIAL", 0.7)), "c"), "scholarship": (_case(("co > 0", "PARTIAL", 0.7)), "co"),
}
LONG = " UNION ALL ".join(
    f"SELECT id, {i} AS ordinal, '{dim}' AS dimension, {state} AS state, {sure} AS confidence, CAST({n} AS BIGINT) AS evidence_count, " + (f"CASE WHEN ({state}) = 'UNKNOWN' THEN '{v.ACTIONS[dim]}' END" if v.ACTIONS[dim] else "CAST(NULL AS VARCHAR)") + " AS next_action FROM k"
    for i, (dim, ((state, sure), n)) in enumerate(RULES.items())
)
COVER = f"WITH {COUNTS}, cover AS ({LONG})"
_cover = lambda t: v.coverage(v.fact_counts(t.works, t.assertions, t.external_identifiers))

query("coverage", f"{COVER} SELECT * FROM cover")(_cover)
query("coverage_states_hist", f"{COVER} SELECT dimension, state, count(*) AS n FROM cover GROUP BY ALL")(lambda t: _cover(t).groupBy("dimension", "state").agg(F.count("*").alias("n")))
query("coverage_wide", f"{COVER} SELECT id, max(state) FILTER (WHERE dimension = 'identity') AS identity_state, max(evidence_count) FILTER (WHERE dimension = 'text') AS text_evidence, max(next_action) FILTER (WHERE dimension = 'date') AS date_action FROM cover GROUP BY id")(
    lambda t: v.coverage_wide(v.fact_counts(t.works, t.assertions, t.external_identifiers)).select("id", F.col("identity.state").alias("identity_state"), F.col("text.evidence_count").alias("text_evidence"), F.col("date.next_action").alias("date_action"))
)
query("frontier", f"{COVER} SELECT id, ordinal, dimension, next_action FROM cover WHERE next_action IS NOT NULL")(lambda t: v.frontier(_cover(t)))
GAPS = f"""{COVER}, gaps AS (SELECT id, dimension, CASE WHEN dimension IN ('author', 'title', 'text') THEN 1 ELSE 2 END AS priority,
  CASE dimension WHEN 'author' THEN 'PANDIT' WHEN 'text' THEN 'GRETIL' WHEN 'manuscript' THEN 'SANSKRITREE' WHEN 'translation' THEN 'ARCHIVE_ORG' WHEN 'edition' THEN 'ARCHIVE_ORG' WHEN 'scholarship' THEN 'CROSSREF' ELSE 'OPENALEX' END AS provider,
  concat(id, ' ', dimension) AS query FROM cover WHERE next_action IS NOT NULL)"""
query("gap_actions", f"{GAPS} SELECT * FROM gaps")(lambda t: v.gap_actions(v.frontier(_cover(t))))
query("gap_identify", f"{GAPS} SELECT dimension, provider, priority, count(*) AS n FROM gaps GROUP BY ALL")(lambda t: v.gap_actions(v.frontier(_cover(t))).groupBy("dimension", "provider", "priority").agg(F.count("*").alias("n")))
query("gap_discover")(lambda t: v.gap_discover(v.gap_actions(v.frontier(_cover(t)))))
query("discovery_rate")(lambda t: v.gap_actions(v.frontier(_cover(t))).agg(F.count("*").alias("n_actions")).crossJoin(v.gap_discover(v.gap_actions(v.frontier(_cover(t)))).agg(F.count("*").alias("n_found"))).withColumn("rate", F.try_divide(F.col("n_found").cast("double"), F.col("n_actions"))))

WORK = """counts AS (SELECT id, preferred_title, (SELECT count(*) FROM assertions a WHERE a.subject_id = w.id) AS assertion_count, (SELECT count(*) FROM external_identifiers e WHERE e.entity_id = w.id) AS ext_id_count,
  (SELECT count(*) FROM editions x WHERE x.work_id = w.id) AS edition_count, (SELECT count(*) FROM translations x WHERE x.work_id = w.id) AS translation_count, (SELECT count(*) FROM witnesses x WHERE x.work_id = w.id) AS witness_count,
  (SELECT count(*) FROM etexts x WHERE x.work_id = w.id) AS etext_count FROM works w),
  wc AS (SELECT id, CASE WHEN coalesce(preferred_title, '') <> '' THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS identity, CASE WHEN etext_count > 0 THEN 'ETEXT' WHEN edition_count > 0 THEN 'CATALOG' ELSE 'NONE' END AS source,
  CASE WHEN translation_count > 0 THEN 'EXISTING' ELSE 'NONE_KNOWN' END AS translation, CASE WHEN ext_id_count > 0 THEN 'COMPLETE' ELSE 'NONE' END AS bibliography, assertion_count, ext_id_count, edition_count, translation_count, witness_count, etext_count FROM counts)"""
_work = lambda t: v.work_coverage(t.works, t.assertions, t.external_identifiers, t.editions, t.translations, t.witnesses, t.etexts)
query("work_coverage_counts", f"WITH {WORK} SELECT * FROM wc")(_work)
query("frontier_all", f"WITH {WORK} SELECT id, identity, source, translation, bibliography FROM wc ORDER BY id LIMIT 50")(lambda t: _work(t).orderBy("id").limit(50).select("id", "identity", "source", "translation", "bibliography"))
query("frontier_translations", f"WITH {WORK} SELECT id FROM wc WHERE translation = 'NONE_KNOWN' ORDER BY id LIMIT 50")(lambda t: _work(t).where("translation = 'NONE_KNOWN'").orderBy("id").limit(50).select("id"))
STATS = """s AS (SELECT (SELECT count(*) FROM works) AS total, (SELECT count(*) FROM works WHERE coalesce(preferred_title, '') <> '') AS resolved, (SELECT count(DISTINCT work_id) FROM etexts) AS with_text, (SELECT count(DISTINCT work_id) FROM translations) AS with_translation,
  (SELECT count(DISTINCT entity_id) FROM external_identifiers) AS with_bibliography)"""
RATES = "SELECT *, resolved * 100.0::DOUBLE / total AS resolution_rate, with_text * 100.0::DOUBLE / total AS text_rate, with_translation * 100.0::DOUBLE / total AS translation_rate, with_bibliography * 100.0::DOUBLE / total AS bibliography_rate FROM s"
_stats = lambda t: v.coverage_stats(t.works, t.etexts, t.translations, t.external_identifiers)
query("coverage_stats", f"WITH {STATS} {RATES}")(_stats)
query("stats_merge", f"WITH {STATS} SELECT r.*, (SELECT count(*) FROM assertions) AS n_assertions, (SELECT count(*) FROM ledger) AS n_events FROM ({RATES}) r")(
    lambda t: _stats(t).crossJoin(t.assertions.agg(F.count("*").alias("n_assertions"))).crossJoin(t.ledger.agg(F.count("*").alias("n_events")))
)
DONE = """flags AS (SELECT w.id, preferred_title, (SELECT count(*) FROM assertions a WHERE a.subject_id = w.id AND lifecycle = 'DEPRECATED') AS contested, (SELECT count(*) FROM assertions a WHERE a.subject_id = w.id) AS assertion_count,
  (SELECT count(*) FROM editions x WHERE x.work_id = w.id) AS edition_count, (SELECT count(*) FROM etexts x WHERE x.work_id = w.id) AS etext_count, (SELECT count(*) FROM translations x WHERE x.work_id = w.id) AS translation_count,
  (SELECT count(*) FROM translations x WHERE x.work_id = w.id AND completeness = 'FULL') AS f, (SELECT count(*) FROM translations x WHERE x.work_id = w.id AND completeness = 'PARTIAL') AS p, (SELECT count(*) FROM translations x WHERE x.work_id = w.id AND completeness = 'MACHINE') AS m,
  (SELECT count(*) FROM external_identifiers e WHERE e.entity_id = w.id) AS external_id_count, (SELECT count(*) FROM external_identifiers e WHERE e.entity_id = w.id AND scheme IN ('DOI', 'OPENALEX')) AS sch FROM works w),
  done AS (SELECT id, CASE WHEN contested > 0 THEN 'CONTESTED' WHEN coalesce(preferred_title, '') <> '' THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS identity, CASE WHEN edition_count > 0 AND etext_count > 0 THEN 'ETEXT' WHEN edition_count > 0 THEN 'CATALOG' ELSE 'NONE' END AS source,
  CASE WHEN f > 0 THEN 'EXISTING' WHEN p > 0 THEN 'PARTIAL' WHEN m > 0 THEN 'MACHINE' WHEN translation_count > 0 THEN 'EXISTING' ELSE 'NONE_KNOWN' END AS translation, CASE WHEN sch > 0 THEN 'COMPLETE' WHEN external_id_count > 0 THEN 'PARTIAL' ELSE 'NONE' END AS bibliography,
  assertion_count, edition_count, translation_count, external_id_count FROM flags)"""
_done = lambda t: v.completeness(t.works, t.assertions, t.editions, t.etexts, t.translations, t.external_identifiers)
query("completeness_compile", f"WITH {DONE} SELECT * FROM done")(_done)
query("completeness_api", f"WITH {DONE} SELECT id, identity, edition_count, translation_count FROM done")(lambda t: _done(t).select("id", "identity", "edition_count", "translation_count"))
query("completeness_stats", f"WITH {DONE} SELECT count(*) AS total, count(*) FILTER (WHERE identity = 'RESOLVED')::DOUBLE / count(*) AS resolved_rate, count(*) FILTER (WHERE source <> 'NONE')::DOUBLE / count(*) AS source_rate, count(*) FILTER (WHERE translation <> 'NONE_KNOWN')::DOUBLE / count(*) AS translation_rate FROM done")(
    lambda t: v.completeness_stats(_done(t))
)
query("completeness_frontier", f"WITH {DONE}, n AS (SELECT id, concat_ws(',', CASE WHEN identity <> 'RESOLVED' THEN 'identity' END, CASE WHEN source = 'NONE' THEN 'source' END, CASE WHEN translation = 'NONE_KNOWN' THEN 'translation' END, CASE WHEN bibliography = 'NONE' THEN 'bibliography' END) AS needs FROM done) SELECT * FROM n WHERE contains(needs, 'source')")(
    lambda t: v.needs(_done(t), "source").select("id", F.array_join("needs", ",").alias("needs"))
)
AVAIL = """r AS (SELECT work_id AS id, max(CASE completeness WHEN 'FULL' THEN 3 WHEN 'PARTIAL' THEN 2 ELSE 1 END) AS b, max(CASE WHEN language = 'eng' THEN CASE completeness WHEN 'FULL' THEN 3 WHEN 'PARTIAL' THEN 2 ELSE 1 END END) AS e, count(*) AS n FROM translations GROUP BY 1),
  av AS (SELECT w.id, CASE b WHEN 3 THEN 'FULL' WHEN 2 THEN 'PARTIAL' WHEN 1 THEN 'EXISTING' ELSE 'NONE_KNOWN' END AS state, CASE e WHEN 3 THEN 'FULL' WHEN 2 THEN 'PARTIAL' WHEN 1 THEN 'EXISTING' ELSE 'NONE_KNOWN' END AS english_state, coalesce(n, 0) AS n_translations,
  w.id IN (SELECT entity_id FROM external_identifiers WHERE scheme IN ('GRETIL', 'DOI', 'OPENALEX')) AS has_bibliography FROM works w LEFT JOIN r ON r.id = w.id)"""
_avail = lambda t: v.availability(t.works, t.translations, t.external_identifiers)
query("availability_compile", f"WITH {AVAIL} SELECT * FROM av")(_avail)
query("availability_summary", f"WITH {AVAIL} SELECT count(*) AS total, count(*) FILTER (WHERE english_state <> 'NONE_KNOWN') AS with_english, count(*) FILTER (WHERE english_state = 'NONE_KNOWN') AS without_english FROM av")(
    lambda t: _avail(t).agg(F.count("*").alias("total"), F.count_if(F.col("english_state") != "NONE_KNOWN").alias("with_english"), F.count_if(F.col("english_state") == "NONE_KNOWN").alias("without_english"))
)
query("language_matrix", "SELECT language, count(*) AS n, count(*) FILTER (WHERE completeness <> 'MACHINE') AS n_downloadable, min(id) AS first_id FROM translations GROUP BY language")(
    lambda t: t.translations.groupBy("language").agg(F.count("*").alias("n"), F.count_if(F.col("completeness") != "MACHINE").alias("n_downloadable"), F.min("id").alias("first_id"))
)
query("traditions_group", "SELECT literal AS tradition, count(*) AS n_works, string_agg(subject_id, ',' ORDER BY subject_id) AS works FROM assertions WHERE predicate_uri = 'TRADITION' GROUP BY literal")(
    lambda t: t.assertions.where("predicate_uri = 'TRADITION'").groupBy(F.col("literal").alias("tradition")).agg(F.count("*").alias("n_works"), F.array_join(F.sort_array(F.collect_list("subject_id")), ",").alias("works"))
)

NOW = "1998-12-10 00:00:00"
query("scheme_hist", "SELECT scheme, count(*) AS n FROM external_identifiers GROUP BY scheme")(lambda t: t.external_identifiers.groupBy("scheme").agg(F.count("*").alias("n")))
query("scheme_minmax", "SELECT scheme, count(*) AS n_ids, min(created_at) AS first_seen, max(created_at) AS last_seen FROM external_identifiers GROUP BY scheme")(lambda t: p.scheme_summary(t.external_identifiers))
CROSS = "x AS (SELECT scheme, count(*) AS n_entities, count(*) FILTER (WHERE n > 1) AS n_crosswalked FROM (SELECT scheme, entity_id, count(*) OVER (PARTITION BY entity_id) AS n FROM (SELECT DISTINCT scheme, entity_id FROM external_identifiers)) GROUP BY scheme)"
query("crosswalk_self_semi", f"WITH {CROSS} SELECT * FROM x")(lambda t: p.crosswalk(t.external_identifiers))
query(
    "provider_health",
    f"""WITH {CROSS}, g AS (SELECT scheme, count(*) AS n_ids, count(DISTINCT entity_id) AS n_covered, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(created_at))) / 3.6e9 AS freshness_hours FROM external_identifiers GROUP BY scheme),
    h AS (SELECT g.scheme, n_ids, freshness_hours, n_covered::DOUBLE / (SELECT count(*) FROM works) AS yield_rate, CASE WHEN g.scheme IN ('GRETIL', 'ARCHIVE_ORG') THEN 'open' ELSE 'restricted' END AS rights_class, n_crosswalked::DOUBLE / n_entities AS crosswalk_rate FROM g JOIN x ON x.scheme = g.scheme)
    SELECT *, n_ids > 0 AND freshness_hours < 168 AND yield_rate > 0.01 AS healthy FROM h""",
)(lambda t: p.provider_health(t.external_identifiers, t.works, NOW))
query("provider_coverage", "SELECT scheme, count(DISTINCT entity_id) AS n_covered, (SELECT count(*) FROM works) AS n_works, count(DISTINCT entity_id)::DOUBLE / (SELECT count(*) FROM works) AS coverage_rate, (SELECT count(*) FROM works) - count(DISTINCT entity_id) AS n_gaps FROM external_identifiers GROUP BY scheme")(
    lambda t: p.provider_coverage(t.external_identifiers, t.works)
)
query("provider_gaps", "SELECT * FROM (SELECT s.scheme, w.id, CAST(row_number() OVER (PARTITION BY s.scheme ORDER BY w.id) AS INTEGER) AS place FROM works w, (SELECT DISTINCT scheme FROM external_identifiers) s WHERE NOT EXISTS (SELECT 1 FROM external_identifiers e WHERE e.entity_id = w.id AND e.scheme = s.scheme)) WHERE place <= 10")(
    lambda t: p.provider_gaps(t.external_identifiers, t.works)
)
query("provider_linked_count", "SELECT count(*) AS n FROM external_identifiers WHERE scheme = upper('gretil')")(lambda t: t.external_identifiers.where(F.col("scheme") == F.upper(F.lit("gretil"))).agg(F.count("*").alias("n")))
query("provider_summary", "SELECT count(DISTINCT scheme) AS n_schemes, count(DISTINCT (scheme, entity_id)) AS n_covered FROM external_identifiers")(
    lambda t: p.provider_coverage(t.external_identifiers, t.works).agg(F.count("*").alias("n_schemes"), F.sum("n_covered").alias("n_covered"))
)
query("median_providers", "SELECT coalesce(median(n), 0.0)::DOUBLE AS median_providers FROM (SELECT w.id, count(DISTINCT scheme) AS n FROM works w LEFT JOIN external_identifiers e ON e.entity_id = w.id GROUP BY w.id)")(lambda t: p.median_providers(t.external_identifiers, t.works))
query("coverage_gaps", "SELECT id, preferred_title FROM works WHERE id NOT IN (SELECT entity_id FROM external_identifiers) ORDER BY preferred_title, id LIMIT 20")(lambda t: p.coverage_gaps(t.external_identifiers, t.works))

RICH = "SELECT w.id, preferred_title, count(DISTINCT a.id) AS n_assertions, count(DISTINCT (e.scheme, e.value)) FILTER (WHERE e.scheme IS NOT NULL) AS n_ids FROM works w LEFT JOIN assertions a ON a.subject_id = w.id LEFT JOIN external_identifiers e ON e.entity_id = w.id GROUP BY w.id, preferred_title"
query("topk_richness", f"SELECT *, n_assertions + n_ids AS richness FROM ({RICH}) r ORDER BY richness DESC, id LIMIT 100")(lambda t: d.top_richness(t.works, t.assertions, t.external_identifiers, 100))
query("topk_richness_2x", f"SELECT *, n_assertions + 2 * n_ids AS richness FROM ({RICH}) r ORDER BY richness DESC, id LIMIT 100")(lambda t: d.top_richness(t.works, t.assertions, t.external_identifiers, 100, 2))
query("star_left_join_dedupe", f"SELECT *, n_assertions + n_ids AS richness FROM ({RICH}) r")(lambda t: d.richness(t.works, t.assertions, t.external_identifiers))
query("dossier_nest", "SELECT id, (SELECT count(*) FROM assertions a WHERE a.subject_id = w.id) AS n_facts, (SELECT string_agg(concat(scheme, ':', value), ',' ORDER BY scheme, value) FROM external_identifiers e WHERE e.entity_id = w.id) AS ids, (SELECT count(*) FROM passages x WHERE x.work_id = w.id) AS n_passages FROM works w")(
    lambda t: d.nest(t.works.select("id"), {"facts": (t.assertions.select("subject_id", "predicate_uri", "literal"), "subject_id"), "ids": (t.external_identifiers.select("entity_id", "scheme", "value"), "entity_id"), "passages": (t.passages.select("work_id", "order_key"), "work_id")}).select(
        "id", F.size("facts").cast("long").alias("n_facts"), F.nullif(F.array_join(F.transform("ids", lambda x: F.concat(x["scheme"], F.lit(":"), x["value"])), ","), F.lit("")).alias("ids"), F.size("passages").cast("long").alias("n_passages")
    )
)
FLAGS = ", ".join(f"EXISTS (SELECT 1 FROM assertions a WHERE a.subject_id = w.id AND predicate_uri = '{x}') AS has_{x.lower()}" for x in ("AUTHOR", "TITLE", "LANGUAGE", "DATE", "TRADITION")) + ", " + ", ".join(f"EXISTS (SELECT 1 FROM external_identifiers e WHERE e.entity_id = w.id AND scheme = '{x}') AS has_{x.lower()}" for x in ("GRETIL", "PANDIT", "DOI", "ARCHIVE_ORG"))
query("dossier_flags", f"SELECT id, {FLAGS} FROM works w")(lambda t: d.flags(t.assertions, t.external_identifiers, t.works))
query("dossier_summary", f"SELECT count(*) AS n_works, count(*) FILTER (WHERE has_author) AS with_author, count(*) FILTER (WHERE has_gretil) AS with_gretil FROM (SELECT id, {FLAGS} FROM works w)")(
    lambda t: d.flags(t.assertions, t.external_identifiers, t.works).agg(F.count("*").alias("n_works"), F.count_if("has_author").alias("with_author"), F.count_if("has_gretil").alias("with_gretil"))
)
SEG = "SELECT e.work_id, count(DISTINCT s.id) AS n_segments FROM etexts e JOIN document_segments s ON s.etext_id = e.id WHERE segment_type = 'manuscript' GROUP BY e.work_id HAVING count(DISTINCT s.id) > 0"
query("manuscripts_join", SEG)(lambda t: t.document_segments.where("segment_type = 'manuscript'").join(t.etexts.select(F.col("id").alias("etext_id"), "work_id"), "etext_id").groupBy("work_id").agg(F.countDistinct("id").alias("n_segments")).where("n_segments > 0"))
query("having_count", SEG.replace("> 0", "> 1"))(lambda t: t.document_segments.where("segment_type = 'manuscript'").join(t.etexts.select(F.col("id").alias("etext_id"), "work_id"), "etext_id").groupBy("work_id").agg(F.countDistinct("id").alias("n_segments")).where("n_segments > 1"))
query("segments_for_work", "SELECT e.work_id, s.id, s.ordinal FROM etexts e JOIN document_segments s ON s.etext_id = e.id")(lambda t: t.document_segments.join(t.etexts.select(F.col("id").alias("etext_id"), "work_id"), "etext_id").select("work_id", "id", "ordinal"))
