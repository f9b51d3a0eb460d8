"""Entity resolution, ledger, collation, text functions and extraction, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from colophon.functions import minhash, scratch
from colophon.functions import text as x
from colophon.functions import udfs
from colophon.operators import collation as co
from colophon.operators import extract
from colophon.operators import identity as i
from colophon.operators import ledger as l
from colophon.operators import projections as pj
from colophon.operators.index import EntityIndex
from colophon.operators.set_join import best_pairs, fuzzy_pairs
from colophon.plans.registry import query

NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '^(the|a|an)\s+', ''), '\s+(vol|volume|part|chapter)\s*\d*$', ''), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"
PRINT = r"CASE WHEN trim(regexp_replace(lower(coalesce({0}, '')), '\s+', ' ', 'g')) = '' THEN '' ELSE substring(sha256(substring(trim(regexp_replace(lower(coalesce({0}, '')), '\s+', ' ', 'g')), 1, 100)), 1, 16) END"
PAIRS = f"""title AS (SELECT subject_id AS work_id, literal FROM assertions WHERE predicate_uri = 'TITLE'), author AS (SELECT subject_id AS work_id, literal FROM assertions WHERE predicate_uri = 'AUTHOR'),
  nt AS (SELECT work_id, {NORM.format("literal")} AS key, {PRINT.format("literal")} AS fp FROM title),
  own AS (SELECT work_id, {NORM.format("title")} AS key, {PRINT.format("title")} AS fp FROM (SELECT subject_id AS work_id, arg_min(literal, id) AS title FROM assertions WHERE predicate_uri = 'TITLE' GROUP BY 1)),
  m1 AS (SELECT a.entity_id AS work_id, b.entity_id AS match_id, 'exact_identifier' AS matcher, 1.0 AS confidence FROM external_identifiers a JOIN external_identifiers b ON a.scheme = b.scheme AND a.value = b.value AND a.entity_id <> b.entity_id),
  m2 AS (SELECT a.work_id, b.work_id AS match_id, 'normalized_title' AS matcher, 0.95 AS confidence FROM own a JOIN nt b ON a.key = b.key AND a.work_id <> b.work_id WHERE a.key <> ''),
  m3 AS (SELECT a.work_id, b.work_id AS match_id, 'author_title' AS matcher, 0.9 AS confidence FROM (SELECT au.work_id, au.literal AS author, ti.literal AS title FROM author au JOIN title ti USING (work_id)) a
         JOIN (SELECT DISTINCT au.work_id, au.literal AS author, ti.literal AS title FROM author au JOIN title ti USING (work_id)) b ON a.author = b.author AND a.title = b.title AND a.work_id <> b.work_id),
  m4 AS (SELECT a.work_id, b.work_id AS match_id, 'text_fingerprint' AS matcher, 0.85 AS confidence FROM own a JOIN nt b ON a.fp = b.fp AND a.work_id <> b.work_id WHERE a.fp <> ''),
  al AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3 UNION ALL SELECT * FROM m4),
  rk AS (SELECT work_id, match_id, least(1.0::DOUBLE, max(confidence)::DOUBLE + least(0.1::DOUBLE, 0.05::DOUBLE * (count(*) - 1))) AS confidence, count(*) AS n_rows, array_to_string(list_sort(list(DISTINCT matcher)), ',') AS matchers FROM al GROUP BY ALL),
  lb AS (SELECT *, CASE WHEN confidence >= 0.95 THEN 'same' WHEN confidence >= 0.8 THEN 'probably same' WHEN confidence >= 0.6 THEN 'possibly same' ELSE 'unresolved' END AS resolution FROM rk)"""
_classes = lambda t: i.classes(t.assertions, t.external_identifiers)
_histogram = lambda t: i.histogram(_classes(t))

query("normalize_title", f"SELECT id, {NORM.format('literal')} AS key FROM assertions")(lambda t: t.assertions.select("id", x.normalize_title(F.col("literal")).alias("key")))
query("title_prefix_fp", f"SELECT id, {PRINT.format('preferred_title')} AS fp FROM works")(lambda t: t.works.select("id", x.title_fingerprint(F.col("preferred_title")).alias("fp")))
query("self_exact_identifier", f"WITH {PAIRS} SELECT work_id, match_id, matcher, confidence::DOUBLE AS confidence FROM m1")(lambda t: i.by_identifier(t.external_identifiers))
query("self_normalized_title", f"WITH {PAIRS} SELECT work_id, match_id, matcher, confidence::DOUBLE AS confidence FROM m2")(lambda t: i.by_title(t.assertions))
query("self_author_title", f"WITH {PAIRS} SELECT work_id, match_id, matcher, confidence::DOUBLE AS confidence FROM m3")(lambda t: i.by_author_title(t.assertions))
query("self_fingerprint", f"WITH {PAIRS} SELECT work_id, match_id, matcher, confidence::DOUBLE AS confidence FROM m4")(lambda t: i.by_fingerprint(t.assertions))
query("identity_resolve", f"WITH {PAIRS} SELECT * FROM lb")(lambda t: i.identity_resolve(_classes(t)))
query("ranker_group", f"WITH {PAIRS} SELECT matchers, n_rows, count(*) AS n FROM lb GROUP BY ALL")(lambda t: i.ranker_group(_histogram(t)))
query("resolution_hist", f"WITH {PAIRS} SELECT resolution, count(*) AS n, count(DISTINCT work_id) AS n_works FROM lb GROUP BY 1")(lambda t: i.resolution_hist(_histogram(t)))
query("rank_candidates", f"WITH {PAIRS} SELECT work_id, match_id, confidence, CAST(row_number() OVER (PARTITION BY work_id ORDER BY confidence DESC, match_id) AS INTEGER) AS place FROM lb QUALIFY place <= 3")(lambda t: i.rank_candidates(_classes(t)).select("work_id", "match_id", "confidence", "place"))
query("candidate_counts", f"WITH {PAIRS} SELECT work_id, CAST(sum(n_rows) AS BIGINT) AS total_candidates, count(*) AS unique_matches FROM lb GROUP BY 1")(lambda t: i.candidate_counts(_histogram(t)))
query("resolve_work_experiment", f"WITH {PAIRS} SELECT count(*) AS n_pairs FROM (SELECT DISTINCT work_id, match_id FROM al WHERE matcher <> 'author_title')")(lambda t: _histogram(t).where("n_identifier + n_title + n_print > 0").agg(F.sum("n").alias("n_pairs")))

# A cluster's candidates come from two providers, each with the identifiers of its own scheme. Known entities are the works
# that are described by a note and a date; their identifiers and fingerprints are registered, then those of works with a
# note and a tradition again, for other entities.
FP = "CASE WHEN trim(lower(coalesce(title, ''))) <> '' THEN substring(sha256(concat(trim(lower(title)), '|', trim(lower(coalesce(author, ''))))), 1, 16) END"
CAND = f"""cand AS (SELECT concat('K', CAST(seq % 300 AS STRING)) AS cluster, id AS candidate_id, seq AS ordinal, preferred_title AS title, CASE WHEN seq % 4 = 0 THEN NULL ELSE work_type END AS author, CASE WHEN seq % 3 = 0 THEN 'GRETIL' ELSE 'PANDIT' END AS provider FROM works),
  cid AS (SELECT cluster, candidate_id, ordinal, scheme, value FROM cand JOIN external_identifiers e ON e.entity_id = candidate_id AND scheme = provider),
  noted AS (SELECT subject_id FROM assertions WHERE predicate_uri = 'NOTE'),
  described AS (SELECT 1 AS version, subject_id, concat('Z', subject_id) AS as_entity FROM assertions WHERE predicate_uri = 'DATE' AND subject_id IN (FROM noted) UNION ALL SELECT 2, subject_id, concat('Y', subject_id) FROM assertions WHERE predicate_uri = 'TRADITION' AND subject_id IN (FROM noted)),
  idx AS (SELECT scheme, value, as_entity AS entity_id FROM described JOIN external_identifiers e ON e.entity_id = subject_id JOIN works ON id = subject_id QUALIFY row_number() OVER (PARTITION BY scheme, value ORDER BY version DESC, seq DESC, as_entity DESC) = 1),
  cross_idx AS (SELECT scheme, value, concat('X', subject_id) AS entity_id FROM noted JOIN external_identifiers e ON e.entity_id = subject_id JOIN works ON id = subject_id QUALIFY row_number() OVER (PARTITION BY scheme, value ORDER BY seq DESC, subject_id DESC) = 1),
  fps AS (SELECT fp, as_entity AS entity_id FROM (SELECT version, ordinal, as_entity, {FP} AS fp FROM described JOIN cand ON candidate_id = subject_id) WHERE fp IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fp ORDER BY version DESC, ordinal DESC, as_entity DESC) = 1)"""


def _candidates(t):
    cand = t.works.select(
        F.concat(F.lit("K"), (F.col("seq") % 300).cast("string")).alias("cluster"), F.col("id").alias("candidate_id"), F.col("seq").alias("ordinal"), F.col("preferred_title").alias("title"), F.when(F.col("seq") % 4 != 0, F.col("work_type")).alias("author"),
        F.when(F.col("seq") % 3 == 0, "GRETIL").otherwise("PANDIT").alias("provider"),
    )
    ids = cand.join(t.external_identifiers.select(F.col("entity_id").alias("candidate_id"), F.col("scheme").alias("provider"), "value"), ["candidate_id", "provider"]).select("cluster", "candidate_id", "ordinal", F.col("provider").alias("scheme"), "value")
    return cand, ids


def _index(t, keys: list[str], label: str, *registered) -> EntityIndex:
    made = EntityIndex(t.spark, f"{label}_{uuid.uuid4().hex}", keys, scratch.path(t.spark, label))
    for r in registered:
        made.register(r)
    return made


def _described(t):
    """Works of the two registrations, each under its entity's name."""
    fact = lambda p: t.assertions.where(F.col("predicate_uri") == p).select(F.col("subject_id").alias("candidate_id")).distinct()
    noted = fact("NOTE")
    return [noted.join(fact(p), "candidate_id").withColumn("entity_id", F.concat(F.lit(x), "candidate_id")) for p, x in (("DATE", "Z"), ("TRADITION", "Y"))], noted.withColumn("entity_id", F.concat(F.lit("X"), "candidate_id"))


def _ids_of(t, works):
    owned = t.external_identifiers.select(F.col("entity_id").alias("candidate_id"), "scheme", "value")
    return works.join(owned, "candidate_id").join(t.works.select(F.col("id").alias("candidate_id"), F.col("seq").alias("ordinal")), "candidate_id").select("scheme", "value", "entity_id", "ordinal")


def _externals(t):
    return _index(t, ["scheme", "value"], "external", *[_ids_of(t, w) for w in _described(t)[0]])


def _crosswalk(t):
    return _index(t, ["scheme", "value"], "crosswalk", _ids_of(t, _described(t)[1]))


def _prints(t):
    fp = _candidates(t)[0].select("candidate_id", "ordinal", x.biblio_fingerprint(F.col("title"), F.col("author")).alias("fp"))
    return _index(t, ["fp"], "prints", *[w.join(fp, "candidate_id").select("fp", "entity_id", "ordinal") for w in _described(t)[0]])


query("index_externals", f"WITH {CAND} SELECT * FROM idx")(lambda t: _externals(t).entries().drop("version"))
query("index_prints", f"WITH {CAND} SELECT * FROM fps")(lambda t: _prints(t).entries().drop("version"))
query("biblio_fp", f"WITH {CAND} SELECT candidate_id, {FP} AS fp FROM cand")(lambda t: _candidates(t)[0].select("candidate_id", x.biblio_fingerprint(F.col("title"), F.col("author")).alias("fp")))
R0 = "SELECT cluster, entity_id, 'MERGE' AS decision, 1.0::DOUBLE AS confidence, 'R0' AS stage FROM (SELECT cluster, entity_id, row_number() OVER (PARTITION BY cluster ORDER BY ordinal, scheme, value, entity_id) AS k FROM cid JOIN idx USING (scheme, value)) WHERE k = 1"
query("r0_index", f"WITH {CAND} {R0}")(
    lambda t: i.r0_index(_candidates(t)[1], _externals(t).entries())
)
R0S = "SELECT DISTINCT cluster, CAST(NULL AS VARCHAR) AS entity_id, 'MERGE' AS decision, 1.0::DOUBLE AS confidence, 'R0' AS stage FROM (SELECT cluster, scheme, value FROM cid GROUP BY ALL HAVING count(DISTINCT candidate_id) > 1)"
query("r0_shared", f"WITH {CAND} {R0S}")(lambda t: i.r0_shared(_candidates(t)[1]))
R1 = "SELECT cluster, entity_id, 'LINK_PROBABLE' AS decision, 0.95::DOUBLE AS confidence, 'R1' AS stage FROM (SELECT cluster, entity_id, row_number() OVER (PARTITION BY cluster ORDER BY ordinal, entity_id) AS k FROM cid JOIN cross_idx USING (scheme, value)) WHERE k = 1"
query("r1_crosswalk", f"WITH {CAND} {R1}")(lambda t: i.r1_crosswalk(_candidates(t)[1], _crosswalk(t).entries()))
R2 = f"SELECT g.cluster, fps.entity_id, 'REVIEW' AS decision, 0.85::DOUBLE AS confidence, 'R2' AS stage FROM (SELECT cluster, fp FROM (SELECT cluster, ordinal, {FP} AS fp FROM cand) WHERE fp IS NOT NULL GROUP BY cluster, fp HAVING count(*) > 1 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY min(ordinal)) = 1) g LEFT JOIN fps USING (fp)"
query("r2_composite", f"WITH {CAND} {R2}")(
    lambda t: i.r2_composite(_candidates(t)[0], _prints(t).entries())
)
TOK = r"list_distinct(string_split(trim(regexp_replace(lower({0}), '\s+', ' ', 'g')), ' '))"
R3 = f"WITH w AS (SELECT cluster, ordinal, {TOK.format('title')} AS t FROM cand), p AS (SELECT a.cluster, len(list_intersect(a.t, b.t))::DOUBLE / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) AS j FROM w a JOIN w b ON a.cluster = b.cluster AND a.ordinal < b.ordinal) SELECT cluster, CAST(NULL AS VARCHAR) AS entity_id, 'REVIEW' AS decision, max(j) AS confidence, 'R3' AS stage FROM p WHERE j > 0.7 GROUP BY cluster"
query("r3_fuzzy", f"WITH {CAND} SELECT * FROM (" + R3 + ")")(
    lambda t: i.r3_fuzzy(_candidates(t)[0])
)
R4 = f"WITH f AS (SELECT cluster, provider, {FP} AS fp FROM cand) SELECT DISTINCT cluster, CAST(NULL AS VARCHAR) AS entity_id, 'LINK_PROBABLE' AS decision, 0.9::DOUBLE AS confidence, 'R4' AS stage FROM (SELECT cluster, fp FROM f WHERE fp IS NOT NULL GROUP BY ALL HAVING count(DISTINCT provider) > 1)"
query("r4_multi_source", f"WITH {CAND} SELECT * FROM (" + R4 + ")")(
    lambda t: i.r4_multi_source(_candidates(t)[0])
)
R5 = f"SELECT cluster, CAST(NULL AS VARCHAR) AS entity_id, 'REVIEW' AS decision, 0.95::DOUBLE AS confidence, 'R5' AS stage FROM cand GROUP BY cluster HAVING count(*) > 1 AND cluster IN (SELECT concat('K', CAST(seq AS STRING)) FROM works WHERE seq % 10 = 0)"
query("r5_scholar", f"WITH {CAND} SELECT * FROM (" + R5 + ")")(
    lambda t: i.r5_scholar(_candidates(t)[0], t.works.where("seq % 10 = 0").select(F.concat(F.lit("K"), F.col("seq").cast("string")).alias("cluster")))
)


STAGES = " UNION ALL ".join(f"SELECT {k} AS k, cluster, entity_id, decision, confidence, stage FROM ({sql})" for k, sql in enumerate((R0, R0S, R1, R2, R3, R4, R5)))
FIRST = "SELECT c.cluster, f.entity_id, coalesce(f.decision, 'REVIEW') AS decision, coalesce(f.confidence, 0.0)::DOUBLE AS confidence, coalesce(f.stage, 'NONE') AS stage FROM (SELECT DISTINCT cluster FROM cand) c LEFT JOIN (FROM every QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY k) = 1) f USING (cluster)"


def _staged(t, all_stages: bool = False):
    cand, ids = _candidates(t)
    attested = t.works.where("seq % 10 = 0").select(F.concat(F.lit("K"), F.col("seq").cast("string")).alias("cluster"))
    return i.resolve(cand, ids, _externals(t).entries(), _prints(t).entries(), attested, _crosswalk(t).entries(), all_stages)


query("stage_order", f"WITH {CAND}, every AS ({STAGES}) {FIRST}")(_staged)
query("stage_decisions", f"WITH {CAND}, every AS ({STAGES}) SELECT cluster, entity_id, decision, confidence, stage FROM every")(lambda t: _staged(t, True))

FEED = "SELECT cursor, event_id, event_type, entity_id FROM ledger WHERE cursor > 500 ORDER BY cursor LIMIT 200"
query("changes_feed", FEED)(lambda t: l.changes_feed(t.ledger, 500, 200).select("cursor", "event_id", "event_type", "entity_id"))
query("max_cursor", "SELECT coalesce(max(cursor), 0) AS max_cursor FROM ledger")(lambda t: l.max_cursor(t.ledger))
query("latest_n_events", "SELECT entity_id, cursor, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY cursor DESC) AS INTEGER) AS place FROM ledger QUALIFY place <= 10")(lambda t: l.latest_events(t.ledger, 10).select("entity_id", "cursor", "place"))
query("replay", "SELECT entity_id AS id, arg_min(title, cursor) AS preferred_title, min(cursor) AS first_cursor FROM ledger WHERE event_type = 'EntityCreated' AND NOT starts_with(entity_id, 'PTCND_') GROUP BY 1")(lambda t: l.replay(t.ledger))
# Beside the one rule that a ledger's events have of themselves, rules for a ledger that names what it adds.
REBUILT = {
    **pj.RULES,
    "assertions": pj.Rule("event_type = 'AssertionAdded'", "event_id", {"subject_id": "entity_id", "literal": "title"}),
    "external_identifiers": pj.Rule("event_type = 'AssertionAdded' AND digest IS NOT NULL", "concat(entity_id, ':', title)", {"entity_id": "entity_id", "scheme": "title", "value": "digest"}),
    "identity_assertions": pj.Rule("event_type NOT IN ('EntityCreated', 'AssertionAdded')", "entity_id", {"relation": "event_type"}),
}
LED = "led AS (SELECT * FROM ledger WHERE NOT starts_with(entity_id, 'PTCND_'))"
ROWS = {
    "works": "SELECT entity_id AS id, min(cursor) AS first_cursor, arg_min(coalesce(title, ''), cursor) AS preferred_title FROM led WHERE event_type = 'EntityCreated' GROUP BY 1",
    "assertions": "SELECT event_id AS id, cursor AS first_cursor, entity_id AS subject_id, title AS literal FROM led WHERE event_type = 'AssertionAdded'",
    "external_identifiers": "SELECT concat(entity_id, ':', title) AS id, min(cursor) AS first_cursor, title AS scheme, arg_min(digest, cursor) AS value FROM led WHERE event_type = 'AssertionAdded' AND digest IS NOT NULL GROUP BY entity_id, title",
    "identity_assertions": "SELECT entity_id AS id, min(cursor) AS first_cursor, arg_min(event_type, cursor) AS relation FROM led WHERE event_type NOT IN ('EntityCreated', 'AssertionAdded') GROUP BY 1",
}


def _rebuilt(t) -> str:
    """Two rebuilds: of the first half of the ledger, then of all of it; readers see the second."""
    root = scratch.path(t.spark, "projections")
    half = t.ledger.agg(F.floor(F.avg("cursor")).alias("c")).first()["c"] or 0
    pj.rebuild(t.ledger.where(F.col("cursor") <= half), root, REBUILT)
    pj.rebuild(t.ledger, root, REBUILT)
    return root


query("truncate_rebuild", f"WITH {LED}, " + ", ".join(f"r_{n} AS ({q})" for n, q in ROWS.items()) + " SELECT projection, coalesce(n, 0) AS n_rows FROM (SELECT unnest([" + ", ".join(f"'{n}'" for n in pj.PROJECTIONS) + "]) AS projection) LEFT JOIN (" + " UNION ALL ".join(f"SELECT '{n}' AS projection, count(*) AS n FROM r_{n}" for n in ROWS) + ") USING (projection)")(
    lambda t: pj.counts(t.spark, _rebuilt(t))
)
for _name, _fields in (("works", ["preferred_title"]), ("assertions", ["subject_id", "literal"]), ("external_identifiers", ["scheme", "value"]), ("identity_assertions", ["relation"])):
    query(f"rebuilt_{_name}", f"WITH {LED} {ROWS[_name]}")(lambda t, n=_name, f=_fields: pj.read(t.spark, _rebuilt(t), n, {c: "string" for c in f}))

query(
    "merkle_root",
    """WITH RECURSIVE leaves AS (SELECT row_number() OVER (ORDER BY cursor) - 1 AS pos, sha256(concat(event_id, ':', CAST(cursor AS STRING), ':', coalesce(digest, ''))) AS h FROM ledger),
       tree AS (SELECT 0 AS lvl, pos, h, (SELECT count(*) FROM leaves) AS n FROM leaves UNION ALL
         SELECT lvl + 1, pos // 2, sha256(concat(h, coalesce(nx, h))), (n + 1) // 2 FROM (SELECT lvl, pos, h, n, lead(h) OVER (ORDER BY pos) AS nx FROM tree) WHERE n > 1 AND pos % 2 = 0)
       SELECT h AS root, (SELECT min(cursor) FROM ledger) AS first_cursor, (SELECT max(cursor) FROM ledger) AS last_cursor, (SELECT count(*) FROM ledger) AS n_events FROM tree WHERE n = 1""",
)(lambda t: l.merkle_root(t.ledger))
query("merkle_leaf", "SELECT cursor, sha256(concat(event_id, ':', CAST(cursor AS STRING), ':', coalesce(digest, ''))) AS hash FROM ledger")(lambda t: t.ledger.select("cursor", l.leaf(F.col("event_id"), F.col("cursor"), F.col("digest")).alias("hash")))

WT = r"wt AS (SELECT work_id, siglum, pos - 1 AS position, arg_max(tok, ordinal) AS token FROM (SELECT work_id, siglum, ordinal, unnest(w) AS tok, unnest(range(1, len(w) + 1)) AS pos FROM (SELECT work_id, siglum, ordinal, list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' '), lambda y: y <> '') AS w FROM readings)) GROUP BY ALL)"
COL = f"{WT}, vo AS (SELECT work_id, position, token, count(*) AS n FROM wt GROUP BY ALL), cl AS (SELECT work_id, CAST(position AS INTEGER) AS position, CAST(sum(n) AS BIGINT) AS n_witnesses, count(*) AS n_tokens, first(token ORDER BY n DESC, token) AS consensus, count(*) > 1 AS is_variant FROM vo GROUP BY work_id, position)"
_collated = lambda t: co.collate(co.witness_tokens(t.readings))
query("collate", f"WITH {COL} SELECT * FROM cl")(_collated)
query("collation_counts", f"WITH {COL} SELECT work_id, count(*) AS n_places, count(*) FILTER (WHERE is_variant) AS n_variants, count(*) FILTER (WHERE NOT is_variant) AS n_consensus, 1 - count(*) FILTER (WHERE is_variant)::DOUBLE / count(*) AS score FROM cl GROUP BY work_id")(lambda t: co.collation_score(_collated(t)))
query("first_n_variants", f"WITH {COL} SELECT work_id, position, consensus, CAST(row_number() OVER (PARTITION BY work_id ORDER BY position) AS INTEGER) AS place FROM cl WHERE is_variant QUALIFY place <= 20")(
    lambda t: co.apparatus(_collated(t), co.witness_tokens(t.readings)).select("work_id", "position", "consensus", "place")
)
query("apparatus", f"WITH {COL}, fv AS (SELECT work_id, position FROM cl WHERE is_variant QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY position) <= 20) SELECT f.work_id, f.position, string_agg(concat(siglum, '=', token), '|' ORDER BY siglum) AS readings FROM fv f JOIN wt ON wt.work_id = f.work_id AND wt.position = f.position GROUP BY ALL")(
    lambda t: co.apparatus(_collated(t), co.witness_tokens(t.readings)).select("work_id", "position", F.array_join(F.transform(F.array_sort(F.map_entries("readings")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("readings"))
)
query("dupe_hash", "SELECT sha256(text) AS input_hash, count(*) AS n_rows FROM documents GROUP BY 1 HAVING count(*) > 1")(lambda t: co.duplicate_hashes(t.documents, "text"))
query("extractor_sanity", "SELECT source, count(*) AS n_rows, count(*) FILTER (WHERE regexp_matches(substring(lower(text), 1, 40), '[āīūṛṝḷḹṃḥṅñṭḍṇśṣḻäöüéèçñó]')) AS n_marked, count(*) - count(DISTINCT text) AS n_repeats, (count(*) FILTER (WHERE regexp_matches(substring(lower(text), 1, 40), '[āīūṛṝḷḹṃḥṅñṭḍṇśṣḻäöüéèçñó]')) < greatest(1, count(*) // 2)) OR count(*) > count(DISTINCT text) AS suspicious FROM documents GROUP BY source")(
    lambda t: co.extractor_sanity(t.documents, "source", "text")
)
query("substring_bidirectional_anti", "WITH c AS (SELECT DISTINCT lower(preferred_title) AS title FROM works), f AS (SELECT DISTINCT lower(literal) AS other FROM assertions WHERE predicate_uri = 'TITLE') SELECT title FROM c WHERE NOT EXISTS (SELECT 1 FROM f WHERE contains(title, other) OR contains(other, title))")(
    lambda t: co.missed(t.works.select(F.col("preferred_title").alias("title")), t.assertions.where("predicate_uri = 'TITLE'").select(F.col("literal").alias("title")))
)
query("passages_missed", "WITH c AS (SELECT DISTINCT lower(text) AS title FROM benchmark), f AS (SELECT DISTINCT lower(unnest(string_split(text, chr(10)))) AS other FROM documents) SELECT title FROM c WHERE NOT EXISTS (SELECT 1 FROM f WHERE other <> '' AND (contains(title, other) OR contains(other, title)))")(
    lambda t: co.missed(t.benchmark.select(F.col("text").alias("title")), t.documents.select(F.explode(F.split("text", "\n")).alias("title")).where("title <> ''"))
)
query("source_binding_join", "SELECT concat('o', CAST(d.doc_id AS STRING)) AS object_id, CASE WHEN d.doc_id % 7 = 0 THEN 'MISSING' WHEN d.doc_id % 5 = 0 THEN 'MISMATCH' ELSE 'MATCH' END AS status FROM documents d")(
    lambda t: co.source_binding(
        t.documents.select(F.concat(F.lit("o"), F.col("doc_id").cast("string")).alias("object_id"), F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).cast("binary"), 256).alias("sha256")),
        t.documents.where("doc_id % 7 <> 0").select(F.concat(F.lit("o"), F.col("doc_id").cast("string")).alias("object_id"), "text"),
    )
)
AL = "list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '([{1}]+)', 1))"
NW = r"len(list_filter(string_split(trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g')), ' '), lambda y: y <> ''))"
PV = f"pv AS (SELECT doc_id, source, translation, len(s) AS n_source_tokens, len(list_intersect(s, o)) AS n_matched, len(list_intersect(s, o))::DOUBLE / nullif(len(s), 0) AS b, nt::DOUBLE / nullif(ns, 0) AS c FROM (SELECT a.doc_id, a.text AS source, b.text AS translation, {AL.format('a.text', 'a-zāīūṛṝḷḹṃṁñṅṇśṣṭḍḥ')} AS s, {AL.format('b.text', 'a-z')} AS o, {NW.format('a.text')} AS ns, {NW.format('b.text')} AS nt FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1))"
_pairs = lambda t: t.documents.select("doc_id", F.col("text").alias("source")).join(t.documents.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("translation")), "doc_id")
_TERMS = {"tion": ("ation",), "que": ("queau", "ment"), "heit": ("zz",)}
VIOLATED = "CASE WHEN contains(lower(translation), 'tion') AND NOT contains(lower(translation), 'ation') THEN 1 ELSE 0 END + CASE WHEN contains(lower(translation), 'que') AND NOT contains(lower(translation), 'queau') AND NOT contains(lower(translation), 'ment') THEN 1 ELSE 0 END + CASE WHEN contains(lower(translation), 'heit') AND NOT contains(lower(translation), 'zz') THEN 1 ELSE 0 END"
query("prove", f"WITH {PV} SELECT doc_id, CAST(n_source_tokens AS INTEGER) AS n_source_tokens, CAST(n_matched AS INTEGER) AS n_matched, round_even(coalesce(b, 0.0), 3) AS binding, round_even(coalesce(c, 0.0), 3) AS coverage, {VIOLATED} AS n_violations, substring(sha256(source), 1, 16) AS source_sha, CASE WHEN coalesce(b, 0) > 0.1 AND coalesce(c, 0) > 0.3 AND {VIOLATED} = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM pv")(
    lambda t: co.prove(_pairs(t), _TERMS).withColumn("n_violations", F.size("violations")).select("doc_id", "n_source_tokens", "n_matched", "binding", "coverage", "n_violations", "source_sha", "verdict")
)
query("term_consistency", "SELECT a.doc_id AS id, g.term FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1, (VALUES ('tion', ['ation']), ('que', ['queau', 'ment']), ('heit', ['zz'])) g(term, r) WHERE contains(lower(b.text), g.term) AND NOT contains(lower(b.text), r[1]) AND NOT contains(lower(b.text), r[-1])")(
    lambda t: co.term_violations(_pairs(t).withColumnRenamed("doc_id", "id"), t.spark.createDataFrame([(k, list(v)) for k, v in _TERMS.items()], "term string, renderings array<string>"))
)

query("word_jaccard", f"WITH n AS (SELECT a.doc_id, {TOK.format('a.text')} AS s, {TOK.format('b.text')} AS o FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1) SELECT doc_id, len(list_intersect(s, o))::DOUBLE / len(list_distinct(list_concat(s, o))) AS jaccard FROM n")(
    lambda t: _pairs(t).select("doc_id", x.word_jaccard(F.col("source"), F.col("translation")).alias("jaccard"))
)
query("fuzzy_pair_join", f"WITH w AS (SELECT DISTINCT preferred_title AS title FROM works), k AS (SELECT title, {TOK.format('title')} AS s FROM w) SELECT a.title AS title_a, b.title AS title_b, len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) AS score FROM k a JOIN k b ON a.title < b.title WHERE score > 0.3")(
    lambda t: fuzzy_pairs(t.works.select(F.col("preferred_title").alias("title")), 0.3)
)


query("fuzzy_documents", f"WITH w AS (SELECT DISTINCT string_split(text, chr(10))[1] AS title FROM documents), k AS (SELECT title, {TOK.format('title')} AS s FROM w WHERE trim(title) <> '') SELECT a.title AS title_a, b.title AS title_b, len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) AS score FROM k a JOIN k b ON a.title < b.title WHERE score > 0.7")(
    lambda t: fuzzy_pairs(t.documents.select(F.substring_index("text", "\n", 1).alias("title")), 0.7)
)
query("best_pair", f"WITH {CAND}, w AS (SELECT cluster, ordinal, {TOK.format('title')} AS t FROM cand), p AS (SELECT a.cluster, a.ordinal AS first, b.ordinal AS second, len(list_intersect(a.t, b.t))::DOUBLE / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) AS score FROM w a JOIN w b ON a.cluster = b.cluster AND a.ordinal < b.ordinal) SELECT cluster, first, second, score FROM p WHERE score > 0.7 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY score DESC, first, second) = 1")(
    lambda t: best_pairs(_candidates(t)[0])
)


query("fold_iast", "SELECT doc_id, regexp_replace(translate(lower(text), 'āīūṛṝḷḹṃḥṅñṭḍṇśṣḻ', 'aiurrllmhnntdnssl'), '[^a-z0-9 ]', '', 'g') AS folded FROM documents")(lambda t: t.documents.select("doc_id", x.fold_iast(F.col("text")).alias("folded")))
query("normalize_sanskrit", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS normal FROM documents")(lambda t: t.documents.select("doc_id", x.normalize_sanskrit(udfs.nfc("text")).alias("normal")))
query("digest", "SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS n_bytes FROM documents")(lambda t: t.documents.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("n_bytes")))
query("prefix_suffix_fp", "SELECT doc_id, substring(sha256(substring(text, 1, 100)), 1, 16) AS prefix_hash, substring(sha256(right(text, 100)), 1, 16) AS suffix_hash, CAST(length(text) AS INTEGER) AS n_letters FROM documents")(
    lambda t: t.documents.select("doc_id", x.prefix_suffix_hash(F.col("text")).alias("f")).select("doc_id", "f.*")
)
query("shingles", "SELECT doc_id, greatest(length(text) - 2, 0) AS n_shingles FROM documents")(lambda t: t.documents.select("doc_id", F.size(x.shingles(F.col("text"))).cast("long").alias("n_shingles")))
query("slugify", "SELECT doc_id, CASE WHEN s = '' THEN 'work' ELSE s END AS slug FROM (SELECT doc_id, substring(replace(lower(trim(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g'))), ' ', '_'), 1, 60) AS s FROM documents)")(lambda t: t.documents.select("doc_id", x.slugify(F.col("text")).alias("slug")))
query("timestamps", "SELECT cursor, strftime(recorded_at, '%Y-%m-%dT%H:%M:%SZ') AS at FROM ledger")(lambda t: t.ledger.select("cursor", x.iso_seconds(F.col("recorded_at")).alias("at")))
query("rights_class", "SELECT scheme, value, CASE WHEN scheme IN ('GRETIL', 'ARCHIVE_ORG') THEN 'open' ELSE 'restricted' END AS rights FROM external_identifiers")(lambda t: t.external_identifiers.select("scheme", "value", F.when(F.col("scheme").isin("GRETIL", "ARCHIVE_ORG"), "open").otherwise("restricted").alias("rights")))
query("minhash_signature")(lambda t: minhash.signatures(t.documents, "doc_id", "text"))
query("html_links")(lambda t: extract.html_links(t.pages, "page_id", "url", "html"))
query("passages_split", "SELECT doc_id, unnest(range(1, len(p) + 1)) AS ordinal, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)")(
    lambda t: t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "line")).select("doc_id", (F.col("ordinal") + 1).cast("long").alias("ordinal"), "line")
)
query("verse_rows", "SELECT concat(CAST(doc_id AS STRING), ':v', CAST(min(ordinal) AS STRING)) AS object_id, sha256(line) AS sha256 FROM (SELECT doc_id, unnest(range(1, len(p) + 1)) AS ordinal, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)) GROUP BY doc_id, line")(
    lambda t: extract.verse_rows(t.documents.select(F.col("doc_id").cast("string").alias("work"), F.posexplode(F.split("text", "\n")).alias("p", "verse")).select("work", (F.col("p") + 1).alias("ordinal"), "verse")).select("object_id", "sha256")
)
query("adapter_normalize", "SELECT concat('W', CAST(doc_id AS STRING)) AS subject_id, p AS predicate_uri, v AS literal FROM (SELECT doc_id, unnest(['TITLE', 'LANGUAGE', 'SOURCE']) AS p, unnest([split_part(text, chr(10), 1), lang, source]) AS v FROM documents) WHERE v IS NOT NULL")(
    lambda t: t.documents.select(F.concat(F.lit("W"), F.col("doc_id").cast("string")).alias("subject_id"), F.inline(F.array(*[F.struct(F.lit(p).alias("predicate_uri"), c.alias("literal")) for p, c in (("TITLE", F.substring_index("text", "\n", 1)), ("LANGUAGE", F.col("lang")), ("SOURCE", F.col("source")))]))).where("literal is not null")
)
query("adapter_audit", "SELECT page_id, len(regexp_extract_all(html, '<a ')) AS n_links, len(regexp_extract_all(html, '<p>')) AS n_paragraphs FROM pages")(
    lambda t: t.pages.select("page_id", F.size(F.regexp_extract_all("html", F.lit("<a "), F.lit(0))).cast("long").alias("n_links"), F.size(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0))).cast("long").alias("n_paragraphs"))
)
