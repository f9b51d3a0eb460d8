"""Records of the ledger, of annotations and of public vocabularies, text extraction and file readers, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.functions import minhash, scratch, udfs
from colophon.functions import text as x
from colophon.operators import extract
from colophon.operators import ledger as l
from colophon.operators import serialize as s
from colophon.operators import services as sv
from colophon.operators import snapshot as sn
from colophon.plans.registry import query
from colophon.sources import readers

AT = "2026-01-01T00:00:00Z"


# --- ledger ----------------------------------------------------------------------

TREE = """tree AS (SELECT 0 AS lvl, pos, h, (SELECT count(*) FROM leaves) AS n FROM leaves UNION ALL
         SELECT lvl + 1, pos // 2, sha256(concat(h, coalesce(nx, h))), (n + 1) // 2 FROM (SELECT lvl, pos, h, n, lead(h) OVER (ORDER BY pos) AS nx FROM tree) WHERE n > 1 AND pos % 2 = 0)"""
query("state_digest", """WITH page AS (SELECT * FROM ledger WHERE cursor > 0) SELECT sha256(concat('{"events":[', string_agg(concat('{"id":"', event_id, '","type":"', event_type, '"}'), ',' ORDER BY cursor), ']}')) AS state_digest, count(*) AS n_events FROM page""")(lambda t: l.state_digest(t.ledger, algorithm="sha256"))
query("state_root", f"WITH RECURSIVE leaves AS (SELECT row_number() OVER (ORDER BY cursor) - 1 AS pos, sha256(concat(event_id, ':', event_type)) AS h FROM ledger), {TREE} SELECT h AS state_root, (SELECT count(*) FROM ledger) AS n_events FROM tree WHERE n = 1")(lambda t: l.state_root(t.ledger))


def _checkpoints(t):
    """Three checkpoints over growing stretches of the ledger; roots don't matter for what reads them by place."""
    return t.spark.createDataFrame([("c1", 1, 10, "a"), ("c2", 11, 40, "b"), ("c3", 41, 90, "c")], "id string, first_event_cursor long, last_event_cursor long, root string")


query("latest_checkpoint", "SELECT id, first_event_cursor FROM (VALUES ('c1', 1::BIGINT), ('c2', 11::BIGINT), ('c3', 41::BIGINT)) c(id, first_event_cursor) ORDER BY first_event_cursor DESC LIMIT 1")(lambda t: l.latest_checkpoint(_checkpoints(t)).select("id", "first_event_cursor"))
query(
    "checkpoint_row",
    f"WITH RECURSIVE leaves AS (SELECT row_number() OVER (ORDER BY cursor) - 1 AS pos, sha256(concat(event_id, ':', CAST(cursor AS STRING), ':', coalesce(digest, ''))) AS h FROM ledger), {TREE} SELECT 'c3' AS previous_checkpoint_id, (SELECT min(cursor) FROM ledger) AS first_event_cursor, (SELECT max(cursor) FROM ledger) AS last_event_cursor, (SELECT count(*) FROM ledger) AS event_count, concat('{{\"root\":\"', h, '\",\"leaf_count\":', CAST((SELECT count(*) FROM ledger) AS STRING), '}}') AS merkle FROM tree WHERE n = 1",
)(lambda t: l.checkpoint_row(t.ledger, _checkpoints(t), F.lit(AT)).drop("id", "generated_at"))
query("merkle_verify", "SELECT * FROM (VALUES ('kept', true), ('one event changed', false), ('one event lost', false), ('no checkpoint', false)) v(ledger, valid)")(lambda t: _verified(t))


def _verified(t):
    """The recorded root against the ledger as it is, with one event changed, with one lost, and without a checkpoint."""
    kept = l.merkle_root(t.ledger).select(F.lit("c").alias("checkpoint_id"), "first_cursor", "last_cursor", "root")
    middle = F.col("cursor") == t.ledger.agg(F.floor(F.avg("cursor")).alias("c")).first()["c"]
    cases = {"kept": (t.ledger, "c"), "one event changed": (t.ledger.withColumn("digest", F.when(middle, "x").otherwise(F.col("digest"))), "c"), "one event lost": (t.ledger.where(~middle), "c"), "no checkpoint": (t.ledger, "d")}
    return reduce(DataFrame.unionByName, [l.merkle_verify(ledger, kept, c).select(F.lit(name).alias("ledger"), "valid") for name, (ledger, c) in cases.items()])


query("append_event", "SELECT event_id, (SELECT max(cursor) FROM ledger) + row_number() OVER (ORDER BY recorded_at, event_id) AS cursor FROM ledger")(
    lambda t: l.append_events(t.ledger, t.ledger.select("event_id", "recorded_at")).select("event_id", "cursor")
)
query("payload_digest", """SELECT event_id, concat('{"algorithm":"sha256","value":"', sha256(concat('{"event_type":"', event_type, '","user_id":', user_id, '}')), '"}') AS digest FROM events""")(lambda t: t.events.select("event_id", l.payload_digest(F.to_json(F.struct("user_id", "event_type")), "sha256").alias("digest")))
query("sign_verify", "SELECT event_id, event_id % 2 = 0 AS valid FROM events")(
    lambda t: t.events.select("event_id", F.to_json(F.struct("event_id", "event_type")).alias("r")).select("event_id", l.signature_valid(F.when(F.col("event_id") % 2 == 0, F.col("r")).otherwise(F.lit("{}")), l.signature(F.col("r"), F.lit(AT))).alias("valid"))
)
query("follow_merges", "SELECT id AS from_id, 'W1' AS into_id FROM works WHERE seq > 1")(
    lambda t: l.follow_merges(t.works.where("seq > 1").select(F.col("id").alias("from_id"), F.concat(F.lit("W"), F.floor(F.col("seq") / 2).cast("string")).alias("into_id")))
)
# Works and their authors and traditions as a graph.
GRAPH = "e AS (SELECT subject_id AS s, predicate_uri AS r, literal AS t FROM assertions WHERE predicate_uri IN ('AUTHOR', 'TRADITION', 'LANGUAGE')), b AS (SELECT s, r, t FROM e UNION ALL SELECT t, r, s FROM e)"
_edges = lambda t: t.assertions.where("predicate_uri in ('AUTHOR', 'TRADITION', 'LANGUAGE')").select(F.col("subject_id").alias("source"), F.col("predicate_uri").alias("relation"), F.col("literal").alias("target"))
query("graph_traverse", f"WITH RECURSIVE {GRAPH}, walk AS (SELECT 'W1' AS node, 0 AS d UNION SELECT t, d + 1 FROM walk JOIN b ON s = node WHERE r IN ('AUTHOR', 'TRADITION', 'LANGUAGE') AND d < 2) SELECT node, CAST(min(d) AS INTEGER) AS distance FROM walk GROUP BY 1")(lambda t: l.traverse(_edges(t), ["W1"], 2))
query("graph_neighbours", f"WITH RECURSIVE {GRAPH}, walk AS (SELECT 'W3' AS node, 0 AS d UNION SELECT t, d + 1 FROM walk JOIN b ON s = node WHERE r = 'TRADITION' AND d < 4) SELECT node, CAST(min(d) AS INTEGER) AS distance FROM walk GROUP BY 1 ORDER BY distance, node LIMIT 20")(lambda t: l.traverse(_edges(t), ["W3"], 4, relation="TRADITION", limit=20))
query("graph_out", f"WITH RECURSIVE {GRAPH}, walk AS (SELECT id AS node, 0 AS d FROM works WHERE seq <= 50 UNION SELECT t, d + 1 FROM walk JOIN e ON s = node WHERE d < 5) SELECT node, CAST(min(d) AS INTEGER) AS distance FROM walk GROUP BY 1")(
    lambda t: l.traverse(_edges(t), [f"W{k}" for k in range(51)] if t.works.where("seq = 0").count() else [f"W{k}" for k in range(1, 51)], 5, "out")
)
query("split_lookup", "SELECT concat('S', CAST(seq AS STRING)) AS id FROM works WHERE work_type = (SELECT work_type FROM works WHERE seq = 1)")(
    lambda t: sv.split_targets(t.works.select(F.concat(F.lit("S"), F.col("seq").cast("string")).alias("id"), F.col("work_type").alias("old_id")), t.works.where("seq = 1").first()["work_type"]).select("id")
)
query("record_derivation", f"""SELECT id AS entity, concat('ACT_', substring(sha256(concat('{{"activity_type":"INGEST","inputs":"[{{\\"object_id\\":\\"', id, '\\"}}]","outputs":"', id, '","at":"{AT}"}}')), 1, 32)) AS id, '{{}}' AS software FROM works""")(
    lambda t: sv.record_derivations(
        t.works.select(F.lit("INGEST").alias("activity_type"), F.to_json(F.array(F.struct(F.col("id").alias("object_id")))).alias("inputs"), F.col("id").alias("outputs"), F.lit(None).cast("string").alias("actor_id"), F.lit(None).cast("string").alias("software"), F.lit(None).cast("string").alias("configuration"), F.lit(AT).alias("at"))
    ).select(F.col("outputs").alias("entity"), "id", "software")
)
query("record_llm_call", """SELECT doc_id, CASE WHEN text IS NULL THEN '[{"prompt_digest":{"algorithm":"sha256"}}]' ELSE concat('[{"prompt_digest":{"algorithm":"sha256","value":"', sha256(text), '"}}]') END AS inputs, coalesce('provider:' || source, '') AS actor_id FROM documents""")(
    lambda t: sv.record_model_calls(t.documents.select(F.lit("m").alias("model"), F.col("source").alias("provider"), F.col("text").alias("prompt"), F.lit("r").alias("response"), F.col("doc_id").cast("string").alias("config"), F.lit(AT).alias("at"))).select(F.col("configuration").cast("long").alias("doc_id"), "inputs", "actor_id")
)

# --- snapshots: two of works and people, the second after works were renamed in a few buckets -------------

DIGESTS = """rowed AS (SELECT table_name, substring(sha256(id), 1, 2) AS bucket, sha256(j) AS h FROM r), digests AS (SELECT table_name, bucket, count(*) AS n_rows, sha256(concat_ws(':', count(*), sum(CAST(concat('0x', substring(h, 1, 15)) AS HUGEINT)),
  sum(CAST(concat('0x', substring(h, 16, 15)) AS HUGEINT)), sum(CAST(concat('0x', substring(h, 31, 15)) AS HUGEINT)), sum(CAST(concat('0x', substring(h, 46, 15)) AS HUGEINT)))) AS digest FROM rowed GROUP BY ALL)"""
SNAPPED = "r AS (SELECT 'works' AS table_name, id, CAST(to_json({'id': id, 'preferred_title': preferred_title, 'work_type': work_type, 'seq': seq}) AS VARCHAR) AS j FROM works UNION ALL SELECT 'people', id, CAST(to_json({'id': id, 'name': name, 'role': role}) AS VARCHAR) FROM people)"


def _snapshots(t) -> str:
    root = scratch.path(t.spark, "snapshots")
    renamed = t.works.withColumn("preferred_title", F.when(F.col("seq") <= 5, F.concat("preferred_title", F.lit("!"))).otherwise(F.col("preferred_title")))
    for works in (renamed, t.works):
        sn.take(root, {"works": (works, "id"), "people": (t.people, "id")})
    return root


query("export_snapshot", f"WITH {SNAPPED}, {DIGESTS} SELECT table_name, CAST(sum(n_rows) AS BIGINT) AS n_rows, sha256(string_agg(concat(bucket, ':', digest), ',' ORDER BY bucket)) AS root FROM digests GROUP BY table_name")(
    lambda t: sn.listing(t.spark, _snapshots(t)).where("version = 2").drop("version")
)
query("snapshot_changes", "SELECT DISTINCT 'works' AS table_name, substring(sha256(id), 1, 2) AS bucket FROM works WHERE seq <= 5")(lambda t: sn.changed(t.spark, _snapshots(t), 1, 2))
query("snapshot_restore", "SELECT * FROM works")(lambda t: sn.restore(t.spark, _snapshots(t), 2, "works"))
query("snapshot_verify", "SELECT DISTINCT substring(sha256(id), 1, 2) AS bucket, true AS valid FROM works")(lambda t: sn.verify(t.spark, _snapshots(t), 1, "works", "id"))

# --- vocabularies ------------------------------------------------------------------

query("prov_entity", f"SELECT id, CAST(to_json({{'@context': '{s.PROV}', 'type': 'prov:Entity', 'id': id}}) AS VARCHAR) AS json FROM works")(lambda t: t.works.select("id", s.prov_entity(F.col("id")).alias("json")))
query("prov_activity", f"SELECT id, CAST(to_json({{'@context': '{s.PROV}', 'type': 'prov:Activity', 'id': id, 'prov:startedAtTime': '{AT}', 'prov:endedAtTime': '{AT}', 'prov:used': [{{'type': 'prov:Entity', 'id': work_type}}], 'prov:generated': [{{'type': 'prov:Entity', 'id': preferred_title}}], 'prov:wasAssociatedWith': {{'type': 'prov:Agent', 'id': 'a'}}}}) AS VARCHAR) AS json FROM works")(
    lambda t: t.works.select("id", s.prov_activity(F.col("id"), F.array("work_type"), F.array("preferred_title"), F.lit(AT), F.lit(AT), F.lit("a")).alias("json"))
)
query("prov_graph", f"SELECT work_type, concat('{{\"@context\":\"{s.PROV}\",\"type\":\"prov:Bundle\",\"entities\":[', string_agg(CAST(to_json({{'@context': '{s.PROV}', 'type': 'prov:Entity', 'id': id}}) AS VARCHAR), ',' ORDER BY id), '],\"activities\":[],\"agents\":[', CAST(to_json({{'@context': '{s.PROV}', 'type': 'prov:Agent', 'id': 'a'}}) AS VARCHAR), ']}}') AS json FROM works GROUP BY work_type")(
    lambda t: t.works.groupBy("work_type").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("work_type", s.prov_graph(F.transform("ids", lambda i: s.prov_entity(i)), F.array().cast("array<string>"), F.array(s.prov_agent(F.lit("a")))).alias("json"))
)
ANCHOR = "SELECT doc_id, concat('D', CAST(doc_id AS STRING)) AS source, length(text) // 3 AS lo, length(text) // 2 AS hi, replace(replace(substring(text, length(text) // 3 + 1, length(text) // 2 - length(text) // 3), chr(10), ' '), chr(9), ' ') AS exact FROM documents WHERE text IS NOT NULL"


def _anchors(t):
    n = F.char_length("text")
    lo, hi = F.floor(n / 3), F.floor(n / 2)
    exact = F.replace(F.replace(F.substring("text", (lo + 1).cast("int"), (hi - lo).cast("int")), F.lit("\n"), F.lit(" ")), F.lit("\t"), F.lit(" "))
    return t.documents.where("text is not null").select("doc_id", F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("source"), lo.alias("lo"), hi.alias("hi"), exact.alias("exact"))


query("web_annotation", f"WITH an AS ({ANCHOR}) SELECT doc_id, CAST(to_json({{'@context': '{s.ANNO}', 'type': 'Annotation', 'body': {{'type': 'TextualBody', 'value': 'note'}}, 'target': {{'type': 'TextPosition', 'start': lo, 'end': hi}}, 'created': '{AT}', 'generator': '{s.BY}'}}) AS VARCHAR) AS json FROM an")(
    lambda t: _anchors(t).select("doc_id", s.web_annotation(F.col("source"), s.anchor_selectors(F.col("lo"), F.col("hi"), F.col("exact")), F.lit("note"), F.lit(AT)).alias("json"))
)
query("stam_annotation", f"WITH an AS ({ANCHOR}) SELECT doc_id, CAST(to_json({{'type': 'Annotation', 'id': source, 'target': {{'type': 'TextSelector', 'text': {{'set': source}}, 'quote': exact}}, 'body': {{'type': 'TextualBody', 'value': ''}}, 'motivation': 'linking', 'created': '{AT}'}}) AS VARCHAR) AS json FROM an")(
    lambda t: _anchors(t).select("doc_id", s.stam_from_anchor(F.col("source"), F.col("source"), s.anchor_selectors(F.col("lo"), F.col("hi"), F.col("exact")), F.lit(AT)).alias("json"))
)
query("stam_round_trip", f"WITH an AS ({ANCHOR}) SELECT doc_id, source, 1 AS n_selectors, exact FROM an")(
    lambda t: _anchors(t).select("doc_id", s.anchor_from_stam(s.stam_from_anchor(F.col("source"), F.col("source"), s.anchor_selectors(F.col("lo"), F.col("hi"), F.col("exact")), F.lit(AT))).alias("a")).select("doc_id", F.col("a.source").alias("source"), F.size("a.selectors").alias("n_selectors"), F.col("a.selectors")[0]["exact"].alias("exact"))
)
ANCHORED = """WITH p AS (SELECT doc_id, length(text) // 3 AS lo, length(text) // 2 AS hi, substring(coalesce(text, ''), length(text) // 3 + 1, length(text) // 2 - length(text) // 3) AS q FROM documents),
  r AS (SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN lo END AS start, CASE WHEN doc_id % 4 <> 0 THEN hi END AS stop, coalesce(q, '') AS q, CASE WHEN doc_id % 2 = 0 THEN concat('/p[', CAST(doc_id AS VARCHAR), ']') END AS xpath, CASE WHEN doc_id % 3 = 0 THEN concat('p', CAST(doc_id AS VARCHAR)) END AS xml_id FROM p)
  SELECT doc_id, array_to_string(list_filter([CASE WHEN start IS NOT NULL AND stop IS NOT NULL THEN 'TextPosition' END, CASE WHEN q <> '' THEN 'TextQuote' END, CASE WHEN xpath IS NOT NULL THEN 'XPath' END, CASE WHEN xml_id IS NOT NULL THEN 'XmlId' END], lambda y: y IS NOT NULL), ',') AS types,
    CASE WHEN stop IS NOT NULL THEN start END AS start, stop, CASE WHEN q <> '' THEN substring(q, 1, 100) END AS exact, CASE WHEN q <> '' THEN CASE WHEN length(q) > 20 THEN substring(q, 1, 20) ELSE '' END END AS prefix,
    CASE WHEN q <> '' THEN CASE WHEN length(q) > 20 THEN right(q, 20) ELSE '' END END AS suffix, xpath, xml_id, sha256(q) AS digest FROM r"""
query("text_anchor", ANCHORED)(lambda t: _anchored(t))


def _anchored(t):
    n, every = F.char_length("text"), F.col("doc_id")
    lo, hi, text = F.floor(n / 3), F.floor(n / 2), lambda c: c.cast("string")
    some = lambda k, c: F.when(every % k == 0, c)
    a = x.text_anchor(text(every), F.substring("text", (lo + 1).cast("int"), (hi - lo).cast("int")), F.when(every % 4 != 0, lo), F.when(every % 4 != 0, hi), some(2, F.concat(F.lit("/p["), text(every), F.lit("]"))), some(3, F.concat(F.lit("p"), text(every))))
    of = lambda kind, field: F.get(F.filter("a.selectors", lambda y: y["type"] == kind), F.lit(0))[field]
    names = F.array_join(F.transform("a.selectors", lambda y: y["type"]), ",").alias("types")
    quoted = [of("TextQuote", c).alias(c) for c in ("exact", "prefix", "suffix")]
    return t.documents.select("doc_id", a.alias("a")).select("doc_id", names, of("TextPosition", "start").alias("start"), of("TextPosition", "end").alias("stop"), *quoted, of("XPath", "xpath").alias("xpath"), of("XmlId", "xml_id").alias("xml_id"), F.col("a.source_digest.value").alias("digest"))


query("cidoc_work", f"SELECT id, CAST(to_json({{'@context': '{s.CIDOC}', 'type': 'crm:E31_Documentary_Object', 'id': id, 'crm:P102_has_title': preferred_title, 'crm:P106_is_composed_of': [{{'type': 'crm:E39_Actor', 'crm:P102_has_title': work_type}}]}}) AS VARCHAR) AS json FROM works")(
    lambda t: t.works.select("id", s.cidoc_work(F.col("id"), F.col("preferred_title"), F.array("work_type")).alias("json"))
)
query("cidoc_activity", f"SELECT event_id, CAST(to_json({{'@context': '{s.CIDOC}', 'type': 'crm:E5_Event', 'id': event_id, 'crm:P1_has_type': event_type, 'crm:P4_has_time_span': {{'crm:P82_at_some_time_within': '{AT}'}}}}) AS VARCHAR) AS json FROM ledger")(
    lambda t: t.ledger.select("event_id", s.cidoc_activity(F.col("event_id"), F.col("event_type"), F.lit(AT)).alias("json"))
)
query("cidoc_observation", f"SELECT event_id, CAST(to_json({{'@context': '{s.CIDOC}', 'type': 'crmsci:O2_Observation', 'id': event_id, 'crm:P10_was_used_by': entity_id, 'crm:P4_has_time_span': {{'crm:P82_at_some_time_within': '{AT}'}}}}) AS VARCHAR) AS json FROM ledger")(
    lambda t: t.ledger.select("event_id", s.cidoc_observation(F.col("event_id"), F.col("entity_id"), F.lit(AT)).alias("json"))
)
query("datacite", f"SELECT id, CAST(to_json({{'data': {{'type': 'dois', 'attributes': {{'identifiers': [{{'identifier': id, 'identifierType': 'Handle'}}], 'titles': [{{'title': preferred_title}}], 'creators': [{{'name': work_type, 'nameType': 'Personal'}}], 'descriptions': [{{'description': 'd', 'descriptionType': 'Abstract'}}], 'publisher': '{s.BY}', 'publicationYear': 2026, 'types': {{'resourceTypeGeneral': 'Dataset', 'resourceType': 'Scholarly Database'}}, 'schemaVersion': '{s.DATACITE}'}}}}}}) AS VARCHAR) AS json FROM works")(
    lambda t: t.works.select("id", s.datacite(F.col("id"), F.col("preferred_title"), F.array("work_type"), F.lit("d"), F.lit(2026)).alias("json"))
)
query("ro_crate", f"SELECT id, concat('{{\"@context\":\"{s.CRATE}/context\",\"@graph\":[', CAST(to_json({{'@type': 'Dataset', '@id': id, 'name': preferred_title, 'description': concat('Scholarly record for ', preferred_title), 'license': 'https://creativecommons.org/licenses/by-sa/4.0/', 'creator': {{'@type': 'Organization', 'name': '{s.BY}'}}, 'datePublished': '2026-01-01'}}) AS VARCHAR), ',', CAST(to_json({{'@type': 'CreativeWork', '@id': 'ro-crate-metadata.json', 'conformsTo': '{s.CRATE}', 'about': {{'@id': id}}}}) AS VARCHAR), ',', CAST(to_json({{'@type': 'File', '@id': concat('file://a/', id, '.xml'), 'name': concat(id, '.xml'), 'about': {{'@id': id}}}}) AS VARCHAR), ']}}') AS json FROM works")(
    lambda t: t.works.select("id", s.ro_crate(F.col("id"), F.col("preferred_title"), F.array(F.concat(F.lit("a/"), "id", F.lit(".xml"))), F.lit("2026-01-01")).alias("json"))
)
query("c2pa_manifest", "SELECT id, CAST(to_json({'claim_generator': 'g', 'title': preferred_title, 'assertions': [{'label': 'c2pa.hash.data', 'data': {'alg': 'sha256', 'hash': sha256(id)}}]}) AS VARCHAR) AS json FROM works")(
    lambda t: t.works.select("id", s.c2pa_manifest(F.col("preferred_title"), F.sha2(F.col("id").cast("binary"), 256), "g").alias("json"))
)
query("dataset_card", "SELECT work_type, concat('---', chr(10), 'language:', chr(10), '  - sa', chr(10), '  - en', chr(10), 'license: cc-by-sa-4.0', chr(10), '---', chr(10), chr(10), '# ', work_type, chr(10), chr(10), 'works', chr(10), chr(10), 'Rows: ', CAST(count(*) AS STRING), chr(10)) AS card FROM works GROUP BY work_type")(
    lambda t: t.works.groupBy("work_type").agg(F.count("*").alias("n")).select("work_type", s.dataset_card(F.col("work_type"), F.lit("works"), F.col("n")).alias("card"))
)
query("envelope", "SELECT work_type, CAST(to_json({'meta': {'count': count(*)}, 'results': list_sort(list(id))}) AS VARCHAR) AS json FROM works GROUP BY work_type")(
    lambda t: t.works.groupBy("work_type").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids")).select("work_type", s.envelope(F.col("ids"), F.col("n")).alias("json"))
)
query("judge_parse", "SELECT id, CASE WHEN seq % 3 = 0 THEN 'unknown' ELSE 'yes' END AS fits_work, CASE WHEN seq % 3 = 0 THEN concat('__PARSE__ ', substring(preferred_title, 1, 60)) ELSE preferred_title END AS reason FROM works")(
    lambda t: t.works.select("id", s.judged(F.when(F.col("seq") % 3 == 0, F.col("preferred_title")).otherwise(F.concat(F.lit("Sure:\n"), F.to_json(F.struct(F.lit("yes").alias("fits_work"), F.lit("correct").alias("tier"), F.lit("correct").alias("language"), F.col("preferred_title").alias("reason"))), F.lit("\nDone.")))).alias("v")).select("id", "v.fits_work", "v.reason")
)

# --- text fingerprints ---------------------------------------------------------------

NORMAL = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
query("text_fp_record", f"SELECT doc_id, CAST(greatest(length(n) - 2, 0) AS INTEGER) AS shingle_count, substring(n, 1, 100) AS prefix, substring(sha256(substring(n, 1, 100)), 1, 16) AS prefix_hash, substring(sha256(right(n, 100)), 1, 16) AS suffix_hash, CAST(length(n) AS INTEGER) AS n_letters, substring(sha256(coalesce(text, '')), 1, 16) AS text_hash FROM (SELECT doc_id, text, {NORMAL} AS n FROM documents)")(
    lambda t: minhash.text_fingerprints(t.documents, "doc_id", "text").select(F.col("id").alias("doc_id"), "shingle_count", "prefix", "prefix_hash", "suffix_hash", "n_letters", "text_hash")
)
query("normalize_for_fp", f"SELECT doc_id, {NORMAL} AS normal FROM documents")(lambda t: t.documents.select("doc_id", x.normalize_sanskrit(udfs.nfc(F.coalesce("text", F.lit(""))), False).alias("normal")))
# A signature's component in SQL: the least of the first four bytes, as hex digits, over the distinct shingles, each hashed once.
SIGNED = "RECURSIVE gram AS (SELECT DISTINCT doc_id, substring(text, i, 3) AS g FROM (SELECT doc_id, text, unnest(range(1, length(text) - 1)) AS i FROM documents WHERE length(text) >= 3)), hashed AS (SELECT g, c, substring(sha256(concat(g, '_', CAST(c AS VARCHAR))), 1, 8) AS h FROM (SELECT DISTINCT g FROM gram), range(8) r(c)), least AS (SELECT doc_id, c, min(h) AS h FROM gram JOIN hashed USING (g) GROUP BY ALL)"
_signed = lambda t: minhash.signatures(t.documents, "doc_id", "text", 8)
query("minhash_components", f"WITH {SIGNED} SELECT d.doc_id, CAST(r.c AS INTEGER) AS component, coalesce(CAST(concat('0x', h) AS BIGINT), 0) AS value FROM documents d CROSS JOIN range(8) r(c) LEFT JOIN least l ON l.doc_id = d.doc_id AND l.c = r.c")(
    lambda t: _signed(t).select(F.col("id").alias("doc_id"), F.posexplode("signature").alias("component", "value"))
)
query("minhash_similarity", f"WITH {SIGNED} SELECT d.doc_id, (SELECT count(*) FROM range(8) r(c) LEFT JOIN least a ON a.c = r.c AND a.doc_id = d.doc_id LEFT JOIN least b ON b.c = r.c AND b.doc_id = d.doc_id + 1 WHERE coalesce(a.h, '') = coalesce(b.h, '')) / 8.0::DOUBLE AS similarity FROM documents d WHERE d.doc_id + 1 IN (SELECT doc_id FROM documents)")(
    lambda t: _signed(t).join(_signed(t).select((F.col("id") - 1).alias("id"), F.col("signature").alias("next")), "id").select(F.col("id").alias("doc_id"), minhash.similarity(F.col("signature"), F.col("next")).alias("similarity"))
)

# --- extraction ------------------------------------------------------------------------

CLEAN = r"replace(replace(replace(regexp_replace(coalesce(text, ''), '[^\x{20}-\x{7E}\x{A1}-\x{24F}\n]', ' ', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _tei(t):
    """Every document as a TEI file: its lines are verses, its source is a witness whose reading is the first line."""
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), "[^\\x20-\\x7E\\u00A1-\\u024F\\n]", " ")
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        clean = F.replace(clean, F.lit(sign), F.lit(entity))
    first = F.substring_index(clean, "\n", 1)
    source = F.coalesce("source", F.lit("none"))
    xml = F.concat(
        F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><title>'), first, F.lit("</title><author>"), source, F.lit('</author><listWit><witness xml:id="'), source, F.lit('">w</witness></listWit></teiHeader><text><body><div type="chapter" xml:id="d"><app><lem>l</lem><rdg wit="'),
        source, F.lit('">'), first, F.lit("</rdg></app><l>"), F.replace(clean, F.lit("\n"), F.lit("</l><l>")), F.lit("</l></div></body></text></TEI>"),
    )
    return t.documents.select(F.col("doc_id").cast("string").alias("id"), xml.alias("xml"))


LINES = r"SELECT doc_id, source, string_split(regexp_replace(coalesce(text, ''), '[^\x{20}-\x{7E}\x{A1}-\x{24F}\n]', ' ', 'g'), chr(10)) AS p FROM documents"
query("tei_header", rf"WITH ln AS ({LINES}) SELECT CAST(doc_id AS STRING) AS id, p[1] AS title, coalesce(source, 'none') AS author FROM ln")(lambda t: extract.tei_header(_tei(t)).select("id", "title", "author"))
query("tei_apparatus", rf"WITH ln AS ({LINES}) SELECT CAST(doc_id AS STRING) AS id, 0 AS ordinal, 'l' AS lemma, coalesce(source, 'none') AS witness, trim(regexp_replace(p[1], '\s+', ' ', 'g')) AS text FROM ln")(lambda t: extract.tei_apparatus(_tei(t)))
query("tei_witnesses", "SELECT CAST(doc_id AS STRING) AS id, coalesce(source, 'none') AS siglum, 'w' AS description FROM documents")(lambda t: extract.tei_witnesses(_tei(t)).select("id", "siglum", "description"))
query("verses_sarit", rf"WITH ln AS ({LINES}), vs AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS k, unnest(p) AS line FROM ln), nm AS (SELECT doc_id, k, trim(regexp_replace(line, '\s+', ' ', 'g')) AS verse FROM vs) SELECT CAST(doc_id AS STRING) AS id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS ordinal, verse FROM nm WHERE verse <> ''")(lambda t: extract.tei_verses(_tei(t), "l"))
query("tei_body", rf"WITH ln AS ({LINES}) SELECT CAST(doc_id AS STRING) AS id, 0 AS ordinal, 'chapter' AS kind, 'd' AS xml_id, trim(regexp_replace(concat('l ', p[1], ' ', array_to_string(p, ' ')), '\s+', ' ', 'g')) AS text FROM ln")(
    lambda t: extract.tei_body(_tei(t)).select("id", "ordinal", "kind", "xml_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))
)
query("verses_iast", r"WITH v AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) SELECT doc_id, count(*) AS n FROM v WHERE regexp_matches(substring(lower(l), 1, 40), '[āīūṛṝḷṃḥṅñṭḍṇśṣ]') GROUP BY doc_id")(
    lambda t: extract.iast_verses(t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("l")).withColumn("line", F.concat("l", F.lit(" || 1 ||")))).groupBy("doc_id").agg(F.count("*").alias("n"))
)
query("is_sanskrit_line", r"WITH v AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) SELECT doc_id, count(*) AS n FROM v WHERE length(regexp_replace(substring(lower(l), 1, 60), '[^āīūṛṝḷṃḥṅñṭḍṇśṣ]', '', 'g')) >= 3 GROUP BY doc_id")(
    lambda t: t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("l")).where(extract.is_sanskrit_line(F.col("l"))).groupBy("doc_id").agg(F.count("*").alias("n"))
)

# --- readers: files are written from a table in the shared folder, and read back ------------


def _files(t, rows, label: str, write: str = "text") -> str:
    path = scratch.path(t.spark, label)
    getattr(rows.write, write)(path)
    return path


def _documents(t, rows, label: str) -> str:
    """One file per row, however the rows are dealt over the tasks: the readers of whole files take each for one document."""
    path = scratch.path(t.spark, label)
    rows.write.option("maxRecordsPerFile", 1).text(path)
    return path


_work = lambda: F.struct("id", "preferred_title", "work_type", "seq")
WORKS = "SELECT id, preferred_title, work_type, seq FROM works"
_SHAPE = "id string, preferred_title string, work_type string, seq long"
#: Files of about 500 records: one array or object each.
_grouped = lambda t, cell: t.works.groupBy(F.floor(F.col("seq") / 500)).agg(cell.alias("value")).select("value")

query("scan_json_list", WORKS)(lambda t: readers.json_list(t.spark, _documents(t, _grouped(t, F.to_json(F.collect_list(_work()))), "list"), _SHAPE))
query("read_jsonl_tolerant", WORKS)(lambda t: readers.jsonl(t.spark, _files(t, t.works.select(F.to_json(_work()).alias("value")).union(t.works.where("seq % 9 = 0").select(F.lit('{"id": broken'))), "lines"), _SHAPE))
query("scan_json_dict", "SELECT id AS key, preferred_title, work_type FROM works")(
    lambda t: readers.json_dict(t.spark, _documents(t, _grouped(t, F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("id"), F.struct("preferred_title", "work_type")))))), "dict"), "struct<preferred_title:string,work_type:string>").select("key", "preferred_title", "work_type")
)
query("saved_responses", WORKS)(lambda t: readers.saved_responses(t.spark, _documents(t, _grouped(t, F.to_json(F.struct(F.struct(F.collect_list(_work()).alias("items")).alias("message")))), "answers"), "$.message.items", "struct<id:string,preferred_title:string,work_type:string,seq:bigint>"))
query("write_jsonl", "SELECT work_type, count(*) AS n FROM works GROUP BY work_type")(lambda t: _written(t))


def _written(t):
    path = scratch.path(t.spark, "by-type")
    readers.write_jsonl(t.works, path, "work_type")
    return t.spark.read.schema(_SHAPE).json(path).groupBy("work_type").agg(F.count("*").alias("n"))


query("normalize_items", "SELECT concat('W_', id) AS subject_id, p AS predicate_uri, v AS literal, c AS confidence FROM (SELECT id, unnest(['TITLE', 'TYPE']) AS p, unnest([preferred_title, work_type]) AS v, unnest([0.9::DOUBLE, 0.5::DOUBLE]) AS c FROM works) WHERE v <> ''")(
    lambda t: readers.normalize(t.works, "id", "W_", {"TITLE": ("preferred_title", 0.9), "TYPE": ("work_type", 0.5)}, {"SEQ": "seq"})[1]
)
query("adapter_kinds", "SELECT id AS name, CASE WHEN seq % 4 = 0 THEN 'MIXED' WHEN seq % 4 = 1 THEN 'REAL' WHEN seq % 4 = 2 THEN 'LOCAL' ELSE 'SCAFFOLDED' END AS kind FROM works")(
    lambda t: readers.audit_adapters(t.works.select(F.col("id").alias("name"), F.concat(F.when(F.col("seq") % 4 < 2, "urlopen(u) ").otherwise(""), F.when(F.col("seq") % 2 == 0, "open(f)").otherwise("pass")).alias("code"))).select("name", "kind")
)
