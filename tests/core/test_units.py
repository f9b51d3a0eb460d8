import hashlib
import json
import re
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from colophon.functions import minhash, text, udfs
from colophon.operators import catalogue, collation, extract, identity, ledger, serialize, services
from colophon.sources import readers
from colophon.streaming import ledger as stream


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


@pytest.mark.parametrize(("title", "want"), [("The Vigrahavyāvartanī vol 2", "vigrahavyāvartanī"), ("A  śāstra: (part 3)", "śāstra part 3"), (None, ""), ("Annals", "annals"), ("x_y  Volume", "x_y")])
def test_normalize_title(spark, title, want):
    assert one(spark, text.normalize_title(F.col("t")), t=title) == want


def test_small_text_functions(spark):
    assert one(spark, text.fold_iast(F.col("t")), t="Śrī Ṛgveda!") == "sri rgveda"
    assert one(spark, text.word_jaccard(F.col("a"), F.col("b")), a="x y z", b="Y z w") == pytest.approx(0.5)
    assert one(spark, text.word_jaccard(F.col("a"), F.col("b")), a="", b="x") == 0.0
    assert one(spark, text.shingles(F.col("t")), t="abcd") == ["abc", "bcd"] and one(spark, text.shingles(F.col("t")), t="ab") == []
    assert one(spark, text.slugify(F.col("t")), t="--Ab c!") == "ab_c" and one(spark, text.slugify(F.col("t")), t="!!") == "work"
    assert one(spark, text.title_guard(F.col("a"), F.col("b")), a="Tantrāloka of X", b="The tantraloka, translated")
    assert one(spark, text.edition_tier(F.col("t"), F.col("a"), ["Torella"]), t="Study", a="R. Torella") == "A"
    assert one(spark, text.normalize_sanskrit(F.col("t")), t=" क ॥ १२ ।") == "क | 12 |"
    assert one(spark, text.classify_file(F.col("t")), t="x_djvu.txt") == "ocr_text"
    a = one(spark, text.text_anchor(F.lit("s"), F.col("t"), F.lit(2), F.lit(4), xml_id=F.lit("d")), t="abcdef" * 20)
    assert [y.type for y in a.selectors] == ["TextPosition", "TextQuote", "XmlId"] and a.source_digest.value == hashlib.sha256(("abcdef" * 20).encode()).hexdigest()
    assert (a.selectors[1].exact, a.selectors[1].prefix, a.selectors[1].suffix) == (("abcdef" * 20)[:100], ("abcdef" * 4)[:20], ("abcdef" * 20)[-20:])
    assert [y.type for y in one(spark, text.text_anchor(F.lit("s"), F.col("t"), F.lit(2)), t="").selectors] == []


def test_state_digest_is_that_of_the_canonical_page(spark):
    rows = [(k, f"E{k}", "EntityCreated" if k % 2 else 'with "quotes" é') for k in range(1, 8)]
    page = {"events": [{"id": e, "type": t} for _, e, t in rows[2:6]]}
    want = hashlib.sha512(json.dumps(page, separators=(",", ":"), ensure_ascii=False, sort_keys=True).encode()).hexdigest()
    assert tuple(ledger.state_digest(spark.createDataFrame(rows[::-1], "cursor long, event_id string, event_type string"), 2, 4).first()) == (want, 4)


def test_state_digest_is_that_of_the_whole_ledger(spark):
    rows = [(k, f"E{k}", "a" if k % 3 else 'b "c" é') for k in range(2_500)]
    want = hashlib.sha256(json.dumps({"events": [{"id": e, "type": t} for k, e, t in rows if k > 0]}, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    events = spark.createDataFrame(rows[::-1], "cursor long, event_id string, event_type string").repartition(4)
    assert tuple(ledger.state_digest(events, algorithm="sha256").first()) == (want, 2_499)
    empty = hashlib.sha256(b'{"events":[]}').hexdigest()
    assert tuple(ledger.state_digest(events, 9_999, algorithm="sha256").first()) == (empty, 0)


def test_fingerprint_records_of_repeated_ids(spark):
    rows = [(1, "one text"), (1, "another text"), (1, "one text"), (None, None), (2, "")]
    got = minhash.text_fingerprints(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()
    assert len(got) == 5 and all(len(r.minhash) == 8 for r in got)
    assert {tuple(r.minhash) for r in got if r.prefix == "one text"} == {tuple(min(int(hashlib.sha256(f"{s}_{i}".encode()).hexdigest()[:8], 16) for s in ("one", "ne ", "e t", " te", "tex", "ext")) for i in range(8))}


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_minhash_of_any_letters(spark, k):
    texts = ["", None, "ab", "🙂é漢字 and 🙂é漢字", "x" * 50_000, "the quick brown fox " * 900]
    got = {r.id: r.signature for r in minhash.signatures(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t", 6, k).collect()}
    for n, t in enumerate(texts):
        grams = {t[i : i + k] for i in range(len(t) - k + 1)} if t else set()
        assert got[n] == [min((int(hashlib.sha256(f"{s}_{i}".encode()).hexdigest()[:8], 16) for s in grams), default=0) for i in range(6)]


@pytest.mark.parametrize(("x", "want"), [(1e21, "1e+21"), (1e20, "100000000000000000000"), (1e-7, "1e-7"), (0.000001, "0.000001"), (333333333.33333329, "333333333.3333333"), (-0.0, "0"), (4.5, "4.5"), (2e-3, "0.002"), (1.25e-10, "1.25e-10"), (10.0, "10"), (123.456, "123.456"), (1e23, "1e+23")])
def test_canonical_numbers(x, want):
    assert udfs.canonical_json(x) == want


def test_canonical_json_and_digests(spark):
    assert one(spark, udfs.jcs(F.col("t")), t='{"b": [1, true, null], "a": {"é": "\\u20ac", "d": 1.50}}') == '{"a":{"d":1.5,"é":"€"},"b":[1,true,null]}'
    assert one(spark, udfs.jcs(F.col("t")), t="{broken") is None
    assert one(spark, udfs.blake2b(F.col("t")), t="abc") == hashlib.blake2b(b"abc").hexdigest()
    assert one(spark, udfs.nfc(F.col("t")), t="é") == unicodedata.normalize("NFC", "é")


def test_minhash_is_the_plain_definition(spark):
    df = spark.createDataFrame([(1, "abcdabc"), (2, "xy"), (3, "abcdabc")], "id long, t string")
    got = {r.id: r.signature for r in minhash.signatures(df, "id", "t", 4).collect()}
    grams = {"abc", "bcd", "cda", "dab"}
    assert got[1] == got[3] == [min(int(hashlib.sha256(f"{s}_{i}".encode()).hexdigest()[:8], 16) for s in grams) for i in range(4)] and got[2] == [0] * 4
    pairs = minhash.similar_pairs(minhash.signatures(spark.createDataFrame([(1, "a long enough text"), (2, "a long enough test")], "id long, t string"), "id", "t", 32), 0.1, 2).collect()
    assert [(r.id_a, r.id_b) for r in pairs] == [(1, 2)]


def plain_root(leaves):
    level = [hashlib.sha256(x.encode()).hexdigest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.sha256((level[i] + level[min(i + 1, len(level) - 1)]).encode()).hexdigest() for i in range(0, len(level), 2)]
    return level[0] if level else hashlib.sha256(b"empty-ledger").hexdigest()


@pytest.mark.parametrize("n", [0, 1, 2, 5, 9])
def test_merkle_root(spark, n, monkeypatch):
    events = spark.createDataFrame([(k * 3, f"E{k}", None if k == 1 else f"d{k}") for k in range(n)], "cursor long, event_id string, digest string")
    want = plain_root([f"E{k}:{k * 3}:{'' if k == 1 else f'd{k}'}" for k in range(n)])
    assert ledger.merkle_root(events).first()["root"] == want
    monkeypatch.setattr(ledger, "BLOCK", 1)  # more blocks than one
    assert ledger.merkle_root(events).first()["root"] == want
    checkpoint = spark.createDataFrame([("C", 0, 3 * n, want)], "checkpoint_id string, first_cursor long, last_cursor long, root string")
    assert ledger.merkle_verify(events, checkpoint, "C").first()["valid"] and not ledger.merkle_verify(events, checkpoint, "D").first()["valid"]


def test_ledger_chains(spark):
    merges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "from_id string, into_id string")
    assert {(r.from_id, r.into_id) for r in ledger.follow_merges(merges).collect()} == {("a", "d"), ("b", "d"), ("c", "d"), ("x", "y")}
    cycles = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("p", "q"), ("r", "r")], "from_id string, into_id string")
    assert {r.from_id: r.into_id for r in ledger.follow_merges(cycles).collect()} == {"a": None, "b": None, "c": None, "x": None, "p": "q"}
    gaps = spark.createDataFrame([(k if k < 20 else k * 10**9,) for k in range(40)], "cursor long").repartition(5)
    assert [r.pos for r in sorted(ledger.positions(gaps).collect())] == list(range(40))
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "source string, target string")
    walk = lambda *a, **k: {(r.node, r.distance) for r in ledger.traverse(edges, *a, **k).collect()}
    assert walk(["a"], 2, "out") == {("a", 0), ("b", 1), ("c", 2)}
    assert walk(["c"], 1, "in") >= {("c", 0), ("b", 1)} and {n for n, _ in walk(["c"], 5)} >= {"a", "b", "c"}
    assert walk(["a"], 5, "out", limit=2) == {("a", 0), ("b", 1)} and walk(["nowhere"], 3) == {("nowhere", 0)}


def test_collation(spark):
    readings = spark.createDataFrame([("w", "A", 1, "x y z"), ("w", "B", 1, "x q"), ("w", "B", 2, "x y"), ("w", "C", 1, "x k z"), ("v", "A", 1, None)], "work_id string, siglum string, ordinal int, text string")
    rows = {r.position: r for r in collation.collate(collation.witness_tokens(readings)).collect()}
    assert [rows[k].consensus for k in range(3)] == ["x", "y", "z"] and [rows[k].is_variant for k in range(3)] == [False, True, False]
    assert rows[2].n_witnesses == 2


def test_staged_resolver(spark):
    cand = spark.createDataFrame([("m", "1", 0, "T", "A", "p"), ("r2", "2", 0, "Same", "A", "p"), ("r2", "3", 1, " same", "a", "q"), ("r3", "4", 0, "one two three four", None, "p"), ("r3", "5", 1, "one two three four five", None, "p"), ("n", "6", 0, "x", None, "p")], "cluster string, candidate_id string, ordinal int, title string, author string, provider string")
    ids = spark.createDataFrame([("m", "1", 0, "DOI", "v")], "cluster string, candidate_id string, ordinal int, scheme string, value string")
    index = spark.createDataFrame([("DOI", "v", "W9")], "scheme string, value string, entity_id string")
    none = spark.createDataFrame([], "fp string, entity_id string")
    got = {r.cluster: r for r in identity.resolve(cand, ids, index, none, cand.limit(0).select("cluster"), index.limit(0)).collect()}
    assert (got["m"].stage, got["m"].entity_id, got["r2"].stage, got["r3"].stage, got["n"].stage) == ("R0", "W9", "R2", "R3", "NONE")
    assert got["r3"].confidence == pytest.approx(0.8) and got["n"].confidence == 0.0
    every = identity.resolve(cand, ids, index, none, cand.limit(0).select("cluster"), index.limit(0), all_stages=True).collect()
    assert {(r.cluster, r.stage) for r in every} >= {("r2", "R2"), ("r2", "R4"), ("r2", "R3")}


TEI = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><title>T</title><author>A</author><language ident="sa"/></teiHeader><text><div type="outer" xml:id="d1"><div>in <hi>ner</hi></div><lg><l>l one</l><l>l two</l></lg></div><app><lem>x</lem><rdg wit="#A">y</rdg><rdg wit="#B">z</rdg></app><witness xml:id="A">Ms A</witness></text></TEI>'


def test_extraction(spark):
    table = spark.createDataFrame([("t", TEI), ("bad", "<x")], "id string, xml string")
    head = extract.tei_header(table.where("id = 't'")).first()
    assert (head.title, head.author, head.language) == ("T", "A", "sa")
    body = extract.tei_body(table).orderBy("ordinal").collect()
    assert [(r.kind, r.xml_id) for r in body] == [("outer", "d1"), ("section", None)] and body[1].text == "in ner" and "in ner" in body[0].text
    assert [(r.lemma, r.witness, r.text) for r in extract.tei_apparatus(table).orderBy("ordinal").collect()] == [("x", "#A", "y"), ("x", "#B", "z")]
    assert extract.tei_witnesses(table).first().siglum == "A" and [r.verse for r in extract.tei_verses(table).orderBy("ordinal").collect()] == ["l one", "l two"]
    lines = spark.createDataFrame([("dharmakṣetre kurukṣetre || 12 ||",), ("plain || 3 ||",), ("धर्मक्षेत्रे कुरुक्षेत्रे ॥ १ ॥",), ("क ॥",)], "line string")
    assert [r.verse for r in extract.iast_verses(lines).collect()] == ["dharmakṣetre kurukṣetre"]
    assert [r.verse for r in extract.devanagari_verses(lines).collect()] == ["धर्मक्षेत्रे कुरुक्षेत्रे"]
    page = spark.createDataFrame([(1, "https://h.org/x", '<a href="/a">A &amp; <b>B</b></a><a href="https://h.org/a">again</a><a href="https://other.org/">o</a><a href="/s.css">s</a><a class="k" href="/q?x=1">q</a>')], "id int, url string, html string")
    assert [(r.url, r.label) for r in extract.html_links(page, "id", "url", "html").collect()] == [("https://h.org/a", "A & B")]


def test_serializers(spark):
    got = one(spark, serialize.prov_activity(F.col("a"), F.array(F.lit("x")), F.array().cast("array<string>"), F.lit("t"), F.lit("u"), software=F.lit("s"), version=F.lit("1")), a="act")
    assert json.loads(got)["prov:used"] == [{"type": "prov:Entity", "id": "x"}, {"type": "prov:SoftwareAgent", "id": "s", "prov:wasAttributedTo": "1"}]
    assert "prov:generated" not in json.loads(got) and "prov:wasAssociatedWith" not in json.loads(got)
    selectors = serialize.anchor_selectors(F.lit(1), F.lit(2), F.lit("q"))
    note = json.loads(one(spark, serialize.web_annotation(F.lit("s"), selectors, F.col("a"), F.lit("t")), a='say "n"'))
    assert note["target"] == {"type": "TextPosition", "start": 1, "end": 2} and note["body"]["value"] == 'say "n"'
    whole = json.loads(one(spark, serialize.web_annotation(F.lit("s"), F.array().cast(serialize.SELECTORS), F.col("a"), F.lit("t")), a="n"))
    assert whole["target"] == {"type": "TextPositionSelector", "source": "s"}
    stam = one(spark, serialize.stam_from_anchor(F.col("a"), F.lit("s"), selectors, F.lit("t")), a="i")
    assert json.loads(stam)["target"] == {"type": "TextSelector", "text": {"set": "s"}, "quote": "q"}
    back = one(spark, serialize.anchor_from_stam(F.col("a")), a=json.dumps({"id": "i", "target": {"type": "TextSelector", "text": {"set": "s"}, "begin": 3, "end": 9}}))
    assert (back["id"], back["source"], [(x["type"], x["start"], x["end"]) for x in back["selectors"]]) == ("i", "s", [("TextPosition", 3, 9)])
    collection = json.loads(one(spark, serialize.annotation_collection(F.array(serialize.prov_entity(F.col("a")))), a="n"))
    assert [x["id"] for x in collection["items"]] == ["n"]
    passage = json.loads(one(spark, serialize.passage_annotation(F.col("a"), F.lit("p"), F.lit("x"), F.array().cast("array<string>"), F.lit("t")), a="w"))
    assert passage == {"work_id": "w", "passage_id": "p", "text": "x", "annotations": [], "metadata": {"created_at": "t", "source": "Colophon"}}
    assert json.loads(one(spark, serialize.stam_set(F.col("a"), F.lit("n"), F.array().cast("array<string>"), F.lit("t")), a="i"))["annotations"] == []
    assert json.loads(one(spark, serialize.atlas_from_annotation(F.col("a"), F.lit(None), F.lit("m"), F.lit("p")), a="l"))["lemma"] == ""
    assert json.loads(one(spark, serialize.web_from_annotation(F.col("a"), F.lit("s"), F.lit(1), F.lit(2), F.lit("v"), F.lit("linking"), F.lit("t")), a="i"))["target"]["selector"]["end"] == 2
    snapshot = json.loads(one(spark, serialize.datacite_snapshot(F.col("a"), F.lit("2026-05-04T00:00:00Z"), F.lit(7), F.lit(2026)), a="S"))
    assert snapshot["data"]["attributes"]["titles"] == [{"title": "Colophon Snapshot 2026-05-04"}]
    assert json.loads(one(spark, serialize.error(F.col("a"), F.lit("m"), F.lit(404)), a="c")) == {"error": {"code": "c", "message": "m", "status": 404}}
    assert json.loads(one(spark, serialize.c2pa_manifest(F.col("a"), F.lit("d"), "colophon"), a="t"))["assertions"][0]["data"]["hash"] == "d"
    assert one(spark, serialize.judged(F.col("a")), a="no object here")["reason"] == "__PARSE__ no object here"


def test_readers(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"k1": {"title": "A"}, "k2": {"title": "B"}}')
    assert [(r.key, r.title) for r in readers.json_dict(spark, str(tmp_path / "d.json"), "struct<title:string>").orderBy("key").collect()] == [("k1", "A"), ("k2", "B")]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\nbroken\n{"a": 2}\n')
    assert [r.a for r in readers.jsonl(spark, str(tmp_path / "l.jsonl"), "a int").collect()] == [1, 2]
    (tmp_path / "s.ts").write_text("// seed\nexport const SEED: Work[] = [\n  { id: 'w1', title: 'One', },\n  { id: 'w2', title: 'Two' },\n];\n")
    assert [(r.id, r.title) for r in readers.ts_seed(spark, str(tmp_path / "s.ts"), "struct<id:string,title:string>").collect()] == [("w1", "One"), ("w2", "Two")]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("Some Title-123-IAST.txt", "text")
        z.writestr("__MACOSX/x.txt", "no")
    row = readers.zip_texts(spark, str(tmp_path / "z.zip")).collect()
    assert [(r.title, r.resource_id, r.text) for r in row] == [("Some Title", "123", "text")]
    (tmp_path / "r.json").write_text('{"results": [{"id": "1", "names": ["a", "b"], "doi": null}]}')
    items = readers.saved_responses(spark, str(tmp_path / "r.json"), "$.results", "struct<id:string,names:array<string>,doi:string>")
    cand, facts, ids = readers.normalize(items, "id", "PTCND_", {"AUTHOR": ("names", 0.8)}, {"DOI": "doi"})
    assert cand.first()[0] == "PTCND_1" and sorted(r.literal for r in facts.collect()) == ["a", "b"] and ids.count() == 0
    code = spark.createDataFrame([("n", "urlopen('https://x')"), ("f", "open('x')"), ("s", "pass")], "name string, code string")
    assert {r.name: r.kind for r in readers.audit_adapters(code).collect()} == {"n": "REAL", "f": "LOCAL", "s": "SCAFFOLDED"}
    manifest = readers.snapshot_manifest(spark, str(tmp_path / "d.json"))
    assert len(readers.manifest_root(manifest)) == 64
    readers.write_jsonl(items.select("id", "doi"), str(tmp_path / "out"), "id")
    assert (tmp_path / "out" / "id=1").is_dir()
    with pytest.raises(ValueError):
        readers.load_adapter("nothing")


def test_stream_equals_batch(spark, tmp_path):
    shape = "cursor long, event_id string, event_type string, entity_id string, title string, digest string"
    rows = [(k, f"E{k}", "EntityCreated" if k % 2 == 0 else "Other", f"W{k % 7}" if k % 5 else f"PTCND_{k}", f"t{k}", "d") for k in range(60)]
    df = spark.createDataFrame(rows, shape).withColumn("recorded_at", F.timestamp_seconds("cursor"))
    for lo in (0, 20, 40):
        df.where(F.col("cursor").between(lo, lo + 19)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = {(r.id) for r in ledger.replay(df).collect()}
    stream.project_works(stream.read_ledger(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = [r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert stream.counts_per_window(stream.read_ledger(spark, str(tmp_path / "in"))).isStreaming


def test_pages_follow_each_other(spark):
    works = spark.createDataFrame([(f"W{k}", f"t{k % 3}", "x") for k in range(7)], "id string, preferred_title string, work_type string")
    seen, after = [], None
    while True:
        rows = catalogue.page(works, 3, after).collect()
        seen += [r.id for r in rows]
        if not rows or not rows[-1].has_more:
            break
        after = (rows[-1].preferred_title, rows[-1].id)
    assert sorted(seen) == sorted(f"W{k}" for k in range(7)) and len(seen) == 7


def test_canonical_tables_use_every_row(spark):
    from colophon.bindings import table
    from tests.conftest import DATA

    lines, orders = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("lineitem", "orders"))
    n = {x: table(spark, DATA, x).count() for x in ("passages", "document_segments", "translations", "editions", "etexts", "witnesses")}
    assert n["passages"] == n["document_segments"] == lines.count()
    assert n["translations"] + n["editions"] + n["etexts"] + n["witnesses"] == orders.count() and min(n.values()) > 0
    ids = table(spark, DATA, "external_identifiers")
    given = lines.select(F.concat(F.lit("W"), (F.col("l_partkey") - (F.col("l_partkey") % 13 == 12).cast("int")).cast("string")), "l_orderkey").distinct()
    assert ids.count() == ids.select("entity_id", "value").distinct().count() == given.count()
    assert 0 < table(spark, DATA, "works").join(ids, F.col("id") == F.col("entity_id"), "left_anti").count()


def test_minhash_query_has_every_component(spark):
    from colophon import plans
    from tests.conftest import DATA

    got = {r.id: r.signature for r in plans.QUERIES["minhash_signature"](spark, DATA).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    assert got.keys() == texts.keys() and {len(s) for s in got.values()} == {128}
    for k in sorted(texts, key=lambda k: len(texts[k]))[:3]:
        grams = {texts[k][i : i + 3] for i in range(len(texts[k]) - 2)}
        assert got[k] == [min((int(hashlib.sha256(f"{s}_{i}".encode()).hexdigest()[:8], 16) for s in grams), default=0) for i in range(128)]


def test_a_long_glossary_is_read_whole(spark):
    terms = [f"t{k:05}" for k in range(12_000)]
    glossary = spark.createDataFrame([(x, [x.upper() + "!"]) for x in terms], "term string, renderings array<string>")
    pairs = spark.createDataFrame([(1, "", f"{' '.join(terms)}! {terms[7]}! and no more"), (2, " ".join(terms), "")], "id long, source string, translation string")
    got = collation.term_violations(pairs, glossary).collect()
    assert sorted((r.id, r.term) for r in got) == [(1, x) for x in terms if x not in (terms[7], terms[-1])]


def test_prove(spark):
    rows = [
        (1, "dharmaṃ vakṣye || 12 || dharma iti", "I tell of Dharma , the dharma", "the dharma I tell"),
        (2, "śivaṃ namāmi", "bow to śiva", None),
        (3, "śivaṃ namāmi yoga", "yoga for Śiva who is śiva", ""),
        (4, "", "anything", "x"),
        (5, None, None, None),
        (6, "a b c d e f g h i j", "a b", "a z"),
    ]

    def plain(source, translation, gold):
        source, translation = source or "", translation or ""
        s, t = set(re.findall(r"[a-zA-Zāīūṛṝḷḹṃṁñṅṇśṣṭḍḥ]+", source.lower())), set(re.findall(r"[a-zA-Z]+", translation.lower()))
        binding = len(s & t) / len(s) if s else 0
        bad = [x for x, ok in collation.GLOSSARY.items() if x.lower() in translation.lower() and not any(a.lower() in translation.lower() for a in ok)]
        cover = len(translation.split()) / len(source.split()) if source.split() else 0
        semantic = round(len(set(gold.lower().split()) & set(translation.lower().split())) / len(set(gold.lower().split())), 3) if gold else None
        return round(binding, 3), bad, len(re.findall(r"\|\|\s*\d+\s*\|\|", source)), round(cover, 3), semantic, "PASS" if binding > 0.1 and not bad and cover > 0.3 else "FAIL"

    got = {r.id: (r.binding, r.violations, r.n_padas, r.coverage, r.semantic, r.verdict) for r in collation.prove(spark.createDataFrame(rows, "id long, source string, translation string, gold string")).collect()}
    assert got == {r[0]: plain(*r[1:]) for r in rows}


def test_records(spark):
    hits = spark.createDataFrame([("w", 2, "b", "u1"), ("w", 2, "a", "u1"), ("w", 2, "c", "u2"), ("w", 3, "d", "u3")], "work string, variant_order int, source string, url string")
    assert [tuple(r) for r in services.deepfind(hits).collect()] == [("w", 2, ["a", "c"])]
    one_row = lambda n: spark.range(n)
    assert tuple(services.gap_cycle(one_row(3), one_row(2), one_row(0)).first()) == (3, 2, 0)
    want = hashlib.sha256(json.dumps({"gold": "g", "code": "c", "config": "f"}, sort_keys=True).encode()).hexdigest()
    assert one(spark, services.run_signature(F.col("g"), F.lit("c"), F.lit("f")), g="g") == want
    digest = json.loads(one(spark, ledger.payload_digest(F.col("p")), p='{"b": 1, "a": [true, null]}'))
    assert digest == {"algorithm": "sha512", "value": hashlib.sha512(b'{"a":[true,null],"b":1}').hexdigest()}
