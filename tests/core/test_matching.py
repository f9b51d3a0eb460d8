"""Classes of works, containment and set joins against plain Python over every pair."""

import random
import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from colophon.operators import collation, identity, set_join
from colophon.operators.containment import contained, possible

MARKS = {"exact_identifier": 1.0, "normalized_title": 0.95, "author_title": 0.9, "text_fingerprint": 0.85}


@pytest.fixture(scope="module")
def catalogue():
    """A title that most works share, others of two or three works, works with several titles, authors and identifiers, and none."""
    rng = random.Random(11)
    facts, ids, n = [], [], 0
    for w in range(70):
        for kind, pool, most in (("TITLE", ["Common Title", "the common title", "Common  Title!", "Rare", "A Rare vol 2", "!!!", "Third"] + [f"Only {w}"], 3), ("AUTHOR", ["X", "Y", "Z", f"own {w}"], 3)):
            for _ in range(rng.randint(0, most)):
                n += 1
                facts.append((f"A{n:04}", f"W{w:02}", kind, rng.choice(pool) if rng.random() < 0.9 else None))
        ids += [(f"W{w:02}", "S", rng.choice(["hot", "hot", f"k{w // 3}", f"k{w // 2}", f"own{w}"])) for _ in range(rng.randint(0, 3))]
    return facts, ids


def brute(facts, ids):
    """Rows of each matcher for each ordered pair, as a work asks for them."""
    import hashlib
    import re

    def norm(t):
        t = re.sub(r"^(the|a|an)\s+", "", (t or "").lower())
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", re.sub(r"\s+(vol|volume|part|chapter)\s*\d*$", "", t))).strip()

    def print_of(t):
        return hashlib.sha256(re.sub(r"\s+", " ", t.lower()).strip()[:100].encode()).hexdigest()[:16] if t else ""

    works = sorted({f[1] for f in facts} | {i[0] for i in ids})
    found = Counter()
    for w in works:
        for _, s, v in (i for i in ids if i[0] == w):
            found.update((w, m, "exact_identifier") for m, t, x in ids if (t, x) == (s, v) and m != w)
        titles, authors = ([f for f in facts if f[1] == w and f[2] == k] for k in ("TITLE", "AUTHOR"))
        if titles:
            own = min(titles)[3]
            for name, key in (("normalized_title", norm), ("text_fingerprint", print_of)):
                if key(own):
                    found.update((w, f[1], name) for f in facts if f[2] == "TITLE" and f[1] != w and key(f[3]) == key(own))
        has = {(f[1], f[2], f[3]) for f in facts if f[3] is not None}
        for a in authors:
            for t in titles:
                found.update((w, m, "author_title") for m in works if m != w and (m, "AUTHOR", a[3]) in has and (m, "TITLE", t[3]) in has)
    pairs = {}
    for (w, m, name), n in found.items():
        pairs.setdefault((w, m), {})[name] = n
    out = {}
    for k, by in pairs.items():
        n = sum(by.values())
        out[k] = (min(1.0, max(MARKS[b] for b in by) + min(0.1, 0.05 * (n - 1))), n, ",".join(sorted(by)))
    return out


@pytest.mark.parametrize("much", [256, 2])
def test_identity_by_classes(spark, catalogue, much):
    facts, ids = catalogue
    want = brute(facts, ids)
    m = identity.classes(spark.createDataFrame(facts, "id string, subject_id string, predicate_uri string, literal string"), spark.createDataFrame(ids, "entity_id string, scheme string, value string"), much)
    assert {(r.work_id, r.match_id): (r.confidence, r.n_rows, r.matchers) for r in identity.identity_resolve(m).collect()} == want
    h = identity.histogram(m).persist()
    assert {(r.matchers, r.n_rows): r.n for r in identity.ranker_group(h).collect()} == Counter((v[2], v[1]) for v in want.values())
    totals = {r.work_id: (r.total_candidates, r.unique_matches) for r in identity.candidate_counts(h).collect()}
    assert totals == {w: (sum(v[1] for k, v in want.items() if k[0] == w), sum(k[0] == w for k in want)) for w in {k[0] for k in want}}
    top = {(r.work_id, r.place): (r.match_id, r.confidence, r.matchers) for r in identity.rank_candidates(m).collect()}
    expected = {}
    for w in {k[0] for k in want}:
        best = sorted((-v[0], k[1], v[2]) for k, v in want.items() if k[0] == w)[:3]
        expected |= {(w, p + 1): (b[1], -b[0], b[2]) for p, b in enumerate(best)}
    assert top == expected
    h.unpersist()


def test_identity_never_joins_works_by_a_title(spark):
    """Ten thousand works with one title: a pair of classes, and a histogram of one row each."""
    n = 10_000
    works = spark.range(n).select(F.format_string("A%06d", "id").alias("id"), F.format_string("W%06d", "id").alias("subject_id"), F.lit("TITLE").alias("predicate_uri"), F.lit("Untitled").alias("literal"))
    m = identity.classes(works, spark.createDataFrame([], "entity_id string, scheme string, value string"))
    assert m.titles.count() == 1 and m.works.count() == 0
    h = identity.histogram(m)
    assert h.agg(F.count("*"), F.min("n"), F.max("n")).first() == (n, n - 1, n - 1)
    first = {r.work_id: r.match_id for r in identity.rank_candidates(m, 1).collect()}
    assert len(first) == n and first["W000000"] == "W000001" and first["W009999"] == "W000000"


def _shuffled(spark, since=-1):
    """Rows written for shuffles by stages after ``since``, and the last stage."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    stages = [stages.apply(k) for k in range(stages.size())]
    return sum(s.shuffleWriteRecords() for s in stages if s.stageId() > since), max((s.stageId() for s in stages), default=-1)


def test_pairs_by_identifiers_are_shuffled_as_lists(spark, catalogue):
    """60 works an identifier: their pairs are ten times as many as the rows shuffled, and each is counted once for each identifier."""
    facts, _ = catalogue
    rng = random.Random(5)
    ids = [(w, "S", f"k{k}") for k in range(60) for w in rng.sample([f"V{n:04}" for n in range(500)], 60)] + [("W01", "S", "k0"), ("W02", "S", "k0"), ("W02", "S", "k0")]
    _, since = _shuffled(spark)
    m = identity.classes(spark.createDataFrame(facts, "id string, subject_id string, predicate_uri string, literal string"), spark.createDataFrame(ids, "entity_id string, scheme string, value string"))
    got = {(r.work_id, r.match_id): (r.confidence, r.n_rows, r.matchers) for r in identity.identity_resolve(m).collect()}
    assert got == brute(facts, ids)
    assert _shuffled(spark, since)[0] < 60 * 60 * 59 / 4


def test_identity_list_by_list(spark, catalogue, monkeypatch):
    """Lists, parts and deals of a few works: each pair still comes once, with all that its classes and its own identifiers say."""
    for name, n in (("BLOCK", 8), ("PARTS", 2), ("BLOCKS_DEALT", 1)):
        monkeypatch.setattr(identity, name, n)
    facts, ids = catalogue
    m = identity.classes(spark.createDataFrame(facts, "id string, subject_id string, predicate_uri string, literal string"), spark.createDataFrame(ids, "entity_id string, scheme string, value string"))
    rows = identity.identity_resolve(m).collect()
    got = {(r.work_id, r.match_id): (r.confidence, r.n_rows, r.matchers) for r in rows}
    assert got == brute(facts, ids) and len(rows) == len(got)


def test_no_works(spark):
    m = identity.classes(spark.createDataFrame([], "id string, subject_id string, predicate_uri string, literal string"), spark.createDataFrame([], "entity_id string, scheme string, value string"))
    assert identity.identity_resolve(m).count() == identity.histogram(m).count() == identity.rank_candidates(m).count() == 0


TERMS = ["tion", "a", "ab", "", "xyz", "Śiva", "🙂x", "needle in", "abcabcabc", "zzzz", "tion", None]
TEXTS = ["", "a", "station", "one needle in a haystack", "abcabcabcabc", "x🙂xyz Śivaśiva", "ab" * 20_000 + "needle in", None, "station"]


def test_possible_terms(spark):
    """Terms that are in a text stay, also short ones and the empty one; of a thousand others none goes on."""
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "row long, text string")
    there = {t for t in TERMS if t is not None and any(t in x for x in TEXTS if x is not None)}
    others = [f"no text has {k}" for k in range(1_000)]
    got = {r.term for r in possible(spark.createDataFrame([(t,) for t in [*TERMS, *others]], "term string"), texts).collect()}
    assert there <= got and not got & set(others)


def test_contained(spark):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "row long, text string")
    for terms in (TERMS, [t for t in TERMS if t], TERMS[-1:], []):
        got = contained(texts, spark.createDataFrame([(t,) for t in terms], "term string"))
        assert Counter(map(tuple, got.collect())) == Counter((k, t) for k, x in enumerate(TEXTS) for t in set(terms) - {None} if x is not None and t in x)


def test_term_violations_of_a_long_glossary(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 7)))
    glossary = [(w, [word() for _ in range(rng.randint(0, 3))]) for w in {word() for _ in range(12_000)}][:10_500] + [("Dup", ["dupe"]), ("Dup", ["zzz"])]
    texts = [(k % 50, " ".join(word() for _ in range(8)) + " dup" * (k % 2)) for k in range(60)] + [(99, None), (98, "")]
    df = collation.term_violations(spark.createDataFrame(texts, "id long, translation string"), spark.createDataFrame(glossary, "term string, renderings array<string>"))
    assert "NestedLoop" not in df._jdf.queryExecution().toString() and "Cartesian" not in df._jdf.queryExecution().toString()
    want = Counter()
    for i, t in texts:
        if t is not None:
            want.update((i, w) for w in {w for w, rs in glossary if w.lower() in t.lower() and not any(r.lower() in t.lower() for r in rs)})
    assert Counter(map(tuple, df.collect())) == want


def test_missed(spark):
    curated, found = ["The Whole Title", "part", "Unknown Work", "Equal", "unk", None], ["whole", "a longer part of it", "EQUAL", "nothing", None]
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "title string")
    assert sorted(r.title for r in collation.missed(frame(curated), frame(found)).collect()) == ["unk", "unknown work"]
    assert collation.missed(frame(curated), frame([])).count() == 5 and collation.missed(frame([]), frame(found)).count() == 0
    assert collation.missed(frame(curated), frame([""])).count() == 0  # the empty title is part of every other


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.7])
def test_set_join(spark, threshold):
    rng = random.Random(4)
    rows = [(k % 5, k, None if k % 41 == 7 else " ".join(["the"] + [rng.choice(["a", "b", "c", "d", "e", "f", "g"]) for _ in range(rng.randint(0, 6))]) if k % 29 else "  ") for k in range(200)]
    sets = {k: set(t.split()) for _, k, t in rows if t and t.strip()}
    score = lambda a, b: len(a & b) / len(a | b)
    df = spark.createDataFrame(rows, "cluster long, ordinal long, title string")
    best = {}
    for (c, i, t), (d, j, u) in combinations(rows, 2):
        if c == d and i in sets and j in sets and score(sets[i], sets[j]) > threshold:
            best.setdefault(c, []).append((-score(sets[i], sets[j]), i, j))
    assert {r.cluster: (-r.score, r.first, r.second) for r in set_join.best_pairs(df, threshold).collect()} == {c: min(v) for c, v in best.items()}
    titles = sorted({t for _, k, t in rows if k in sets})
    want = {(a, b): score(set(a.split()), set(b.split())) for a, b in combinations(titles, 2) if score(set(a.split()), set(b.split())) > threshold}
    assert {(r.title_a, r.title_b): r.score for r in set_join.fuzzy_pairs(df, threshold).collect()} == want


def test_a_word_in_every_title_makes_no_pairs(spark):
    titles = spark.range(3000).select(F.lit(0).alias("cluster"), F.format_string("common words first%d second%d", "id", "id").alias("title"))
    keyed, classes = set_join._classes(titles.withColumn("ordinal", F.monotonically_increasing_id()), "title", ["cluster", "ordinal"])
    assert classes.count() == 3000 and set_join.similar_classes(classes, 0.7).count() == 0
    prefixes = classes.select(F.explode(F.slice("words", 1, 2)).alias("word")).groupBy("word").count().agg(F.max("count")).first()[0]
    assert prefixes == 1


def test_words_do_not_carry_their_titles(spark, monkeypatch):
    kinds, made = [], set_join.ordered_sets
    monkeypatch.setattr(set_join, "ordered_sets", lambda items, text, by: kinds.append(items.select(*by).dtypes) or made(items, text, by))
    long = " ".join(f"word{k}" for k in range(2000))
    titles = spark.createDataFrame([(t,) for t in (long, long + " more", "More " + long, long, "a b", "b  a", "B a", " ", None)], "title string")
    found = {(r.title_a, r.title_b): r.score for r in set_join.fuzzy_pairs(titles, 0.7).collect()}
    assert found == {(long, long + " more"): 2000 / 2001, ("More " + long, long): 2000 / 2001, ("More " + long, long + " more"): 1.0, ("a b", "b  a"): 1.0, ("B a", "a b"): 1.0, ("B a", "b  a"): 1.0}
    assert kinds == [[("cluster", "int"), ("item", "bigint")]]  # what goes with every word


def _titles(spark, rows):
    return spark.createDataFrame([(f"A{k}", w, "TITLE", x) for k, (w, x) in enumerate(rows)], "id string, subject_id string, predicate_uri string, literal string")


def test_pairs_of_titles_are_those_of_all_rows_whatever_the_blocks(spark, monkeypatch):
    names = ["The Big Book", "big book", "Big Book vol 2", "Other", "", None, "!!", "OTHER"]
    rows = [(f"W{k % 23}" if k % 17 else None, names[k * k % 8]) for k in range(90)]
    own = {}
    for w, x in rows:  # ids are in order of their text, as A10 is before A2
        own.setdefault(w, [])
    for k in sorted(range(len(rows)), key=lambda k: f"A{k}"):
        own[rows[k][0]].append(rows[k][1])
    norm = lambda x: " ".join(re.sub(r"[^\w\s]", "", re.sub(r"\s+vol\s*\d*$", "", re.sub(r"^the\s+", "", (x or "").lower()))).split())
    # The own title is that of the least id, null or not.
    first = {w: x[0] for w, x in own.items() if w and x[0] is not None}
    want = Counter((w, v) for w, x in first.items() for v, y in rows if v and w != v and norm(x) and y is not None and norm(x) == norm(y))
    same = lambda x: " ".join((x or "").lower().split())
    prints = Counter((w, v) for w, x in first.items() for v, y in rows if v and w != v and same(x) and y is not None and same(x) == same(y))
    assert want and prints and max(want.values()) > 1
    for sizes in ((identity.BLOCK, identity.PARTS, identity.BLOCKS_DEALT), (1, 1, 1), (2, 3, 1), (3, 2, 2)):
        for name, n in zip(("BLOCK", "PARTS", "BLOCKS_DEALT"), sizes):
            monkeypatch.setattr(identity, name, n)
        for by, pairs, matcher in ((identity.by_title, want, "normalized_title"), (identity.by_fingerprint, prints, "text_fingerprint")):
            got = by(_titles(spark, rows)).collect()
            assert Counter((r.work_id, r.match_id) for r in got) == pairs
            assert {(r.matcher, r.confidence) for r in got} == {(matcher, identity.MATCHERS[matcher])}


@pytest.mark.parametrize("by", [identity.by_fingerprint, identity.by_title])
def test_pairs_of_one_title_take_little_disk(spark, tmp_path, by):
    n = 1200
    by(_titles(spark, [(f"W{k * 7919 % 99991}", "one title") for k in range(n)])).write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == n * (n - 1)
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 0.75 * n * (n - 1)  # less than a byte a pair


@pytest.mark.parametrize("by", [identity.by_fingerprint, identity.by_title])
def test_lists_of_one_title_repeat_byte_by_byte(spark, tmp_path, by):
    n = 1203  # not a multiple of eight
    by(_titles(spark, [(f"W{k * 7919 % 99991}", "one title") for k in range(n)])).write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == got.select("work_id", "match_id").distinct().count() == n * (n - 1)
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 0.2 * n * (n - 1)


def test_a_row_of_the_last_join_makes_the_pairs_of_one_work_and_one_list(spark):
    """Spark keeps them until it asks for the next row; a join by broadcast would keep those of a whole part."""
    pairs = identity.by_title(_titles(spark, [(f"W{k}", "one title") for k in range(400)]))
    assert pairs.count() == 400 * 399
    written = pairs.groupBy("work_id").agg(F.count("match_id").alias("n"))
    written.collect()
    plan = written._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    joins = re.findall(r"(\w+Join) ", plan)
    assert joins[0] == "SortMergeJoin" and "explode(element_at(" in plan
