import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colophon.llm import fingerprint, huffman, nn_descent
from tests.llm.conftest import SHAPE


def test_edits(docs, corpus):
    rows = fingerprint.fingerprinted_edits(docs).collect()
    assert len(rows) == len(corpus)
    order = sorted(((c[0], c[1] or "") for c in corpus), key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1]))
    want = {}
    for k, (doc, text) in enumerate(order):
        nxt, f = order[(k + 1) % len(order)][1], len(text) // 3
        want.setdefault((doc, hashlib.sha256((text[: len(text) - f] + nxt[:f]).encode()).hexdigest()), len(text))
    by_text = {}
    for r in rows:
        assert want[r.doc_id, r.edited_sha256] == r.n_chars
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        text = next(c[1] or "" for c in corpus if c[0] == r.doc_id)
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
    assert all(by_text[t] == "" for t in ("", " \n\t ")) and by_text["one"] != ""


def test_anchor_rule(spark):
    """An anchor is a k-mer whose least inner hash is at an edge, wherever it stands."""
    words = [f"w{(k * k) % 37}" for k in range(60)]
    df = spark.createDataFrame([(" ".join(words),), (" ".join(["new", "start", *words]),)], "text string")
    a, b = (r[0] for r in df.select(fingerprint.anchors(df.text, keep=1000)).collect())
    assert {(x.h, x.p + 2) for x in a} <= {(x.h, x.p) for x in b} | {(x.h, x.p + 2) for x in a if x.h in {y.h for y in b}}
    assert {x.h for x in a} <= {y.h for y in b}
    h = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("xxhash64(w)").collect()]
    m = [r[0] for r in spark.createDataFrame([(h[i], h[i + 1]) for i in range(len(h) - 1)], "a long, b long").selectExpr("xxhash64(a, b)").collect()]
    span = fingerprint.K - fingerprint.S
    chosen = [i for i in range(len(h) - fingerprint.K + 1) if min(m[i : i + span + 1]) in (m[i], m[i + span])]
    assert {x.p for x in a} <= set(chosen) and len(a) == len({tuple(words[i : i + fingerprint.K]) for i in chosen})
    both = df.select(fingerprint.likeness(fingerprint.anchors(df.text), fingerprint.anchors(df.text)).alias("same"), fingerprint.from_string(fingerprint.as_string(fingerprint.anchors(df.text))) == fingerprint.anchors(df.text)).collect()
    assert all(r[0] == 1.0 and r[1] for r in both)


def test_long_texts_keep_every_anchor(spark):
    """A passage that two long texts share is aligned, and likeness is that of all anchors."""
    one, two, shared = ([f"{c}{k}" for k in range(n)] for c, n in (("a", 5000), ("b", 4000), ("s", 80)))
    texts = " ".join(one[:3000] + shared + one[3000:]), " ".join(two[:700] + shared + two[700:])
    df = spark.createDataFrame([texts], "a string, b string")
    a, b = fingerprint.anchors(df.a), fingerprint.anchors(df.b)
    row = df.select(a.alias("a"), b.alias("b"), fingerprint.aligned(a, b).alias("both"), fingerprint.likeness(a, b).alias("near"), fingerprint.aligned(a, fingerprint.anchors(F.lit(""))).alias("no"), fingerprint.likeness(a, b, 64).alias("few")).first()
    p, q = {x.h: x.p for x in row.a}, {x.h: x.p for x in row.b}
    assert len(p) > 2500 and [x.h for x in row.a] == sorted(p)
    assert [tuple(x) for x in row.both] == sorted((p[h], q[h]) for h in p.keys() & q.keys())
    assert len(row.both) > 30 and all(x.p - 3000 == x.q - 700 for x in row.both) and row.no == []
    assert row.near == len(p.keys() & q.keys()) / len(p.keys() | q.keys()) and 0 <= row.few <= 1


def test_empty_tables(spark, none, tmp_path):
    assert fingerprint.fingerprinted_edits(none).count() == 0
    assert nn_descent.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def brute(vectors):
    unit = {}
    for k, v in vectors:
        if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            unit[k] = np.array(v, float) / np.linalg.norm(v)
    ids = sorted(unit)
    parent, n = {k: k for k, _ in vectors if k is not None}, dict.fromkeys((k for k, _ in vectors), 0)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9:
                n[a] += 1
                n[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (n[k], find(k)) for k in parent}


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(k, rng.standard_normal(16).astype(np.float32).tolist()) for k in range(300)]
    rows += [(400 + k, (np.array(rows[5][1]) + 0.05 * rng.standard_normal(16)).astype(np.float32).tolist()) for k in range(40)]  # a crowded group
    rows += [(500 + k, rows[k][1]) for k in range(10)] + [(520 + k, rows[9][1]) for k in range(15)]  # equal vectors
    rows += [(600, None), (601, []), (602, [0.0] * 16), (603, [float("nan")] * 16), (604, [None] * 16), (605, [1.0] * 4), (606, [1.0, 1.0, 1.0, 1.1])]
    got = nn_descent.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=6, leaf=64).collect()
    want = brute(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got) and {r.audit_recall for r in got} == {1.0}


def test_links_between_saturated_groups(spark):
    """Two tight groups larger than any list, with links between them that no list has room for."""
    rng = np.random.default_rng(4)
    a, far = np.eye(16)[0], np.eye(16)[1]
    b = 0.92 * a + np.sqrt(1 - 0.92**2) * far
    near = lambda v: (v + 0.01 * rng.standard_normal(16)).tolist()
    rows = [(k, near(a)) for k in range(60)] + [(100 + k, near(b)) for k in range(60)] + [(200 + k, rng.standard_normal(16).tolist()) for k in range(200)]
    want = brute(rows)
    for options in ({}, {"block": 32}):
        got = nn_descent.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=6, leaf=64, **options).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert want[100][1] == 0 and sum(r.kept for r in got) == len({c for _, c in want.values()})


def test_code_is_optimal_and_limited():
    counts = np.array([0, 5, 9, 12, 13, 16, 45, 0])
    assert int((huffman.code_lengths(counts).astype(int) * counts).sum()) == 224  # a textbook example
    skew = np.array([1 << k for k in range(30)])
    lengths = huffman.code_lengths(skew, 6)
    assert lengths.max() <= 6 and sum(2.0 ** -int(x) for x in lengths) <= 1
    assert huffman.code_lengths(np.zeros(4)).tolist() == [0] * 4 and huffman.code_lengths(np.array([0, 3])).tolist() == [0, 1]
    codes = huffman.canonical_codes(lengths)
    words = [format(int(c), f"0{n}b") for c, n in zip(codes, lengths)]
    assert not any(a != b and b.startswith(a) for a in words for b in words)


def test_blocks_round_trip():
    rng = np.random.default_rng(2)
    docs = [rng.geometric(0.02, n).clip(0, 999).astype(np.uint16) for n in (1, 2, 255, 256, 257, 1000, 1)]
    lengths = huffman.code_lengths(np.bincount(np.concatenate(docs), minlength=1000))
    bits, payload = huffman.encode_block(docs, lengths, huffman.canonical_codes(lengths))
    back = huffman.decode_block(np.array([len(d) for d in docs]), bits, payload, huffman.decode_table(lengths))
    assert (back == np.concatenate(docs)).all()


def test_corpus_round_trip(spark, docs, corpus, none, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    huffman.write_corpus(docs, f"file://{tmp_path}/c", path, vocabulary=49408, end_id=2)
    rows = sorted(huffman.read_corpus(spark, f"file://{tmp_path}/c").collect(), key=lambda r: r.start)
    assert [r.doc for r in rows] == sorted((c[0] for c in corpus), key=lambda x: (x is not None, x))
    texts, at = {c[0]: c[1] for c in corpus}, 0
    for r in rows:
        want = [*tok.encode(texts[r.doc] or "", add_special_tokens=False).ids, 2]
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want and (r.start, r.n_tokens) == (at, len(want))
        at += len(want)
    checks = {r.start: r.ids_crc32 for r in huffman.read_corpus(spark, f"file://{tmp_path}/c", digest=True).collect()}
    assert all(checks[r.start] == zlib.crc32(bytes(r.ids)) for r in rows)
    huffman.write_corpus(none, f"file://{tmp_path}/e", path, vocabulary=49408, end_id=2)
    assert huffman.read_corpus(spark, f"file://{tmp_path}/e").count() == 0


def test_chunks_agree_with_whole_texts():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    t = huffman.CachedTokenizer(public_tokenizers.path("word_bpe_49k.json"), huffman.id_type(49408))
    for text in ["Ünï, ß. SS ſs can't it's THE'S <|endoftext|> a<|startoftext|>b 123 4,5 ... éa éa  x\x1cy z ŉ. Ŀ, ª µ ﬁ.", "İstanbul ǅ Σας, 你好. नमस्ते,", " a b c\x85d\n\te "]:
        for _ in range(2):  # new chunks, then known ones
            ids, at = t.encode(pa.array([None, text, "", text]))
            want = t.tokenizer.encode(text, add_special_tokens=False).ids
            assert ids.tolist() == want + want and at.tolist() == [0, 0, len(want), len(want), 2 * len(want)]


def test_chunks_agree_when_they_are_many_or_forgotten(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(huffman.CachedTokenizer, "AT_ONCE", 3)
    monkeypatch.setattr(huffman.CachedTokenizer, "KEEP", 20)
    t = huffman.CachedTokenizer(public_tokenizers.path("word_bpe_49k.json"), huffman.id_type(49408))
    texts = [" ".join(f"Wörd{k * n}{'.,&'[k % 3]}" for k in range(n)) for n in (1, 3, 4, 40, 7)]
    for kind in (pa.string(), pa.large_string()):
        for text in texts:
            assert t.encode(pa.array([text], kind))[0].tolist() == t.tokenizer.encode(text, add_special_tokens=False).ids


def test_plain_words_are_encoded_once_whatever_their_case_and_marks(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    t = huffman.CachedTokenizer(public_tokenizers.path("word_bpe_49k.json"), huffman.id_type(49408))
    whole, asked = t._ids, []
    monkeypatch.setattr(t, "_ids", lambda texts: asked.extend(texts) or whole(texts))
    words = [f"{a}ngel{b}\u00f6zt" for a in ("\u00e9", "o", "\u00df") for b in ("", "at", "ing")]
    chunks = [f(w) + m for w in words for f in (str, str.upper, str.title) for m in ("", ".", "###", ".!!", ",***", "(<|", "_`{")]
    chunks += ["\u0130a.", "\u0130###", "a\u0301b.", "\u212bx.", "\u01c5.", "\u0149a", "\u00aa\u00ba.", "x\u00d7y", "can't", "it's.", "'s", "s'", "a1.", "###", "<|endoftext|>.", "a<|endoftext|>", "\u03a3\u03b1\u03c2.", "\u4f60\u597d.", "a\u00a0b.", "a\x1c.", "x\u0250."]
    for kind in (pa.string(), pa.large_string()):
        for text in (" ".join(chunks), *chunks):
            assert t.encode(pa.array([text], kind))[0].tolist() == t.tokenizer.encode(text, add_special_tokens=False).ids
    assert not any(w.lower() in x.lower() for w in words for x in asked)  # no plain word went through the whole tokenizer


def _word_level_bpe(path, *, added=(), **options):
    """A vocabulary with the parts of word_bpe_49k.json, without any token for z."""
    tokenizers = pytest.importorskip("tokenizers")
    letters = "abcz" if options.get("z") else "abc"
    names = [*letters, *(f"{x}</w>" for x in letters), ".", ".</w>", "ab", "ab</w>"]
    model = tokenizers.models.BPE({name: k for k, name in enumerate(names)}, [("a", "b"), ("a", "b</w>")], end_of_word_suffix="</w>")
    t, pre = tokenizers.Tokenizer(model), tokenizers.pre_tokenizers
    t.normalizer = tokenizers.normalizers.Lowercase() if options.get("lowers", True) else None
    runs = pre.Split(tokenizers.Regex(options.get("runs", huffman.LETTER_RUNS)), "removed", invert=True)
    t.pre_tokenizer = pre.Sequence([runs, pre.ByteLevel(add_prefix_space=False, use_regex=False)])
    t.add_tokens(list(added))
    t.save(path)
    return t


def test_words_are_plain_only_where_the_file_says_so(tmp_path):
    path = str(tmp_path / "t.json")
    texts = ["ab AB. abab.. z az za. cab zz bz", "z", "zz z", "", "ab.c a.b abc.. Abc", "z ab"]
    for options, plain in (({}, True), ({"z": True}, True), ({"lowers": False}, True), ({"added": ["b."]}, False), ({"added": ["bc"]}, False), ({"added": ["a.b"]}, True), ({"runs": r"[\p{L}]|[^\s\p{L}]+"}, False)):
        t = _word_level_bpe(path, **options)
        mine = huffman.CachedTokenizer(path, huffman.id_type(64))
        assert not mine.by_chunk or mine.plain == plain, options
        for text in texts:
            assert mine.encode(pa.array([text]))[0].tolist() == t.encode(text, add_special_tokens=False).ids, (options, text)


def test_vocabularies_that_keep_white_space_encode_whole_texts(tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    words = {"[UNK]": 0, "a": 1, "\u2581a": 2, "\u2581": 3, "b": 4, "\u2581b": 5}
    t = tokenizers.Tokenizer(tokenizers.models.WordLevel(words, unk_token="[UNK]"))
    t.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace()
    t.save(str(tmp_path / "t.json"))
    mine = huffman.CachedTokenizer(str(tmp_path / "t.json"), huffman.id_type(6))
    assert not mine.by_chunk
    for text in ("a b", "a  b", "", "b\na"):
        assert mine.encode(pa.array([text]))[0].tolist() == t.encode(text, add_special_tokens=False).ids


def test_corpus_of_repeated_and_missing_ids(spark, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    rows = [(7, f"text {k % 5}", None, None, None, 1, None, "y") for k in range(40)] + [(None, "no id", None, None, None, 1, None, "y")] * 9 + [(1, None, None, None, None, 1, "x", None)]
    docs = spark.createDataFrame(rows, SHAPE).repartition(4)
    path = f"file://{tmp_path}/r"
    huffman.write_corpus(docs, path, public_tokenizers.path("word_bpe_49k.json"), vocabulary=49408, end_id=2)
    out = sorted(huffman.read_corpus(spark, path, digest=True).collect(), key=lambda r: r.start)
    assert [r.doc for r in out] == [None] * 9 + [1] + [7] * 40
    assert [r.start for r in out] == [sum(x.n_tokens for x in out[:k]) for k in range(len(out))]
