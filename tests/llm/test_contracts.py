"""Every registered query over the smallest tables: its columns and types, and what plain Python can say of its rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest

from colophon.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="needs the given tables")
WORD = re.compile("[^\x20\x09-\x0d]+")
COLUMNS = {
    "op1_mix": "doc_id:bigint size:bigint source_size:bigint target:double taken:bigint",
    "op2_shard": "doc_id:bigint size:bigint text_crc32:bigint law:string shard:int slot:bigint grown_shard:int",
    "op3_embeddings": "vec_id:bigint n_links:bigint component_id:bigint kept:boolean",
    "op4_fingerprint": "doc_id:bigint n_chars:bigint edited_sha256:string fingerprint:string edited_fingerprint:string near_edited:double near_next:double",
    "op5_pack": "doc_id:bigint",
    "op6_language": "doc_id:bigint held_out:boolean lang_pred:string score:double",
    "op7_secrets": "doc_id:bigint n_assign:bigint n_access:bigint n_hex:bigint base_sha256:string spans:string",
    "op8_ngram_join": "doc_id:bigint n_shingles:bigint component_id:bigint",
    "op9_quality": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op10_huffman": "doc_id:bigint start:bigint n_tokens:bigint ids_crc32:bigint",
    "op11_lines": "doc_id:bigint n_lines:bigint n_dropped:bigint kept_sha256:string",
    "op12_tokens": "doc_id:bigint n_a:bigint n_b:bigint n_groups:bigint n_links:bigint n_best:bigint count_sum:bigint groups_sha256:string",
    "op13_turns": "conv_id:bigint gaps:bigint blank:bigint duplicate:bigint truncated:bigint illegal:bigint cost:bigint audit:string repaired_sha256:string",
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows_of(spark, name: str, key: str = "doc_id") -> dict:
    made = QUERIES[name](spark, SF)
    kinds = {f.name: f.dataType.simpleString() for f in made.schema}
    for column in COLUMNS[name].split():
        assert kinds.get(column.split(":")[0]) == column.split(":")[1], column
    rows = made.collect()
    out = {r[key]: r for r in rows}
    assert len(out) == len(rows)
    return out


def components(nodes, links) -> dict:
    of = {n: n for n in nodes}

    def top(n):
        while of[n] != n:
            n = of[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        of[b] = a
    return {n: top(n) for n in nodes}


def test_op1(spark, texts):
    got = rows_of(spark, "op1_mix")
    size = {k: len(WORD.findall(r.text or "")) for k, r in texts.items()}
    total = Counter()
    for k, r in texts.items():
        total[r.source] += size[k]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight, target = {s: 1 + k % 3 for k, s in enumerate(order)}, {}
    while free := [s for s in order if s not in target]:
        share = (sum(total.values()) - sum(target.values())) / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * share > 3 * total[s]]
        target.update({s: 3.0 * total[s] for s in over} or {s: weight[s] * share for s in free})
    taken = Counter()
    for k, r in texts.items():
        assert (got[k].size, got[k].source_size) == (size[k], total[r.source])
        assert got[k].target == pytest.approx(target[r.source]) and 0 <= got[k].taken <= 3 * size[k]
        taken[r.source] += got[k].taken
    assert got.keys() == texts.keys()
    longest = {s: max(size[k] for k, r in texts.items() if r.source == s) for s in order}
    assert all(abs(taken[s] - target[s]) <= 0.5 * longest[s] + 0.02 * target[s] for s in order)


def test_op2(spark, texts):
    got = rows_of(spark, "op2_shard")
    slots = defaultdict(list)
    for k, r in texts.items():
        raw = (r.text or "").encode()
        assert (got[k].size, got[k].law) == (len(raw) + 16, "rows")
        assert r.text is None or got[k].text_crc32 == zlib.crc32(raw)
        slots[got[k].shard].append(got[k].slot)
    assert got.keys() == texts.keys() and set(slots) == set(range(40))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op3(spark):
    got = rows_of(spark, "op3_embeddings", "vec_id")
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    whole = [k for k, v in vectors.items() if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = np.array([np.array(vectors[k], float) / np.linalg.norm(vectors[k]) for k in whole])
    a, b = np.nonzero(np.triu(unit @ unit.T >= 0.9, 1))
    links = [(whole[i], whole[j]) for i, j in zip(a, b)]
    n, lowest = Counter(x for pair in links for x in pair), components(vectors, links)
    assert {k: (r.n_links, r.component_id, r.kept) for k, r in got.items()} == {k: (n[k], lowest[k], lowest[k] == k) for k in vectors}


def test_op4(spark, texts):
    got = rows_of(spark, "op4_fingerprint")
    order, prints = sorted(texts, reverse=True), defaultdict(set)
    for k, after in zip(order, order[1:] + order[:1]):
        text, other = texts[k].text or "", texts[after].text or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + other[:cut]
        assert (got[k].n_chars, got[k].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[k].near_edited <= 1 and 0 <= got[k].near_next <= 1
        prints[text].add(got[k].fingerprint)
        prints[edited].add(got[k].edited_fingerprint)
    assert got.keys() == texts.keys() and all(len(x) == 1 for x in prints.values())


def test_op5(spark, texts):
    assert rows_of(spark, "op5_pack").keys() == texts.keys()


def test_op6_and_op9(spark, texts):
    langs, quality = rows_of(spark, "op6_language"), rows_of(spark, "op9_quality")
    known = {r.lang for r in texts.values()} - {None} | {"und"}
    assert langs.keys() == quality.keys() == texts.keys()
    for k, r in texts.items():
        fold = zlib.crc32(str(k).encode())
        assert langs[k].held_out == (fold % 4 == 2) and langs[k].lang_pred in known and 0 <= langs[k].score <= 1
        assert (langs[k].lang_pred == "und") >= (not any(c.isalpha() for c in r.text or ""))
        assert quality[k].held_out == (fold % 5 == 0) and 0 <= quality[k].score <= 1 and quality[k].predicted == (quality[k].score >= 0.3)


def test_op7(spark, texts):
    got = rows_of(spark, "op7_secrets")
    assign = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    kinds = [("assign", assign, 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]
    for k, r in texts.items():
        found = [(m.start(), place, f"{kind}:{m.start()}:{m.end()}") for place, (kind, rule, group, least) in enumerate(kinds) for m in rule.finditer(r.text or "") if len(m[group]) >= least]
        n = Counter(place for _, place, _ in found)
        base = [x for _, _, x in sorted(found)]
        assert (got[k].n_assign, got[k].n_access, got[k].n_hex) == (n[0], n[1], n[2])
        assert got[k].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(got[k].spans.split(","))
    assert got.keys() == texts.keys()


def test_op8(spark, texts):
    got = rows_of(spark, "op8_ngram_join")
    lower, sets = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), {}
    for k, r in texts.items():
        words = WORD.findall((r.text or "").translate(lower))
        sets[k] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    lowest = components(sets, links)
    assert links and {k: (r.n_shingles, r.component_id) for k, r in got.items()} == {k: (len(sets[k]), lowest[k]) for k in sets}


def test_op10(spark, texts):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    got, library, at = rows_of(spark, "op10_huffman"), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    for k in sorted(texts):
        ids = np.array([*library.encode(texts[k].text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert got.keys() == texts.keys()


def test_op11(spark, texts):
    from tests.llm.test_line_dedup import plain

    got = rows_of(spark, "op11_lines")
    want = {r[0]: (n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()) for r, n, kept in plain([(k, r.text) for k, r in texts.items()])}
    assert {k: tuple(r)[1:] for k, r in got.items()} == want and any(n for _, n, _ in want.values())


def test_op12(spark, texts):
    pytest.importorskip("public_tokenizers")
    from tests.llm.test_token_align import plain

    got, order = rows_of(spark, "op12_tokens"), sorted(texts)
    assert [tuple(got[k])[1:8] for k in order] == plain([texts[k].text for k in order]) and len(got) == len(order)


def test_op13(spark):
    from colophon.llm.turn_repair import damaged
    from tests.llm.test_turn_repair import by_conversation

    got, table = rows_of(spark, "op13_turns", "conv_id"), spark.read.parquet(f"{SF}/conversations.parquet")
    want = by_conversation([tuple(r) for r in damaged(table).collect()])
    full = {k: (*v[:-1], hashlib.sha256("\n".join(v[-1]).encode()).hexdigest()) for k, v in want.items()}
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert {k: tuple(r)[1:] for k, r in got.items()} == {r.conv_id: full.get(r.conv_id, none) for r in table.select("conv_id").distinct().collect()}
