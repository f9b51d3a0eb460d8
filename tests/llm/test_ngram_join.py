import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from colophon.llm import components, ngram_join
from tests.llm.conftest import SHAPE, prose


def brute(rows, percent=75, width=5):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(low))
        sets[r[0]] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    ids = sorted(k for k in sets if k is not None)
    parent = {k: k for k in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in ids}


def test_against_brute_force(spark, docs, corpus):
    want = brute(corpus)
    got = ngram_join.near_duplicates(docs).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r


def test_chains_of_near_copies(spark):
    rng, rows = random.Random(4), []
    for family in range(6):
        words = prose(family + 50, 120).split()
        for k in range(25):
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
            rows.append((family * 100 + k, " ".join(words).title() if k % 5 == 0 else " ".join(words), None, None, None, 1, None, None))
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, SHAPE)).collect()}
    assert got == brute(rows)


def test_one_of_each(docs, corpus):
    want = brute(corpus)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted(k for k, (_, c) in want.items() if k == c) and None in ids


def test_empty(none):
    assert ngram_join.near_duplicates(none).count() == 0
    assert ngram_join.one_of_each(none).count() == 0


@pytest.mark.parametrize("percent", [60, 75, 90])
def test_filters_lose_nothing(percent):
    rng = np.random.default_rng(percent)
    for _ in range(300):
        n = int(rng.integers(1, 40))
        x = np.sort(rng.choice(60, n, replace=False)).astype(np.uint64) << np.uint64(58)
        y = np.sort(rng.permutation(np.unique(np.concatenate([rng.choice(x, max(1, n - 2), replace=False), rng.choice(60, 2).astype(np.uint64) << np.uint64(58)]))))
        both = len(np.intersect1d(x, y))
        assert ngram_join.suffix_bound(x, y) >= both
        sketches = ngram_join.Sketches(pa.array(ngram_join.parity_sketches(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)])), pa.binary()))
        assert sketches.apart(np.array([0]), np.array([1]))[0] <= len(x) + len(y) - 2 * both
        linked = 100 * both >= percent * (len(x) + len(y) - both)
        assert linked == (both >= ngram_join.least_overlap(len(x), len(y), percent))
        if linked:
            p, q = (int(ngram_join.prefix_length(np.array([len(v)]), percent)[0]) for v in (x, y))
            first = next((v for v in x[:p] if v in y[:q]), None)
            assert first is not None
            i, j = int(np.searchsorted(x, first)), int(np.searchsorted(y, first))
            assert ngram_join._may_link(len(x), i, len(y), j, percent)


def test_components(spark, monkeypatch):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(30)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(5, 5), (7, 3)]
    parent = defaultdict(lambda: None)

    def find(x):
        parent[x] = x if parent[x] is None else parent[x]
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    nodes = {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in nodes}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    monkeypatch.setattr(components, "BLOCK", 1)  # next to no help from the tasks
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(9)).collect()}
    assert got == {x: find(x) for x in nodes}


def test_sketches_of_different_sizes_fold():
    rng = np.random.default_rng(3)
    for n in (100, 120, 127, 128, 129, 150, 3000, 40_000):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: int(0.9 * n)], rng.integers(0, 1 << 63, n // 5, dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        sketches = ngram_join.Sketches(pa.array(ngram_join.parity_sketches(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)])), pa.binary()))
        assert 0 < sketches.apart(np.array([0]), np.array([1]))[0] <= len(x) + len(y) - 2 * both


def test_tiles_and_slices_lose_nothing(spark, monkeypatch):
    """Near copies that share a passage, in lists that are cut into tiles and slices."""
    rng, rows = random.Random(8), []
    passage = prose(1, 60).split()
    for k in range(160):
        words = passage[:]
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(60)] = f"w{rng.randrange(10**6)}"
        rows.append((k, " ".join(words + prose(1000 + k, rng.randint(0, 14)).split()), None, None, None, 1, None, None))
    table = spark.createDataFrame(rows, SHAPE)
    want = brute(rows)
    monkeypatch.setattr(ngram_join, "TILE", 16)
    for rounds in (0, 6):
        monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(table).collect()} == want
    pairs, members = ngram_join.similar_sets(table)
    sets = {r.node: r.doc_id for r in members.collect()}
    assert {tuple(sorted((sets[r.a], sets[r.b]))) for r in pairs.collect()} == brute_pairs(rows)
    assert len(sets) == len(rows)


def brute_pairs(rows, percent=75, width=5):
    sets = {r[0]: {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} for r in rows for w in [r[1].lower().split()]}
    both = lambda a, b: len(sets[a] & sets[b])
    return {(a, b) for a in sets for b in sets if a < b and 100 * both(a, b) >= percent * (len(sets[a]) + len(sets[b]) - both(a, b))}


def packed_bucket(flushes, sets, entries):
    """Rows of one bucket, and its (token, node) entries: half of the tokens occur once."""
    rng, rows, all_tokens, all_nodes = np.random.default_rng(5), [], [], []
    for k in range(flushes):
        each = np.full(sets, entries // sets, np.int32)
        node = np.arange(k * sets, (k + 1) * sets, dtype=np.int64)
        token = np.where(rng.random(int(each.sum())) < 0.5, rng.integers(0, 1 << 62, int(each.sum())), rng.integers(0, 1 << 12, int(each.sum())) << 40).astype(np.uint64)
        rows.append(ngram_join._pack(np.array([sets, len(token)], np.int64), node, np.full(sets, 100, np.int32), each, token, np.zeros(len(token), np.int32)))
        all_tokens.append(token)
        all_nodes.append(np.repeat(node, each))
    return pa.record_batch({"bucket": pa.array([0] * flushes, pa.int32()), "packed": pa.array(rows, pa.binary())}), np.concatenate(all_tokens), np.concatenate(all_nodes)


def test_lists_of_a_bucket_in_little_memory():
    class Shared:
        value = np.ones(ngram_join.CELLS, np.int32)

    batch, token, node = packed_bucket(20, 1000, 50_000)
    tracemalloc.start()
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in ngram_join._lists(75, Shared)(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20  # a million entries: 16 MB, and 57 MB when the whole bucket was unpacked at once
    pairs = np.unique(np.stack([token.view(np.int64), node], 1), axis=0)
    values, at, n = np.unique(pairs[:, 0], return_inverse=True, return_counts=True)
    want = pairs[n[at] > 1]
    found = np.stack([np.concatenate([g[k] for g in got]) for k in (0, 1)], 1)
    assert len(found) == len(want) and (np.unique(found, axis=0) == want).all()
