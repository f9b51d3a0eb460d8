"""Fingerprints and their likenesses against a plain version that hashes word by word."""

import hashlib
import re
import struct

import pytest

from colophon.llm import fingerprint
from tests.llm.conftest import SHAPE, prose

xxhash = pytest.importorskip("xxhash")


def xx(*values):
    """Spark's xxhash64: each value is hashed with the hash before it as the seed; signed."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def plain_anchors(text):
    words = [xx(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    if len(words) < fingerprint.K:
        return {xx(*words): 0} if words else {}
    inner = [xx(words[i], words[i + 1]) for i in range(len(words) - 1)]
    every = range(len(words) - fingerprint.K + 1)
    picked = [i for i in every if min(inner[i], inner[i + 2]) <= inner[i + 1]] or list(every)
    out = {}
    for i in picked:
        out.setdefault(xx(inner[i], inner[i + 2], inner[i + 2]), i)
    return out


def plain_print(text):
    return ",".join(f"{h & (2**64 - 1):016X}:{p}" for h, p in sorted(plain_anchors(text).items()))


def plain_likeness(a, b):
    x, y = set(plain_anchors(a)), set(plain_anchors(b))
    return 1.0 if not x and not y else len(x & y) / len(x | y) if x and y else 0.0


def test_prints_and_likenesses(spark):
    shared = prose(1, 40)
    texts = [prose(k, 3 + 11 * k % 90) for k in range(30)] + [shared, shared + " and a tail", "x " + shared, "", None, " \n ", "one", "a b c", "é ü ß words ø å", shared]
    rows = [(k * 7 % 101, t, None, None, None, 1, None, "y") for k, t in enumerate(texts)]
    order = sorted(rows, key=lambda r: -r[0])
    got = {r.doc_id: r for r in fingerprint.fingerprinted_edits(spark.createDataFrame(rows, SHAPE).repartition(4)).collect()}
    assert len(got) == len(rows)
    for k, row in enumerate(order):
        text, ahead = row[1] or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + ahead[:cut]
        r = got[row[0]]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (plain_print(text), plain_print(edited))
        assert r.near_edited == pytest.approx(plain_likeness(text, edited)) and r.near_next == pytest.approx(plain_likeness(text, ahead))


def test_repeated_and_missing_ids(spark):
    """Rows of one id follow each other by text, null ids come last, and every row is there."""
    rows = [(7, t, None, None, None, 1, None, "y") for t in ("b b b b b", "a a a a a", "b b b b b", None)] + [(None, "no id", None, None, None, 1, None, "y")] * 3 + [(9, "z z z z z z", None, None, None, 1, None, "y")]
    got = fingerprint.fingerprinted_edits(spark.createDataFrame(rows, SHAPE).repartition(3)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in got) == sorted((r[0] is None, r[0] or 0, len(r[1] or "")) for r in rows)
    nine = next(r for r in got if r.doc_id == 9)
    assert nine.edited_sha256 == hashlib.sha256(b"z z z z ").hexdigest()  # the next one is the null text of id 7
