"""Line deduplication against plain Python, on nulls, repeats, ties, long texts and clashing names."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from colophon.llm import line_dedup

SHAPE = "doc_id long, text string, lang string, places string, `a.b` string, __id string, line int, row string, id string"
BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    pool = [f"Shared line number {k}" for k in range(30)] + ["short", "", "  \t", "ÉTAT de choses", "état de choses", "exactly10.", "\x0b\x0cExactly10.  ", "non breaking ", "a\rb carriage"]
    out = []
    for k in range(80):
        text = "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"own {k} {rng.random()}" for _ in range(rng.randint(1, 20)))
        out.append((k, text.upper() if k % 7 == 0 else text))
    out += [(200, None), (201, ""), (202, "\n\n"), (203, "\nShared line number 1\n"), (204, "x" * 300_000 + "\n" + "y" * 300_000), (205, "y" * 300_000)]
    out += [(300, "\n".join(f"frequent {k}" for k in range(4000))), (301, "\n".join(f"frequent {k % 3000}" for k in range(4000)))]
    out += [out[4], out[4], (5, "another text of five\nShared line number 2"), (None, "Shared line number 3\nno id"), (None, "no id here\nShared line number 4"), (None, None)]
    return [(*r, "en", "p", "q", "i", 1, None, "z") for r in out]


def plain(rows, least=10, documents=2):
    key = lambda line: line.strip(BLANK).translate(LOWER)
    holders = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            holders[key(line)].add(r[0])
    first = {k: min((x for x in v if x is not None), default=None) for k, v in holders.items() if len(k) >= least and len(v) >= documents}
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        out.append((r, len(lines), [x for x in lines if key(x) not in first or first[key(x)] == r[0]]))
    return out


@pytest.mark.parametrize("least,documents", [(10, 2), (0, 2), (12, 5)])
def test_against_plain_python(spark, rows, least, documents):
    df = spark.createDataFrame(rows, SHAPE).repartition(4)
    want = plain(rows, least, documents)
    got = line_dedup.line_report(df, least=least, documents=documents).collect()
    assert Counter(map(tuple, got)) == Counter((r[0], n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()) for r, n, kept in want)
    out = line_dedup.deduplicated(df, least=least, documents=documents)
    assert out.columns == df.columns
    assert Counter(map(tuple, out.collect())) == Counter((r[0], None if r[1] is None else "\n".join(kept), *r[2:]) for r, _, kept in want)


def test_stays_in_the_jvm(spark, rows):
    plan = line_dedup.line_report(spark.createDataFrame(rows, SHAPE))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    assert line_dedup.line_report(spark.createDataFrame([], SHAPE)).count() == 0
    assert line_dedup.deduplicated(spark.createDataFrame([], SHAPE)).count() == 0
