"""Conversation repair against a plain search over all edits, and over runs of every length."""

import hashlib
import random
import re
import zlib

import pytest

from colophon.llm import turn_repair

COLUMNS = "conv_id long, turn long, role string, text string, rank long, size string, id string, `a.b` string, __id string"
SAYS = ["Yes.", "No!", "Why", "", "  \t", "Yes.", "so on, and", "Well?"]


def conversation(k: int, n: int, rng: random.Random) -> list[tuple]:
    out = []
    for t in range(n):
        role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]) if rng.random() < 0.4 else ("user", "assistant")[t % 2]
        text = None if rng.random() < 0.05 else rng.choice(SAYS) if rng.random() < 0.4 else f"It is {rng.random()}."
        out.append((k, None if rng.random() < 0.04 else t + (t > 3), role, text, 1, "x", "y", "z", "w"))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [r for k in range(60) for r in conversation(k, rng.choice([1, 2, 3, 5, 8, 13]), rng)]
    out += conversation(100, 90, rng) + [r for r in conversation(101, 40, rng) for _ in range(2)]
    out += [(None, t, *r[2:]) for t, r in enumerate(conversation(0, 6, rng))]
    out += [(102, 1, "user", "x" * 200_000 + ".", 1, "x", "y", "z", "w"), (103, 7, None, None, 1, "x", "y", "z", "w")]
    out += [(104, 3, "user", "The same.", 1, None, None, None, None)] * 30
    return out


def plain(turns: list[tuple]) -> tuple:
    """By trying every edit at every turn: states are the initials so far, in short."""
    turns = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in turns), key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), v[2].encode()))
    seen, faults, codes = set(), [], []
    for _, role, text in turns:
        dark = re.findall("[^\x20\x09-\x0d]", text)
        fault = "blank" if not dark else "duplicate" if (role, text) in seen else "truncated" if dark[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
    grammar = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def with_inserts(best):
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                for role in ("user", "assistant"):
                    if (state, role[0]) in grammar:
                        put(best, grammar[state, role[0]], (cost + 3, audit + "I", lines + [f"{role}:"]))
        return best

    def put(best, state, value):
        if state not in best or value[:2] < best[state][:2]:
            best[state] = value

    best = {"": (0, "", [])}
    for (_, role, text), fault in zip(turns, faults):
        after: dict = {}
        for state, (cost, audit, lines) in with_inserts(best).items():
            put(after, state, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 if fault else 0
            if (state, role[:1]) in grammar:
                put(after, grammar[state, role[0]], (cost + extra, audit + "K", lines + [f"{role}:{text}"]))
            for other in ("user", "assistant"):
                if (state, other[0]) in grammar:
                    put(after, grammar[state, other[0]], (cost + extra + 3, audit + "R", lines + [f"{other}:{text}"]))
        best = after
    cost, audit, lines = min((v for k, v in with_inserts(best).items() if k in ("", "a")), key=lambda v: v[:2])
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    return gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, lines


def by_conversation(rows) -> dict:
    out: dict = {}
    for k, *turn in rows:
        out.setdefault(k, []).append(turn[:3])
    return {k: plain(v) for k, v in out.items()}


@pytest.mark.parametrize("segment,fan", [(256, 16), (4, 2), (1, 3)])
def test_against_plain_search(spark, rows, segment, fan):
    want = by_conversation(rows)
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    turns, audits = turn_repair.repair(df, segment=segment, fan=fan)
    assert {r.id: tuple(r)[1:] for r in audits.collect()} == {k: v[:-1] for k, v in want.items()}
    got: dict = {}
    for r in sorted(turns.collect(), key=lambda r: (r.segment, r.place)):
        got.setdefault(r.id, []).append(f"{r.role}:{r.text}")
    assert got == {k: v[-1] for k, v in want.items() if v[-1]}
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in v)) for v in got.values())
    more = spark.createDataFrame(rows + [(999, 0, "user", "Gone.", 1, "x", "y", "z", "w")], COLUMNS)
    report = {r.conv_id: tuple(r)[1:] for r in turn_repair.repair_report(df, more, segment=segment, fan=fan).collect()}
    assert report.pop(999) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert report == {k: (*v[:-1], hashlib.sha256("\n".join(v[-1]).encode()).hexdigest()) for k, v in want.items()}


def test_ties_choose_the_least_audit(spark):
    cases = {"a": "IK", "u": "KI", "s": "D", "sua": "KKK", "ua": "KK", "uu": "IK" * 0 + "KIKI", "au": None}
    rows = [(k, t, {"s": "system", "u": "user", "a": "assistant"}[c], f"Turn {t}.") for k, case in enumerate(cases) for t, c in enumerate(case)]
    _, audits = turn_repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.id: (r.cost, r.audit) for r in audits.collect()}
    want = by_conversation(rows)
    for k, (case, audit) in enumerate(cases.items()):
        assert got[k] == want[k][5:7], case
    assert got[0] == (3, "IK") and got[3] == (0, "KKK") and got[2] == (4, "D")


def test_damage(spark, rows):
    got = sorted(map(repr, map(tuple, turn_repair.damaged(spark.createDataFrame(rows, COLUMNS)).collect())))
    want = []
    for k, t, role, text, *_ in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if k is None else k}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [repr((k, t, "user" if kind == 4 else role, text))] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert got == sorted(want)


def test_empty_table(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert turn_repair.repair_report(turn_repair.damaged(none), none).count() == 0
