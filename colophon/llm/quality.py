"""Quality scores by Bradley-Terry ranking.

A document's worth is a linear score of text features.  Preference pairs (a
document marked good over one marked bad) teach the weights by logistic loss on
feature differences.  The threshold is a quantile of the training scores, the
one that tells the two marks apart best; scores are then mapped to 0..1 by a
logistic curve that puts the threshold at ``CUT``.

Features are read from bytes, over whole texts: shares of letter cases, digits,
white space, single symbols and symbol runs, word lengths, and how often words,
word pairs and lines repeat.

Learning uses a bounded sample: per mark at most ``sample`` labelled rows,
those least by a hash of their id and text.  Scoring covers every document.

Edge cases: null and empty texts get features of an empty text and a score like
any other; without both marks in the sample every score is 0.5; null labels
teach nothing; repeated rows are scored each; extra columns are carried, but for
one of the score's name, which the score replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.llm.storage import named
from colophon.llm.textblocks import slices, text_view, word_hashes, words

CUT = 0.3
_SYMBOLS = b"#$%&*!|<>{}[]=_/\\@~^+"
#: Byte classes: one per row of the table below.
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",", b"-'\"():;?", b"!", b"|", b"#$%&*", _SYMBOLS, bytes(range(0xC0, 0x100)), bytes(range(0, 9))]
_TABLE = np.zeros((len(_CLASSES), 256), dtype=np.uint8)
for _k, _c in enumerate(_CLASSES):
    _TABLE[_k, list(_c)] = 1
N_FEATURES = len(_CLASSES) + 11


def _per_doc(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return sums[at[1:]] - sums[at[:-1]]


def _distinct(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.array([len(np.unique(values[a:b])) for a, b in zip(first[:-1], first[1:])], dtype=np.int64)


def features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of features per document; shares enter as square roots, which lifts small ones."""
    size = np.maximum(np.diff(at), 1)
    columns = [np.sqrt(_per_doc(_TABLE[k][raw], at) / size) for k in range(len(_CLASSES))]
    start, end, first = words(raw, at)
    n = np.diff(first)
    some = np.maximum(n, 1)
    h = word_hashes(raw, start, end)
    length = end - start
    doc = np.repeat(np.arange(len(n)), n)
    same_doc = doc[1:] == doc[:-1]
    again = np.concatenate([[False], (h[1:] == h[:-1]) & same_doc]) if len(h) else np.zeros(0, bool)
    pair = h[:-1] * np.uint64(3) + h[1:] if len(h) else np.zeros(0, np.uint64)
    pairs = [pair[a : max(b - 1, a)] for a, b in zip(first[:-1], first[1:])]
    upper = _TABLE[0][raw[start]].astype(bool) & (length > 1) & _TABLE[0][raw[np.minimum(start + 1, len(raw) - 1)]].astype(bool) if len(h) else np.zeros(0, bool)
    odd_end = np.isin(raw[end - 1], np.frombuffer(_SYMBOLS, np.uint8)) if len(h) else np.zeros(0, bool)
    mean = np.bincount(doc, length, len(n)) / some
    columns += [
        np.log1p(n) / 10,
        mean / 10,
        np.sqrt(np.maximum(np.bincount(doc, length.astype(float) ** 2, len(n)) / some - mean**2, 0)) / 10,
        np.sqrt(_per_doc(again, first) / some),
        np.sqrt(1 - _distinct(h, first) / some) * (n > 0),
        np.sqrt(np.array([1 - len(np.unique(p)) / max(len(p), 1) if len(p) else 0.0 for p in pairs])),
        np.sqrt(_per_doc(upper, first) / some),
        np.sqrt(_per_doc(odd_end, first) / some),
        np.sqrt(_per_doc(length == 1, first) / some),
        np.sqrt(_per_doc(length > 20, first) / some),
        (n == 0).astype(float),
    ]
    return np.stack([np.asarray(c, dtype=np.float64) for c in columns], 1)


def bradley_terry(x: np.ndarray, good: np.ndarray, pairs: int = 20_000, ridge: float = 1e-3, seed: int = 5) -> np.ndarray:
    """Weights w that maximise sum log sigmoid(w . (x_better - x_worse)), by Newton steps."""
    rng = np.random.default_rng(seed)
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    d = x[rng.choice(up, pairs)] - x[rng.choice(down, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w)), d.T @ p / pairs - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Ranker:
    """Standardised features, weights, threshold and slope: a few hundred bytes to send to tasks."""

    def __init__(self, x: np.ndarray, good: np.ndarray):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z = (x - self.mean) / self.scale
        self.weights = bradley_terry(z, good)
        s = z @ self.weights
        # The quantile with the best balanced accuracy; between two neighbours, the middle.
        cuts = np.unique(np.quantile(s, np.linspace(0, 1, 401)))
        middle = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
        quality = [((s[good] >= c).mean() + (s[~good] < c).mean()) for c in middle]
        best = np.flatnonzero(np.array(quality) >= max(quality) - 1e-9)
        self.threshold = float(middle[best].mean())
        self.slope = 4 / (np.quantile(s[good], 0.5) - np.quantile(s[~good], 0.5) + 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        s = ((x - self.mean) / self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * (s - self.threshold) + np.log(CUT / (1 - CUT)), -30, 30)))


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            x = features(*text_view(part.column(1)))
            yield pa.record_batch({"good": part.column(0), "x": pa.array([r.tobytes() for r in x], pa.binary()), "n": part.column(2)})


def train(docs: DataFrame, labels: DataFrame, *, sample: int = 2000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranker | None:
    """Learn from at most ``sample`` documents of each mark; None if one mark is missing."""
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("good"))
    # Rows, not ids, are counted: an id may have any number of them. Hashes are ranked, and texts travel only for what is picked.
    keyed = docs.select(F.col(id_col).alias("__id"), F.xxhash64(F.lit(3), F.col(id_col), F.col(text_col)).alias("__h"), F.col(text_col).alias("text"))
    found = keyed.select("__id", "__h").join(marked, "__id")
    least = lambda mark: found.where(F.col("good") == mark).orderBy("__h", "__id").limit(sample)
    few = least(1).union(least(0)).groupBy("__h", "__id", "good").agg(F.count("*").alias("n"))
    # At most 2 * sample rows: bounded by the parameter, so the broadcast is too. Rows that agree in id and text are one row with a number.
    once = keyed.join(F.broadcast(few), ["__h", "__id"]).groupBy("__h", "__id", "good", "n").agg(F.first("text").alias("text"))
    rows = once.select(F.col("good").cast("int").alias("good"), "text", F.col("n").cast("int").alias("n")).mapInArrow(_featurize, "good int, x binary, n int").collect()
    rows = [r for r in rows for _ in range(r["n"])]
    good = np.array([r["good"] == 1 for r in rows], dtype=bool)
    if not good.any() or good.all():
        return None
    x = np.stack([np.frombuffer(bytes(r["x"])) for r in rows])
    order = np.lexsort(np.concatenate([x.T, good[None]]))  # rows come in any order: sort, so that reruns agree
    return Ranker(x[order], good[order])


def scored(docs: DataFrame, ranker: Ranker | None, *, text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``keep`` columns (all, if None) with the score as ``name``; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(ranker)
    columns = [c for c in (docs.columns if keep is None else keep) if c != name]
    # Workers see columns by place, so that any name will do.
    places = [f"c{k}" for k in range(len(columns))]
    picked = docs.select(*[named(c).alias(k) for c, k in zip(columns, places)], named(text_col).alias("text"))
    shape = picked.drop("text").withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                view = text_view(part.column(len(places)))
                s = model.score(features(*view)) if model is not None else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(places)], pa.array(s)], names=[*places, "score"])

    return picked.mapInArrow(run, shape).toDF(*columns, name)
