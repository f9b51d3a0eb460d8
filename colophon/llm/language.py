"""Language identification with error-correcting output codes.

Every language has a codeword; one linear classifier over hashed letter n-grams
predicts each bit.  Decoding is loss-weighted: a language's loss is the sum of
logistic losses of the bit margins against its codeword, and the least loss
wins.  The score is the winner's share of ``exp(-loss)``; a small lead over the
runner-up sets ``ambiguous``.

N-grams are 1 to 3 bytes of the lower-cased text; everything that is not an
ASCII letter or part of a longer character separates.  Documents enter as square
roots of their n-gram shares, over whole texts.

Learning uses a bounded sample: at most ``sample`` documents (20 per language at
least), evenly over the languages, picked by a hash of id and text.

Edge cases: null, empty and letterless texts are ``und`` with score 0; without
labelled rows everything is; with one language it always wins; repeated rows are
predicted each.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colophon.llm.textblocks import slices, text_view

CELLS, ROWS = 2048, 128
_LETTER = np.zeros(256, dtype=np.int64)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def code_matrix(languages: int, seed: int = 11) -> np.ndarray:
    """Codewords of -1/+1, one row per language: all splits for few languages, else the best of random codes."""
    if languages <= 6:
        columns = [c for c in itertools.product((1, -1), repeat=languages) if c[0] == 1 and -1 in c]
        return np.array(columns, dtype=np.float64).T if columns else np.ones((languages, 1))
    rng, bits, best, code = np.random.default_rng(seed), max(16, 4 * int(np.ceil(np.log2(languages)))), -1, None
    for _ in range(300):
        c = rng.choice([-1.0, 1.0], (languages, bits))
        apart = (bits - c @ c.T) / 2 + np.eye(languages) * bits
        if apart.min() > best and (np.abs(c.sum(0)) < languages).all():
            best, code = apart.min(), c
    return code


def ngram_shares(texts: pa.Array) -> np.ndarray:
    """Square roots of hashed n-gram shares, one row per text."""
    raw, at = text_view(pc.utf8_lower(texts))
    n = len(at) - 1
    out = np.zeros(n * CELLS)
    if len(raw):
        b = _LETTER[raw]
        doc = np.repeat(np.arange(n), np.diff(at))
        for order in (1, 2, 3):
            if len(b) < order:
                break
            m = len(b) - order + 1
            gram = b[:m].copy()
            for k in range(1, order):
                gram = gram * 257 + b[k : m + k]
            cell = ((gram * (2 * order + 1) * 0x9E3779B1) >> 15) % CELLS
            use = (b[:m] > 0) & (doc[:m] == doc[order - 1 :])
            out += np.bincount((doc[:m] * CELLS + cell)[use], minlength=n * CELLS)
    out = out.reshape(n, CELLS)
    return np.sqrt(out / np.maximum(out.sum(1, keepdims=True), 1)).astype(np.float32)


def fit_bits(x: np.ndarray, targets: np.ndarray, steps: int = 80, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regressions for all bits at once (accelerated gradient steps). Last row: intercepts."""
    x = np.hstack([x, np.full((len(x), 1), 0.2, x.dtype)]).astype(np.float32)
    t = targets.astype(np.float32)
    w = np.zeros((x.shape[1], t.shape[1]), np.float32)
    ahead, rate = w.copy(), np.float32(4.0 / (1.05 * np.linalg.norm(x, 2) ** 2 / len(x)))
    for k in range(steps):
        pull = t / (1 + np.exp(np.clip(t * (x @ ahead), -30, 30)))
        new = ahead + rate * (x.T @ pull / len(x) - ridge * ahead)
        ahead = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


class Decoder:
    def __init__(self, x: np.ndarray, langs: list[str]):
        self.languages = sorted(set(langs))
        self.code = code_matrix(len(self.languages))
        own = np.array([self.languages.index(v) for v in langs])
        self.weights = fit_bits(x, self.code[own])

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the best language, its score and its lead over the runner-up."""
        margin = np.hstack([x, np.full((len(x), 1), 0.2, np.float32)]) @ self.weights
        loss = np.stack([np.logaddexp(0, -margin * c).sum(1) for c in self.code], 1)
        p = np.exp(-(loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        order = np.sort(p, 1)
        return p.argmax(1), order[:, -1], order[:, -1] - (order[:, -2] if p.shape[1] > 1 else 0)


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", rows=ROWS):
            x = ngram_shares(part.column(1))
            yield pa.record_batch({"lang": part.column(0), "x": pa.array([r.tobytes() for r in x], pa.binary())})


def train(docs: DataFrame, *, sample: int = 3000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Decoder | None:
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}  # one row per language
    if not counts:
        return None
    each = max(20, sample // len(counts))
    # A share of each language by a hash of id and text, then the least of them: many rows of one id are as good as any.
    whole, limit = 1 << 30, F.lit(0)
    for lang, n in counts.items():
        limit = F.when(F.col("lang") == lang, F.lit(min(whole, 2 * whole * each // n + 1))).otherwise(limit)
    keyed = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit(9), F.col(id_col), F.col(text_col)).alias("h"))
    some = keyed.where(F.pmod("h", F.lit(whole)) < limit)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(whole)), "h"))
    # Ranked without texts; rows that agree in hash are copies, and one of them stands for all.
    few = some.select("lang", "h").distinct().withColumn("place", place).where(F.col("place") <= each).select("lang", "h")
    # ``sample`` rows or 20 per language: bounded by the parameters, so the broadcast and what is collected are too.
    texts = some.join(F.broadcast(few), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")
    rows = texts.mapInArrow(_shares, "lang string, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    return Decoder(np.stack([np.frombuffer(bytes(r["x"]), np.float32) for r in rows]), [r["lang"] for r in rows])


def identified(docs: DataFrame, decoder: Decoder | None, *, id_col: str = "doc_id", text_col: str = "text", lead: float = 0.2) -> DataFrame:
    """``id_col``, ``lang_pred``, ``score``, ``ambiguous`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(decoder)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text", rows=ROWS):
                texts = part.column(1)
                has = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                n = part.num_rows
                best, score, gap = model.decode(ngram_shares(texts)) if model is not None else (np.zeros(n, int), np.zeros(n), np.zeros(n))
                has = has & (model is not None)
                names = [model.languages[k] if h else "und" for k, h in zip(best, has)]
                yield pa.record_batch({id_col: part.column(0), "lang_pred": pa.array(names, pa.string()), "score": pa.array(np.where(has, score, 0.0).astype(np.float64)), "ambiguous": pa.array(~has | (gap < lead))})

    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, ambiguous boolean")
