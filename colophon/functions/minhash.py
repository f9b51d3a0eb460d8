"""MinHash signatures over letter shingles, cut from the letters of whole Arrow batches; every distinct shingle is hashed once per worker."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.functions.buffers import pieces
from colophon.functions.text import normalize_sanskrit, prefix_suffix_hash
from colophon.functions.udfs import nfc

#: Shingles that a worker remembers the hashes of (4 bytes for each component); then it starts anew.
KNOWN = 100_000
#: Shingles whose hashes are looked at together.
TOGETHER = 1 << 14
_known: dict[tuple[int, int], tuple[dict[bytes, int], np.ndarray]] = {}


def _hashes(shingle: str, components: int) -> list[int]:
    """The first four bytes of the SHA-256 of the shingle, an underscore and the component's number."""
    head, out = hashlib.sha256(f"{shingle}_".encode()), []
    for i in range(components):
        h = head.copy()
        h.update(str(i).encode())
        out.append(int.from_bytes(h.digest()[:4], "big"))
    return out


def _hashed(shingles: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a table of hashes for each of the distinct ``shingles`` (rows of letters), and the table."""
    k = shingles.shape[1]
    place, table = _known.get((components, k)) or ({}, np.zeros((1024, components), np.uint32))
    if len(place) + len(shingles) > KNOWN:
        place, table = {}, np.zeros((max(1024, len(shingles)), components), np.uint32)
    keys, at = [s.tobytes() for s in shingles], np.empty(len(shingles), np.int64)
    for n, key in enumerate(keys):
        if key not in place:
            if len(place) == len(table):
                table = np.concatenate([table, np.zeros_like(table)])
            table[len(place)] = _hashes(key.decode("utf-32-le"), components)
            place[key] = len(place)
        at[n] = place[key]
    _known[components, k] = place, table
    return at, table


def _signed(texts: list[str | None], components: int, k: int) -> np.ndarray:
    """One row per text: the least hash of each component over its shingles; zeros without any."""
    size = np.array([len(t or "") for t in texts], np.int64)
    letters = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le"), np.uint32)
    out = np.zeros((len(texts), components), np.uint32)
    if len(letters) < k:
        return out
    runs = np.lib.stride_tricks.sliding_window_view(letters, k)
    ends = np.cumsum(size)
    of = np.repeat(np.arange(len(texts)), size)[: len(runs)]
    whole = np.flatnonzero(np.arange(len(runs)) + k <= ends[of])
    if not len(whole):
        return out
    # Letters have 21 bits: a shingle's number is exact for three, and for more it is that of its rank so far and the next letter.
    code = np.zeros(len(whole), np.int64)
    for j in range(k):
        if j > 1:
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
        code = (code << 21) | runs[whole, j]
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    at, table = _hashed(np.ascontiguousarray(runs[whole[first]]), components)
    once = np.unique(of[whole] * len(first) + code)  # each shingle of a text once
    text, rows = once // len(first), at[once % len(first)]
    out[np.unique(text)] = np.iinfo(np.uint32).max
    for lo in range(0, len(rows), TOGETHER):
        t, r = text[lo : lo + TOGETHER], rows[lo : lo + TOGETHER]
        new = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        out[t[new]] = np.minimum(out[t[new]], np.minimum.reduceat(table[r], new, axis=0))
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, components: int = 128, k: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id``, ``signature`` of every row, and the columns ``keep``: per component the least hash of all shingles; zeros without any.

    A shingle's hashes don't depend on the document, so a worker makes them once
    for all its documents; the minimum doesn't mind repeats.  Nothing is shuffled
    or joined: rows with one id stay as many as they are.
    """
    picked = docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("text"))
    shape = picked.drop("text").withColumn("signature", F.array().cast("array<bigint>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                signed = _signed(part.column("text").to_pylist(), components, k).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * components, pa.int32()), pa.array(signed.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], names=[*part.schema.names[:-1], "signature"])

    return picked.mapInArrow(run, shape)


def similarity(a: Column, b: Column) -> Column:
    """Share of equal components; 0 for signatures of different lengths."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.coalesce(F.try_divide(same.cast("double"), F.size(a)), F.lit(0.0))).otherwise(0.0)


def similar_pairs(signed: DataFrame, threshold: float, rows: int = 8) -> DataFrame:
    """Pairs found in a common band of ``rows`` components, with their similarity."""
    bands = signed.select("id", "signature", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.size("signature") / rows).cast("int") - 1), lambda b: F.xxhash64(F.slice("signature", b * rows + 1, rows)))).alias("band", "key"))
    # Equal signatures are one node per band, so copies don't meet each other in pairs.
    nodes = bands.groupBy("band", "key", "signature").agg(F.min("id").alias("id"))
    a, b = nodes.alias("a"), nodes.alias("b")
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")))
    out = pairs.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), similarity(F.col("a.signature"), F.col("b.signature")).alias("similarity"))
    return out.where(F.col("similarity") >= threshold).distinct()


def text_fingerprints(docs: DataFrame, id_col: str, text_col: str, components: int = 128, kept: int = 8) -> DataFrame:
    """The fingerprint record of every text: shingles, the first ``kept`` components, prefix and suffix with their digests, length and digest."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(F.col(id_col).alias("id"), F.substring(F.sha2(text.cast("binary"), 256), 1, 16).alias("text_hash"), normalize_sanskrit(nfc(text), False).alias("normal"))
    normal = F.col("normal")
    ends = prefix_suffix_hash(normal)
    told = plain.select("id", F.greatest(F.char_length(normal) - 2, F.lit(0)).alias("shingle_count"), F.substring(normal, 1, 100).alias("prefix"), F.right(normal, F.lit(100)).alias("suffix"), ends["prefix_hash"].alias("prefix_hash"), ends["suffix_hash"].alias("suffix_hash"), ends["n_letters"].alias("n_letters"), "text_hash", "normal")
    kinds = tuple(c for c in told.columns if c not in ("id", "normal"))
    return signatures(told, "id", "normal", components, keep=kinds).withColumn("minhash", F.slice("signature", 1, kept)).drop("signature")
