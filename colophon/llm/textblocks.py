"""Arrow string columns seen as NumPy byte arrays, and words hashed without a Python loop per word.

``slices`` cuts a record batch into row ranges of about a megabyte of text, so
memory stays flat however long the documents are (one document is never cut).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# A fixed random number per byte value, and an odd base whose powers can be undone modulo 2**64.
_VALUE = np.random.default_rng(20240611).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.random.default_rng(20240612).integers(1, 1 << 63, size=16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def text_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its n+1 offsets; null rows are empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Row ranges of ``batch`` with about ``most`` bytes of text, and ``rows`` rows, at most."""
    _, at = text_view(batch.column(batch.schema.get_field_index(text)))
    row, n = 0, batch.num_rows
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
        end = min(end, n, row + rows)
        yield batch.slice(row, end - row)
        row = end


def mix64(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 2 * SLICE_BYTES)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (run without ASCII white space), and the index of each document's first word."""
    dark = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[at] = True  # a word never spans two documents
    before = np.concatenate([[False], dark[:-1]]) if len(raw) else dark
    after = np.concatenate([dark[1:], [False]]) if len(raw) else dark
    start = np.flatnonzero(dark & (~before | edge[:-1]))
    end = np.flatnonzero(dark & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, at)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes from one running sum, then mixed with its length."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[_LOWER[raw] if lower else raw] * up[: len(raw)], out=sums[1:])
    return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside each document, and the first shingle of each document.

    A document with fewer words has one shingle, its whole sequence; without words, none.
    """
    counts = np.diff(first)
    each = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(each)])
    if not starts[-1]:
        return np.zeros(0, np.uint64), starts
    word = np.arange(starts[-1]) + np.repeat(first[:-1] - starts[:-1], each)
    short = np.flatnonzero((counts > 0) & (counts < width))
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    out = np.zeros(starts[-1], dtype=np.uint64)
    for k in range(width):
        out += padded[word + k] * _PLACE[k % len(_PLACE)]
    for d in short:  # the whole sequence, without the words of the next document
        run = hashes[first[d] : first[d] + counts[d]]
        out[starts[d]] = np.sum(run * _PLACE[np.arange(len(run)) % len(_PLACE)], dtype=np.uint64) + np.uint64(counts[d])
    return mix64(out), starts


def sorted_sets(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct values in ascending order, and where each document begins."""
    out, sizes = [], np.zeros(len(starts), dtype=np.int64)
    for d in range(len(starts) - 1):
        v = np.sort(values[starts[d] : starts[d + 1]])
        if len(v) > 1:
            v = v[np.concatenate([[True], v[1:] != v[:-1]])]
        out.append(v)
        sizes[d + 1] = len(v)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(sizes)
