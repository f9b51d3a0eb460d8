"""Arrow string columns as NumPy bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and its n + 1 offsets; null rows are empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, text: str, most: int = 1 << 20, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Row ranges of ``batch`` with about ``most`` bytes of text and ``rows`` rows at most."""
    _, at = text_bytes(batch.column(text))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
        end = min(end, batch.num_rows, row + rows)
        yield batch.slice(row, end - row)
        row = end


def byte_runs(raw: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All runs of ``n`` (7 at most) bytes inside the rows: the row of each, and its bytes with their number as one integer."""
    if len(raw) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.full(len(raw) - n + 1, n, np.int64)
    for k in range(n):
        code = (code << 8) | raw[k : len(raw) - n + 1 + k]
    size = np.diff(at)
    row = np.repeat(np.arange(len(size)), size)[: len(code)]
    whole = np.arange(len(code)) + n <= at[row + 1]
    return row[whole], code[whole]
