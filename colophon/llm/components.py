"""Connected components of a link table by alternating stars, all in DataFrames.

Each partition first replaces the links that it holds by stars of the same
components.  Then each round points every node at the least node it knows of:
the large star moves a node's greater neighbours to its least one, the small star
its lesser ones.  The link table never grows, ends as one star per component, and
is stored between rounds.  Only two numbers per round reach the driver.

A hub, the least node of many, is a key with many rows in the joins alone, which
adaptive execution splits; aggregates combine before they shuffle.
Edge cases: links of a node with itself are ignored; an empty table has no nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.llm.storage import drop_stored, stored

#: Links that a task replaces by stars at a time (16 bytes each).
BLOCK = 1 << 20


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node that is not the least of its component, and that least one."""
    ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, least = place[: len(u)], place[len(u) :], np.arange(len(ids))
    while True:
        m = np.minimum(least[a], least[b])
        new = least.copy()
        np.minimum.at(new, least[a], m)
        np.minimum.at(new, least[b], m)
        while (new[new] != new).any():
            new = new[new]
        if (new == least).all():
            break
        least = new
    moved = np.flatnonzero(least != np.arange(len(ids)))
    return ids[moved], ids[least[moved]]


def _locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def done() -> pa.RecordBatch:
        u, v = stars(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
        return pa.record_batch({"u": pa.array(u), "v": pa.array(v)})

    for batch in batches:
        held.append([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1)])
        n += batch.num_rows
        if n >= BLOCK:
            yield done()
            held, n = [], 0
    if n:
        yield done()


def components(links: DataFrame, a: str = "a", b: str = "b", label: str = "components") -> DataFrame:
    """``node``, ``component`` (its least node) for every node of a link; ``links`` in either direction, repeats allowed.

    The result is read from a table of ``stored``.
    """
    local = lambda df: df.mapInArrow(_locally, "u long, v long")
    at = stored(local(links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u != v")), label)
    state = _state(at)
    while state[0]:
        both = at.union(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        # In the large star's result every link still points from the greater node to the lesser one.
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        new = stored(local(small.distinct()).distinct(), label)
        before, state = state, _state(new)
        drop_stored(at)
        at = new
        if state == before:
            break
    return at.select(F.col("u").alias("node"), F.col("v").alias("component")).union(at.select(F.col("v"), F.col("v")).distinct())


def _state(at: DataFrame) -> tuple[int, int]:
    r = at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first()
    return r[0], r[1] or 0
