"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``virtual_nodes`` points of a 32-bit ring.  A document's key is
the hash of its text, so equal texts prefer one shard; within one ring point,
documents follow a second hash of their id.  The arc that ends in a virtual node
offers its keys to that node's shard.  A shard takes keys up to its bound; keys
overflowing a full shard continue clockwise to the next shard with room.

The walk runs on key counts per arc (``shards * virtual_nodes`` numbers, fixed by
parameters, never by the data); each document then finds its interval by its
place in ring order.  A single text that fills a third of the table is one ring
point with very many keys, and is cut into intervals like any other arc.

Edge cases: a null text shares the empty text's ring point and has size
``overhead``; a null id hashes like any other value; repeated rows are placed one
by one; an empty table gives an empty result; other columns are left out.

At load factor 1 counts come out at most one apart, which moves more keys when a
shard is added than consistent hashing alone would: the overflow of every full
shard shifts.  ``load_factor`` above 1 trades equal counts for less movement.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from colophon.llm.storage import drop_stored, ranked, stored

RING = 1 << 32


def _mix(x: int) -> int:
    """A 64-bit finaliser (public splitmix64 constants)."""
    x = (x + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 31)


def ring(shards: int, virtual_nodes: int) -> tuple[list[int], list[int]]:
    """Ring points in ascending order and the shard of each; a shard's points don't depend on the others."""
    points = {}
    for shard in range(shards):
        for node in range(virtual_nodes):
            points.setdefault(_mix(shard * 1_000_003 + node) % RING, shard)
    at = sorted(points)
    return at, [points[p] for p in at]


def bounds(total: float, shards: int, load_factor: float, whole: bool) -> list[float]:
    """What each shard may hold. At load factor 1 counts come out at most one apart."""
    if whole and load_factor <= 1:
        return [total // shards + (s < total % shards) for s in range(shards)]
    return [max(1.0, load_factor) * total / shards] * shards


def walk(loads: list[float], owners: list[int], limits: list[float]) -> list[list[tuple[int, float]]]:
    """For each arc, the (shard, amount) pieces that its keys are cut into, in order.

    First every shard serves its own arcs in ring order; then what is left over
    moves clockwise, arc by arc, to the next shard that still has room.
    """
    room, left = list(limits), list(loads)
    pieces: list[list[tuple[int, float]]] = [[] for _ in loads]
    for arc, owner in enumerate(owners):
        took = min(room[owner], left[arc])
        if took > 0:
            pieces[arc].append((owner, took))
            room[owner] -= took
            left[arc] -= took
    for arc in range(len(owners)):
        step = 1
        while left[arc] > 1e-9 and step <= len(owners):
            owner = owners[(arc + step) % len(owners)]
            took = min(room[owner], left[arc])
            if took > 0:
                pieces[arc].append((owner, took))
                room[owner] -= took
                left[arc] -= took
            step += 1
        if left[arc] > 1e-9:  # rounding of fractional bounds
            pieces[arc].append((owners[arc], left[arc]))
    return pieces


def shard_on_ring(
    docs: DataFrame, shards: int, *, law: str = "rows", virtual_nodes: int = 64, load_factor: float = 1.0, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` (slim: the text is replaced by its size and checksum) with ``shard`` and ``slot``.

    ``law``: what the bound limits, ``rows`` or ``bytes``.  ``slot`` counts each
    shard's documents from 0 without gaps, in the shard's ring order.
    """
    at, owners = ring(shards, virtual_nodes)
    # Turned so that the last point is the ring's end: each arc is then one stretch of the global order.
    turn = at[-1] + 1
    points = np.array([(p - turn) % RING for p in at], dtype=np.int64)
    keyed = docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + overhead).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__text"),
        F.xxhash64(F.lit(7), F.col(id_col)).alias("__doc"),
    ).withColumn("__ring", F.pmod(F.shiftrightunsigned("__text", 32) - turn, F.lit(RING)))
    keyed = stored(keyed, "keys")  # the texts are read and hashed once
    placed = ranked(keyed, [F.col("__ring"), F.col("__text"), F.col("__doc"), F.col(id_col).asc_nulls_first()], ("size",), "ring")
    drop_stored(keyed)

    def arc_of(rings: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(points, rings.to_numpy(dtype=np.int64)).astype(np.int32))

    start = "size_before" if law == "bytes" else "rank"
    amount = F.sum("size") if law == "bytes" else F.count("*")
    # One row per arc: shards * virtual_nodes rows at most reach the driver.
    counted = {r["__arc"]: r for r in placed.groupBy(F.pandas_udf(arc_of, IntegerType())("__ring").alias("__arc")).agg(amount.alias("n"), F.min(start).alias("first")).collect()}
    loads = [float(counted[k]["n"]) if k in counted else 0.0 for k in range(len(owners))]
    cuts = walk(loads, owners, bounds(sum(loads), shards, load_factor, law == "rows"))
    begins, to = [], []
    for k in sorted(counted):
        begin = float(counted[k]["first"])
        for shard, took in cuts[k]:
            begins.append(begin)
            to.append(shard)
            begin += took
    begins, to = np.array(begins or [0.0]), np.array(to or [0], dtype=np.int32)

    def piece_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(begins, x.to_numpy(dtype=np.float64) + 1e-6, side="right") - 1, 0).astype(np.int32))

    placed = placed.withColumn("__piece", F.pandas_udf(piece_of, IntegerType())(start))
    # A piece's rows are consecutive in the global order, so a slot is the rank shifted by a number of the piece.
    shift, filled = np.zeros(len(begins), dtype=np.int64), {}
    for r in sorted(placed.groupBy("__piece").agg(F.min("rank").alias("first"), F.count("*").alias("n")).collect()):
        shift[r["__piece"]] = filled.get(to[r["__piece"]], 0) - r["first"]
        filled[to[r["__piece"]]] = filled.get(to[r["__piece"]], 0) + r["n"]

    def shard_of(piece: pd.Series) -> pd.Series:
        return pd.Series(to[piece.to_numpy()])

    def slot_of(piece: pd.Series, rank: pd.Series) -> pd.Series:
        return pd.Series(shift[piece.to_numpy()] + rank.to_numpy(dtype=np.int64))

    return placed.select(id_col, "size", "text_crc32", F.pandas_udf(shard_of, IntegerType())("__piece").alias("shard"), F.pandas_udf(slot_of, LongType())("__piece", "rank").alias("slot"))
