"""Packing into optimal length buckets.

A global histogram of lengths feeds a dynamic program that picks the bucket
boundaries with the least total padding; inside a bucket, shuffled documents
form batches of as many rows as the token budget holds at the bucket's length.

The histogram has a bounded number of cells: lengths are exact up to
``exact_to`` and rounded up to a 1/64 step of their power of two beyond, so the
driver holds some thousand cells whatever the corpus.  A document longer than
the budget has a batch of its own.  Null and empty texts have length 0 and share
the shortest bucket; repeated rows are packed one by one; an empty table gives
an empty result; ``pack`` returns ids and places, ``packed_order`` all columns.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.llm.mixing import word_count
from colophon.llm.storage import drop_stored, partitions, ranked, stored

EXACT_TO = 1024


def cell_of(length: "F.Column", exact_to: int = EXACT_TO) -> "F.Column":
    """Length, rounded up to the histogram's grid."""
    step = F.pow(F.lit(2), F.greatest(F.floor(F.log2(F.greatest(length, F.lit(1)))) - 6, F.lit(0))).cast("long")
    return F.when(length <= exact_to, length).otherwise((F.ceil(length / step) * step).cast("long")).cast("long")


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> tuple[list[int], int]:
    """Bucket lengths (ascending) that minimise sum of (bucket length - length), and that sum.

    ``f[k][j]``: least padding of the first j cells in k buckets.  The cost of one
    bucket over cells i..j-1 is ``length[j-1] * (N[j]-N[i]) - (S[j]-S[i])`` with
    prefix counts N and sums S; each layer is one vectorised minimum per j.
    """
    if not lengths:
        return [], 0
    x, n = np.array(lengths, dtype=np.float64), np.array(counts, dtype=np.float64)
    m, big_n, big_s = len(x), np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * x)])
    best = np.full(m + 1, np.inf)
    best[0] = 0
    back = []
    for _ in range(min(buckets, m)):
        new, cut = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=np.int64)
        new[0] = 0
        for j in range(1, m + 1):
            cost = best[:j] + x[j - 1] * (big_n[j] - big_n[:j]) - (big_s[j] - big_s[:j])
            cut[j] = int(np.argmin(cost))
            new[j] = cost[cut[j]]
        best = new
        back.append(cut)
    ends, j = [], m
    for cut in reversed(back):
        if j == 0:
            break
        ends.append(int(x[j - 1]))
        j = int(cut[j])
    return sorted(set(ends)), int(best[m])


def pack(docs: DataFrame, *, buckets: int = 16, token_budget: int = 16384, seed: int = 23, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: length, bucket, padded length, batch (global) and its row in the batch. ``keep``: further columns to carry."""
    slim = docs.select(F.col(id_col), word_count(text_col).alias("n_tokens"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("__shuffle"), *keep)
    # The texts are read and split once: histogram and order read the sizes.
    slim = stored(slim.withColumn("__cell", cell_of(F.col("n_tokens"))), "sizes")
    # Ordered by cell, then shuffled: every bucket is one stretch of the global order.
    histogram = sorted(slim.groupBy("__cell").count().collect())
    ends, _ = best_boundaries([r[0] for r in histogram], [r[1] for r in histogram], buckets)
    bucket = F.lit(max(len(ends) - 1, 0))
    for k in range(len(ends) - 2, -1, -1):
        bucket = F.when(F.col("__cell") <= ends[k], F.lit(k)).otherwise(bucket)
    rows = ranked(slim.withColumn("bucket", bucket.cast("int")), [F.col("bucket"), F.col("__shuffle"), F.col(id_col).asc_nulls_last(), *keep], (), "pack")
    drop_stored(slim)
    sizes = [0] * max(len(ends), 1)
    for cell, n in histogram:
        sizes[next(k for k, e in enumerate(ends) if cell <= e)] += n
    first, first_batch, table = 0, 0, []
    for k, end in enumerate(ends):
        each = max(1, token_budget // max(end, 1))
        table.append((k, int(end), each, first, first_batch))
        first += sizes[k]
        first_batch += -(-sizes[k] // each)
    known = docs.sparkSession.createDataFrame(table or [(0, 0, 1, 0, 0)], "bucket int, bucket_length long, __each long, __first long, __batch long")
    inside = F.col("rank") - F.col("__first")
    out = rows.join(F.broadcast(known), "bucket")  # one row per bucket
    return out.select(
        id_col, "n_tokens", "bucket", "bucket_length", (F.col("__batch") + F.floor(inside / F.col("__each"))).cast("long").alias("batch"), (inside % F.col("__each")).cast("int").alias("row"), (F.col("bucket_length") - F.col("n_tokens")).alias("padding"), *keep
    )


def packed_order(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with ``n_tokens``, ``bucket``, ``bucket_length``, ``batch`` and ``row``, in files of whole batches ordered by batch.

    Columns of those names are replaced.  Rows are named by a hash of all their
    columns; those that agree in all are interchangeable and get a place each.
    """
    added = ["n_tokens", "bucket", "bucket_length", "batch", "row"]
    told = [x for c in docs.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    named = docs.withColumn("__row", F.struct(F.xxhash64(F.lit(1), *told).alias("a"), F.xxhash64(F.lit(2), *told).alias("b")))
    places = pack(named, keep=("__row",), **options).select(F.col("__row").alias("__r"), F.struct(*added).alias("__p"))
    # A name with several rows has several places: one of the rows goes to each of them.
    many = places.groupBy("__r").agg(F.count("*").alias("__n")).where("__n > 1")
    alone = named.join(many, named["__row"] == many["__r"], "left_anti")
    first = named.join(many.select("__r"), named["__row"] == many["__r"], "left_semi").dropDuplicates(["__row"])
    out = alone.unionByName(first).join(places, F.col("__row") == F.col("__r")).select(*[f"`{c}`" for c in docs.columns if c not in added], "__p.*")
    return out.repartitionByRange(partitions(docs.sparkSession), "batch").sortWithinPartitions("batch", "row")
