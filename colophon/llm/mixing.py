"""Mixing sources to target weights by weighted fair queueing.

Each source shuffles its documents by a seeded hash and serves them in that
order, epoch after epoch.  A copy's virtual finish time is its source's
cumulative words, this copy included, divided by the source's target weight (its
target words).  All copies are range-sorted by virtual time, which interleaves
the sources in proportion, and the mix is truncated at the total budget: before
the first copy with which its words would be further from the budget than
without.  The cut takes a copy's virtual time as that at which half of it is
served, half its own words before its virtual finish time, so a source ends
within half a document of its target, but for what others leave of theirs.

Targets are filled like water: sources share the budget by weight, a source
stops at ``max_epochs`` times its own size, and what it leaves is shared again.

Edge cases: a null source is a source of its own, last in order; null and empty
texts have size 0 and are never taken; an empty table gives an empty mix;
repeated rows are separate rows, and rows that agree in all columns are
interchangeable; other columns are carried by ``mix_rows``, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from colophon.llm.storage import drop_stored, fresh, named, partitions, ranked, stored

WORDS = r"[\x20\x09-\x0D]+"


def word_count(text) -> "F.Column":
    """Number of maximal runs without ASCII white space; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    space = r"[\x20\x09-\x0D]"
    pieces = F.size(F.split(text, WORDS)) - F.substring(text, 1, 1).rlike(space).cast("int") - F.substring(text, -1, 1).rlike(space).cast("int")
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), pieces).otherwise(0).cast("long")


def fill_targets(sizes: list[int], weights: list[float], budget: float, max_epochs: float) -> list[float]:
    """Share ``budget`` by weight; stop each at ``max_epochs * size``; reshare the excess until none is above."""
    target, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    left = float(budget)
    while open_:
        whole = math.fsum(weights[k] for k in open_)
        full = [k for k in open_ if left * weights[k] / whole > max_epochs * sizes[k]]
        if not full:
            for k in open_:
                target[k] = left * weights[k] / whole
            break
        for k in full:
            target[k] = float(max_epochs * sizes[k])
            left -= target[k]
        open_ = [k for k in open_ if k not in set(full)]
    return target


def schedule(
    docs: DataFrame, *, weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per document: size, its source's size and target, the virtual finish time of its first copy, and ``times`` it is taken.

    ``weights`` repeat over the sources in code-point order, null last.  The
    budget is the size of all documents.  ``keep``: further columns to carry.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col), F.col(source_col).alias("source"), word_count(text_col).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("__shuffle"), *keep)
    slim = stored(slim, "sizes")  # the texts are read and split once: sampling and sorting read the sizes
    rows = ranked(slim, [F.col("source").asc_nulls_last(), F.col("__shuffle"), F.col(id_col).asc_nulls_last(), F.col("size"), *keep], ("size",), "mix")
    drop_stored(slim)
    # One row per source: weights are handed out in order on the driver, as the mix's own configuration.
    per = sorted(rows.groupBy("source").agg(F.sum("size").alias("n"), F.min("size_before").alias("first")).collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    budget = sum(r["n"] for r in per)
    targets = fill_targets([r["n"] for r in per], [weights[k % len(weights)] for k in range(len(per))], budget, max_epochs)
    shape = StructType([StructField("source", StringType()), StructField("source_size", LongType()), StructField("target", DoubleType()), StructField("__first", LongType())])
    table = spark.createDataFrame([(r["source"], r["n"], float(t), r["first"]) for r, t in zip(per, targets)], shape)
    rows = rows.withColumnRenamed("source", "__source")
    rows = rows.join(table, rows["__source"].eqNullSafe(table["source"])).drop("__source")
    # Words of the source up to this copy's end; epoch e adds e times the source's size.
    finish = lambda epoch: F.try_divide(F.col("size_before") - F.col("__first") + F.col("size") + epoch * F.col("source_size"), F.col("target"))
    # The queue is cut by the virtual time at which half of a copy is served, not all of it: so a source gets a copy that lies
    # across the cut if that brings it nearer to its target, and sources of long documents don't fall short of theirs.
    half = lambda epoch: finish(epoch) - F.try_divide(F.col("size"), 2 * F.col("target"))
    # Then the document's place, which is unique, then the epoch.
    key = lambda epoch: F.struct(half(epoch).alias("finish"), F.col("rank").alias("place"), epoch.cast("int").alias("epoch"))
    copies = rows.where("size > 0").select("size", F.explode(F.transform(F.sequence(F.lit(0), F.lit(max_epochs - 1)), key)).alias("key")).select("size", "key.*")
    queue = ranked(copies, [F.col("finish"), F.col("place"), F.col("epoch")], ("size",), "queue")
    # One row: the first copy, in the order of the mix, of which more than half is beyond the budget.
    over = queue.where(2 * F.col("size_before") + F.col("size") > 2 * budget).agg(F.min(F.struct("finish", "place", "epoch")).alias("cut")).first()["cut"]
    drop_stored(queue)
    taken = [F.lit(True) if over is None else key(F.lit(e)) < F.struct(F.lit(over["finish"]).alias("finish"), F.lit(over["place"]).cast("long").alias("place"), F.lit(over["epoch"]).alias("epoch")) for e in range(max_epochs)]
    times = sum((x.cast("int") for x in taken[1:]), taken[0].cast("int"))
    return rows.select(id_col, "source", "size", "source_size", "target", finish(F.lit(0)).alias("virtual_finish"), F.when(F.col("size") > 0, times).otherwise(0).alias("times"), *keep)


def mix(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: one row per taken copy, range-sorted by virtual finish time (ids and accounts, no texts)."""
    plan = schedule(docs, id_col=id_col, **options)
    copies = plan.where("times > 0").withColumn("epoch", F.explode(F.expr("sequence(0, times - 1)"))).withColumn("virtual_finish", F.col("virtual_finish") + F.try_divide(F.col("epoch") * F.col("source_size"), F.col("target")))
    order = [F.col("virtual_finish"), F.col("source").asc_nulls_last(), F.col(id_col).asc_nulls_last()]
    return copies.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).drop("times")


def mix_rows(docs: DataFrame, **options) -> DataFrame:
    """The taken documents with all their columns, one row per copy."""
    # A hash of the whole row names it: rows that share one are interchangeable, so one of them stands for all.
    row, other, n, times, copy = (fresh(x, docs.columns) for x in ("__row", "__r", "__n", "__t", "__copy"))
    told = [x for c in docs.columns for x in (named(c).isNull(), named(c))]  # a hash alone skips nulls
    hashed = docs.withColumn(row, F.struct(F.xxhash64(F.lit(1), *told).alias("a"), F.xxhash64(F.lit(2), *told).alias("b")))
    taken = schedule(hashed, keep=(row,), **options).groupBy(F.col(row).alias(other)).agg(F.sum("times").alias(times), F.count("*").alias(n)).where(F.col(times) > 0)
    joined = hashed.join(taken, hashed[row] == taken[other])
    once, many = joined.where(F.col(n) == 1), joined.where(F.col(n) > 1).dropDuplicates([row])
    return once.unionByName(many).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*map(named, docs.columns))
