"""Which texts contain which terms, for any number of both.

An inverted index of byte runs (grams of ``Q`` bytes of UTF-8, or a whole shorter
term) proposes pairs, and the texts verify them.  Every term is looked up by one
gram only, that of its grams which the fewest texts have, so a part that all
texts share proposes nothing as long as a term has another.  A term with a gram
that no text has is in no text and leaves before the join.

Texts are cut in the workers, on the bytes of Arrow batches.  A bitmap of fixed
size, made of the terms' grams, tells the workers which grams no term has: those
never leave.  All joins are equality joins on grams or rows: the plan is the same
for ten terms and for ten million, and Spark ships the smaller side only where it
is small.

Edge cases: the empty term is in every text; null terms and null texts match
nothing; repeated terms count once, repeated rows each; letters are compared as
they are (lower both sides first to ignore case).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.functions.buffers import byte_runs, pieces, text_bytes
from colophon.functions.scratch import cut

Q = 4
#: Slots of the bitmap (2 MB), in blocks as Spark's bitmap functions make them.
SLOTS, BLOCK = 1 << 24, 1 << 15


def _slot(gram: np.ndarray) -> np.ndarray:
    """The high bits of a product with a fixed odd number."""
    return ((gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64)


def _bits(grams: DataFrame) -> np.ndarray:
    """The bitmap of all grams' slots: 512 blocks of 4 KB at most reach the driver."""
    slot = F.col("slot") + 1  # Spark's blocks begin at 1
    made = grams.select("slot").groupBy(F.bitmap_bucket_number(slot).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    out = np.zeros(SLOTS // 8, np.uint8)
    for r in made:
        at = (r["block"] - 1) * BLOCK // 8
        out[at : at + BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _grams(rows: DataFrame, row: str, text: str, lengths: list[int], bits=None) -> DataFrame:
    """(row, gram, slot): the different grams of each text, of each of ``lengths`` bytes; a text shorter than that has none of them. Only grams whose slot is set in ``bits`` leave."""
    kind = rows.schema[row].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None if bits is None else bits.value
        for whole in batches:
            for batch in pieces(whole, "text"):
                raw, at = text_bytes(batch.column("text"))
                for n in lengths:
                    if n == 0:
                        of, gram = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
                    else:
                        of, gram = byte_runs(raw, at, n)
                    slot = _slot(gram)
                    if held is not None:
                        there = np.flatnonzero((held[slot >> 3] >> (slot & 7)) & 1)
                        of, gram = of[there], gram[there]
                    order = np.lexsort((gram, of))
                    of, gram = of[order], gram[order]
                    new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (gram[1:] != gram[:-1])])) if len(of) else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(of[new])), pa.array(gram[new]), pa.array(_slot(gram[new]))], names=["row", "gram", "slot"])

    return rows.select(F.col(row).alias("row"), F.col(text).alias("text")).where("text is not null").mapInArrow(run, f"row {kind}, gram long, slot long")


def possible(terms: DataFrame, texts: DataFrame, term: str = "term", text: str = "text") -> DataFrame:
    """The column ``term``, less terms with a run of ``Q`` bytes whose slot no text sets: those are in no text.

    Where terms are many and most are in no text, none of their runs leaves a worker. ``texts`` is read once.
    """
    bits = terms.sparkSession.sparkContext.broadcast(_bits(_grams(texts, text, text, [Q])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        for whole in batches:
            for batch in pieces(whole, term):
                of, gram = byte_runs(*text_bytes(batch.column(term)), Q)
                slot = _slot(gram)
                keep = np.ones(batch.num_rows, bool)
                keep[of[((held[slot >> 3] >> (slot & 7)) & 1) == 0]] = False
                yield batch.filter(pa.array(keep))

    return terms.select(term).where(F.col(term).isNotNull()).mapInArrow(run, terms.select(term).schema)


def contained(texts: DataFrame, terms: DataFrame, row: str = "row", text: str = "text", term: str = "term") -> DataFrame:
    """(row, term): each term that each text contains. ``row`` names a text; ``texts`` is read three times: store it first if it is dear."""
    spark = texts.sparkSession
    known = cut(terms.select(F.col(term).alias("term")).where("term is not null").distinct())
    size = F.least(F.octet_length("term"), F.lit(Q))
    lengths = sorted(r[0] for r in known.select(size.alias("n")).distinct().collect())  # Q + 1 at most
    if not lengths:
        return texts.select(F.col(row).alias("row")).join(known, F.lit(False))
    parts = [_grams(known.where(size == n), "term", "term", [n]) for n in lengths]
    for p in parts[1:]:
        parts[0] = parts[0].unionByName(p)
    parts = cut(parts[0].withColumnRenamed("row", "term"))
    seen = _grams(texts, row, text, lengths, spark.sparkContext.broadcast(_bits(parts))).join(parts.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    counted = parts.join(seen, "gram", "left").groupBy("term").agg(F.min(F.struct("n", "gram", "slot")).alias("least"), F.count_if(F.col("n").isNull()).alias("absent"))
    looked_up = cut(counted.where("absent = 0").select("term", "least.gram", "least.slot"))
    proposed = _grams(texts, row, text, lengths, spark.sparkContext.broadcast(_bits(looked_up))).join(looked_up.drop("slot"), "gram").select("row", "term")
    whole: Column = F.contains("__text", F.col("term"))
    return proposed.join(texts.select(F.col(row).alias("row"), F.col(text).alias("__text")), "row").where(whole).select("row", "term")
