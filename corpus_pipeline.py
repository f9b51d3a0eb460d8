"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

1. quality classifier: documents that the Bradley-Terry ranking rejects go;
2. n-gram Jaccard join: of each group of near copies, the least id stays;
3. secret scans: secrets are replaced by a mark, documents stay;
4. mixing: documents as often as the mix to target weights takes them;
5. packing: the place of each row in optimal length buckets and batches.

All stages but the last return the columns of ``documents``.  Rows with a null
id, null or empty texts, repeated rows and further columns pass through every
stage as its operator states; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.llm import mixing, ngram_join, packing, quality, secrets
from colophon.llm.storage import fresh, named, scratch_path, write


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranker = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh("__score", docs.columns)
    return quality.scored(docs, ranker, name=score).where(F.col(score) >= quality.CUT).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    length = F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return secrets.redacted(docs).select(*[length.alias(c) if c == "n_chars" else named(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_rows(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality_classifier", keep_good), ("ngram_jaccard_join", drop_copies), ("secret_scans", hide_secrets), ("mixing", mix_sources), ("packing", pack_batches)]

#: No stage but packing could be told in SQL, and it follows four that can't: tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        write(stage(spark, docs, sf_dir), path)
        docs = spark.read.parquet(path)
    return docs
