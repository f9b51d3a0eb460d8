"""The thin queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.llm import fingerprint, huffman, language, line_dedup, mixing, ngram_join, nn_descent, packing, quality, secrets, sharding, token_align, turn_repair
from colophon.llm.storage import scratch_path


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.schedule(_docs(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "source", "virtual_finish")


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_on_ring(_docs(spark, sf_dir), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir))


def _fold(parts: int) -> "F.Column":
    """crc32 of the id as text, modulo ``parts``: which documents a model must not learn from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprinted_edits(_docs(spark, sf_dir))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    found = language.identified(docs, language.train(docs.where(_fold(4) != 2)))
    return found.select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(_docs(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    ranker = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(_fold(5) != 0))
    found = quality.scored(docs.select("doc_id", "text"), ranker, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_docs(spark, sf_dir))


def op10_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "corpus")
    huffman.write_corpus(_docs(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), vocabulary=49408, end_id=2)
    return huffman.read_corpus(spark, path, digest=True).withColumnRenamed("doc", "doc_id")


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_docs(spark, sf_dir))


def op12_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = token_align.aligned(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.drop("a", "b")


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turn_repair.repair_report(turn_repair.damaged(rows), rows)


QUERIES = {"op1_mix": op1_mix, "op2_shard": op2_shard, "op3_embeddings": op3_embeddings, "op4_fingerprint": op4_fingerprint, "op5_pack": op5_pack, "op6_language": op6_language, "op7_secrets": op7_secrets, "op8_ngram_join": op8_ngram_join, "op9_quality": op9_quality, "op10_huffman": op10_huffman, "op11_lines": op11_lines, "op12_tokens": op12_tokens, "op13_turns": op13_turns}

ORACLE_SQL: dict[str, str] = {"op11_lines": line_dedup.REPORT_SQL, "op13_turns": turn_repair.REPORT_SQL}
