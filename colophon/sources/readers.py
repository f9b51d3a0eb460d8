"""Readers of the catalogue's file formats. Files are read by Spark, so any store that it knows will do."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_dict(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """A file that is one object of records: one row per key."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value_schema}>")).alias("key", "record")).select("key", "record.*")


def json_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Newline-delimited records; blank and broken lines are dropped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def zip_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text members of zip files (no resource forks): title and id from ``Title-ID-IAST.txt``, text and its sha256."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        if name.endswith(".txt") and "__MACOSX" not in name:
                            yield pd.DataFrame([(source, name, z.read(name).decode("utf-8", "replace"))], columns=["archive", "member", "text"])

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "archive string, member string, text string")
    name = F.regexp_extract("member", r"([^/]*)\.txt$", 1)
    return rows.withColumn("title", F.regexp_extract(name, r"^(.*)-(\d+)-IAST$", 1)).withColumn("resource_id", F.regexp_extract(name, r"^(.*)-(\d+)-IAST$", 2)).withColumn("sha256", F.sha2(F.col("text").cast("binary"), 256))


def ts_seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The first array literal of a TypeScript file: comments and trailing commas go, keys and strings get double quotes."""
    body = F.regexp_extract("value", r"(?s)=\s*(\[.*\])", 1)
    for pattern, new in ((r"(?m)^\s*//.*$", ""), (r"(?s)/\*.*?\*/", ""), (r"([{,]\s*)([A-Za-z_]\w*)\s*:", '$1"$2":'), (r"'([^'\\]*)'", '"$1"'), (r",(\s*[}\]])", "$1")):
        body = F.regexp_replace(body, pattern, new)
    return spark.read.text(path, wholetext=True).select(F.inline(F.from_json(body, f"array<{schema}>")))


def tei_dir(spark: SparkSession, path: str) -> DataFrame:
    """One row per XML file: id (its name) and xml; what can't be parsed is left to the extractors, which skip it."""
    return spark.read.text(path, wholetext=True, pathGlobFilter="*.xml").select(F.regexp_extract(F.input_file_name(), r"([^/]*)\.xml$", 1).alias("id"), F.col("value").alias("xml"))


def saved_responses(spark: SparkSession, path: str, items: str, schema: str) -> DataFrame:
    """Saved answers of a search service: the array at ``items`` (a JSON path) of each file, one row per item."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.inline(F.from_json(F.get_json_object("value", items), f"array<{schema}>")))


def contents(spark: SparkSession, path: str) -> DataFrame:
    """Files as artifacts: path, length and sha256."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


#: Reader of each adapter name; schemas are the caller's.
ADAPTERS = {"pandit": json_dict, "darshana": json_list, "muktabodha": zip_texts, "sanskritree": ts_seed, "gretil": tei_dir, "openalex": saved_responses, "crossref": saved_responses, "archiveorg": saved_responses, "orcid": saved_responses, "ror": saved_responses, "wikidata": saved_responses}


def load_adapter(name: str):
    if name not in ADAPTERS:
        raise ValueError(f"no adapter named {name}; there are {', '.join(sorted(ADAPTERS))}")
    return ADAPTERS[name]


def audit_adapters(sources: DataFrame) -> DataFrame:
    """(name, code) to a class by what the code does: REAL over a network, LOCAL over files, SCAFFOLDED with neither, MIXED."""
    n = lambda p: F.size(F.regexp_extract_all("code", F.lit(p), F.lit(0)))
    out = sources.withColumn("n_network", n(r"https?://|urlopen|requests\.")).withColumn("n_files", n(r"\bopen\(|read_text|read\.(?:json|text|format)"))
    kind = F.when((F.col("n_network") > 0) & (F.col("n_files") > 0), "MIXED").when(F.col("n_network") > 0, "REAL").when(F.col("n_files") > 0, "LOCAL").otherwise("SCAFFOLDED")
    return out.withColumn("kind", kind)


def observations(items: DataFrame, provider: str, key: str) -> DataFrame:
    """Items as raw observations: deterministic id, provider, resource and the record as JSON."""
    return items.select(F.concat(F.lit("PTOBS_"), F.lit(f"{provider}_"), F.col(key).cast("string")).alias("id"), F.lit(provider).alias("provider"), F.col(key).cast("string").alias("resource_id"), F.to_json(F.struct(*items.columns)).alias("payload"))


def normalize(items: DataFrame, key: str, prefix: str, facts: dict[str, tuple[str, float]], ids: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates, assertions and external identifiers of items. ``facts``: predicate to (column, confidence); ``ids``: scheme to column.

    A column that is an array gives one fact per element.
    """
    named = items.withColumn("__id", F.concat(F.lit(prefix), F.col(key).cast("string")))
    arrays = {f.name for f in items.schema.fields if f.dataType.typeName() == "array"}
    values = lambda c: F.col(c).cast("array<string>") if c in arrays else F.array(F.col(c).cast("string"))
    fact = lambda p, s: lambda v: F.struct(F.lit(p).alias("predicate_uri"), v.alias("literal"), F.lit(s).alias("confidence"))
    known = lambda s: lambda v: F.struct(F.lit(s).alias("scheme"), v.alias("value"))
    rows = F.flatten(F.array(*[F.transform(values(c), fact(p, s)) for p, (c, s) in facts.items()]))
    assertions = named.select(F.col("__id").alias("subject_id"), F.inline(rows)).where("literal is not null and literal != ''")
    keys = F.flatten(F.array(*[F.transform(values(c), known(s)) for s, c in ids.items()]))
    external = named.select(F.col("__id").alias("entity_id"), F.inline(keys)).where("value is not null and value != ''")
    return named.select(F.col("__id").alias("candidate_id")), assertions, external


def write_jsonl(table: DataFrame, path: str, by: str) -> None:
    """One folder of newline-delimited records per value of ``by``; rows of one value are written by one task each."""
    table.repartition(by).write.partitionBy(by).mode("overwrite").json(path)


def snapshot_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``path`` with size and digest, for a manifest; the root is the digest of the ordered lines."""
    return contents(spark, path).orderBy("path")


def manifest_root(manifest: DataFrame) -> str:
    lines = sorted(f"{r['path'].rpartition('/')[2]}:{r['length']}:{r['sha256']}" for r in manifest.collect())  # one line per file of a snapshot
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()
