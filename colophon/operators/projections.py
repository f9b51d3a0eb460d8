"""Rebuilding every projection of the ledger from its events.

One scan tags each event with the projections that its rule puts it in; the first
event of an id counts, as in a table that ignores later inserts; one write,
partitioned by projection, fills a new version's folder.  Only when that is
complete does a pointer name it, in a file of one row that Spark's committer
moves into place: readers see the old version or the new one, and a rebuild that
dies leaves the old one readable.  Versions are kept until ``forget``.

A projection without a rule, or without events, is there and empty, as after a
truncation.

Edge cases: events without an entity, and candidates (``PTCND_``), are in no
projection; a ledger without events gives eleven empty projections; two events
with one cursor count by event id.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The projections that a rebuild truncates.
PROJECTIONS = ("works", "people", "institutions", "editions", "witnesses", "etexts", "translations", "passages", "assertions", "external_identifiers", "identity_assertions")
#: The schema that rebuilt works name.
WORK_SCHEMA = "urn:schema:work:1.0.0"


@dataclass(frozen=True)
class Rule:
    """``when`` an event belongs to the projection, the row's ``id``, and its other ``fields`` as SQL over the event's columns."""

    when: str
    id: str
    fields: dict[str, str]


#: What a ledger's events say of themselves: entities that are created are works.
RULES = {"works": Rule("event_type = 'EntityCreated'", "entity_id", {"preferred_title": "coalesce(title, '')", "schema_uri": f"'{WORK_SCHEMA}'"})}


def projected(events: DataFrame, rules: dict[str, Rule] = RULES) -> DataFrame:
    """(projection, id, first_cursor, fields): all projections' rows from one scan; ``fields`` is a map of strings."""
    unknown = set(rules) - set(PROJECTIONS)
    if unknown:
        raise ValueError(f"no projections: {sorted(unknown)}")

    def row(name: str, rule: Rule) -> Column:
        pairs = [x for k, v in rule.fields.items() for x in (F.lit(k), F.expr(v).cast("string"))]
        return F.when(F.expr(rule.when), F.struct(F.lit(name).alias("projection"), F.expr(rule.id).cast("string").alias("id"), F.create_map(*pairs).alias("fields")))

    known = events.where("entity_id is not null and not startswith(entity_id, 'PTCND_')")
    tagged = known.select("cursor", "event_id", F.explode(F.array_compact(F.array(*[row(n, r) for n, r in rules.items()]))).alias("r")).where("r.id is not null")
    first = F.min_by("r.fields", F.struct("cursor", "event_id"))
    return tagged.groupBy("r.projection", "r.id").agg(F.min("cursor").alias("first_cursor"), first.alias("fields"))


def rebuild(events: DataFrame, root: str, rules: dict[str, Rule] = RULES) -> int:
    """Replay ``events`` into the next version under ``root`` and point to it; its number."""
    spark = events.sparkSession
    version = max(versions(spark, root), default=0) + 1
    folder = f"{root}/data/{version}-{uuid.uuid4().hex}"
    # Two rebuilds at once write two folders; of two pointers to one version the greater folder counts.
    projected(events, rules).write.partitionBy("projection").parquet(folder)
    spark.createDataFrame([(version, folder)], "version int, folder string").coalesce(1).write.mode("append").parquet(f"{root}/pointers")
    return version


def versions(spark: SparkSession, root: str) -> dict[int, str]:
    """The folders of all complete versions."""
    try:
        rows = spark.read.schema("version int, folder string").parquet(f"{root}/pointers").collect()  # one row per version
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return {}
    return {r["version"]: r["folder"] for r in sorted(rows)}


def read(spark: SparkSession, root: str, name: str, fields: dict[str, str], version: int | None = None) -> DataFrame:
    """One projection as of a version (the newest): id, first_cursor and ``fields`` (name: type). Only its own folder is read."""
    if name not in PROJECTIONS:
        raise ValueError(f"no projection {name}")
    known = versions(spark, root)
    if not known:
        raise FileNotFoundError(f"nothing was rebuilt under {root}")
    every = spark.read.schema("id string, first_cursor long, fields map<string,string>, projection string").parquet(known[max(known) if version is None else version])
    return every.where(F.col("projection") == name).select("id", "first_cursor", *[F.col("fields")[c].cast(t).alias(c) for c, t in fields.items()])


def counts(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """(projection, n_rows) of all projections, also the empty ones."""
    known = versions(spark, root)
    every = spark.read.schema("id string, projection string").parquet(known[max(known) if version is None else version])
    names = spark.createDataFrame([(n,) for n in PROJECTIONS], "projection string")
    return names.join(every.groupBy("projection").agg(F.count("*").alias("n_rows")), "projection", "left").select("projection", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def forget(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Delete the folders of all versions but the last ``keep``, and of rebuilds that never came to an end; how many went.

    Pointers stay: an older version's is simply one to nothing. Not to be called while a rebuild runs.
    """
    known = versions(spark, root)
    names = {known[v].rstrip("/").rsplit("/", 1)[-1] for v in sorted(known)[max(len(known) - keep, 0) :]}
    sc = spark.sparkContext
    data = sc._jvm.org.apache.hadoop.fs.Path(f"{root}/data")
    fs = data.getFileSystem(sc._jsc.hadoopConfiguration())
    gone = [s.getPath() for s in (fs.listStatus(data) if fs.exists(data) else []) if s.getPath().getName() not in names]
    for path in gone:
        fs.delete(path, True)
    return len(gone)
