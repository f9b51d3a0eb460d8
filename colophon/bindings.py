"""Canonical tables over the driver's tables, as SQL that Spark and DuckDB both run.

Each entry is one canonical table of the catalogue (works, assertions, external
identifiers, ...) as a SELECT over ``part``, ``lineitem``, ``orders``, ``events``,
``customer``, ``supplier``, ``documents``, ``conversations`` and ``pages``.  An
oracle prefixes them as CTEs; Spark gets them as DataFrames.  Every row of a
source is used: the works of one order share its identifier; an order is a translation, an edition, an etext or a witness, and
the lines of four orders in a row are segments of the etext among them.  So that
every coverage state occurs, each 13th work leaves its identifiers to the one before it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "works": "SELECT concat('W', CAST(p_partkey AS STRING)) AS id, p_name AS preferred_title, p_type AS work_type, CAST(p_partkey AS BIGINT) AS seq FROM part",
    "assertions": """
        SELECT concat('A', kind, CAST(p_partkey AS STRING)) AS id, concat('W', CAST(p_partkey AS STRING)) AS subject_id, predicate_uri, literal,
               CASE WHEN p_partkey % 10 = 0 THEN 'DEPRECATED' ELSE 'ACTIVE' END AS lifecycle, CASE WHEN p_partkey % 2 = 0 THEN 'editor' ELSE 'harvester' END AS asserted_by
        FROM (
            SELECT p_partkey, 't' AS kind, 'TITLE' AS predicate_uri, p_name AS literal FROM part WHERE p_partkey % 7 <> 0
            UNION ALL SELECT p_partkey, 'u', 'TITLE', concat('The ', p_name, ' vol 2') FROM part WHERE p_partkey % 9 = 0
            UNION ALL SELECT p_partkey, 'a', 'AUTHOR', p_brand FROM part WHERE p_partkey % 5 <> 0
            UNION ALL SELECT p_partkey, 'r', 'TRADITION', p_type FROM part WHERE p_partkey % 3 = 0
            UNION ALL SELECT p_partkey, 'l', 'LANGUAGE', CASE WHEN p_partkey % 8 = 0 THEN 'x' ELSE 'sa' END FROM part WHERE p_partkey % 4 <> 0
            UNION ALL SELECT p_partkey, 'd', 'DATE', CAST(p_size AS STRING) FROM part WHERE p_partkey % 6 = 0
            UNION ALL SELECT p_partkey, 'n', 'NOTE', 'English Translation known' FROM part WHERE p_partkey % 11 = 0
        ) AS facts""",
    "external_identifiers": """
        SELECT concat('W', CAST(l_partkey - CASE WHEN l_partkey % 13 = 12 THEN 1 ELSE 0 END AS STRING)) AS entity_id,
               CASE l_orderkey % 7 WHEN 0 THEN 'GRETIL' WHEN 1 THEN 'PANDIT' WHEN 2 THEN 'DOI' WHEN 3 THEN 'ARCHIVE_ORG' WHEN 4 THEN 'DARSHANA' WHEN 5 THEN 'SANSKRITREE' ELSE 'OPENALEX' END AS scheme,
               concat('v', CAST(l_orderkey AS STRING)) AS value, min(l_shipdate) AS created_at
        FROM lineitem GROUP BY l_partkey - CASE WHEN l_partkey % 13 = 12 THEN 1 ELSE 0 END, l_orderkey""",
    "translations": """
        SELECT concat('T', CAST(o_orderkey AS STRING)) AS id, concat('W', CAST(o_custkey AS STRING)) AS work_id, CASE o_orderkey % 3 WHEN 0 THEN 'eng' WHEN 1 THEN 'fre' ELSE 'ger' END AS language,
               o_orderpriority AS translator, CASE o_orderstatus WHEN 'F' THEN 'FULL' WHEN 'O' THEN 'PARTIAL' ELSE 'MACHINE' END AS completeness
        FROM orders WHERE o_orderkey % 4 = 0""",
    "editions": "SELECT concat('D', CAST(o_orderkey AS STRING)) AS id, concat('W', CAST(o_custkey AS STRING)) AS work_id, o_orderpriority AS publisher FROM orders WHERE o_orderkey % 4 = 1",
    "etexts": "SELECT concat('E', CAST(o_orderkey AS STRING)) AS id, concat('W', CAST(o_custkey AS STRING)) AS work_id, o_orderstatus AS format FROM orders WHERE o_orderkey % 4 = 2",
    "witnesses": "SELECT concat('X', CAST(o_orderkey AS STRING)) AS id, concat('W', CAST(o_custkey AS STRING)) AS work_id, o_orderstatus AS siglum FROM orders WHERE o_orderkey % 4 = 3",
    "passages": "SELECT concat('P', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS id, concat('W', CAST(l_partkey AS STRING)) AS work_id, l_linenumber AS order_key FROM lineitem",
    "document_segments": """
        SELECT concat('S', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS id, concat('E', CAST(l_orderkey - l_orderkey % 4 + 2 AS STRING)) AS etext_id,
               CASE WHEN l_linenumber % 3 = 0 THEN 'manuscript' ELSE 'verse' END AS segment_type, CAST(l_linenumber AS BIGINT) AS ordinal
        FROM lineitem""",
    "ledger": """
        SELECT CAST(event_id AS BIGINT) AS cursor, concat('EV', CAST(event_id AS STRING)) AS event_id, CASE WHEN event_id % 3 = 0 THEN 'EntityCreated' WHEN event_id % 3 = 1 THEN 'AssertionAdded' ELSE event_type END AS event_type,
               CASE WHEN event_id % 10 = 0 THEN concat('PTCND_', CAST(user_id AS STRING)) ELSE concat('W', CAST(user_id AS STRING)) END AS entity_id, event_type AS title, md5(concat(event_type, CAST(event_id AS STRING))) AS digest, ts AS recorded_at
        FROM events""",
    "people": "SELECT concat('C', CAST(c_custkey AS STRING)) AS id, c_name AS name, c_mktsegment AS role FROM customer",
    "institutions": "SELECT concat('I', CAST(s_suppkey AS STRING)) AS id, s_name AS name, s_nationkey AS place FROM supplier",
    "readings": "SELECT conv_id AS work_id, role AS siglum, turn AS ordinal, text FROM conversations",
}
_BASE = ("part", "lineitem", "orders", "events", "customer", "supplier", "conversations", "documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One canonical table as a DataFrame; only the driver tables that it names are read."""
    sql = TABLES[name]
    used = {b: spark.read.parquet(f"{sf_dir}/{b}.parquet") for b in _BASE if re.search(rf"\b(FROM|JOIN) {b}\b", sql)}
    return spark.sql(re.sub(r"\b(FROM|JOIN) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], sql), **used)


def with_tables(sql: str) -> str:
    """``sql`` for DuckDB, with every canonical table that it names as a CTE in front."""
    named = [n for n in TABLES if re.search(rf"\b{n}\b", sql)]
    ctes = ", ".join(f"{n} AS ({TABLES[n]})" for n in named)
    head, rest = ("WITH RECURSIVE", sql[15:]) if sql.startswith("WITH RECURSIVE ") else ("WITH", sql[5:] if sql.startswith("WITH ") else None)
    return f"{head} {ctes}{', ' + rest if rest is not None else ' ' + sql}" if named else sql
