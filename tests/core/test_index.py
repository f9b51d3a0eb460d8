"""Versioned indexes against a dictionary, and how they are read."""

import random

import pytest
from pyspark.sql import functions as F

from colophon.operators.index import EntityIndex


@pytest.fixture
def index(spark, tmp_path):
    return EntityIndex(spark, f"ix_{random.randrange(1 << 60):x}", ["scheme", "value"], f"file://{tmp_path}", 4)


def test_the_last_registration_counts(spark, index):
    rng, known = random.Random(1), {}
    assert index.entries().count() == 0
    for turn in range(4):
        rows = [(rng.choice(["A", "B", None]), f"v{rng.randrange(40)}", f"E{rng.randrange(9)}" if rng.random() < 0.9 else None, rng.randrange(5)) for _ in range(30 if turn != 2 else 0)]
        assert index.register(spark.createDataFrame(rows, "scheme string, value string, entity_id string, ordinal long")) == turn + 1
        last = {}
        for s, v, e, o in rows:
            if s is not None and (((s, v) not in last) or (o, e is not None, e or "") > last[s, v][0]):
                last[s, v] = ((o, e is not None, e or ""), e)
        known |= {k: (x[1], turn + 1) for k, x in last.items()}
        assert {(r.scheme, r.value): (r.entity_id, r.version) for r in index.entries().collect()} == known
        if turn == 1:
            index.compact()
            index.compact()
            assert {(r.scheme, r.value): (r.entity_id, r.version) for r in index.entries().collect()} == known
    probes = spark.createDataFrame([(*k, 1) for k in known] + [("A", "none", 2), (None, "v1", 3), ("A", None, 4)], "scheme string, value string, n int")
    found = {(r.scheme, r.value, r.n): r.entity_id for r in index.find(probes).collect()}
    assert found == {(*k, 1): e for k, (e, _) in known.items()} | {("A", "none", 2): None, (None, "v1", 3): None, ("A", None, 4): None}


def test_reading_shuffles_nothing(spark, index):
    rows = spark.range(500).select(F.lit("S").alias("scheme"), F.col("id").cast("string").alias("value"), F.lit("E").alias("entity_id"), F.col("id").alias("ordinal"))
    index.register(rows)
    index.register(rows.where("ordinal < 100"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert "Exchange" not in index.entries()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_registration_that_dies_changes_nothing(spark, index):
    row = spark.createDataFrame([("S", "1", "E1", 1)], "scheme string, value string, entity_id string, ordinal long")
    index.register(row)
    index.register(row)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|boom"):
        index.register(row.withColumn("entity_id", F.raise_error(F.lit("boom")).cast("string")))
    assert [tuple(r) for r in index.entries().collect()] == [("S", "1", "E1", 2)] and index.version == 2
    index.register(row.withColumn("entity_id", F.lit("E2")))
    assert [tuple(r) for r in index.entries().collect()] == [("S", "1", "E2", 3)]
