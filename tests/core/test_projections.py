"""Rebuilds: first event wins, all projections are there, and a rebuild that dies changes nothing."""

import pytest
from pyspark.sql import functions as F

from colophon.operators import projections as pj

SHAPE = "cursor long, event_id string, event_type string, entity_id string, title string"
EVENTS = [(3, "c", "EntityCreated", "W1", "later"), (1, "a", "EntityCreated", "W1", "first"), (2, "b", "EntityCreated", "PTCND_1", "x"), (4, "d", "EntityCreated", "W2", None), (5, "e", "Other", "W3", "x"), (6, "f", "EntityCreated", None, "x"), (1, "a", "EntityCreated", "W1", "first")]


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/p"


def test_rebuild(spark, root):
    events = spark.createDataFrame(EVENTS, SHAPE)
    assert pj.versions(spark, root) == {}
    with pytest.raises(FileNotFoundError):
        pj.read(spark, root, "works", {})
    assert pj.rebuild(events.where("cursor > 1"), root) == 1 and pj.rebuild(events, root) == 2
    works = lambda v=None: sorted(map(tuple, pj.read(spark, root, "works", {"preferred_title": "string", "schema_uri": "string"}, v).collect()))
    assert works() == [("W1", 1, "first", pj.WORK_SCHEMA), ("W2", 4, "", pj.WORK_SCHEMA)]
    assert works(1) == [("W1", 3, "later", pj.WORK_SCHEMA), ("W2", 4, "", pj.WORK_SCHEMA)]
    assert {r.projection: r.n_rows for r in pj.counts(spark, root).collect()} == {n: 2 if n == "works" else 0 for n in pj.PROJECTIONS}

    # A rebuild that dies while it writes leaves the version before it, and its folder goes when asked.
    dying = events.withColumn("title", F.when(F.col("cursor") == 4, F.raise_error(F.lit("killed")).cast("string")).otherwise(F.col("title")))
    with pytest.raises(Exception, match="killed"):
        pj.rebuild(dying, root)
    assert sorted(pj.versions(spark, root)) == [1, 2] and len(works()) == 2
    assert pj.forget(spark, root) >= 1 and len(works()) == 2
    assert pj.rebuild(events, root) == 3 and len(works()) == 2


def test_no_events(spark, root):
    pj.rebuild(spark.createDataFrame([], SHAPE), root)
    assert pj.read(spark, root, "works", {"preferred_title": "string"}).count() == 0
    assert pj.counts(spark, root).agg(F.sum("n_rows"), F.count("*")).first() == (0, 11)
    with pytest.raises(ValueError):
        pj.projected(spark.createDataFrame([], SHAPE), {"none": pj.Rule("true", "event_id", {})})


def test_one_scan(spark):
    rules = {**pj.RULES, "passages": pj.Rule("true", "event_id", {"work": "entity_id"})}
    plan = pj.projected(spark.createDataFrame(EVENTS, SHAPE), rules)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
