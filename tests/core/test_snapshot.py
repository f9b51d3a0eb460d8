"""Snapshots write what changed, give back what was, and notice what was tampered with."""

import glob
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colophon.operators import snapshot


def test_snapshots(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    rows = [(f"W{k}" if k else None, f"t{k}", k % 3) for k in range(300)] + [("W1", "t1", 1)] * 3
    table = spark.createDataFrame(rows, "id string, title string, n int")
    empty = spark.createDataFrame([], "id string")
    assert snapshot.take(root, {"works": (table.repartition(3), "id"), "none": (empty, "id")}) == 1
    assert snapshot.take(root, {"works": (table.repartition(5), "id"), "none": (empty, "id")}) == 2
    assert len(glob.glob(f"{tmp_path}/s/data/*")) == 1  # nothing changed, nothing was written
    changed = table.withColumn("title", F.when(F.col("id") == "W7", "new").otherwise(F.col("title"))).where("id is null or id != 'W9'")
    assert snapshot.take(root, {"works": (changed, "id"), "none": (empty, "id")}) == 3
    differing = {r.bucket for r in snapshot.changed(spark, root, 2, 3).collect()}
    assert 1 <= len(differing) <= 2 and snapshot.changed(spark, root, 1, 2).count() == 0
    assert len(glob.glob(f"{tmp_path}/s/data/works-3-*/__bucket=*")) <= 2
    for v, want in ((1, table), (2, table), (3, changed)):
        assert Counter(map(tuple, snapshot.restore(spark, root, v, "works").collect())) == Counter(map(tuple, want.collect()))
        assert all(r.valid for r in snapshot.verify(spark, root, v, "works", "id").collect())
    assert snapshot.restore(spark, root, 3, "none").count() == 0
    listed = {(r.version, r.table_name): (r.n_rows, r.root) for r in snapshot.listing(spark, root).collect()}
    assert listed[1, "works"] == listed[2, "works"] != listed[3, "works"] and listed[3, "works"][0] == 302
    lost = glob.glob(f"{tmp_path}/s/data/works-3-*/__bucket=*")[0]
    shutil.rmtree(lost)
    assert [r.bucket for r in snapshot.verify(spark, root, 3, "works", "id").collect() if not r.valid] == [lost[-2:]]
    with pytest.raises(FileNotFoundError):
        snapshot.restore(spark, root, 9, "works")
    with pytest.raises(Exception, match="boom"):
        snapshot.take(root, {"works": (table.withColumn("n", F.raise_error(F.lit("boom")).cast("int")), "id")})
    assert snapshot.manifests(spark, root).agg(F.max("version")).first()[0] == 3
