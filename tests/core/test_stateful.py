"""Stateful streams over late, repeated and out-of-order files, with a restart between, equal the batch queries."""

import datetime
import random

import pytest

from colophon.operators import ledger
from colophon.streaming import ledger as stream
from colophon.streaming import stateful

T0 = datetime.datetime(2026, 1, 1)


@pytest.fixture
def settings(spark):
    wanted = {**stateful.STORE, "spark.sql.shuffle.partitions": "1"}  # a Python worker per partition and batch
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def events(seed: int, n: int = 60):
    rng = random.Random(seed)
    return [(c, f"E{c}", "EntityCreated" if c % 3 == 0 else "Other", rng.choice(["W1", "W2", "W3", "PTCND_9", None]), f"title {c}", "d", T0 + datetime.timedelta(minutes=c)) for c in range(1, n + 1)]


def put(spark, rows, folder, name):
    spark.createDataFrame(rows, stream.EVENTS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")
    import glob
    import os
    import shutil

    os.makedirs(f"{folder}/in", exist_ok=True)
    for f in glob.glob(f"{folder}/{name}/part-*"):
        shutil.move(f, f"{folder}/in/{name}.parquet")


def test_streams_equal_batches(spark, settings, tmp_path):
    rows, folder = events(3), str(tmp_path)
    files = [rows[20:45], rows[0:30] + rows[40:]]  # the second has what is late, new and repeated
    jobs = {
        "latest": (lambda e: stateful.latest_events(e, 4), stateful.LATEST, "entity_id"),
        "created": (lambda e: stateful.created_works(e, "1 day"), stateful.CREATED, "id"),
    }
    for turn in (files[:1], files[1:]):  # the second turn is a restart from the checkpoint
        for part in turn:
            put(spark, part, folder, f"f{files.index(part)}")
        for name, (job, _, _) in jobs.items():
            q = stateful.write_batches(job(stream.read_ledger(spark, f"{folder}/in", 1)), f"{folder}/{name}", f"{folder}/cp-{name}")
            q.awaitTermination(240)
            assert q.exception() is None
    every = spark.createDataFrame(rows, stream.EVENTS)
    got = stateful.newest(spark, f"{folder}/latest", *jobs["latest"][1:])
    want = ledger.latest_events(every.where("entity_id is not null"), 4)
    assert sorted(map(tuple, got.select("entity_id", "place", "cursor", "event_id").collect())) == sorted(map(tuple, want.select("entity_id", "place", "cursor", "event_id").collect()))
    got = stateful.newest_row(spark, f"{folder}/created", *jobs["created"][1:])
    assert sorted(map(tuple, got.select("id", "preferred_title", "first_cursor").collect())) == sorted(map(tuple, ledger.replay(every).collect()))


def test_what_is_too_late_is_dropped_and_what_is_old_is_settled(spark, settings, tmp_path):
    folder = str(tmp_path)
    made = lambda c, w, minutes: (c, f"E{c}", "EntityCreated", w, f"t{c}", "d", T0 + datetime.timedelta(minutes=minutes))
    for k, rows in enumerate([[made(5, "W1", 0), made(9, "W2", 600)], [made(1, "W1", 1), made(7, "W2", 590), made(12, "W3", 601)]]):
        put(spark, rows, folder, f"f{k}")
    stateful.write_batches(stateful.created_works(stream.read_ledger(spark, f"{folder}/in", 1), "1 hour"), f"{folder}/out", f"{folder}/cp").awaitTermination(240)
    got = {r.id: (r.first_cursor, r.settled) for r in stateful.newest_row(spark, f"{folder}/out", stateful.CREATED, "id").collect()}
    assert got["W1"] == (5, True)  # its earlier creation came ten hours behind the newest event
    assert got["W2"][0] == 7 and got["W3"] == (12, False)


def test_settings_are_asked_for(spark, tmp_path):
    put(spark, events(1, 3), str(tmp_path), "f")
    with pytest.raises(ValueError, match="stateStore"):
        stateful.write_batches(stateful.latest_events(stream.read_ledger(spark, f"{tmp_path}/in")), f"{tmp_path}/o", f"{tmp_path}/c")
