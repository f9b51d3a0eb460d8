"""Per-entity state over the ledger's stream: the latest events of each entity, and the works that the ledger creates.

Both keep what the batch queries of ``operators.ledger`` would give for all events
read so far, whatever the order of the files, and ignore repeated events, so a
restart from a checkpoint or a file that comes twice changes nothing.  An entity's
state is a few rows at most, however many events it has.  Every output row
carries the whole current answer for its entity, so the sink needs no merge: the
newest batch of an entity counts (``newest``).

The session must keep state in RocksDB (``STORE``); it is snapshotted to the
query's checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Session settings that stateful processors need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
LATEST = "entity_id string, place int, cursor long, event_id string, event_type string"
CREATED = "id string, preferred_title string, first_cursor long, settled boolean"


class _Latest(StatefulProcessor):
    """The ``n`` greatest cursors of an entity; forgotten ``ttl`` milliseconds after the last change, if given."""

    def __init__(self, n: int, ttl: int | None):
        self.n, self.ttl = n, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getMapState("latest", "cursor long", "event_id string, event_type string", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = {k[0]: tuple(v) for k, v in self.events.iterator()} if self.events.exists() else {}
        before = dict(known)
        for r in rows:
            if r.cursor is not None:
                known.setdefault(r.cursor, (r.event_id, r.event_type))
                if len(known) > self.n:
                    del known[min(known)]
        if known != before:
            for cursor in before.keys() - known.keys():
                self.events.removeKey((cursor,))
            for cursor in known.keys() - before.keys():
                self.events.updateValue((cursor,), known[cursor])
            for place, cursor in enumerate(sorted(known, reverse=True), 1):
                yield Row(entity_id=key[0], place=place, cursor=cursor, event_id=known[cursor][0], event_type=known[cursor][1])

    def close(self) -> None:
        pass


def latest_events(events: DataFrame, n: int = 10, ttl: int | None = None) -> DataFrame:
    """The last ``n`` events of an entity whenever they change. With ``ttl`` the stream has work as long as time passes, so it
    runs until it is stopped: give ``write_batches`` an interval."""
    return events.select("entity_id", "cursor", "event_id", "event_type").where("entity_id is not null").groupBy("entity_id").transformWithState(_Latest(n, ttl), LATEST, "Update", "None" if ttl is None else "ProcessingTime")


class _Created(StatefulProcessor):
    """The first creation of an entity; settled when the watermark has passed all that could come before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "cursor long, title string, settled boolean")

    def _row(self, key, now) -> Row:
        return Row(id=key[0], preferred_title=now[1], first_cursor=now[0], settled=now[2])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = tuple(self.first.get()) if self.first.exists() else None
        now, newest, behind = known, 0, timerValues.getCurrentWatermarkInMs()
        for r in rows:
            if r.at < behind:
                continue
            newest = max(newest, r.at)
            if now is None or r.cursor < now[0]:
                now = (r.cursor, r.title, False)
        if now != known:
            self.first.update(now)
            self.handle.registerTimer(newest)
            yield self._row(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        cursor, title, settled = self.first.get()
        if not settled:
            self.first.update((cursor, title, True))
            yield self._row(key, (cursor, title, True))

    def close(self) -> None:
        pass


def created_works(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """The works that the ledger creates, again when an earlier creation turns up, and once more as settled when the events'
    time is ``late`` past it. Events further behind the newest than that are dropped, as watermarks do."""
    made = events.withWatermark("recorded_at", late).where("event_type = 'EntityCreated' and entity_id is not null and not startswith(entity_id, 'PTCND_') and cursor is not null")
    slim = made.select(F.col("entity_id").alias("id"), "cursor", "title", "recorded_at", F.unix_millis("recorded_at").alias("at"))
    return slim.groupBy("id").transformWithState(_Created(), CREATED, "Update", "EventTime")


def write_batches(changes: DataFrame, target: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Each batch in a folder of its number; a repeated batch overwrites its own. Ends when the input is read, or goes on at an interval (``every``)."""
    if changes.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STORE["spark.sql.streaming.stateStore.providerClass"]:
        raise ValueError(f"stateful streams need the session settings {STORE}")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    made = changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
    return (made.trigger(availableNow=True) if every is None else made.trigger(processingTime=every)).start()


def newest(spark: SparkSession, target: str, shape: str, key: str) -> DataFrame:
    """What the written batches say of each ``key`` last."""
    rows = spark.read.schema(f"{shape}, batch long").parquet(target)
    last = rows.groupBy(F.col(key).alias("__key")).agg(F.max("batch").alias("__batch"))
    return rows.join(last, (F.col(key) == F.col("__key")) & (F.col("batch") == F.col("__batch"))).drop("__key", "__batch", "batch")


def newest_row(spark: SparkSession, target: str, shape: str, key: str) -> DataFrame:
    """The last row of each key where a batch may have several: settled ones after the others."""
    rows = newest(spark, target, shape, key)
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(F.col("first_cursor"), F.col("settled").desc()))).where("__k = 1").drop("__k")
