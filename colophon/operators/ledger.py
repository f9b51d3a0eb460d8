"""The append-only event ledger: feeds, replay, merges and Merkle checkpoints."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colophon.functions import scratch
from colophon.functions.udfs import jcs

BLOCK = 12  # 2**BLOCK leaves fold in one row before any further shuffle


def changes_feed(events: DataFrame, since: int, limit: int) -> DataFrame:
    return events.where(F.col("cursor") > since).orderBy("cursor").limit(limit)


def max_cursor(events: DataFrame) -> DataFrame:
    return events.agg(F.coalesce(F.max("cursor"), F.lit(0)).alias("max_cursor"))


def latest_events(events: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` events of each entity; the rank filter is also applied before the shuffle."""
    return events.withColumn("place", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.col("cursor").desc()))).where(F.col("place") <= n)


def replay(events: DataFrame) -> DataFrame:
    """Works as the ledger creates them: first event wins, candidates are left out."""
    made = events.where("event_type = 'EntityCreated' and not startswith(entity_id, 'PTCND_')")
    return made.groupBy(F.col("entity_id").alias("id")).agg(F.min_by("title", "cursor").alias("preferred_title"), F.min("cursor").alias("first_cursor"))


def append_events(events: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` with the next cursors in the order of (recorded_at, event_id), and the digest of each payload's canonical JSON."""
    last = max_cursor(events)
    placed = positions(new, order=("recorded_at", "event_id"))
    out = placed.crossJoin(F.broadcast(last)).withColumn("cursor", F.col("max_cursor") + F.col("pos") + 1).drop("max_cursor", "pos")
    return out.withColumn("payload_digest", payload_digest(F.col("payload"))) if "payload" in new.columns else out


def payload_digest(payload, algorithm: str = "sha512"):
    """JSON of algorithm and value: SHA-512 (or SHA-256) of the payload's canonical form."""
    return F.to_json(F.struct(F.lit(algorithm).alias("algorithm"), F.sha2(jcs(payload).cast("binary"), 512 if algorithm == "sha512" else 256).alias("value")))


def leaf(event_id, cursor, digest):
    """sha256 of ``event_id:cursor:digest``; a missing digest is empty."""
    return F.sha2(F.concat(event_id, F.lit(":"), cursor.cast("string"), F.lit(":"), F.coalesce(digest, F.lit(""))).cast("binary"), 256)


def _pair(a, b):
    return F.sha2(F.concat(a, b).cast("binary"), 256)


def merkle_levels(leaves: DataFrame) -> DataFrame:
    """One round: rows (pos, hash) to their parents; an odd last one is paired with itself."""
    sides = leaves.groupBy(F.floor(F.col("pos") / 2).alias("pos")).agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("hash"))).alias("l"), F.max(F.when(F.col("pos") % 2 == 1, F.col("hash"))).alias("r"))
    return sides.select("pos", _pair(F.col("l"), F.coalesce("r", "l")).alias("hash"))


def _up(x):
    """Parents of one level's hashes."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / 2).cast("int")), lambda i: _pair(x[i * 2], x[F.least(i * 2 + 1, F.size(x) - 1)]))


def _fold(hashes, whole: bool):
    """BLOCK levels over a block's leaves. ``whole``: the block is the tree, so it stops at one hash."""
    for _ in range(BLOCK):
        hashes = F.transform(F.array(hashes), lambda x: F.when((F.size(x) > 1) | F.lit(not whole), _up(x)).otherwise(x))[0]
    return hashes[0]


def positions(events: DataFrame, parts: int | None = None, order: tuple[str, ...] = ("cursor",)) -> DataFrame:
    """``pos``: 0-based place of each event by ``order`` (unique): one range shuffle, and one row per partition to add up."""
    spark = events.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    # Ranges come from a sample of the cursors, so gaps don't matter; rows are stored, so places stay as they are.
    rows = scratch.cut(events.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    rows = rows.withColumn("__r", F.shiftrightunsigned("__at", 33))
    counts = rows.groupBy("__r").agg(F.count("*").alias("__n"))
    before = counts.select("__r", F.coalesce(F.sum("__n").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))  # n rows
    return rows.join(F.broadcast(before), "__r").withColumn("pos", F.col("__b") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__r", "__b", "__at")


def merkle_root(events: DataFrame, hashed=None) -> DataFrame:
    """``hashed``: the leaf's hash, if it isn't that of event id, cursor and digest. One row: root, first and last cursor and count. Log2(n) rounds, each half the rows of the one before.

    The number of rounds comes from one count; nothing else reaches the driver.
    """
    facts = events.agg(F.count("*").alias("n_events"), F.min("cursor").alias("first_cursor"), F.max("cursor").alias("last_cursor"))
    n = facts.first()["n_events"]
    if not n:
        return facts.select(F.sha2(F.lit("empty-ledger").cast("binary"), 256).alias("root"), "first_cursor", "last_cursor", "n_events")
    level = positions(events).select("pos", (leaf(F.col("event_id"), F.col("cursor"), F.col("digest")) if hashed is None else hashed).alias("hash"))
    # Whole blocks fold in place: every block but the last is full, so its top is the tree's node at that height.
    block = level.groupBy(F.floor(F.col("pos") / (1 << BLOCK)).alias("pos")).agg(F.sort_array(F.collect_list(F.struct("pos", "hash"))).alias("leaves"))  # 4096 leaves at most
    blocks = -(-n // (1 << BLOCK))
    if blocks == 1:
        top = block.select(_fold(F.transform("leaves", lambda x: x["hash"]), True).alias("root"))
        return top.crossJoin(facts)
    level = block.select("pos", _fold(F.transform("leaves", lambda x: x["hash"]), False).alias("hash"))
    while blocks > 1:
        level, blocks = merkle_levels(level), -(-blocks // 2)
    return level.select(F.col("hash").alias("root")).crossJoin(facts)


def merkle_verify(events: DataFrame, checkpoints: DataFrame, checkpoint_id: str) -> DataFrame:
    """Whether the root over the checkpoint's cursors is still the recorded one; false if there is no such checkpoint."""
    found = checkpoints.where(F.col("checkpoint_id") == checkpoint_id).first()
    if found is None:
        return events.sparkSession.range(1).select(F.lit(False).alias("valid"))
    span = events.where(F.col("cursor").between(found["first_cursor"], found["last_cursor"]))
    return merkle_root(span).select((F.col("root") == F.lit(found["root"])).alias("valid"))


def _streamed(algorithm: str):
    """One task's pieces, in their order, as one document; only the state of the digest and one batch are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, n, first = hashlib.new(algorithm), 0, True
        digest.update(b'{"events":[')
        for batch in batches:
            for piece, k in zip(batch.column("piece"), batch.column("n")):
                if not k.as_py():
                    continue  # the row that is there without events
                digest.update((b"" if first else b",") + piece.as_py().encode())
                n, first = n + k.as_py(), False
        digest.update(b"]}")
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()]), pa.array([n], pa.int64())], names=["state_digest", "n_events"])

    return run


def state_digest(events: DataFrame, since: int = 0, limit: int | None = None, algorithm: str = "sha512") -> DataFrame:
    """The digest of the ledger after ``since``: canonical JSON of ``{"events": [{"id", "type"}, ...]}`` in the order of the cursors.

    ``limit``: of a page of so many events only.  Events are placed and written as JSON in all partitions, 64 to a piece; the
    digest of one document takes one byte after the other, so its pieces stream through one task, which sorts them on disk
    and never holds the document.  ``state_root`` is the digest that is computed in all partitions.
    """
    after = events.where(F.col("cursor") > since) if limit is None else changes_feed(events, since, limit)
    # Places first: ranges come from a sample, for which Spark would write every event as JSON once more.
    each = positions(after.select("cursor", "event_id", "event_type")).select("pos", jcs(F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type")))).alias("event"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "event"))), lambda e: e["event"]), ",")
    pieces = each.groupBy(F.floor(F.col("pos") / 64).alias("at")).agg(listed.alias("piece"), F.count("*").alias("n"))
    none = events.sparkSession.range(1).select(F.lit(-1).cast("long").alias("at"), F.lit("").alias("piece"), F.lit(0).cast("long").alias("n"))
    return pieces.unionByName(none).repartition(1).sortWithinPartitions("at").select("piece", "n").mapInArrow(_streamed("sha512" if algorithm == "sha512" else "sha256"), "state_digest string, n_events long")


def state_root(events: DataFrame) -> DataFrame:
    """One digest of the whole state: the Merkle root of (event id, type) in the order of the cursors. A digest of all events
    as one document has no other order than one byte after the other; a tree is hashed in all partitions at once."""
    return merkle_root(events, F.sha2(F.concat(F.col("event_id"), F.lit(":"), F.col("event_type")).cast("binary"), 256)).select(F.col("root").alias("state_root"), "n_events")


def checkpoint_row(events: DataFrame, checkpoints: DataFrame, generated_at) -> DataFrame:
    """The next checkpoint: root and count over all events, and the id of the checkpoint before it (that of the greatest first cursor)."""
    last = checkpoints.agg(F.max_by("id", F.struct("first_event_cursor", "last_event_cursor")).alias("previous_checkpoint_id"))
    made = merkle_root(events).crossJoin(last)  # one row each
    key = F.sha2(F.concat_ws(":", "root", "first_cursor", "last_cursor", F.coalesce("previous_checkpoint_id", F.lit(""))).cast("binary"), 256)
    merkle = F.to_json(F.struct(F.col("root"), F.col("n_events").alias("leaf_count")))
    return made.select(F.concat(F.lit("CP_"), F.substring(key, 1, 16)).alias("id"), "previous_checkpoint_id", F.coalesce("first_cursor", F.lit(0)).cast("long").alias("first_event_cursor"), F.coalesce("last_cursor", F.lit(0)).cast("long").alias("last_event_cursor"), F.col("n_events").alias("event_count"), merkle.alias("merkle"), generated_at.alias("generated_at"))


def latest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.orderBy(F.desc("first_event_cursor"), F.desc("last_event_cursor")).limit(1)


def signature(record, signed_at, algorithm: str = "sha256", key_id: str = "default"):
    """A signature tagged with its algorithm: the digest of the record's canonical JSON. A key's signature would take the digest's place."""
    digest = F.sha2(jcs(record).cast("binary"), 512 if algorithm == "sha512" else 256)
    return F.struct(F.lit(algorithm).alias("algorithm"), F.lit(key_id).alias("key_id"), digest.alias("signature"), digest.alias("signed_digest"), signed_at.alias("signed_at"))


def signature_valid(record, signed):
    """Whether the record's digest is still the signed one."""
    canonical = jcs(record).cast("binary")
    return F.coalesce(F.when(signed["algorithm"] == "sha512", F.sha2(canonical, 512)).otherwise(F.sha2(canonical, 256)) == signed["signed_digest"], F.lit(False))


def follow_merges(merges: DataFrame) -> DataFrame:
    """``from_id`` to its last ``into_id``, through chains; null for what is on a cycle or leads into one.

    Pointers are doubled, so log2 of the number of merges bounds the rounds: what
    still moves then never ends.
    """
    at = scratch.cut(merges.where("from_id != into_id").groupBy("from_id").agg(F.min("into_id").alias("into_id")).withColumn("moved", F.lit(True)))
    for _ in range(math.ceil(math.log2(at.count() + 2)) + 1):
        ahead = at.select(F.col("from_id").alias("into_id"), F.col("into_id").alias("next"))
        at = scratch.cut(at.select("from_id", "into_id").join(ahead, "into_id", "left").select("from_id", F.coalesce("next", "into_id").alias("into_id"), F.col("next").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            break
    return at.select("from_id", F.when(~F.col("moved"), F.col("into_id")).alias("into_id"))


def traverse(edges: DataFrame, start: list[str], depth: int = 5, direction: str = "both", relation: str | None = None, limit: int | None = None) -> DataFrame:
    """(node, distance): what lies within ``depth`` steps of ``start`` along (source, relation, target), nearest first.

    ``direction``: out (from source to target), in, or both.  The edges are read
    and turned once, and stored by the node that a step starts from; a step joins
    the last frontier only, and what was seen before is left out by an anti join.
    The search ends early when a frontier is empty, or, with ``limit`` (the
    nearest so many nodes, ties by name), when the steps so far have enough.
    """
    if direction not in ("out", "in", "both"):
        raise ValueError(f"no direction {direction}")
    spark = edges.sparkSession
    kept = (edges if relation is None else edges.where(F.col("relation") == relation)).select("source", "target").dropna()
    turned = kept.select(F.col("target").alias("source"), F.col("source").alias("target"))
    steps = scratch.cut({"out": kept, "in": turned, "both": kept.union(turned)}[direction].distinct().repartition("source"))
    seen = spark.createDataFrame([(n, 0) for n in sorted(set(start))], "node string, distance int")
    front = seen
    for d in range(1, depth + 1):
        reached = steps.join(front.select(F.col("node").alias("source")), "source").select(F.col("target").alias("node")).distinct()
        front = scratch.cut(reached.join(seen.select("node"), "node", "left_anti").select("node", F.lit(d).alias("distance")))
        seen = seen.union(front)
        if front.isEmpty() or (limit is not None and seen.limit(limit).count() == limit):
            break
    return seen if limit is None else seen.orderBy("distance", "node").limit(limit)
