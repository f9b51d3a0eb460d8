"""Near duplicates among embeddings by NN-descent.

A random-projection forest gives every vector first neighbours.  Then the graph
is refined: at each vector, its neighbours and those it is a neighbour of meet,
and pairs that are better than what either has replace it (neighbours of
neighbours become neighbours).  Edges at or above the threshold, checked in
double precision, are links.

A list that is full of links is saturated: it may hide more of them, in its own
component or in others.  Saturated lists, and only those, grow four times as long
and are refined again, until they are not saturated or have ``longest`` entries.
Vectors with more links than that are compared with all vectors in blocks, which
emit link counts and the pairs of components that a link joins, never pairs of
vectors.

Recall is audited: a fixed number of vectors is compared with all others, in
blocks; if less than ``least_recall`` of their links were found, over all or per
vector on average, the search is repeated with longer lists and more trees.  If
the last search falls short too, all vectors are compared with all.

Equal vectors are one node with a count from the start, so a vector that fills a
third of the table costs one node.  The forest's medians come from a bounded
sample (``fit``); every vector is indexed.

Edge cases: null vectors, zero vectors and vectors with null or non-finite
components link with nothing, like rows with a null id; only vectors of one
length are compared; repeated rows are vectors like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colophon.llm.components import components
from colophon.llm.storage import drop_stored, partitions, stored

SLACK = 1e-3  # single-precision search keeps candidates this far below the threshold


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of length one in doubles; rows that cannot link are left out."""
    for batch in batches:
        batch = batch.filter(pc.and_(batch.column(0).is_valid(), pc.greater(pc.fill_null(pc.list_value_length(batch.column(1)), 0), 0)))
        sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes):
            part = batch.filter(pa.array(sizes == dim))
            # A null component becomes NaN, which leaves its row out.
            u = part.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
            top = np.abs(u).max(1)
            keep = np.isfinite(top) & (top > 0)
            u = u[keep] / top[keep, None]
            u /= np.sqrt(np.einsum("ij,ij->i", u, u))[:, None]
            yield pa.record_batch({"vec": part.column(0).filter(pa.array(keep)), "dim": pa.array(np.full(len(u), dim, np.int32)), "u": pa.array([r.tobytes() for r in u], pa.binary())})


def _matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    if not n:
        return np.zeros((0, 0), kind)
    return np.frombuffer(b"".join(x.as_buffer() for x in column), kind).reshape(n, -1)


def _by_length(table: pa.Table, column: str) -> list[pa.Table]:
    sizes = pc.binary_length(table.column(column))
    return [table.filter(pc.equal(sizes, n)) for n in pc.unique(sizes)]


def _top(node: np.ndarray, nbr: np.ndarray, sim: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best distinct neighbours of each node."""
    order = np.lexsort((nbr, -sim, node))
    node, nbr, sim = node[order], nbr[order], sim[order]
    keep = np.concatenate([[True], (node[1:] != node[:-1]) | (nbr[1:] != nbr[:-1])]) if len(node) else np.zeros(0, bool)
    node, nbr, sim = node[keep], nbr[keep], sim[keep]
    start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, int)
    place = np.arange(len(node)) - np.repeat(start, np.diff(np.concatenate([start, [len(node)]])))
    pick = place < k
    return pa.record_batch({"node": pa.array(node[pick]), "nbr": pa.array(nbr[pick]), "sim": pa.array(sim[pick].astype(np.float32))})


EDGES = "node long, nbr long, sim float"


def _forest(trees: int, planes: dict):
    """Leaf of every vector in every tree. ``planes``: by dimension, normals and medians."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = planes.value
        for batch in batches:
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = _matrix(part.column(2)).astype(np.float32)
                normals, medians = model[int(dim)]
                depth = normals.shape[1]
                for t in range(trees):
                    bits = (x @ normals[t].T) > medians[t] if depth else np.zeros((len(x), 0), bool)
                    leaf = bits.astype(np.int64) @ (np.int64(1) << np.arange(depth, dtype=np.int64)) if depth else np.zeros(len(x), np.int64)
                    yield pa.record_batch({"node": part.column(0), "dim": part.column(1), "x": pa.array([r.tobytes() for r in x], pa.binary()), "tree": pa.array(np.full(len(x), t, np.int32)), "leaf": pa.array(leaf)})

    return run


def _leaf_neighbours(k: int):
    def run(table: pa.Table) -> pa.Table:
        x, node = _matrix(table.column("x"), np.float32), table.column("node").to_numpy()
        if len(node) < 2:
            return pa.table({"node": pa.array([], pa.int64()), "nbr": pa.array([], pa.int64()), "sim": pa.array([], pa.float32())})
        s = x @ x.T
        np.fill_diagonal(s, -2)
        few = min(k, len(node) - 1)
        best = np.argpartition(-s, few - 1, axis=1)[:, :few]
        return pa.table({"node": pa.array(np.repeat(node, few)), "nbr": pa.array(node[best].ravel()), "sim": pa.array(np.take_along_axis(s, best, 1).ravel().astype(np.float32))})

    return run


def _merge(k: int):
    """Best lists of each node; input is dealt and sorted by node, so a node never spans two partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if rest is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(rest, cols)]
            if not len(cols[0]):
                continue
            cut = len(cols[0]) - int((cols[0] == cols[0][-1]).sum())
            rest = [c[cut:] for c in cols]
            if cut:
                yield _top(*[c[:cut] for c in cols], k)
        if rest is not None:
            yield _top(*rest, k)

    return run


def merged(edges: DataFrame, k: int) -> DataFrame:
    return edges.repartition(partitions(edges.sparkSession), "node").sortWithinPartitions("node").mapInArrow(_merge(k), EDGES)


def _meet(k: int):
    """At each pivot, all its members meet; a pair is emitted for each side whose list it improves, at most ``k`` per side and batch."""

    def pairs(table: pa.Table) -> pa.RecordBatch:
        pivot, node, low = (table.column(c).to_numpy() for c in ("pivot", "node", "low"))
        x = _matrix(table.column("x"), np.float32)  # lists never mix dimensions, and parts are cut by dimension
        cuts = np.flatnonzero(np.concatenate([[True], pivot[1:] != pivot[:-1]]))
        out = []
        for lo, hi in zip(cuts, [*cuts[1:], len(pivot)]):
            if hi - lo > 1:
                s = x[lo:hi] @ x[lo:hi].T
                np.fill_diagonal(s, -2)
                a, b = np.nonzero(s > low[lo:hi, None])
                out.append((node[lo:hi][a], node[lo:hi][b], s[a, b]))
        if not out:
            return _top(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), 1)
        a, b, s = (np.concatenate([o[i] for o in out]) for i in range(3))
        return _top(a, b, s, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            if not table.num_rows:
                continue
            pivot = table.column("pivot").to_numpy()
            cut = len(pivot) - int((pivot == pivot[-1]).sum())
            rest = table.slice(cut)
            if cut:
                yield from (pairs(t) for t in _by_length(table.slice(0, cut), "x"))
        if rest is not None and rest.num_rows:
            yield from (pairs(t) for t in _by_length(rest, "x"))

    return run


def descend(nodes: DataFrame, edges: DataFrame, k: int, seed: int) -> DataFrame:
    """One round: members of a pivot are its own list and at most k of those that list it, by a hash."""
    full = edges.groupBy("node").agg(F.min("sim").alias("low"), F.count("*").alias("n")).select("node", F.when(F.col("n") >= k, F.col("low")).otherwise(-2.0).cast("float").alias("low"))
    order = Window.partitionBy("nbr").orderBy(F.xxhash64(F.lit(seed), "node"))
    back = edges.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k).select(F.col("nbr").alias("pivot"), "node")
    own = edges.select(F.col("node").alias("pivot"), F.col("nbr").alias("node"))
    itself = nodes.select(F.col("node").alias("pivot"), "node")
    members = own.union(back).union(itself).distinct()
    carried = nodes.select("node", "x").join(full, "node", "left").select("node", "x", F.coalesce("low", F.lit(-2.0)).cast("float").alias("low"))
    met = members.join(carried, "node").select("pivot", "node", "low", "x").repartition(partitions(nodes.sparkSession), "pivot").sortWithinPartitions("pivot")
    return merged(edges.select("node", "nbr", "sim").union(met.mapInArrow(_meet(k), EDGES)), k)


def _saturated(edges: DataFrame, k: int, threshold: float) -> DataFrame:
    """Nodes whose list has ``k`` entries that all may be links."""
    return edges.groupBy("node").agg(F.min("sim").alias("low"), F.count("*").alias("n")).where((F.col("n") >= k) & (F.col("low") >= threshold - SLACK)).select("node")


def _widened(nodes: DataFrame, edges: DataFrame, active: DataFrame, k: int, threshold: float, seed: int) -> DataFrame:
    """One round for the ``active`` nodes: at their neighbours, they meet neighbours of neighbours, and keep the ``k`` best possible links."""
    mine = edges.join(active, "node", "left_semi")
    pivots = mine.select(F.col("nbr").alias("pivot")).union(active.select("node")).distinct()
    order = Window.partitionBy("nbr").orderBy(F.xxhash64(F.lit(seed), "node"))
    back = edges.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k).select(F.col("nbr").alias("pivot"), "node")
    members = edges.select(F.col("node").alias("pivot"), F.col("nbr").alias("node")).union(back).union(pivots.select("pivot", F.col("pivot").alias("node")))
    members = members.join(pivots, "pivot", "left_semi").distinct()
    # No similarity is above 2: the others are met, and seek nothing.
    low = F.when(F.col("active"), F.lit(threshold - SLACK)).otherwise(2.0).cast("float")
    carried = nodes.select("node", "x").join(active.withColumn("active", F.lit(True)), "node", "left").select("node", "x", low.alias("low"))
    met = members.join(carried, "node").select("pivot", "node", "low", "x").repartition("pivot").sortWithinPartitions("pivot")
    return merged(mine.select("node", "nbr", "sim").union(met.mapInArrow(_meet(k), EDGES)), k).union(edges.join(active, "node", "left_anti").select("node", "nbr", "sim"))


def enlarged(nodes: DataFrame, edges: DataFrame, k: int, longest: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``edges`` with the lists of saturated nodes enlarged, and the nodes that are saturated still."""
    active, n = stored(_saturated(edges, k, threshold), "active"), edges.count()
    while k < longest and not active.isEmpty():
        k = min(4 * k, longest)
        for r in range(2):
            new = stored(_widened(nodes, edges, active, k, threshold, 100 * k + r), "edges")
            drop_stored(edges)
            edges, before, n = new, n, new.count()
            if n == before:
                break
        still = stored(_saturated(edges.join(active, "node", "left_semi"), k, threshold), "active")
        drop_stored(active)
        active = still
    return edges, active


def _exact(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_length(pa.Table.from_batches([batch]), "x"):
                s = np.einsum("ij,ij->i", _matrix(part.column("x")), _matrix(part.column("y")))
                kept = part.filter(pa.array(s >= threshold)).select(["a", "b"]).combine_chunks()
                yield from kept.to_batches()

    return run


def _block_counts(threshold: float):
    """Saturated rows of side 0 against all of side 1: weighted numbers of links of both, and the pairs of components that links join."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        rows, cols = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        if not rows.num_rows or not cols.num_rows:
            rows = cols = table.slice(0, 0)
        node, other = rows.column("node").to_numpy(), cols.column("node").to_numpy()
        hit = (_matrix(rows.column("u")) @ _matrix(cols.column("u")).T >= threshold) if len(node) else np.zeros((0, 0), bool)
        hit &= node[:, None] != other[None, :]
        weight = lambda part: part.column("m").to_numpy().astype(np.float64)
        rest = ~cols.column("full").to_numpy(zero_copy_only=False).astype(bool)  # the others are rows of their own
        n = np.concatenate([hit @ weight(cols), (weight(rows) @ hit)[rest]]).astype(np.int64)
        ends = np.concatenate([node, other[rest]])
        mine, its = rows.column("component").to_numpy(), cols.column("component").to_numpy()
        i, j = np.nonzero(hit & (mine[:, None] != its[None, :]))
        joined = np.unique(np.stack([mine[i], its[j]], 1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
        ends, n = ends[n > 0], n[n > 0]
        return pa.table({
            "node": pa.array(np.concatenate([ends, joined[:, 0]]), pa.int64()),
            "n": pa.array(np.concatenate([n, np.zeros(len(joined), np.int64)]), pa.int64()),
            "to": pa.concat_arrays([pa.nulls(len(ends), pa.int64()), pa.array(joined[:, 1], pa.int64())]),
        })

    return run


def _settled(nodes: DataFrame, links: DataFrame, groups: DataFrame, full: DataFrame, threshold: float, block: int) -> DataFrame:
    """``node``, ``component``, ``n``: all links of the ``full`` nodes by comparison with all nodes, those between other nodes from ``links``."""
    spark = nodes.sparkSession
    every = nodes.select("node", "dim", "m", "u").join(groups, "node", "left").join(full.select("node", F.lit(True).alias("full")), "node", "left")
    every = stored(every.withColumn("component", F.coalesce("component", "node")).withColumn("full", F.coalesce("full", F.lit(False))), "every")
    sizes = every.groupBy("dim").agg(F.count_if("full").alias("few"), F.count("*").alias("all")).collect()  # one row per vector length
    tiles = spark.createDataFrame([(r["dim"], -(-r["few"] // block), -(-r["all"] // block)) for r in sizes], "dim int, is int, js int")
    cut = every.join(F.broadcast(tiles.where("`is` > 0")), "dim").withColumn("h", F.xxhash64("node"))
    names = ["dim", "node", "m", "u", "component", "full"]
    rows = cut.where("full").select(*names, F.pmod("h", F.col("is")).cast("int").alias("i"), F.explode(F.expr("sequence(0, js - 1)")).alias("j"), F.lit(0).alias("side"))
    cols = cut.select(*names, F.explode(F.expr("sequence(0, `is` - 1)")).alias("i"), F.pmod("h", F.col("js")).cast("int").alias("j"), F.lit(1).alias("side"))
    found = stored(rows.union(cols).groupBy("dim", "i", "j").applyInArrow(_block_counts(threshold), "node long, n long, to long"), "found")
    counted = found.where("to IS NULL").groupBy("node").agg(F.sum("n").alias("n"))
    both = links.union(links.select("b", "a")).distinct().join(full.select(F.col("node").alias("a")), "a", "left_anti")
    listed = both.join(every.where("NOT full").select(F.col("node").alias("b"), "m"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("m").alias("k"))
    merged_ = components(found.where("to IS NOT NULL").select(F.col("node").alias("a"), F.col("to").alias("b")).distinct())
    merged_ = merged_.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    known = every.select("node", "component").join(merged_, "component", "left").join(listed, "node", "left").join(counted, "node", "left")
    return stored(known.select("node", F.coalesce("whole", "component").alias("component"), (F.coalesce("n", F.lit(0)) + F.coalesce("k", F.lit(0))).alias("n")), "known")


def _audit(threshold: float, asked: np.ndarray, units: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked), dtype=np.int64)
        for batch in batches:
            node, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
            same = [k for k, x in enumerate(batch.column(1)) if len(x.as_buffer()) == units.shape[1] * 8]
            if same:
                u = _matrix(batch.column(1).take(pa.array(same)))
                hit = (u @ units.T >= threshold) & (node[same][:, None] != asked[None, :])
                total += (hit * m[same][:, None]).sum(0).astype(np.int64)
        yield pa.record_batch({"node": pa.array(asked), "n": pa.array(total)})

    return run


def near_vectors(
    vectors: DataFrame, *, threshold: float = 0.9, k: int = 8, longest: int = 32, trees: int = 8, leaf: int = 200, rounds: int = 4, fit: int = 8192, audit: int = 256, least_recall: float = 0.97, block: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``id_col``, ``n_links``, ``component_id``, ``kept``, ``audit_recall`` (a number of the whole run)."""
    spark = vectors.sparkSession
    sc, parts = spark.sparkContext, partitions(spark)
    plain = vectors.select(F.col(id_col).cast("long").alias("vec"), F.col(vector_col).alias("v"))
    units = stored(plain.repartition(parts).mapInArrow(_units, "vec long, dim int, u binary").withColumn("key", F.md5("u")), "units")
    classes = units.groupBy("key", "dim").agg(F.min("vec").alias("node"), F.count("*").alias("m"), F.first("u").alias("u"))
    nodes = stored(classes.select("node", "dim", "m", "key", "u"), "nodes")
    single = nodes.mapInArrow(_single, "node long, dim int, x binary")
    single = stored(single, "single")
    sizes = {r["dim"]: r["n"] for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row per vector length
    if not sizes:
        return plain.select(F.col("vec").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("vec").alias("component_id"), F.col("vec").isNotNull().alias("kept"), F.lit(1.0).alias("audit_recall"))
    asked = nodes.orderBy(F.xxhash64(F.lit(77), "node")).limit(audit).select("node", "m", "u", "dim").collect()
    for attempt in range(3):
        planes = {}
        for dim, n in sizes.items():
            depth = min(30, max(0, int(np.ceil(np.log2(max(n, 1) / leaf)))))
            rng = np.random.default_rng(1000 * attempt + dim)
            normals = rng.standard_normal((trees, depth, dim)).astype(np.float32)
            few = nodes.where(F.col("dim") == dim).orderBy(F.xxhash64(F.lit(attempt), "node")).limit(fit).select("u").collect()
            sample = np.frombuffer(b"".join(bytes(r["u"]) for r in few)).reshape(len(few), -1).astype(np.float32)
            planes[int(dim)] = (normals, np.median(sample @ normals.reshape(-1, dim).T, axis=0).reshape(trees, depth) if depth else np.zeros((trees, 0)))
        placed = nodes.select("node", "dim", "u").mapInArrow(_forest(trees, sc.broadcast(planes)), "node long, dim int, x binary, tree int, leaf long")
        counts = placed.groupBy("tree", "dim", "leaf").agg(F.count("*").alias("n"))
        # A leaf with too many vectors is dealt out at random into groups of about twice the aim.
        salted = placed.join(counts, ["tree", "dim", "leaf"]).withColumn("salt", F.pmod(F.xxhash64(F.lit(5), "tree", "node"), F.ceil(F.col("n") / (2 * leaf))).cast("int"))
        first = salted.select("node", "x", "tree", "dim", "leaf", "salt").groupBy("tree", "dim", "leaf", "salt").applyInArrow(_leaf_neighbours(k), EDGES)
        edges = stored(merged(first, k), "edges")
        for r in range(rounds):
            new = stored(descend(single, edges, k, r), "edges")
            fresh = new.join(edges.select("node", "nbr"), ["node", "nbr"], "left_anti").count()
            drop_stored(edges)
            edges = new
            if fresh <= 0.002 * k * sum(sizes.values()):
                break
        edges, full = enlarged(single, edges, k, longest, threshold)
        near = edges.where(F.col("sim") >= threshold - SLACK)
        pairs = near.select(F.least("node", "nbr").alias("a"), F.greatest("node", "nbr").alias("b")).distinct()
        ends = nodes.select("node", "u")
        double = pairs.join(ends.select(F.col("node").alias("a"), F.col("u").alias("x")), "a").join(ends.select(F.col("node").alias("b"), F.col("u").alias("y")), "b").select("a", "b", "x", "y")
        links = stored(double.mapInArrow(_exact(threshold), "a long, b long"), "links")
        groups = stored(components(links), "groups")
        known = _settled(nodes, links, groups, full, threshold, block)
        recall = _recall(known, nodes, asked, threshold)
        if recall >= least_recall:
            break
        if attempt == 2:
            known = _settled(nodes, links, groups, nodes.select("node"), threshold, block)
            recall = _recall(known, nodes, asked, threshold)
        k, trees = 2 * k, 2 * trees
    per_node = nodes.join(known, "node", "left").select("key", "dim", F.coalesce("component", "node").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    found = units.select("vec", "key", "dim").join(per_node, ["key", "dim"]).select("vec", "n_links", "component")
    valid = found.groupBy("vec").agg(F.min("component").alias("component"), F.max("n_links").alias("n_links"))
    out = plain.select("vec").join(valid, "vec", "left")
    component = F.coalesce("component", "vec")
    return out.select(F.col("vec").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec") == component, F.lit(False)).alias("kept"), F.lit(float(recall)).alias("audit_recall"))


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [np.frombuffer(u.as_buffer()).astype(np.float32).tobytes() for u in batch.column(4)]
        yield pa.record_batch({"node": batch.column(0), "dim": batch.column(1), "x": pa.array(x, pa.binary())})


def _recall(known: DataFrame, nodes: DataFrame, asked: list, threshold: float) -> float:
    """Share of the asked vectors' true links that were found, over all or as the mean of each, whichever is less; 1 if they have none."""
    true, found = {}, {}
    for dim in {r["dim"] for r in asked}:
        few = [r for r in asked if r["dim"] == dim]
        ids, units = np.array([r["node"] for r in few], dtype=np.int64), np.stack([np.frombuffer(bytes(r["u"])) for r in few])
        for r in nodes.select("node", "u", "m").mapInArrow(_audit(threshold, ids, units), "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).collect():
            true[r["node"]] = r["n"]
    for r in known.where(F.col("node").isin([r["node"] for r in asked])).collect():  # as many rows as asked at most
        found[r["node"]] = r["n"]
    each = [(min(found.get(x, 0), n), n) for x, n in true.items() if n]
    return float(min(sum(f for f, _ in each) / sum(n for _, n in each), np.mean([f / n for f, n in each]))) if each else 1.0
