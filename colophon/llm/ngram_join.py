"""Similarity self-join on word n-grams: which documents' shingle sets have Jaccard >= a threshold.

Rare-first prefix filtering.  All sets are ordered by one global order, the
document frequency of the shingle's hash cell (counted over every document),
then the hash.  Two sets that reach the threshold share a shingle within their
prefixes, so only prefixes are dealt out by shingle; length and positional
filters drop pairs that cannot reach it, a suffix filter bounds what is left,
and every pair that remains is verified once, on whole sets.

Components need no more links than connect them, so pairs come in rounds.  In
the first ones a list's members meet its leader, picked by a hash that changes
with the round, and each component proposes one pair: the member and leader that
meet in most lists.  So a round has no more pairs than components.  What is left
is compared exactly: in every list whose members are in different components,
those outside its largest component meet all others, in tiles of a bounded size.
Sketches are compared there, in the task, so a pair leaves it only if it may
link: first the one of each two components whose sketches leave most room, then
all that are still between components.  No link between components can be
missed, and a group of near copies costs some comparisons per copy instead of one
per pair.

Documents with equal sets are one node from the start, named by a 64-bit hash
of the set; shingles are compared by 64-bit hashes.

Data that tasks get besides their rows: the frequency cells and a bitmap of
candidate ids, both of a fixed size.  Coarse cells or a full bitmap cost time,
never a link.  The list of a shingle that more than ``HEAVY`` sets may have is
dealt in slices; copies of one set are counted before anything meets them.

Edge cases: null or wordless texts have no shingles and link with nothing;
fewer words than the width make one shingle; a null id gets a null component and
links nothing; repeated rows are repeated in the result; empty tables give empty
results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colophon.llm.components import components
from colophon.llm.storage import drop_stored, fresh, named, stored
from colophon.llm.textblocks import mix64, shingle_hashes, slices, sorted_sets, text_view, word_hashes, words

CELLS, CHUNK = 1 << 20, 1 << 14
#: Prefix entries that a task holds before it deals them out, about a hundred bytes each while it does.
FLUSH = 500_000
#: A bucket's lists are made in so many parts, a power of two, one after the other from its packed rows.
PARTS = 4
BITS = 1 << 24
#: Bits of the smallest and the largest sketch; in between, twice the set's size.
SKETCH = (1 << 8, 1 << 15)
ROUNDS = 6
#: Sets in one slice of a shingle's list, and in one side of a tile.
HEAVY, TILE = 1 << 20, 1 << 9
#: Lists of at most so many sets are compared at once, one distance after the other.
SHORT = 32


def shingle_sets(batch: pa.RecordBatch, text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    raw, at = text_view(batch.column(batch.schema.get_field_index(text)))
    start, end, first = words(raw, at)
    return sorted_sets(*shingle_hashes(word_hashes(raw, start, end), first, width))


def set_keys(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name for each set, from a sum that doesn't depend on order; 0 for the empty set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(values ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    n = np.diff(at)
    keys = mix64((sums[at[1:]] - sums[at[:-1]]) ^ n.astype(np.uint64))
    keys[n == 0] = 0
    return keys.view(np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    return zlib.compress(b"".join(a.tobytes() for a in arrays), 1)


def _measure(width: int):
    """Size and name of every set; at the end, this task's shingle counts by hash cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                values, at = shingle_sets(part, "text", width)
                counts += np.bincount((values >> np.uint64(44)).astype(np.int64), minlength=CELLS)
                n = part.num_rows
                sketches = pa.array(parity_sketches(values, at), pa.binary())
                yield pa.record_batch({"doc": part.column(0), "n": pa.array(np.diff(at)), "node": pa.array(set_keys(values, at)), "sketch": sketches, "chunk": pa.nulls(n, pa.int32()), "counts": pa.nulls(n, pa.binary())})
        used = [k for k in range(CELLS // CHUNK) if counts[k * CHUNK : (k + 1) * CHUNK].any()]
        if used:
            n = len(used)
            packed = [_pack(counts[k * CHUNK : (k + 1) * CHUNK]) for k in used]
            yield pa.record_batch({"doc": pa.nulls(n, pa.int64()), "n": pa.nulls(n, pa.int64()), "node": pa.nulls(n, pa.int64()), "sketch": pa.nulls(n, pa.binary()), "chunk": pa.array(used, pa.int32()), "counts": pa.array(packed, pa.binary())})

    return run


def _add_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts = np.frombuffer(zlib.decompress(packed.as_py()), np.int64)
            total[k] = total[k] + counts if k in total else counts
    if total:
        yield pa.record_batch({"chunk": pa.array(list(total), pa.int32()), "counts": pa.array([x.tobytes() for x in total.values()], pa.binary())})


def cell_frequencies(measured: DataFrame) -> np.ndarray:
    """Summed counts of all tasks: CELLS numbers, whatever the corpus."""
    rows = measured.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(_add_chunks, "chunk int, counts binary").collect()
    out = np.zeros(CELLS, dtype=np.int64)
    for r in rows:
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.int64)
    return np.minimum(out, (1 << 31) - 1).astype(np.int32)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of a set's rarest members must hold a common one: n - ceil(t * n) + 1."""
    return np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The overlap from which J >= t: ceil(t / (1 + t) * (n + m))."""
    whole = 100 + percent
    return (percent * (n + m) + whole - 1) // whole


def _slices(frequency: np.ndarray) -> np.ndarray:
    """Into how many slices a shingle's list is cut, by the count of its cell."""
    return np.maximum(1, -(-frequency.astype(np.int64) // HEAVY))


def _deal(width: int, percent: int, buckets: int, frequencies):
    """Prefixes, dealt by shingle: one packed row per bucket and flush (sets that a flush has twice come once)."""

    def flush(docs: list, tokens: list, places: list) -> pa.RecordBatch:
        node, n = np.concatenate([d[0] for d in docs]), np.concatenate([d[1] for d in docs])
        size = prefix_length(n, percent)
        token, place = np.concatenate(tokens), np.concatenate(places)
        owner = np.repeat(np.arange(len(node)), size)
        _, kept = np.unique(node, return_index=True)
        mask = np.zeros(len(node), dtype=bool)
        mask[kept] = True
        pick = mask[owner]
        token, place, owner = token[pick], place[pick], owner[pick]
        cut = _slices(frequencies.value[(token >> np.uint64(44)).astype(np.int64)]).astype(np.uint64)
        slot = mix64(node.view(np.uint64))[owner] % cut
        bucket = (mix64(token + slot * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        out_k, out_b = [], []
        for k in range(buckets):
            part = order[cuts[k] : cuts[k + 1]]
            if len(part):
                o = owner[part]
                lead = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
                each = np.diff(np.concatenate([lead, [len(o)]]))
                head = np.array([len(lead), len(o)], np.int64)
                out_k.append(k)
                out_b.append(_pack(head, node[o[lead]], n[o[lead]].astype(np.int32), each.astype(np.int32), token[part], place[part].astype(np.int32)))
        return pa.record_batch({"bucket": pa.array(out_k, pa.int32()), "packed": pa.array(out_b, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = frequencies.value
        docs, tokens, places, held = [], [], [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                values, at = shingle_sets(part, "text", width)
                n = np.diff(at)
                size = prefix_length(n, percent)
                docs.append((set_keys(values, at), n))
                rank = cells[(values >> np.uint64(44)).astype(np.int64)]
                for d in range(len(n)):
                    lo, hi, p = at[d], at[d + 1], size[d]
                    if p:
                        f = rank[lo:hi]
                        # Values ascend, so a stable sort by frequency gives the global order (frequency, hash).
                        tokens.append(values[lo:hi][np.argsort(f, kind="stable")[:p]])
                        places.append(np.arange(p))
                held += int(size.sum())
                if held >= FLUSH:
                    yield flush(docs, tokens, places)
                    docs, tokens, places, held = [], [], [], 0
        if held:
            yield flush(docs, tokens, places)

    return run


def _unpack(packed: bytes) -> tuple[np.ndarray, ...]:
    raw = zlib.decompress(packed)
    d, p = np.frombuffer(raw, np.int64, 2)
    at, out = 16, []
    for kind, count in ((np.int64, d), (np.int32, d), (np.int32, d), (np.uint64, p), (np.int32, p)):
        out.append(np.frombuffer(raw, kind, count, at))
        at += out[-1].nbytes
    node, n, each, token, place = out
    return token, np.repeat(node, each), np.repeat(n, each), place


def _fitting(token: np.ndarray, n: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """Which entries of a contiguous list may link with another one by length and place; all of those of a long list."""
    heads = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    sizes = np.diff(np.concatenate([heads, [len(token)]]))
    own = np.repeat(sizes, sizes)
    out = own > SHORT
    short = np.flatnonzero(~out)
    for d in range(1, SHORT):
        x = short[short < len(token) - d]
        x = x[token[x] == token[x + d]]
        if not len(x):
            break
        x = x[_may_link(n[x], place[x], n[x + d], place[x + d], percent)]
        out[x] = out[x + d] = True
    return out


def _lists(percent: int, frequencies):
    """Entries of the shingles that two or more sets have in their prefixes, if their lengths and places let them link.

    ``cut``: the slices of the shingle's list.  A task keeps its bucket's rows packed and unpacks one part of the shingles at a time.
    """

    def part_of(packed: list[pa.Scalar], turn: int) -> Iterator[pa.RecordBatch]:
        parts = []
        for x in packed:
            entries = _unpack(x.as_py())
            # Buckets are remainders of the same hash; its highest bits don't depend on them.
            mine = mix64(entries[0]) >> np.uint64(65 - PARTS.bit_length()) == turn
            parts.append([c[mine] for c in entries])
        token, node, n, place = (np.concatenate([p[k] for p in parts]) for k in range(4))
        del parts
        order = np.argsort(token, kind="stable")
        t = token[order]
        cut = _slices(frequencies.value[(t >> np.uint64(44)).astype(np.int64)])
        same = t[1:] == t[:-1]
        # Of a sliced list others may have the rest.
        order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]]) | (cut > 1)]
        token, node, n, place = token[order], node[order], n[order], place[order]
        order = np.lexsort((node, token))
        token, node, n, place = token[order], node[order], n[order], place[order]
        if not len(token):
            return
        # One entry per set: copies may have come in different flushes.
        keep = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])])
        token, node, n, place = token[keep], node[keep], n[keep], place[keep]
        cut = _slices(frequencies.value[(token >> np.uint64(44)).astype(np.int64)])
        shared = _fitting(token, n.astype(np.int64), place.astype(np.int64), percent) | (cut > 1)
        token = token.view(np.int64)
        for lo in range(0, len(token), 100_000):
            pick = np.flatnonzero(shared[lo : lo + 100_000]) + lo
            if len(pick):
                yield pa.record_batch({"token": pa.array(token[pick]), "node": pa.array(node[pick]), "n": pa.array(n[pick]), "place": pa.array(place[pick]), "cut": pa.array(cut[pick].astype(np.int32))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = [x for batch in batches for x in batch.column(1)]
        for turn in range(PARTS if packed else 0):
            yield from part_of(packed, turn)

    return run


def _may_link(n, i, m, j, percent):
    """Length and positional filter for a pair that meets at places i and j of its prefixes."""
    fits = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    return fits & (1 + np.minimum(n - i - 1, m - j - 1) >= least_overlap(n, m, percent))


def _stars(percent: int, turn: int):
    """Every member of a list and its leader, which a hash that changes with ``turn`` picks, if they are in different components.

    ``hits``: in how many lists of the batch they meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None  # of the list that may go on in the next batch
        for batch in batches:
            block = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)]
            if not len(block[0]):
                continue
            if lead is not None:
                block = [np.concatenate([x[None], y]) for x, y in zip(lead, block)]
            token, node, n, place, component = block
            priority = mix64(node.view(np.uint64) ^ np.uint64(0xA0761D6478BD642F * (turn + 1) % (1 << 64)))
            order = np.lexsort((priority, token))
            t = token[order]
            head = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            leader = order[np.repeat(head, np.diff(np.concatenate([head, [len(t)]])))]
            last = np.flatnonzero(token == token[-1])
            lead = [x[last[np.argmin(priority[last])]] for x in block]
            fit = (component[leader] != component[order]) & _may_link(n[leader], place[leader], n[order], place[order], percent)
            member, leader = order[fit], leader[fit]
            if not len(member):
                continue
            by = np.lexsort((node[leader], node[member]))
            a, b = node[member][by], node[leader][by]
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            hits = np.diff(np.concatenate([first, [len(a)]]))
            yield pa.record_batch({"a": pa.array(a[first]), "b": pa.array(b[first]), "ca": pa.array(component[member][by][first]), "cb": pa.array(component[leader][by][first]), "hits": pa.array(hits)})

    return run


class Sketches:
    """A batch's sketches by size, whole and folded once."""

    def __init__(self, column: pa.Array):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        sizes = np.array([len(x.as_buffer()) for x in column], dtype=np.int64)
        self.size, self.row, self.whole, self.half = sizes, np.zeros(len(sizes), dtype=np.int64), {}, {}
        for size in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == size)
            self.row[mine] = np.arange(len(mine))
            words = np.frombuffer(b"".join([column[k].as_buffer() for k in mine.tolist()]), np.uint64).reshape(len(mine), -1)
            self.whole[size] = words
            self.half[size] = words[:, : words.shape[1] // 2] ^ words[:, words.shape[1] // 2 :]

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """In how many bits the sketches of rows ``x`` and ``y`` differ: at most so many members the sets differ in."""
        swap = self.size[x] > self.size[y]
        small, large = np.where(swap, y, x), np.where(swap, x, y)
        out = np.zeros(len(x), dtype=np.int64)
        for size in self.whole:
            for table, wanted in ((self.whole, size), (self.half, 2 * size)):
                pick = np.flatnonzero((self.size[small] == size) & (self.size[large] == wanted))
                for lo in range(0, len(pick), 8192) if wanted in table else ():
                    part = pick[lo : lo + 8192]
                    out[part] = np.bitwise_count(self.whole[size][self.row[small[part]]] ^ table[wanted][self.row[large[part]]]).sum(1, dtype=np.int64)
        return out  # sets whose sizes differ by more don't link by their lengths


def _tile_pairs(group: np.ndarray, role: np.ndarray, component: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of a row and a column of one tile that are in different components; tiles are contiguous."""
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.concatenate([heads, [len(group)]]))
    own = np.repeat(sizes, sizes)
    meets = lambda x, y: (component[x] != component[y]) & (((role[x] & 1) & (role[y] >> 1)) | ((role[y] & 1) & (role[x] >> 1))).astype(bool)
    short = np.flatnonzero(own <= SHORT)
    for d in range(1, SHORT):
        x = short[short < len(group) - d]
        x = x[group[x] == group[x + d]]
        if not len(x):
            break
        x = x[meets(x, x + d)]
        if len(x):
            yield x, x + d
    for lo, size in zip(heads.tolist(), sizes.tolist()):
        if size > SHORT:
            rows = np.flatnonzero(role[lo : lo + size] & 1) + lo
            every = np.arange(lo, lo + size)
            for k in range(0, len(rows), 64):
                x, y = rows[k : k + 64, None], every[None, :]
                i, j = np.nonzero(meets(x, y) & ((x < y) | (role[y] & 1 == 0)))
                if len(i):
                    yield rows[k : k + 64][i], every[j]


def _cross(percent: int, every: bool):
    """Pairs of a tile in different components that lengths, places and sketches leave room for.

    All of them, or of each two components the pair whose sketches leave most room.
    """

    def tiles(table: pa.Table) -> Iterator[pa.RecordBatch]:
        token, i, j, node, n, place, component, role = (table.column(k).to_numpy().astype(np.int64) for k in range(8))
        group = np.cumsum(np.concatenate([[0], (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        sketches = Sketches(table.column(8))
        got, held = [], 0
        for x, y in _tile_pairs(group, role, component):
            fit = _may_link(n[x], place[x], n[y], place[y], percent)
            x, y = x[fit], y[fit]
            room = (n[x] + n[y] - sketches.apart(x, y)) // 2 - least_overlap(n[x], n[y], percent)
            x, y, room = x[room >= 0], y[room >= 0], room[room >= 0]
            if len(x):
                swap = component[x] > component[y]
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                got.append(np.stack([component[x], component[y], -room, node[x], node[y]], 1))
                held += len(x)
            if held >= 100_000:
                got = [_reduced(got, every)]
                if every or len(got[0]) >= 50_000:
                    yield _links(got[0])
                    got = []
                held = len(got[0]) if got else 0
        if got:
            yield _links(_reduced(got, every))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            if not table.num_rows:
                continue
            # The last tile may go on in the next batch; tiles are contiguous, and their size is bounded.
            key = [table.column(k).to_numpy() for k in range(3)]
            cut = table.num_rows - int(((key[0] == key[0][-1]) & (key[1] == key[1][-1]) & (key[2] == key[2][-1])).sum())
            rest = table.slice(cut)
            if cut:
                yield from tiles(table.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield from tiles(rest)

    return run


def _reduced(got: list[np.ndarray], every: bool) -> np.ndarray:
    """Distinct rows, or of each two components the one with most room."""
    rows = np.unique(np.concatenate(got), axis=0)
    return rows if every else rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])]


def _links(rows: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"a": pa.array(rows[:, 3]), "b": pa.array(rows[:, 4]), "ca": pa.array(rows[:, 0]), "cb": pa.array(rows[:, 1]), "room": pa.array(-rows[:, 2])})


def _bit(ids: np.ndarray) -> np.ndarray:
    return (mix64(ids.view(np.uint64)) % np.uint64(BITS)).astype(np.int64)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(BITS, dtype=bool)
    for batch in batches:
        bits[_bit(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))] = True
    if bits.any():
        packed = np.packbits(bits).reshape(64, -1)
        used = [k for k in range(64) if packed[k].any()]
        yield pa.record_batch({"chunk": pa.array(used, pa.int32()), "bits": pa.array([zlib.compress(packed[k].tobytes(), 1) for k in used], pa.binary())})


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
            bits = np.frombuffer(zlib.decompress(packed.as_py()), np.uint8)
            total[k] = total[k] | bits if k in total else bits
    if total:
        yield pa.record_batch({"chunk": pa.array(list(total), pa.int32()), "bits": pa.array([x.tobytes() for x in total.values()], pa.binary())})


def id_bitmap(ids: DataFrame) -> np.ndarray:
    """BITS bits that are set for every id (and by chance for others): a prefilter of fixed size."""
    rows = ids.mapInArrow(_mark, "chunk int, bits binary").repartition("chunk").mapInArrow(_unite, "chunk int, bits binary").collect()
    out = np.zeros((64, BITS // 8 // 64), dtype=np.uint8)
    for r in rows:
        out[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _sets(width: int, bitmap):
    """Node and whole set (ascending hashes) of the documents whose id the bitmap has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            ids = batch.column(0)
            bit = _bit(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            hit = ((bits[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1).astype(bool) & ids.is_valid().to_numpy(zero_copy_only=False)
            if not hit.any():
                continue
            for part in slices(batch.filter(pa.array(hit)), "text"):
                values, at = shingle_sets(part, "text", width)
                offsets = pa.array(at * 8).buffers()[1]
                members = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, offsets, pa.py_buffer(values.tobytes())]).cast(pa.binary())
                yield pa.record_batch({"doc": part.column(0), "node": pa.array(set_keys(values, at)), "members": members})

    return run


def parity_sketches(values: np.ndarray, at: np.ndarray) -> list[bytes]:
    """One sketch per set; each member flips one bit of it. Two sets differ in at least as many members as their sketches in bits.

    Sizes are powers of two, and the halves of a sketch, one flipped by the
    other, are the sketch of half the size.
    """
    spot, out = mix64(values ^ np.uint64(0x2545F4914F6CDD1D)), []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        bits = min(SKETCH[1], max(SKETCH[0], 1 << max(2 * (hi - lo) - 1, 1).bit_length()))
        flips = np.bincount((spot[lo:hi] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(flips.astype(np.uint8)).tobytes())
    return out


def _close(percent: int):
    """Pairs whose sketches leave room for the overlap that they need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                k = part.num_rows
                n, m = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (4, 5))
                apart = Sketches(pa.concat_arrays([part.column(6), part.column(7)])).apart(np.arange(k), np.arange(k, 2 * k))
                yield part.select(["a", "b", "ca", "cb"]).filter(pa.array((n + m - apart) // 2 >= least_overlap(n, m, percent)))

    return run


def suffix_bound(x: np.ndarray, y: np.ndarray) -> int:
    """At most so many common members: both sets are cut at the same hashes and each part counts its shorter side."""
    at = np.linspace(0, 2**64 - 2**11, 9)[1:-1].astype(np.uint64)
    cx = np.diff(np.concatenate([[0], np.searchsorted(x, at), [len(x)]]))
    cy = np.diff(np.concatenate([[0], np.searchsorted(y, at), [len(y)]]))
    return int(np.minimum(cx, cy).sum())


def _verify(percent: int):
    """The pairs whose whole sets reach the threshold, and the size of their intersection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            overlap = np.full(batch.num_rows, -1, dtype=np.int64)
            for k, (left, right) in enumerate(zip(batch.column(4), batch.column(5))):
                x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                need = int(least_overlap(len(x), len(y), percent))
                if suffix_bound(x, y) >= need:
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    overlap[k] = common if common >= need else -1
            linked = pa.array(overlap >= 0)
            part = batch.select(["a", "b", "ca", "cb"]).filter(linked)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(overlap).filter(linked)], names=["a", "b", "ca", "cb", "overlap"])

    return run


_PAIRS = "a long, b long, ca long, cb long"


class Corpus:
    """What all rounds read: the documents, one row per distinct set, and the lists of shared rare shingles."""

    def __init__(self, docs: DataFrame, percent: int, width: int, id_col: str, text_col: str):
        sc = docs.sparkSession.sparkContext
        self.percent, self.width = percent, width
        self.plain = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
        self.measured = stored(self.plain.mapInArrow(_measure(width), "doc long, n long, node long, sketch binary, chunk int, counts binary"), "measured")
        frequencies = sc.broadcast(cell_frequencies(self.measured))
        # A row of counts has a chunk; a document has a size.
        self.nodes = self.measured.where("chunk is null").select("doc", "n", "node", "sketch")
        some = self.nodes.where("n > 0 and doc is not null")
        # Equal sets have equal sizes and sketches. Copies are counted together before the shuffle.
        self.sets = stored(some.groupBy("node").agg(F.min("doc").alias("doc"), F.min("n").alias("n"), F.min("sketch").alias("sketch")), "distinct")
        entries = self.nodes.agg(F.sum("n")).first()[0] or 0
        # A task holds one bucket of prefixes, about a million entries, packed, and a part of them as arrays.
        self.buckets = max(sc.defaultParallelism, int(entries * (100 - percent) // 100 // 1_000_000))
        dealt = self.plain.where("doc is not null").mapInArrow(_deal(width, percent, self.buckets, frequencies), "bucket int, packed binary").repartition(self.buckets, "bucket")
        self.lists = stored(dealt.mapInArrow(_lists(percent, frequencies), "token long, node long, n int, place int, cut int"), "lists")

    def told(self, known: DataFrame | None) -> DataFrame:
        """List entries with their component so far."""
        if known is None:
            return self.lists.withColumn("component", F.col("node"))
        return self.lists.join(known, "node", "left").withColumn("component", F.coalesce("component", "node")).select("token", "node", "n", "place", "cut", "component")

    def proposed(self, known: DataFrame | None, turn: int) -> DataFrame:
        """One pair per component at most: the member and leader that meet in most lists."""
        part = F.pmod(F.xxhash64(F.lit(turn), "node"), F.col("cut"))
        dealt = self.told(known).withColumn("part", part).repartition("token", "part").sortWithinPartitions("token", "part")
        met = dealt.select("token", "node", "n", "place", "component").mapInArrow(_stars(self.percent, turn), f"{_PAIRS}, hits long")
        met = met.groupBy("a", "b", "ca", "cb").agg(F.sum("hits").alias("hits"))
        best = met.groupBy("ca").agg(F.max_by(F.struct("a", "b", "cb"), F.struct("hits", F.xxhash64(F.lit(turn), "a", "b"))).alias("p"))
        return best.select("p.a", "p.b", "ca", "p.cb")

    def crossing(self, known: DataFrame | None, every: bool = True) -> DataFrame:
        """All pairs of lists that are in different components, but for those that lengths, places and sketches rule out.

        Without ``every``, of each two components the pair whose sketches leave most room.
        """
        told = self.told(known)
        sizes = told.groupBy("token", "component").agg(F.count("*").alias("c")).groupBy("token").agg(F.sum("c").alias("all"), F.max(F.struct("c", "component")).alias("top"), F.count("*").alias("k"))
        open_ = sizes.where("k > 1").select("token", F.col("top.component").alias("top"), F.ceil((F.col("all") - F.col("top.c")) / TILE).cast("int").alias("is"), F.ceil(F.col("all") / TILE).cast("int").alias("js"))
        at = told.join(open_, "token").withColumn("h", F.xxhash64(F.lit(3), "node"))
        at = at.withColumn("i", F.pmod("h", F.col("is")).cast("int")).withColumn("j", F.pmod(F.shiftright("h", 20), F.col("js")).cast("int")).withColumn("outside", F.col("component") != F.col("top"))
        # A member is a column of its own j for all rows; outside the largest component also a row of its own i for all columns.
        cell = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), role.alias("role"))
        one = F.array(cell(F.lit(0), F.lit(0), F.when(F.col("outside"), 3).otherwise(2)))
        columns = F.transform(F.sequence(F.lit(0), F.col("is") - 1), lambda i: cell(i, F.col("j"), F.when(F.col("outside") & (i == F.col("i")), 3).otherwise(2)))
        rows = F.filter(F.transform(F.sequence(F.lit(0), F.col("js") - 1), lambda j: cell(F.col("i"), j, F.lit(1))), lambda t: t["j"] != F.col("j"))
        tiles = F.when((F.col("is") == 1) & (F.col("js") == 1), one).when(F.col("outside"), F.concat(columns, rows)).otherwise(columns)
        cut = at.join(self.sets.select("node", "sketch"), "node").withColumn("t", F.explode(tiles)).select("token", "t.i", "t.j", "node", "n", "place", "component", "t.role", "sketch")
        found = cut.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(_cross(self.percent, every), f"{_PAIRS}, room long")
        if every:
            return found.drop("room").distinct()
        best = found.groupBy("ca", "cb").agg(F.max_by(F.struct("a", "b"), F.struct("room", "a", "b")).alias("p"))
        return best.select("p.a", "p.b", "ca", "cb")

    def close(self, pairs: DataFrame) -> DataFrame:
        """Pairs that their sketches leave room for."""
        side = lambda end, n, s: self.sets.select(F.col("node").alias(end), F.col("n").alias(n), F.col("sketch").alias(s))
        return pairs.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b").select("a", "b", "ca", "cb", "n", "m", "x", "y").mapInArrow(_close(self.percent), _PAIRS)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose whole sets reach the threshold, each compared once; ``pairs`` is a stored table.

        Sets are made again from the texts of one document per node that a pair
        names; of a pair, one set travels to the other.
        """
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        wanted = stored(self.sets.select("node", "doc").join(ends, "node", "left_semi"), "wanted")
        bitmap = pairs.sparkSession.sparkContext.broadcast(id_bitmap(wanted.select("doc")))
        made = self.plain.mapInArrow(_sets(self.width, bitmap), "doc long, node long, members binary")
        # Rows of one id may have different texts or be repeated.
        sets = stored(made.join(wanted, ["doc", "node"], "left_semi").dropDuplicates(["node"]), "sets")
        left, right = sets.select(F.col("node").alias("a"), F.col("members").alias("x")), sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
        met = pairs.join(left, "a").join(right, "b").select("a", "b", "ca", "cb", "x", "y")
        out = stored(met.mapInArrow(_verify(self.percent), f"{_PAIRS}, overlap long"), "links")
        drop_stored(sets, wanted)
        return out

    def drop(self) -> None:
        drop_stored(self.lists)


def _merged(known: DataFrame | None, links: DataFrame) -> DataFrame:
    """``known`` after the components ``ca`` and ``cb`` of every link are one."""
    new = components(links.select("ca", "cb"), "ca", "cb")
    if known is None:
        return stored(new, "known")
    moved = new.select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = known.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return stored(old.union(new.join(known, "node", "left_anti").select("node", "component")), "known")


def near_duplicates(docs: DataFrame, *, percent: int = 75, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_shingles`` and ``component_id``, the least id reachable by links."""
    corpus = Corpus(docs, percent, width, id_col, text_col)
    known = None

    def joined(found: DataFrame) -> int:
        """Verify the pairs, join the components of those that link, and return how many do."""
        nonlocal known
        pairs = stored(found, "pairs")
        links = corpus.verified(pairs)
        n, before = links.count(), known
        if n or known is None:
            known = _merged(known, links)
            drop_stored(*[x for x in (before,) if x is not None])
        drop_stored(pairs, links)
        return n

    total = 0
    for turn in range(ROUNDS):
        n = joined(corpus.close(corpus.proposed(known, turn)))
        total += n
        if 20 * n <= total:  # hardly any progress: what is left is for the comparison of sketches
            break
    joined(corpus.crossing(known, every=False))
    joined(corpus.crossing(known))
    corpus.drop()
    # From here on one row per distinct set, until the documents get the least id of their class.
    labelled = corpus.sets.select("node", "doc").join(known, "node", "left").select("node", "doc", F.coalesce("component", "node").alias("component"))
    least = labelled.groupBy("component").agg(F.min("doc").alias("least"))
    labelled = stored(labelled.join(least, "component").select("node", "least"), "named")
    out = corpus.nodes.select("doc", "n", "node").join(labelled, "node", "left")
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("least", "doc")).cast("long").alias("component_id"))


def similar_sets(docs: DataFrame, *, percent: int = 75, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links between distinct sets as (a, b, overlap, jaccard), and the members of each set as (id, node, n_shingles).

    ``a`` and ``b`` are names of sets; documents with equal sets link with each
    other and share their set's links, and are not listed in pairs.
    """
    corpus = Corpus(docs, percent, width, id_col, text_col)
    pairs = stored(corpus.crossing(None), "pairs")
    links = corpus.verified(pairs)
    corpus.drop()
    drop_stored(pairs)
    n = lambda end: corpus.sets.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"))
    found = links.join(n("a"), "a").join(n("b"), "b").select("a", "b", "overlap", (F.col("overlap") / (F.col("n_a") + F.col("n_b") - F.col("overlap"))).alias("jaccard"))
    return found, corpus.nodes.where("n > 0").select(F.col("doc").alias(id_col), "node", F.col("n").alias("n_shingles"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without near copies: of each component the least id stays, of rows with one id the first by text.

    Rows with a null id are left alone.
    """
    key, order = fresh("__id", docs.columns), fresh("__k", docs.columns)
    groups = stored(near_duplicates(docs, id_col=id_col, text_col=text_col, **options).select(named(id_col).alias(key), "component_id"), "groups")
    gone = groups.where(F.col(key) != F.col("component_id")).select(key).distinct()
    kept = docs.join(gone, named(id_col) == F.col(key), "left_anti")
    repeated = groups.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    if repeated.isEmpty():
        return kept
    again = kept.join(repeated, named(id_col) == F.col(key), "left_semi")
    first = again.withColumn(order, F.row_number().over(Window.partitionBy(named(id_col)).orderBy(named(text_col), F.xxhash64(*map(named, docs.columns))))).where(F.col(order) == 1).drop(order)
    return kept.join(repeated, named(id_col) == F.col(key), "left_anti").union(first)
