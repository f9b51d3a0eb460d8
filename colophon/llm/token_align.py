"""Alignment of two tokenizers' tokens over the same texts.

Tokenizer A is a byte-level BPE file of the tokenizers library, tokenizer B a
SentencePiece model.  Every text is read by both as space and text; where the
tokens' bytes joined give exactly that, both cut the same bytes.  The tokens of B
are a static interval index: their starts and ends in order.  For each token of A
two bisections stab that index and give the tokens of B that overlap it; a gap of
B that no token of A spans is where one group ends and the next begins.  All
texts of a slice are indexed at once, one behind the other, for texts end where
groups end.

A first pass tokenizes, aligns and stores ids and digests, and counts linked id
pairs in the worker before they are summed by pair.  A second pass aligns the
stored ids again and weighs each link by the corpus-wide count of its pair.  The
``HOT`` most frequent pairs, a fixed number, reach every worker as a table;
links of any other pair leave as (text, pair, links) and meet the counts in a
join.  Pairs that are not among the most frequent have no hot key, so no task of
that join grows with one pair.

SentencePiece pieces that hold no space behind another letter, nor a line feed,
let a text be cut before its spaces and line feeds: each cut is encoded once per
worker and remembered.  Models of another make encode whole texts.

Edge cases: null and empty texts, and texts whose bytes one tokenizer changes,
have no tokens: zeros and an empty digest; repeated rows count as often as they
occur; rows need no id; an empty table gives an empty result; further columns are
left out of the result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.llm.storage import drop_stored, named, stored
from colophon.llm.textblocks import slices

#: Fixed value: how byte-level BPE files cut a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE = "▁"
#: Pairs whose counts all workers hold (16 bytes each), pairs that a worker counts before it passes them on, cuts that it remembers.
HOT, COUNTED, REMEMBERED, LONGEST = 1 << 20, 1 << 21, 1 << 18, 48


def byte_letters() -> dict[str, int]:
    """The letter that byte-level files write for each byte: itself if it shows, else the next free one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """Token bytes by id, as one array, and encoded texts."""

    def __init__(self, tokens: dict[int, bytes]):
        n = max(tokens) + 1
        each = [tokens.get(i, b"") for i in range(n)]
        self.size, self.length = n, np.array([len(t) for t in each], np.int64)
        self.raw, self.at = np.frombuffer(b"".join(each), np.uint8), np.concatenate([[0], np.cumsum(self.length)[:-1]])

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, one behind the other."""
        n = self.length[ids]
        ends = np.cumsum(n)
        return self.raw[np.repeat(self.at[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


class ByteLevel(Vocabulary):
    """A byte-level BPE file. Files whose merges stand in the order of their ids are read by tiktoken, others by the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        spec, letters = json.loads(text), byte_letters()
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        super().__init__({i: bytes(letters[c] for c in t) for t, i in model["vocab"].items()})
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not spec.get("normalizer") and not any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
        if plain and merged == sorted(merged) and len(merged) + 256 == len(model["vocab"]):
            import tiktoken

            ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items()}
            encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self._encode = lambda texts: [np.array(encoding.encode_ordinary(t), np.int64) for t in texts]
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_str(text)
            library.encode_special_tokens = True
            self._encode = lambda texts: [np.array(e.ids, np.int64) for e in library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of space and text."""
        return self._encode([" " + t for t in texts])


class Pieces(Vocabulary):
    """A SentencePiece model."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            proto = f.read()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        spec = sentencepiece_model_pb2.ModelProto.FromString(proto)
        pieces = [p.piece for p in spec.pieces]
        named_byte = re.compile("<0x([0-9A-F]{2})>")
        super().__init__({i: bytes([int(m[1], 16)]) if (m := named_byte.fullmatch(p)) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)})
        #: No piece spans a cut: pieces hold spaces at their head only, and line feeds stand alone.
        self.cuts = spec.trainer_spec.model_type == 2 and spec.normalizer_spec.name == "identity" and not any(SPACE in p.lstrip(SPACE) or "\n" in p or " " in p for p in pieces)
        self.space = self.model.encode("\n")[:-1]  # ids of the space that the model adds, but not to an empty text
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of the text, to which the model itself adds a space."""
        if not self.cuts:
            return [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]
        cut = re.compile(r"\n *[^ \n]*| +[^ \n]*").findall
        parts = [cut(" " + t) for t in texts]
        every = set().union(*parts)
        new = [p for p in every if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(every)
        spaced, broken = [p for p in new if p[0] == " "], [p for p in new if p[0] == "\n"]
        fresh = dict(zip(spaced, self.model.encode([p[1:] for p in spaced], num_threads=1)))
        fresh |= {" ": self.space} | {p: ids[len(self.space) :] for p, ids in zip(broken, self.model.encode(broken, num_threads=1))}
        for p, ids in fresh.items():
            self.known[p] = np.array(ids, np.int32).tobytes()
        out = [np.frombuffer(b"".join(map(self.known.__getitem__, ps)), np.int32).astype(np.int64) for ps in parts]
        for p in new:
            if len(p) > LONGEST:
                del self.known[p]
        return out


@lru_cache(maxsize=4)
def _vocabularies(a: str, b: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(a), Pieces(b)


class Aligned:
    """Tokens of both sides over the same bytes: ``first`` and ``last`` are, for each token of A, the range of B that overlaps it."""

    def __init__(self, a: np.ndarray, b: np.ndarray, length_a: np.ndarray, length_b: np.ndarray):
        ends_a, ends_b = np.cumsum(length_a), np.cumsum(length_b)
        self.a, self.b = a, b
        self.first = np.searchsorted(ends_b, ends_a - length_a, side="right")
        self.last = np.searchsorted(ends_b - length_b, ends_a, side="left")
        #: Whether a group ends behind each token of A: the next one overlaps only later tokens of B.
        self.closes = np.append(self.last[:-1] == self.first[1:], True)[: len(a)]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Places in A and B of all overlapping pairs, in order of A."""
        n = self.last - self.first
        ends = np.cumsum(n)
        return np.repeat(np.arange(len(n)), n), np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first - (ends - n), n)


def _per_text(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive values, of which each text has those up to its end."""
    total = np.concatenate([[0], np.cumsum(values)])[ends]
    return np.diff(total, prepend=0)


class _Digits:
    """Decimal ids as rows of bytes, zeros before the first digit."""

    def __init__(self, size: int):
        width, ids = len(str(max(size - 1, 1))), np.arange(size)
        self.table, self.width = np.zeros((size, width), np.uint8), width
        for k in range(width):
            tens = 10 ** (width - 1 - k)
            self.table[:, k] = np.where((ids >= tens) | (tens == 1), 48 + ids // tens % 10, 0)
        self.length = (self.table > 0).sum(axis=1)


def group_digests(x: Aligned, ends_a: np.ndarray, digits: _Digits) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` of each text; ``ends_a``: where each text ends among the tokens of A."""
    last = np.flatnonzero(x.closes)  # the last token of A of each group
    stop_a, stop_b = last + 1, x.last[last]
    count_a, count_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
    # Each group's tokens of A, then its tokens of B.
    place_a = np.arange(len(x.a)) + np.repeat(stop_b - count_b, count_a)
    place_b = np.arange(len(x.b)) + np.repeat(stop_a, count_b)
    ids, marks = np.empty(len(x.a) + len(x.b), np.int64), np.full(len(x.a) + len(x.b), ord(","), np.uint8)
    ids[place_a], ids[place_b] = x.a, x.b
    marks[place_a[stop_a - 1]], marks[place_b[stop_b - 1]] = ord("|"), ord(";")
    rows = np.concatenate([digits.table[ids], marks[:, None]], axis=1)
    flat = rows[rows > 0]
    group_ends = np.cumsum(digits.length[ids] + 1)[stop_a + stop_b - 1]
    out, begin = [], 0
    for k in np.searchsorted(stop_a, ends_a):
        out.append(hashlib.sha256(flat[begin : group_ends[k] - 1].data).hexdigest())
        begin = group_ends[k]
    return out


def _tokens(texts: list[str], va: ByteLevel, vb: Pieces) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    """Which texts both tokenizers give back byte by byte, and their ids on both sides."""
    kept, a, b = [], va.encode(texts), vb.encode(texts)
    for k, t in enumerate(texts):
        raw = np.frombuffer((" " + t).encode(), np.uint8)
        if np.array_equal(va.joined(a[k]), raw) and np.array_equal(vb.joined(b[k]), raw):
            kept.append(k)
    return kept, [a[k] for k in kept], [b[k] for k in kept]


def _summed(codes: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different codes in order, and the sum of their numbers."""
    codes, n = np.concatenate(codes), np.concatenate(n)
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[new], np.add.reduceat(n, new) if len(codes) else n


_SHAPE = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a binary, b binary, pair long, n long"


def _align(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        va, vb = _vocabularies(path_a, path_b)
        digits, kind = _Digits(max(va.size, vb.size)), None
        codes, numbers, held = [], [], 0

        def counted(most: int = 0) -> Iterator[pa.RecordBatch]:
            nonlocal codes, numbers, held
            if not codes:
                return
            one, n = _summed(codes, numbers)
            codes, numbers, held = ([one], [n], len(one)) if most and len(one) <= most // 2 else ([], [], 0)
            if not codes:
                for k in range(0, len(one), 1 << 16):
                    m = len(one[k : k + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([pa.nulls(m, kind), *[pa.nulls(m, t) for t in (pa.int64(),) * 4], pa.nulls(m, pa.string()), *[pa.nulls(m, pa.binary())] * 2, pa.array(one[k : k + m]), pa.array(n[k : k + m])], names=["id", *[c.split()[0] for c in _SHAPE.split(", ")]])

        for batch in batches:
            kind = batch.schema.field("id").type
            for piece in slices(batch, "text"):
                texts, m = piece.column("text").to_pylist(), piece.num_rows
                full = [k for k, t in enumerate(texts) if t]
                kept, a, b = _tokens([texts[k] for k in full], va, vb)
                rows = np.array([full[k] for k in kept], np.int64)
                numeric = np.zeros((4, m), np.int64)
                digests, ids_a, ids_b = [""] * m, [None] * m, [None] * m
                if len(rows):
                    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
                    x = Aligned(flat_a, flat_b, va.length[flat_a], vb.length[flat_b])
                    ends_a = np.cumsum([len(v) for v in a])
                    numeric[0, rows], numeric[1, rows] = [len(v) for v in a], [len(v) for v in b]
                    numeric[2, rows], numeric[3, rows] = _per_text(x.closes, ends_a), _per_text(x.last - x.first, ends_a)
                    for k, d, p, q in zip(rows, group_digests(x, ends_a, digits), a, b):
                        digests[k], ids_a[k], ids_b[k] = d, p.astype("<u2" if va.size <= 1 << 16 else "<u4").tobytes(), q.astype("<u2" if vb.size <= 1 << 16 else "<u4").tobytes()
                    i, j = x.links()
                    one, n = np.unique(flat_a[i] * vb.size + flat_b[j], return_counts=True)
                    codes.append(one)
                    numbers.append(n)
                    held += len(one)
                yield pa.RecordBatch.from_arrays([piece.column("id"), *[pa.array(v) for v in numeric], pa.array(digests, pa.string()), pa.array(ids_a, pa.binary()), pa.array(ids_b, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names=["id", *[c.split()[0] for c in _SHAPE.split(", ")]])
                if held > COUNTED:
                    yield from counted(COUNTED)
        yield from counted()

    return run


def _weigh(path_a: str, path_b: str, hot):
    """Per text: the best links and counts of hot pairs, and the links of all other pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        va, vb = _vocabularies(path_a, path_b)
        pairs, counts, best = hot.value
        small = "<u2" if va.size <= 1 << 16 else "<u4", "<u2" if vb.size <= 1 << 16 else "<u4"
        for whole in batches:
            for batch in slices_of_ids(whole):
                a, b = ([np.frombuffer(v, t) for v in batch.column(c).to_pylist()] for c, t in zip("ab", small))
                flat_a, flat_b = np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)
                x = Aligned(flat_a, flat_b, va.length[flat_a], vb.length[flat_b])
                i, j = x.links()
                code = flat_a[i] * vb.size + flat_b[j]
                at = np.minimum(np.searchsorted(pairs, code), max(len(pairs) - 1, 0))
                there = pairs[at] == code if len(pairs) else np.zeros(len(code), bool)
                ends = np.cumsum(x.last - x.first)[np.cumsum([len(v) for v in a]) - 1]
                sums = _per_text(np.where(there, counts[at] if len(pairs) else 0, 0), ends)
                tops = _per_text(there & (best[at] if len(pairs) else False), ends)
                rare = np.flatnonzero(~there)
                cuts = np.searchsorted(rare, ends)
                rest = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], cuts]), pa.int32()), pa.array(code[rare], pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(tops, pa.int64()), pa.array(sums, pa.int64()), rest], names=["row", "n_best", "count_sum", "rest"])

    return run


def slices_of_ids(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges with about so many bytes of ids at most."""
    size = np.cumsum(pc.binary_length(batch.column("a")).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(size, (size[row - 1] if row else 0) + most, side="right")))
        yield batch.slice(row, end - row)
        row = end


def hottest(pairs: DataFrame, most: int) -> DataFrame:
    """The pairs above the least step of frequency (a sixteenth of a power of two) that ``most`` pairs at most reach."""
    step = F.floor(F.log2("n") * 16)
    held, least = 0, None
    for r in sorted(pairs.groupBy(step.alias("step")).agg(F.count("*").alias("pairs")).collect(), key=lambda r: -r["step"]):  # 16 rows per power of two
        held += r["pairs"]
        if held > most:
            break
        least = r["step"]
    return pairs.where(F.lit(False) if least is None else step >= least)


def aligned(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Per row: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and the ids of both sides packed, ``a`` and ``b``."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    read = docs.select(named(id_col).alias("id"), named(text_col).alias("text")).mapInArrow(_align(path_a, path_b), f"id {kind}, {_SHAPE}")
    made = stored(read.withColumn("row", F.monotonically_increasing_id()), "aligned")
    texts, size_b = made.where("pair IS NULL").drop("pair", "n"), Pieces(path_b).size
    pairs = stored(made.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    tops = pairs.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("n").alias("top"))  # a row per piece at most
    pairs = stored(pairs.withColumn("b", F.col("pair") % size_b).join(F.broadcast(tops), "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "pairs")
    most = hottest(pairs, hot).toArrow().sort_by("pair")
    shipped = spark.sparkContext.broadcast(tuple(most[c].to_numpy() for c in ("pair", "n", "best")))
    weighed = stored(texts.where("n_a > 0").select("row", "a", "b").mapInArrow(_weigh(path_a, path_b, shipped), "row long, n_best long, count_sum long, rest array<long>"), "weighed")
    rare = weighed.where(F.size("rest") > 0).select("row", F.explode("rest").alias("pair")).groupBy("row", "pair").agg(F.count("*").alias("links"))
    rare = rare.join(pairs, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more_sum"))
    out = texts.join(weighed.drop("rest"), "row", "left").join(rare, "row", "left")
    both = lambda c, d: (F.coalesce(c, F.lit(0)) + F.coalesce(d, F.lit(0))).alias(c)
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", both("n_best", "more_best"), both("count_sum", "more_sum"), "groups_sha256", "a", "b")
