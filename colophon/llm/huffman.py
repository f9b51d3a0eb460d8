"""Token ids as canonical length-limited Huffman files, and back.

One code for the whole corpus, from the counts of all ids, at most ``LIMIT``
bits long (package-merge), so a decoder needs one table of ``2**LIMIT`` entries.
Files hold independent blocks of consecutive documents: a block lists its
documents, their token counts and the bit offset of a checkpoint every ``STEP``
tokens (every document begins at one, on a byte).  A block can be decoded alone,
and all its checkpoints at the same time.

Format of a corpus folder (Parquet as the container, so any file system that
Spark writes will do):

* ``code``: one row: ``lengths``, one byte per id, 0 for an unused id. The code
  is canonical: by (length, id).
* ``blocks``: ``part`` and ``seq`` (their order is the documents' order),
  ``before`` and ``total`` (ids of the part's earlier blocks, and its own), ``docs`` (little-endian int64,
  null as ``missing``), ``counts`` (int32 ids of each document), ``bits``
  (int64 bit offset of each checkpoint), ``payload``.

Edge cases: a null or empty text is its end id alone; a null document id sorts
first; repeated rows are written each; an empty table makes an empty corpus.
"""

from __future__ import annotations

import json
import os
import string
import zlib
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colophon.llm.storage import drop_stored, partitions, stored
from colophon.llm.textblocks import slices

LIMIT, STEP, BLOCK_TOKENS, TEXT_BYTES = 16, 256, 1 << 18, 1 << 23

# --- token ids ---------------------------------------------------------------


#: How the vocabularies whose words are plain cut a text: a run of letters is one piece, so is a run of marks without an apostrophe.
LETTER_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: ASCII marks but the apostrophe, and the Latin letters below U+0250, which no normal form composes with each other.
MARKS, LATIN = "".join(c for c in string.punctuation if c != "'"), "".join(c for c in map(chr, range(0x250)) if c.isalpha())


def _is_plain(word: str) -> bool:
    return word.isalpha() and (word.isascii() or max(word) <= LATIN[-1])


def _take(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces ``which`` of ``flat``, whose pieces have these sizes, in a row; and where each begins and ends."""
    begins, n = np.cumsum(sizes) - sizes, sizes[which]
    ends = np.concatenate([[0], np.cumsum(n)])
    return flat[np.repeat(begins[which] - ends[:-1], n) + np.arange(ends[-1])], ends


class CachedTokenizer:
    """The library's ids of whole texts; each distinct chunk between white space is encoded once.

    That is the same only if the vocabulary's pre-tokenizer drops white space and
    no added token contains any: both are asked when it is loaded.  Other
    vocabularies encode each text whole.  ``KEEP`` bounds what a worker remembers.

    A plain chunk is a run of Latin letters, then a run of ``MARKS`` or nothing.
    Where the file's parts say that these two are pieces of their own
    (``_parts_are_plain``), they are looked up apart. The library normalizes many
    new words as one text and puts many of them as one text through the file's
    pre-tokenizer and model: ids with the suffix of a word's end part them.
    """

    KEEP, AT_ONCE = 2_000_000, 1024

    def __init__(self, path: str, dtype: np.dtype):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), dtype
        self.by_chunk = self._drops_white_space()
        self.plain = self.by_chunk and self._parts_are_plain(json.loads(self.tokenizer.to_str()))
        if self.plain:
            # Letters that stay such letters when normalized, as each of them is by itself: a capital I with a dot becomes two characters.
            self.letters = "".join(c for c in LATIN if _is_plain(self._normalized(c)))
            self.lowers = "Lowercase" in str(self.tokenizer.normalizer)
            self.words_only = Tokenizer(self.tokenizer.model)
            self.words_only.pre_tokenizer = self.tokenizer.pre_tokenizer
            suffix, names = self.tokenizer.model.end_of_word_suffix, self.tokenizer.get_vocab(with_added_tokens=False)
            self.ends_word = np.zeros(max(names.values()) + 1, dtype=bool)
            self.ends_word[[k for name, k in names.items() if name.endswith(suffix)]] = True
        self._forget()

    def _drops_white_space(self) -> bool:
        pre = self.tokenizer.pre_tokenizer
        if pre is None or any(any(c.isspace() for c in t.content) for t in self.tokenizer.get_added_tokens_decoder().values()):
            return False
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        pieces = ("a", "Bc", "1", "23", ".", ",.", "a's", "'")
        # No piece may depend on the white space beside it.
        return all(ids(f"{x}{gap}{y}") == ids(x) + ids(y) for gap in (" ", "\n", "\t", "\r", "\x0b", "\x0c", " \n ") for x in pieces for y in pieces) and not any(p.isspace() for p, _ in pre.pre_tokenize_str("a b\nc\td\re"))

    def _parts_are_plain(self, parts: dict) -> bool:
        """Whether the file's own parts say that a plain chunk's letters and marks are one piece each, whatever the vocabulary."""
        each = lambda part, of: part[of] if part and part["type"] == "Sequence" else [part] if part else []
        blank = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
        split = {"type": "Split", "pattern": {"Regex": LETTER_RUNS}, "behavior": "Removed", "invert": True}
        model, pre = parts["model"], each(parts["pre_tokenizer"], "pretokenizers")
        added = [text for t in parts["added_tokens"] for text in (t["content"], self._normalized(t["content"]))]
        return (
            all(n == blank or n["type"] in ("NFC", "Lowercase") for n in each(parts["normalizer"], "normalizers"))
            and len(pre) == 2 and pre[0] == split and pre[1]["type"] == "ByteLevel" and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"]
            and model["type"] == "BPE" and bool(model["end_of_word_suffix"]) and not model["end_of_word_suffix"].isalpha() and not model["dropout"] and not model["continuing_subword_prefix"]
            and parts["post_processor"] is None and parts["truncation"] is None and parts["padding"] is None
            and not any((x := text.rstrip(MARKS)) == "" or x.isalpha() for text in added)  # none lies within a plain chunk
        )

    def _normalized(self, text: str) -> str:
        return self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text

    def _forget(self) -> None:
        self.known = {"": b""}

    def _cut(self, raw: np.ndarray, ends: Iterable[int]) -> list[bytes]:
        packed, step = raw.tobytes(), self.dtype.itemsize
        return [packed[a * step : b * step] for a, b in pairwise(chain([0], ends))]

    def _ids(self, texts: list[str]) -> list[bytes]:
        out = []
        for k in range(0, len(texts), self.AT_ONCE):  # few lists at a time, so the garbage collector has little to look through
            made = [e.ids for e in self.tokenizer.encode_batch_fast(texts[k : k + self.AT_ONCE], add_special_tokens=False)]
            out += self._cut(np.fromiter(chain.from_iterable(made), self.dtype), accumulate(map(len, made)))
        return out

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of normalized plain words."""
        out = []
        for k in range(0, len(words), self.AT_ONCE):
            some = words[k : k + self.AT_ONCE]
            ids = np.array(self.words_only.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            # A letter without a token of its own leaves none, and maybe a word without an end.
            out += self._cut(ids, ends.tolist()) if len(ends) == len(some) and ends[-1] == len(ids) else self._ids(some)
        return out

    def _new_ids(self, new: list[str]) -> Iterable[tuple[str, bytes]]:
        """Chunks, words and marks that aren't known yet, all distinct, with their ids."""
        words = list(filter(_is_plain, new)) if self.plain else []
        found = {w: w for w in words if w.isascii() and (w.islower() or not self.lowers)}  # normal already
        rest, normal = [w for w in words if w not in found], []
        for k in range(0, len(rest), self.AT_ONCE):
            normal += self._normalized(" ".join(rest[k : k + self.AT_ONCE])).split(" ")
        found |= {w: x for w, x in zip(rest, normal, strict=True) if _is_plain(x)}
        others = [w for w in new if w not in found]
        return chain(zip(found, self._word_ids(list(found.values()))), zip(others, self._ids(others)))

    def _lookup(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct chunks in a row, and how many each has."""
        if len(self.known) > self.KEEP:
            self._forget()
        known, names = self.known, chunks.to_numpy(zero_copy_only=False).tolist()
        made = list(map(known.get, names))
        missing = [k for k, x in enumerate(made) if x is None]
        known.update(self._new_ids([names[k] for k in missing]))
        for k in missing:
            made[k] = known[names[k]]
        return np.frombuffer(b"".join(made), self.dtype), np.fromiter(map(len, made), np.int64, len(made)) // self.dtype.itemsize

    def _parted(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``_lookup``, with the words and marks of plain chunks looked up apart."""
        words, marks = pc.utf8_rtrim(chunks, MARKS), pc.utf8_ltrim(chunks, self.letters)
        # What is left without the marks at the end and without the letters at the beginning is the whole: no other characters.
        plain = pc.and_(pc.greater(pc.binary_length(words), 0), pc.equal(pc.add(pc.binary_length(words), pc.binary_length(marks)), pc.binary_length(chunks)))
        words = pc.if_else(plain, pc.ascii_lower(words) if self.lowers else words, chunks).dictionary_encode()
        marks = pc.if_else(plain, marks, "").dictionary_encode()
        (ids, sizes), (more, others) = self._lookup(words.dictionary), self._lookup(marks.dictionary)
        pieces = np.stack([words.indices.to_numpy(), marks.indices.to_numpy() + len(sizes)], axis=1)
        sizes = np.concatenate([sizes, others])
        return _take(np.concatenate([ids, more]), sizes, pieces.ravel())[0], sizes[pieces].sum(axis=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's begin and end (a null text has none)."""
        texts = pc.fill_null(texts, "")
        if not self.by_chunk:
            made = self._ids(texts.to_pylist())
            return np.frombuffer(b"".join(made), self.dtype), np.concatenate([[0], np.cumsum([len(x) // self.dtype.itemsize for x in made])]).astype(np.int64)
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        ids, ends = _take(*(self._parted if self.plain else self._lookup)(coded.dictionary), coded.indices.to_numpy())
        return ids, ends[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])]


_TOKENIZERS: dict = {}


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")


def _tokenize(path: str, dtype: np.dtype, end_id: int, vocabulary: int):
    """Ids of every text; at the end, one row with this task's counts of all ids that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, dtype) not in _TOKENIZERS:
            _TOKENIZERS[path, dtype] = CachedTokenizer(path, dtype)
        tokenizer, total = _TOKENIZERS[path, dtype], np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text", most=TEXT_BYTES):
                ids, at = tokenizer.encode(part.column(1))
                ids = np.insert(ids, at[1:], end_id)
                total += np.bincount(ids, minlength=vocabulary)
                offsets = ((at + np.arange(len(at))) * dtype.itemsize).astype(np.int64)
                column = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.tobytes())]).cast(pa.binary())
                yield pa.record_batch({"doc": part.column(0), "ids": column, "counts": pa.nulls(part.num_rows, pa.binary())})
        used = np.flatnonzero(total)
        if len(used):
            counts = np.stack([used, total[used]]).astype("<i8").tobytes()
            yield pa.record_batch({"doc": pa.nulls(1, pa.int64()), "ids": pa.nulls(1, pa.binary()), "counts": pa.array([counts], pa.binary())})

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for packed in batch.column(0):
            used, n = np.frombuffer(packed.as_buffer(), "<i8").reshape(2, -1)
            yield pa.record_batch({"id": pa.array(used.astype(np.int32)), "n": pa.array(n)})


def tokenized(docs: DataFrame, path: str, *, vocabulary: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc``, ``ids``: little-endian ids of every whole text with ``end_id`` appended; and, where ``ids`` is null, a task's ``counts``."""
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(_tokenize(path, id_type(vocabulary), end_id, vocabulary), "doc long, ids binary, counts binary")


# --- the code ----------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of this length")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    packages, levels = np.zeros(0), []
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        sort = np.argsort(both, kind="stable")
        levels.append(sort < len(leaves))  # which places of this level are leaves
        merged = both[sort]
        pairs = len(merged) // 2
        packages = merged[: 2 * pairs : 2] + merged[1 : 2 * pairs : 2]
    take, depth = 2 * len(leaves) - 2, np.zeros(len(leaves), dtype=np.int64)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        depth[:n] += 1
        take = 2 * (take - n)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Code of each id: consecutive numbers by (length, id), shifted at each longer length."""
    codes = np.zeros(len(lengths), dtype=np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    n = lengths[order].astype(np.int64)
    # With 2**-length as a measure, a code is the measure of all before it.
    before = np.concatenate([[0], np.cumsum(np.int64(1) << (LIMIT - n))[:-1]]) if len(n) else np.zeros(0, np.int64)
    codes[order] = (before >> (LIMIT - n)).astype(np.uint32)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every LIMIT-bit window: the id it begins with, and that id's length."""
    ids, sizes = np.zeros(1 << LIMIT, dtype=np.uint32), np.ones(1 << LIMIT, dtype=np.uint8)
    codes = canonical_codes(lengths)
    for k in np.flatnonzero(lengths):
        lo = int(codes[k]) << (LIMIT - int(lengths[k]))
        hi = lo + (1 << (LIMIT - int(lengths[k])))
        ids[lo:hi] = k
        sizes[lo:hi] = lengths[k]
    return ids, sizes


def encode_block(docs_ids: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Bit offsets of all checkpoints, and the payload. Every document begins on a byte."""
    counts = np.array([len(x) for x in docs_ids], dtype=np.int64)
    ids = np.concatenate(docs_ids)
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    own = np.add.reduceat(size, first)
    begins = np.concatenate([[0], np.cumsum((own + 7) // 8 * 8)])
    at = ends - size + np.repeat(begins[:-1] - (ends[first] - size[first]), counts)
    code = codes[ids].astype(np.int64) << (24 - size - (at & 7))  # LIMIT + 7 bits fit into three bytes
    byte, n = at >> 3, int(begins[-1] >> 3) + 3
    out = np.bincount(byte, code >> 16, n) + np.bincount(byte + 1, (code >> 8) & 255, n) + np.bincount(byte + 2, code & 255, n)
    within = np.arange(len(ids)) - np.repeat(first, counts)
    return at[within % STEP == 0], out.astype(np.uint8)[: n - 3].tobytes()


def decode_block(counts: np.ndarray, bits: np.ndarray, payload: bytes, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """All ids of a block: every checkpoint is a lane, and all lanes step together through the table."""
    ids_of, size_of = table
    raw = np.concatenate([np.frombuffer(payload, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    window = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    lanes = -(-counts // STEP)
    each = np.full(int(lanes.sum()), STEP, dtype=np.int64)
    last = np.cumsum(lanes) - 1
    each[last] = counts - (lanes - 1) * STEP
    place = np.concatenate([[0], np.cumsum(each)[:-1]])
    out, at = np.empty(int(counts.sum()), dtype=np.uint32), bits.astype(np.int64).copy()
    order = np.argsort(-each, kind="stable")
    at, place, each = at[order], place[order], each[order]
    for k in range(int(each[0]) if len(each) else 0):
        live = int(np.searchsorted(-each, -k, side="left"))
        a = at[:live]
        peek = (window[a >> 3] >> (24 - LIMIT - (a & 7)).astype(np.uint32)) & np.uint32((1 << LIMIT) - 1)
        out[place[:live] + k] = ids_of[peek]
        at[:live] = a + size_of[peek]
    return out


# --- files -------------------------------------------------------------------


def write_corpus(docs: DataFrame, path: str, tokenizer: str, *, vocabulary: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize ``docs`` and write them under ``path`` in ascending id order."""
    spark = docs.sparkSession
    made = stored(tokenized(docs, tokenizer, vocabulary=vocabulary, end_id=end_id, id_col=id_col, text_col=text_col), "ids")
    ids, counts = made.where("ids is not null").select("doc", "ids"), np.zeros(vocabulary, dtype=np.int64)
    for r in made.where("counts is not null").select("counts").mapInArrow(_counted, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # one row per vocabulary entry
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    spark.createDataFrame([(bytearray(lengths.tobytes()), vocabulary, end_id)], "lengths binary, vocabulary int, end_id int").write.parquet(f"{path}/code")
    shared = spark.sparkContext.broadcast((lengths, canonical_codes(lengths)))
    dtype = id_type(vocabulary)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, code = shared.value
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        names, texts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            bits, payload = encode_block(texts, size, code)
            name = np.array([0 if x is None else x for x in names], "<i8").tobytes()
            missing = np.array([x is None for x in names], np.uint8).tobytes()
            n = np.array([len(x) for x in texts], "<i4").tobytes()
            row = {"part": [part], "seq": [seq], "before": [before], "total": [held], "docs": [name], "missing": [missing], "counts": [n], "bits": [bits.astype("<i8").tobytes()], "payload": [payload]}
            kinds = {"part": pa.int32(), "seq": pa.int32(), "before": pa.int64(), "total": pa.int64()}
            return pa.record_batch({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in row.items()})

        for batch in batches:
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                names.append(name)
                texts.append(np.frombuffer(x.as_buffer(), dtype))
                held += len(texts[-1])
                if held >= BLOCK_TOKENS:
                    yield flush()
                    seq, before, names, texts, held = seq + 1, before + held, [], [], 0
        if texts:
            yield flush()

    # Rows of one id, or without any, may be many: their checksums deal them out, and equal rows are interchangeable.
    order = [F.col("doc").asc_nulls_first(), F.xxhash64("ids"), F.col("ids")]
    in_order = ids.repartitionByRange(partitions(spark), *order[:2]).sortWithinPartitions(*order)
    in_order.mapInArrow(blocks, "part int, seq int, before long, total long, docs binary, missing binary, counts binary, bits binary, payload binary").write.option("compression", "none").parquet(f"{path}/blocks")
    drop_stored(made)


def read_corpus(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """``doc``, ``start``, ``n_tokens`` and, from the files alone, the ids (or with ``digest`` their checksum).

    ``digest``: unsigned crc32 of the ids as little-endian unsigned 32-bit integers.
    """
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/code").first()["lengths"]), np.uint8)
    table = spark.sparkContext.broadcast(decode_table(lengths))
    blocks = spark.read.parquet(f"{path}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                buf = lambda c, kind: np.frombuffer(col[c][k].as_buffer(), kind)  # noqa: E731, B023
                counts = buf("counts", "<i4").astype(np.int64)
                ids = decode_block(counts, buf("bits", "<i8"), col["payload"][k].as_py(), table.value).astype("<u4")
                ends = np.cumsum(counts)
                cuts = [ids[e - n : e] for e, n in zip(ends, counts)]
                out = pa.array([zlib.crc32(x) for x in cuts], pa.int64()) if digest else pa.array([x.tobytes() for x in cuts], pa.binary())
                docs = pa.array(buf("docs", "<i8"), mask=buf("missing", np.uint8).astype(bool))
                n = len(counts)
                yield pa.record_batch({"doc": docs, "part": pa.array([col["part"][k].as_py()] * n, pa.int32()), "inside": pa.array(ends - counts + col["before"][k].as_py()), "n_tokens": pa.array(counts), "ids": out})

    decoded = blocks.mapInArrow(run, f"doc long, part int, inside long, n_tokens long, ids {'long' if digest else 'binary'}")
    # One row per part, from the blocks' own counts: nothing is decoded for it.
    sizes = blocks.groupBy("part").agg(F.max(F.col("before") + F.col("total")).alias("n"))
    base = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return decoded.join(F.broadcast(base), "part").select("doc", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", F.col("ids").alias("ids_crc32" if digest else "ids"))
