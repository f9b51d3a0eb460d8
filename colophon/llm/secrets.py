"""Secret scans: patterns, and novelty against a primed compressor.

Base patterns find assignments, access keys and long hex runs.  The novelty
method adds strings that no pattern names: every candidate (a long mixed run with
a sensitive word within ``CONTEXT`` characters before or after it, on any line;
also its parts between equals signs, and what follows a sensitive word in it up to
the next) is compressed with zstandard primed with the text around it and a
dictionary of the corpus' own identifiers: the words that occur most often in and
around the candidates of all documents.  Its marginal compressed bytes per byte
tell how much of it neither the surroundings nor the dictionary explains;
incompressible candidates are reported as ``novel``.  A text costs linear time,
also where one run of letters fills it.

The dictionary is counted over every document in a first pass (``dictionary``);
its size is a parameter of the model, ``WORDS`` words, and it is all that reaches
the driver.

Spans are in code points, end exclusive, over the whole text.

Edge cases: null and empty texts have no spans; a span that overlaps a base span
is never added as novel; repeated rows are scanned each; an empty table has an
empty dictionary; other columns are carried by ``redacted``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
SENSITIVE = re.compile(r"passw|passphrase|pwd|secret|token|credential|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer", re.ASCII | re.IGNORECASE)
RUN = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
#: Part of a run between equals signs; those at the end of the run are padding.
PART = re.compile(r"[A-Za-z0-9+/_.-]{16,}(?:=+$)?")
#: A document without any of these has no span of any kind; scanned by a linear-time automaton.
_ANY = r"(?i:passw|passphrase|pwd|secret|token|credential|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
#: Words of the dictionary: no digits, so that no copied secret is among them; zstandard finds no shorter repeats.
WORDS, WORD = 4096, re.compile(r"[A-Za-z_./-]{4,}")
#: Random strings reach this novelty, names with known words in them don't: on sf0.1 host names have 0.47 at most, random ones 0.81 in 99 of 100.
CONTEXT, NOVELTY = 400, 0.72


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words in and around each document's candidates, and how often they occur there."""
    for batch in batches:
        texts, found = batch.column(0), Counter()
        hits = pc.fill_null(pc.match_substring_regex(texts, _ANY), False)
        for k in pc.indices_nonzero(hits).to_pylist():
            text, at = texts[k].as_py(), 0
            for s, e in candidates(text):
                lo, hi = max(at, s - CONTEXT), e + CONTEXT  # windows that overlap count once
                found.update(WORD.findall(text, lo, hi))
                at = max(at, min(hi, len(text)))
        yield pa.record_batch({"word": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})


def dictionary(docs: DataFrame, *, text_col: str = "text", words: int = WORDS) -> bytes:
    """The identifiers that surround candidates most often, as raw content for the compressor: the most frequent come last, nearest to what it reads."""
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # What occurs once explains nothing, and may be part of a secret.
    top = counted.where("n > 1").orderBy(F.col("n").desc(), "word").limit(words).collect()
    return " ".join(r["word"] for r in reversed(top)).encode()


#: Literals stay bytes, so that a byte that nothing explains counts as one whatever its letter; repeats from four bytes on.
_PARAMETERS = zstandard.ZstdCompressionParameters.from_level(-1, min_match=4, hash_log=16, window_log=17, target_length=1, write_content_size=False, write_checksum=False)


class Novelty:
    """Marginal bytes beside a dictionary. The dictionary is digested once; the compressor keeps nothing between two calls."""

    def __init__(self, words: bytes = b""):
        primed = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if words else None
        if primed is not None:
            primed.precompute_compress(compression_params=_PARAMETERS)
        self._compressor = zstandard.ZstdCompressor(compression_params=_PARAMETERS, dict_data=primed)

    def _size(self, text: str) -> int:
        return len(self._compressor.compress(text.encode()))

    def marginal_bytes(self, candidate: str, before: str, after: str) -> int:
        """By how many bytes a stream that has the dictionary and the surroundings grows when the candidate follows them.

        The fast strategy may step over a repeat: the least of three orders counts.
        """
        return min(self._size(near + candidate) - self._size(near) for near in (f"{before}\n{after}\n", f"{after}\n{before}\n", "\n"))


@lru_cache(maxsize=2)
def _novelty(words: bytes) -> Novelty:
    return Novelty(words)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, leftmost and non-overlapping per kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Runs near a sensitive word, in the order of the text: parts of a run, then the run, then what follows each word in it
    up to the next. The three together are at most three times as long as the runs."""
    words = [m.span() for m in SENSITIVE.finditer(text)]
    starts, ends = [s for s, _ in words], [e for _, e in words]
    for m in RUN.finditer(text) if words else ():
        s, e = m.span()
        if bisect_left(ends, s - CONTEXT) < bisect_right(starts, e + CONTEXT):
            parts = [(s + x.start(), s + x.end()) for x in PART.finditer(m[0])]
            inside = range(bisect_right(ends, s), bisect_right(ends, e - 16))
            tails = [(ends[k], min(e, starts[k + 1] if k + 1 < len(words) else e)) for k in inside]
            yield from dict.fromkeys([*parts, (s, e), *[(a, b) for a, b in tails if b - a >= 16]])


def novel_spans(text: str, taken: list[tuple[int, int, int]], words: bytes = b"") -> list[tuple[int, int, int]]:
    out, ordered, reach = [], sorted(taken), 0
    starts, furthest = [a for a, _, _ in ordered], []
    for _, _, b in ordered:
        furthest.append(reach := max(reach, b))
    measure = _novelty(words).marginal_bytes
    for s, e in candidates(text):
        c = text[s:e]
        mixed = DIGIT.search(c) and LETTER.search(c)
        k = bisect_left(starts, e)
        if not mixed or (k and furthest[k - 1] > s) or (out and out[-1][2] > s):  # ends in ``out`` never go back
            continue
        if measure(c, text[max(0, s - CONTEXT) : s], text[e : e + CONTEXT]) >= NOVELTY * len(c):
            out.append((s, 3, e))
    return out


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(text: str | None, words: bytes = b"") -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text or "")
    return base, sorted(base + novel_spans(text or "", base, words))


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with every span (overlapping ones as one) replaced by ``mark``."""
    out, at = [], 0
    for s, _, e in spans:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def scanned(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base counts, checksum of the base spans, and all spans."""
    kind = docs.schema[id_col].dataType.simpleString()
    words = dictionary(docs, text_col=text_col)
    none = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            hits = pc.fill_null(pc.match_substring_regex(batch.column(1), _ANY), False)
            counts, digests, spans = [[0] * n for _ in range(3)], [none] * n, [""] * n
            for k in pc.indices_nonzero(hits).to_pylist():
                base, every = scan(batch.column(1)[k].as_py(), words)
                for _, which, _ in base:
                    counts[which][k] += 1
                digests[k] = hashlib.sha256(_join(base).encode()).hexdigest()
                spans[k] = _join(every)
            yield pa.record_batch({id_col: batch.column(0), "n_assign": pa.array(counts[0], pa.int64()), "n_access": pa.array(counts[1], pa.int64()), "n_hex": pa.array(counts[2], pa.int64()), "base_sha256": pa.array(digests, pa.string()), "spans": pa.array(spans, pa.string())})

    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced by a mark; other columns as they are."""
    at = docs.columns.index(text_col)
    words = dictionary(docs, text_col=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            hits = pc.fill_null(pc.match_substring_regex(texts, _ANY), False)
            if pc.any(hits).as_py():
                new = texts.to_pylist()
                for k in pc.indices_nonzero(hits).to_pylist():
                    new[k] = redact(new[k], scan(new[k], words)[1])
                batch = batch.set_column(at, batch.schema.field(at).name, pa.array(new, texts.type))
            yield batch

    # Workers see columns by place, so that any name will do.
    placed = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return placed.mapInArrow(run, placed.schema).toDF(*docs.columns)
