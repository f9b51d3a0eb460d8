"""Document fingerprints from closed syncmers, in DataFrame functions only.

The letters are words: a k-mer is ``k`` consecutive words, its inner substrings
are its runs of ``s`` words.  A k-mer is an anchor if its least inner hash lies at
either edge.  Whether it is one depends on the k-mer alone, never on its
neighbours, so an insertion elsewhere moves anchors but doesn't change them, and
there is one in every ``k - s`` consecutive k-mers.

A fingerprint holds all anchors by ascending hash, each with the word position of
its first occurrence: ``HASH:POSITION`` joined by commas; it grows with the text.
Two fingerprints are as alike as the Jaccard similarity of their hashes; the
positions align the common ones.  ``keep`` leaves the least hashes only, for
callers that want a sketch: likeness is then an estimate.

Words are runs without ASCII white space.  Edge cases: a null text counts as
empty; without words the fingerprint is empty, alike (1) to empty ones only;
with fewer than ``k`` words the whole sequence is the one anchor; where no k-mer
qualifies (fewer than ``k - s`` of them), all are anchors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.llm.storage import partitions

K, S = 4, 2
ANCHORS = "array<struct<h:bigint,p:int>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda's variable is never inlined."""
    return F.transform(F.array(value), body)[0]


def anchors(text: Column, k: int = K, s: int = S, keep: int | None = None) -> Column:
    """The anchors of ``text`` (all, or the ``keep`` least), ascending by hash: array of (h, p)."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def hashed(h: Column) -> Column:
        n = F.size(h)
        inner = F.transform(F.sequence(F.lit(0), n - s), lambda i: F.xxhash64(*[h[i + j] for j in range(s)]))
        return F.when(n >= k, _let(inner, lambda m: chosen(h, m))).when(n > 0, F.array(F.struct(F.xxhash64(h).alias("h"), F.lit(0).alias("p")))).otherwise(F.array().cast(ANCHORS))

    def chosen(h: Column, m: Column) -> Column:
        all_ = F.sequence(F.lit(0), F.size(h) - k)
        span = k - s  # the k-mer at i has the inner hashes i .. i + span
        middle = [m[0]] if span < 2 else None
        edge = lambda i: F.least(m[i], m[i + span]) <= (F.least(*[m[i + j] for j in range(1, span)]) if span > 2 else m[i + 1])
        picked = all_ if middle is not None else F.filter(all_, edge)
        named = lambda i: F.struct(F.xxhash64(*[m[i + j] for j in range(0, span + 1, s)], m[i + span]).alias("h"), i.cast("int").alias("p"))
        return _let(F.transform(_let(picked, lambda x: F.when(F.size(x) > 0, x).otherwise(all_)), named), least)

    def least(found: Column) -> Column:
        distinct = lambda a: F.filter(a, lambda x, i: (i == 0) | (x["h"] != a[F.greatest(i - 1, F.lit(0))]["h"]))
        return _let(F.sort_array(found), lambda a: distinct(a) if keep is None else F.slice(distinct(a), 1, keep))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), hashed)


def as_string(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat(F.lpad(F.hex(x["h"]), 16, "0"), F.lit(":"), x["p"].cast("string"))), ",")


def from_string(text: Column) -> Column:
    """The anchors of a fingerprint string."""
    parts = F.filter(F.split(text, ","), lambda x: x != "")
    signed = lambda x: F.conv(F.substring(x, 1, 16), 16, -10).cast("long")
    return F.sort_array(F.transform(parts, lambda x: F.struct(signed(x).alias("h"), F.substring(x, 18, 12).cast("int").alias("p"))))


def likeness(a: Column, b: Column, keep: int | None = None) -> Column:
    """0 to 1, from two arrays of anchors (of the ``keep`` least each, if given)."""
    x, y = F.transform(a, lambda e: e["h"]), F.transform(b, lambda e: e["h"])
    both = lambda xs: F.slice(F.sort_array(F.array_union(xs["x"], xs["y"])), 1, keep)
    pair = F.struct(x.alias("x"), y.alias("y"))
    if keep is None:
        share = _let(pair, lambda p: _let(F.size(F.array_intersect(p["x"], p["y"])), lambda n: n / (F.size(p["x"]) + F.size(p["y"]) - n)))
    else:
        share = _let(pair, lambda p: _let(both(p), lambda u: F.size(F.array_intersect(u, F.array_intersect(p["x"], p["y"]))) / F.size(u)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(share)


def aligned(a: Column, b: Column) -> Column:
    """Word positions of the common anchors in both texts: array of (p, q) in the order of the first."""
    side = lambda xs, k: F.transform(xs, lambda x: F.struct(x["h"].alias("h"), F.lit(k).alias("side"), x["p"].alias("p")))
    before = lambda u, i: u[F.greatest(i - 1, F.lit(0))]
    # Each hash is in a side once: common ones are neighbours in the order of both.
    pairs = lambda u: F.transform(u, lambda x, i: F.when((i > 0) & (before(u, i)["h"] == x["h"]), F.struct(before(u, i)["p"].alias("p"), x["p"].alias("q"))))
    return F.sort_array(F.filter(_let(F.sort_array(F.concat(side(a, 0), side(b, 1))), pairs), lambda x: x.isNotNull()))


def with_next(docs: DataFrame, value, name: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, text (null as empty), ``name`` = ``value(text)``, and both of the next document as ``next_text`` and ``next_<name>``.

    The next one follows in descending id order, the first follows the last.
    Ids are cut at quantiles that are ids themselves; a range's first document is
    also the sentinel at the end of the range before it, so each range is
    complete in itself and texts are shuffled once.  Repeated ids follow by text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranges = 4 * partitions(spark)
    # ``ranges`` numbers reach the driver, whatever the table.
    seen = rows.agg(F.percentile_approx("__id", [k / ranges for k in range(1, ranges)], 100 * ranges).alias("q"), F.max("__id").alias("top")).first()
    heads = sorted({x for x in seen["q"] or [] if x != seen["top"]}, reverse=True)
    bounds = F.array(*[F.lit(x).cast("long") for x in heads]).cast("array<bigint>")
    place = F.size(F.filter(bounds, lambda b: b >= F.col("__id")))
    last = len(heads)
    own = F.struct(F.lit(False).alias("guard"), F.lit(False).alias("wraps"), F.col("__place").alias("range"))
    before = F.struct(F.lit(True).alias("guard"), F.lit(False).alias("wraps"), (F.col("__place") - 1).alias("range"))
    wrap = F.struct(F.lit(True).alias("guard"), F.lit(True).alias("wraps"), F.lit(last).alias("range"))
    copies = F.when(F.col("__id") == F.lit(seen["top"]), F.array(own, wrap)).when(F.array_contains(bounds, F.col("__id")), F.array(own, before)).otherwise(F.array(own))
    dealt = rows.withColumn("__place", place).withColumn("__as", F.explode(copies)).select(id_col, "__id", "text", F.col("__as.guard").alias("__guard"), F.col("__as.wraps").alias("__wraps"), F.col("__as.range").alias("__range"))
    dealt = dealt.repartition(partitions(spark), "__range").withColumn(name, value(F.col("text")))
    ahead = Window.partitionBy("__range").orderBy(F.col("__wraps"), F.col("__id").desc(), F.col("text"))
    out = dealt.withColumn("next_text", F.lead("text").over(ahead)).withColumn(f"next_{name}", F.lead(name).over(ahead))
    return out.where(~F.col("__guard")).drop("__guard", "__wraps", "__range", "__id")


def fingerprinted_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit, whose last third comes from the next document."""
    rows = with_next(docs, anchors, "found", id_col=id_col, text_col=text_col).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.withColumn("__edited", edited).withColumn("__found", anchors(F.col("__edited")))
    return rows.select(
        id_col,
        "n_chars",
        F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("found")).alias("fingerprint"),
        as_string(F.col("__found")).alias("edited_fingerprint"),
        likeness(F.col("found"), F.col("__found")).alias("near_edited"),
        likeness(F.col("found"), F.col("next_found")).alias("near_next"),
    )
