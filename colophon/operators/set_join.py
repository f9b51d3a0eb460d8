"""Pairs of word sets whose Jaccard similarity is above a threshold, within clusters.

Words are put in order of frequency, rare ones first; two sets above the
threshold share a word of their prefixes, so only prefixes are joined, with
filters on length and place, and every proposed pair is verified once.  Equal
sets of a cluster are one class: however many items share a title, it is joined
once.  A word that every title has is last in every order and proposes nothing
unless a title consists of such words only.

Edge cases: null and blank titles have no words and no pair; repeated words count
once; items of one class have similarity 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.functions.scratch import cut
from colophon.functions.text import tokens

_EPS = 1e-9


def ordered_sets(items: DataFrame, text: str, by: list[str]) -> DataFrame:
    """(``by``..., words): the different words of each item, the rarest of all items first; items without words are left out."""
    flat = items.select(*by, F.explode(tokens(F.col(text))).alias("word"))
    frequency = flat.groupBy("word").agg(F.count("*").alias("n"))
    placed = F.transform(F.sort_array(F.collect_list(F.struct("n", "word"))), lambda w: w["word"])
    return flat.join(frequency, "word").groupBy(*by).agg(placed.alias("words"))


def _least_common(n: Column, m: Column, threshold: float) -> Column:
    return F.ceil(threshold / (1 + threshold) * (n + m) - _EPS)


def similar_classes(classes: DataFrame, threshold: float) -> DataFrame:
    """(cluster, a, b, score): pairs a < b of classes (cluster, key, words) above the threshold."""
    prefix = F.slice("words", F.lit(1), (F.size("words") - F.ceil(threshold * F.size("words") - _EPS) + 1).cast("int"))
    p = classes.select("cluster", "key", F.size("words").alias("n"), F.posexplode(prefix).alias("at", "word"))
    q = p.select("cluster", "word", F.col("key").alias("b"), F.col("n").alias("m"), F.col("at").alias("bt"))
    near = (F.col("key") < F.col("b")) & (F.col("n") >= threshold * F.col("m") - _EPS) & (F.col("m") >= threshold * F.col("n") - _EPS)
    enough = 1 + F.least(F.col("n") - F.col("at"), F.col("m") - F.col("bt")) - 1 >= _least_common(F.col("n"), F.col("m"), threshold)
    met = p.join(q, ["cluster", "word"]).where(near & enough).select("cluster", F.col("key").alias("a"), "b").distinct()
    words = lambda k, name: classes.select("cluster", F.col("key").alias(k), F.col("words").alias(name))
    both = met.join(words("a", "x"), ["cluster", "a"]).join(words("b", "y"), ["cluster", "b"])
    common = F.size(F.array_intersect("x", "y"))
    return both.withColumn("score", common / (F.size("x") + F.size("y") - common)).where(F.col("score") > threshold).select("cluster", "a", "b", "score")


def _classes(items: DataFrame, text: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Items with the number of their class, and the classes of each cluster; both stored. ``by`` goes with every word: let it be short."""
    sets = cut(ordered_sets(items, text, by).withColumn("digest", F.sha2(F.to_json("words").cast("binary"), 256)))
    classes = cut(sets.groupBy("cluster", "digest").agg(F.first("words").alias("words")).withColumn("key", F.monotonically_increasing_id()))
    keyed = cut(sets.select(*by, "digest").join(classes.select("cluster", "digest", "key"), ["cluster", "digest"]).select(*by, "key"))
    return keyed, classes.select("cluster", "key", "words")


def fuzzy_pairs(titles: DataFrame, threshold: float, title: str = "title") -> DataFrame:
    """(title_a, title_b, score) of different titles, title_a < title_b. Titles with the same words are a pair each."""
    numbered = cut(titles.select(F.col(title).alias("title")).where("title is not null").distinct().select(F.lit(0).alias("cluster"), "title", F.monotonically_increasing_id().alias("item")))
    items, classes = _classes(numbered, "title", ["cluster", "item"])
    score = cut(similar_classes(classes, threshold).select("a", "b", "score"))
    # Pairs are numbers until the last joins, which make the result's columns.
    item = lambda k, name: items.select(F.col("key").alias(k), F.col("item").alias(name))
    found = score.join(item("a", "i"), "a").join(item("b", "j"), "b").select("i", "j", "score")
    if threshold < 1:
        found = found.union(item("a", "i").join(item("a", "j"), "a").where("i < j").select("i", "j", F.lit(1.0).alias("score")))
    t, u = numbered.select(F.col("item").alias("i"), F.col("title").alias("t")), numbered.select(F.col("item").alias("j"), F.col("title").alias("u"))
    return found.join(t, "i").join(u, "j").select(F.least("t", "u").alias("title_a"), F.greatest("t", "u").alias("title_b"), "score")


def best_pairs(candidates: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(cluster, first, second, score): the most similar two titles of each cluster above the threshold; of equal ones the pair that comes first."""
    items, classes = _classes(candidates.select("cluster", "ordinal", "title").distinct(), "title", ["cluster", "ordinal"])
    # The least ordinals of a class stand for it: any other pair of the same score comes later.
    least = items.groupBy("cluster", "key").agg(F.min("ordinal").alias("o"))
    second = items.join(least, ["cluster", "key"]).where("ordinal > o").groupBy("cluster", "key").agg(F.min("o").alias("first"), F.min("ordinal").alias("second"))
    o = lambda k, name: least.select("cluster", F.col("key").alias(k), F.col("o").alias(name))
    across = similar_classes(classes, threshold).join(o("a", "p"), ["cluster", "a"]).join(o("b", "q"), ["cluster", "b"]).select("cluster", F.least("p", "q").alias("first"), F.greatest("p", "q").alias("second"), "score")
    found = across.union(second.select("cluster", "first", "second", F.lit(1.0).alias("score"))) if threshold < 1 else across
    return found.groupBy("cluster").agg(F.min_by(F.struct("first", "second", "score"), F.struct(-F.col("score"), "first", "second")).alias("best")).select("cluster", "best.*")
