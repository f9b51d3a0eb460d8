"""Catalogue queries: search, filters, sorts, groups, lookups and set operations over works and their facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORK = ("id", "preferred_title", "work_type")


def _page(hits: DataFrame, limit: int, after: tuple[str, str] | None = None) -> DataFrame:
    """First ``limit`` rows by (title, id) after a key, each with whether there are more. One top-k, no second job."""
    if after is not None:
        title, key = after
        hits = hits.where((F.col("preferred_title") > title) | ((F.col("preferred_title") == title) & (F.col("id") > key)))
    order = [F.col("preferred_title").asc_nulls_last(), F.col("id")]
    more = hits.orderBy(*order).limit(limit + 1)
    place = F.row_number().over(Window.orderBy(*order))  # over limit + 1 rows
    return more.withColumn("__place", place).withColumn("has_more", F.max("__place").over(Window.partitionBy()) > limit).where(F.col("__place") <= limit).drop("__place")


def search_hits(works: DataFrame, assertions: DataFrame, query: str) -> DataFrame:
    """Works whose title or any literal matches LIKE ``%query%`` without regard to case, once each.

    Two scans with the pattern pushed to each side; only the ids of matching
    facts are shuffled, never a work times its facts.
    """
    pattern = f"%{query.lower()}%"
    by_fact = assertions.where(F.lower("literal").like(pattern)).select(F.col("subject_id").alias("id"))
    by_title = works.where(F.lower("preferred_title").like(pattern)).select("id")
    return works.join(by_fact.union(by_title).distinct(), "id", "left_semi").select(*WORK)


def search_like(works: DataFrame, assertions: DataFrame, query: str, limit: int = 25, after: tuple[str, str] | None = None) -> DataFrame:
    """A page of ``search_hits`` with the total number of hits; ``after``: (title, id) of the page before's last row."""
    hits = search_hits(works, assertions, query)
    total = hits.agg(F.count("*").alias("total"))
    return _page(hits, limit, after).crossJoin(F.broadcast(total))  # one row


def search_literal(works: DataFrame, query: str) -> DataFrame:
    """Works whose title contains ``query`` as it is, without regard to case."""
    return works.where(F.contains(F.lower("preferred_title"), F.lower(F.lit(query)))).select(*WORK, F.lit(1.0).alias("score"))


def autocomplete(works: DataFrame, query: str, limit: int = 10) -> DataFrame:
    return works.where(F.lower("preferred_title").like(f"%{query.lower()}%")).orderBy(F.col("preferred_title").asc_nulls_last(), "id").limit(limit).select("id", "preferred_title")


def having(works: DataFrame, keys: DataFrame, wanted: bool | None) -> DataFrame:
    """Works that occur (or don't) among ``keys`` (one column ``id``); None asks nothing."""
    if wanted is None:
        return works
    return works.join(keys, "id", "left_semi" if wanted else "left_anti")


def filter_works(
    works: DataFrame, assertions: DataFrame, external_ids: DataFrame, translations: DataFrame, *, work_type: str | None = None, has_author: bool | None = None, has_scheme: tuple[str, bool] | None = None, has_translation: bool | None = None
) -> DataFrame:
    """All of the given conditions; the facts' sides become semi and anti joins."""
    out = works if work_type is None else works.where(F.col("work_type") == work_type)
    out = having(out, assertions.where("predicate_uri = 'AUTHOR'").select(F.col("subject_id").alias("id")), has_author)
    if has_scheme is not None:
        out = having(out, external_ids.where(F.col("scheme") == has_scheme[0]).select(F.col("entity_id").alias("id")), has_scheme[1])
    out = having(out, translations.select(F.col("work_id").alias("id")), has_translation)
    return out.select(*WORK)


def page(hits: DataFrame, limit: int = 25, after: tuple[str, str] | None = None) -> DataFrame:
    return _page(hits, limit, after)


def list_assertions(assertions: DataFrame, *, subject: str | None = None, predicate: str | None = None, lifecycle: str | None = None, asserted_by: str | None = None) -> DataFrame:
    """Facts under any of the four conditions; ``predicate`` matches anywhere in the predicate."""
    tests: list[Column] = []
    if subject is not None:
        tests.append(F.col("subject_id") == subject)
    if predicate is not None:
        tests.append(F.col("predicate_uri").like(f"%{predicate}%"))
    if lifecycle is not None:
        tests.append(F.col("lifecycle") == lifecycle)
    if asserted_by is not None:
        tests.append(F.col("asserted_by") == asserted_by)
    return assertions.where(reduce(lambda a, b: a & b, tests)) if tests else assertions


def resolve_title(works: DataFrame, titles: DataFrame) -> DataFrame:
    """For each row of ``titles`` (column ``query``): how many works bear it (case aside), and EXACT, AMBIGUOUS or NONE."""
    counted = works.groupBy(F.lower("preferred_title").alias("__t")).agg(F.count("*").alias("n_matches"), F.min("id").alias("first_id"))
    asked = titles.withColumn("__t", F.lower("query"))
    n = F.coalesce("n_matches", F.lit(0))
    status = F.when(n == 1, "EXACT").when(n > 1, "AMBIGUOUS").otherwise("NONE")
    return asked.join(counted, "__t", "left").select("query", n.alias("n_matches"), status.alias("status"), F.when(n == 1, F.col("first_id")).alias("match_id"))


def filter_expr(table: DataFrame, text: str) -> DataFrame:
    """The small filter language ``column:value,column:!value,column:a|b`` as pushed-down predicates."""
    for clause in filter(None, text.split(",")):
        column, _, value = clause.partition(":")
        negated = value.startswith("!")
        test = F.col(column).cast("string").isin(value.lstrip("!").split("|"))
        table = table.where(~test if negated else test)
    return table


def group_by_field(works: DataFrame, field: str) -> DataFrame:
    """Counts and least ids by value; a missing value counts as ``Unknown``."""
    return works.groupBy(F.coalesce(F.col(field).cast("string"), F.lit("Unknown")).alias("value")).agg(F.count("*").alias("n_works"), F.min("id").alias("first_id"))


def sort_works(works: DataFrame, key: str = "preferred_title", descending: bool = False) -> DataFrame:
    if key not in ("preferred_title", "id"):
        return works
    order = F.coalesce(F.col(key), F.lit(""))
    return works.orderBy(order.desc() if descending else order.asc(), F.col("id").asc())


def sample_by_hash(table: DataFrame, key: str, one_in: int, seed: int = 0) -> DataFrame:
    """About one row in ``one_in``, the same ones in every run: the key's checksum decides."""
    return table.where(F.pmod(F.crc32(F.concat(F.lit(f"{seed}:"), F.col(key)).cast("binary")), F.lit(one_in)) == 0)


def lookup(works: DataFrame, external_ids: DataFrame, scheme: str, value: str) -> DataFrame:
    """The work of one external identifier; of several, the least id."""
    keys = external_ids.where((F.col("scheme") == scheme) & (F.col("value") == value)).select(F.col("entity_id").alias("id"))
    return works.join(keys, "id", "left_semi").orderBy("id").limit(1).select(*WORK)


def batch_resolve(asked: DataFrame, works: DataFrame, external_ids: DataFrame) -> DataFrame:
    """For each (scheme, value) asked: the least matching work or null, and whether there is one. Incomplete pairs are dropped."""
    asked = asked.where("scheme is not null and value is not null")
    known = external_ids.join(asked.select("scheme", "value").distinct(), ["scheme", "value"], "left_semi").join(works.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    first = known.groupBy("scheme", "value").agg(F.min("entity_id").alias("work_id"))
    return asked.join(first, ["scheme", "value"], "left").withColumn("resolved", F.col("work_id").isNotNull())


def dedupe_first(table: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in ``order`` (a rank filter, which Spark also applies before its shuffle)."""
    return table.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def top_n(table: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return table.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def count_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its count."""
    parts = [t.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def upsert_last(old: DataFrame, new: DataFrame, key: str, changed: list[str], order: str) -> DataFrame:
    """New keys are added; of known ones only ``changed`` columns follow the last new row by ``order``."""
    last = new.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in new.columns if c not in (key, order)])
    updates = last.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in changed], F.lit(True).alias("__hit"))
    kept = old.join(updates, key, "left").select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in old.columns])
    return kept.unionByName(last.join(old.select(key), key, "left_anti").select(*old.columns))


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows of ``new`` with a key not yet there, the first by ``order`` of each, added to ``old``."""
    first = dedupe_first(new, key, [F.col(order)]).select(*old.columns)
    return old.unionByName(first.join(old.select(*key), key, "left_anti"))


def source_utility(table: DataFrame) -> DataFrame:
    """Gap value x expected yield x authority x rights x reach over cost; a cost of 0 gives null."""
    score = F.col("gap_value") * F.col("expected_yield") * F.col("authority") * F.col("rights_usability") * F.col("reach")
    return table.withColumn("utility", F.try_divide(score, F.col("cost")))
