"""Coverage, completeness, availability and what follows from gaps. Facts are aggregated once per work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The twelve dimensions in their fixed order, and the action asked for where one is missing.
ACTIONS = {
    "identity": None, "author": "search for author", "title": None, "language": "detect language", "date": "search for date", "tradition": None, "text": "search for e-text",
    "translation": "search for translation", "edition": "search for edition", "manuscript": "search for manuscript", "digital": None, "scholarship": "search for scholarship",
}
#: Providers to ask about a gap; dimensions not listed go to OPENALEX.
PROVIDERS = {"author": "PANDIT", "text": "GRETIL", "manuscript": "SANSKRITREE", "translation": "ARCHIVE_ORG", "edition": "ARCHIVE_ORG", "scholarship": "CROSSREF"}


def fact_counts(works: DataFrame, assertions: DataFrame, external_ids: DataFrame) -> DataFrame:
    """One row per work: distinct literals by predicate (a null literal counts), identifiers by scheme."""
    predicates, schemes = ("AUTHOR", "TITLE", "LANGUAGE", "DATE", "TRADITION"), ("GRETIL", "ARCHIVE_ORG", "PANDIT", "DARSHANA", "SANSKRITREE", "DOI")
    facts = assertions.groupBy("subject_id", "predicate_uri", "literal").agg(F.lit(1).alias("one"))
    facts = facts.groupBy(F.col("subject_id").alias("id")).agg(
        *[F.count_if(F.col("predicate_uri") == p).alias(f"n_{p}") for p in predicates], F.count("*").alias("n_facts"), F.max(F.contains(F.lower("literal"), F.lit("translation")).cast("int")).alias("speaks_of_translation")
    )
    ids = external_ids.groupBy(F.col("entity_id").alias("id")).agg(*[F.count_if(F.col("scheme") == s).alias(f"c_{s}") for s in schemes], F.count("*").alias("n_ids"))
    return works.select("id").join(facts, "id", "left").join(ids, "id", "left").na.fill(0)


def _state(*cases: tuple[Column, str, float]) -> tuple[Column, Column]:
    state, confidence = F.lit("UNKNOWN"), F.lit(0.3)
    for test, name, sure in reversed(cases):
        state, confidence = F.when(test, name).otherwise(state), F.when(test, sure).otherwise(confidence)
    return state, confidence


def coverage(counts: DataFrame) -> DataFrame:
    """Long form: one row per work and dimension with state, confidence, evidence and next action."""
    c = F.col
    some = lambda x: c(x) > 0
    many = lambda p, sure: ((c(f"n_{p}") > 1, "MULTIPLE", sure), (c(f"n_{p}") == 1, "FULL", 0.9))
    known = {
        "identity": (_state((some("n_AUTHOR") & some("n_TITLE") & some("n_ids"), "REVIEWED", 0.95), (some("n_AUTHOR") & some("n_TITLE"), "FULL", 0.85), (some("n_ids"), "PARTIAL", 0.7)), c("n_facts") + c("n_ids")),
        "author": (_state(*many("AUTHOR", 0.8)), c("n_AUTHOR")),
        "title": (_state(*many("TITLE", 0.7)), c("n_TITLE")),
        "language": (_state((some("n_LANGUAGE"), "FULL", 0.9)), c("n_LANGUAGE")),
        "date": (_state((some("n_DATE"), "FULL", 0.8)), c("n_DATE")),
        "tradition": (_state((some("n_TRADITION"), "FULL", 0.8)), c("n_TRADITION")),
        "text": (_state((some("c_GRETIL"), "FULL", 0.9), (some("c_ARCHIVE_ORG"), "PARTIAL", 0.7)), c("c_GRETIL") + c("c_ARCHIVE_ORG")),
        "translation": (_state((some("speaks_of_translation"), "PARTIAL", 0.7)), c("speaks_of_translation")),
        "edition": (_state((some("c_PANDIT") | some("c_DARSHANA"), "PARTIAL", 0.7)), c("c_PANDIT") + c("c_DARSHANA")),
        "manuscript": (_state((some("c_SANSKRITREE") | some("c_ARCHIVE_ORG"), "PARTIAL", 0.7)), c("c_SANSKRITREE") + c("c_ARCHIVE_ORG")),
        "digital": (_state((some("n_ids"), "PARTIAL", 0.7)), c("n_ids")),
        "scholarship": (_state((some("c_DOI"), "PARTIAL", 0.7)), c("c_DOI")),
    }
    rows = [
        F.struct(
            F.lit(k).cast("int").alias("ordinal"), F.lit(d).alias("dimension"), s.alias("state"), sure.alias("confidence"), n.cast("long").alias("evidence_count"),
            (F.when(s == "UNKNOWN", ACTIONS[d]) if ACTIONS[d] else F.lit(None)).cast("string").alias("next_action"),
        )
        for k, (d, ((s, sure), n)) in enumerate(known.items())
    ]
    return counts.select("id", F.inline(F.array(*rows)))


def coverage_wide(counts: DataFrame) -> DataFrame:
    """One row per work with a struct per dimension."""
    return coverage(counts).groupBy("id").pivot("dimension", list(ACTIONS)).agg(F.first(F.struct("state", "confidence", "evidence_count", "next_action")))


def frontier(cover: DataFrame) -> DataFrame:
    """The dimensions that ask for an action, in their order."""
    return cover.where("next_action is not null").select("id", "ordinal", "dimension", "next_action")


def gap_actions(front: DataFrame) -> DataFrame:
    """A provider to ask and the words to ask with; author, title and text come first."""
    provider = F.lit("OPENALEX")
    for d, p in PROVIDERS.items():
        provider = F.when(F.col("dimension") == d, p).otherwise(provider)
    return front.select("id", "dimension", F.when(F.col("dimension").isin("author", "title", "text"), 1).otherwise(2).alias("priority"), provider.alias("provider"), F.concat(F.col("id"), F.lit(" "), F.col("dimension")).alias("query"))


def gap_discover(actions: DataFrame, one_in: int = 10, seed: int = 0) -> DataFrame:
    """The simulated tenth of the actions that find something: a checksum of the action decides, so reruns agree."""
    return actions.where(F.pmod(F.crc32(F.concat(F.lit(f"{seed}:"), F.col("id"), F.lit(":"), F.col("dimension")).cast("binary")), F.lit(one_in)) == 0)


def _per_work(table: DataFrame, key: str, *aggs) -> DataFrame:
    return table.groupBy(F.col(key).alias("id")).agg(*aggs)


def work_coverage(works: DataFrame, assertions: DataFrame, external_ids: DataFrame, editions: DataFrame, translations: DataFrame, witnesses: DataFrame, etexts: DataFrame) -> DataFrame:
    """Six counts and four states per work; each child is aggregated before it is joined."""
    out = works.select("id", "preferred_title")
    for table, key, name in ((assertions, "subject_id", "assertion"), (external_ids, "entity_id", "ext_id"), (editions, "work_id", "edition"), (translations, "work_id", "translation"), (witnesses, "work_id", "witness"), (etexts, "work_id", "etext")):
        out = out.join(_per_work(table, key, F.count("*").alias(f"{name}_count")), "id", "left")
    out = out.na.fill(0)
    return out.select(
        "id",
        F.when(F.coalesce("preferred_title", F.lit("")) != "", "RESOLVED").otherwise("UNRESOLVED").alias("identity"),
        F.when(F.col("etext_count") > 0, "ETEXT").when(F.col("edition_count") > 0, "CATALOG").otherwise("NONE").alias("source"),
        F.when(F.col("translation_count") > 0, "EXISTING").otherwise("NONE_KNOWN").alias("translation"),
        F.when(F.col("ext_id_count") > 0, "COMPLETE").otherwise("NONE").alias("bibliography"),
        *[f"{n}_count" for n in ("assertion", "ext_id", "edition", "translation", "witness", "etext")],
    )


def percent(part: Column, whole: Column) -> Column:
    """Unrounded percentage, 0 for an empty whole."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def coverage_stats(works: DataFrame, etexts: DataFrame, translations: DataFrame, external_ids: DataFrame) -> DataFrame:
    parts = [
        works.agg(F.count("*").alias("total"), F.count_if(F.coalesce("preferred_title", F.lit("")) != "").alias("resolved")),
        etexts.agg(F.countDistinct("work_id").alias("with_text")),
        translations.agg(F.countDistinct("work_id").alias("with_translation")),
        external_ids.agg(F.countDistinct("entity_id").alias("with_bibliography")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out.select("*", *[percent(F.col(c), F.col("total")).alias(f"{n}_rate") for c, n in (("resolved", "resolution"), ("with_text", "text"), ("with_translation", "translation"), ("with_bibliography", "bibliography"))])


def completeness(works: DataFrame, assertions: DataFrame, editions: DataFrame, etexts: DataFrame, translations: DataFrame, external_ids: DataFrame) -> DataFrame:
    """Ladders per work; a contested fact beats a title, DOI or OPENALEX make a complete bibliography."""
    flag = lambda test, name: F.max(test.cast("int")).alias(name)
    out = works.select("id", "preferred_title")
    out = out.join(_per_work(assertions, "subject_id", flag(F.col("lifecycle") == "DEPRECATED", "contested"), F.count("*").alias("assertion_count")), "id", "left")
    out = out.join(_per_work(editions, "work_id", F.count("*").alias("edition_count")), "id", "left").join(_per_work(etexts, "work_id", F.count("*").alias("etext_count")), "id", "left")
    out = out.join(_per_work(translations, "work_id", flag(F.col("completeness") == "FULL", "full"), flag(F.col("completeness") == "PARTIAL", "partial"), flag(F.col("completeness") == "MACHINE", "machine"), F.count("*").alias("translation_count")), "id", "left")
    out = out.join(_per_work(external_ids, "entity_id", flag(F.col("scheme").isin("DOI", "OPENALEX"), "scholarly"), F.count("*").alias("external_id_count")), "id", "left").na.fill(0)
    c = F.col
    return out.select(
        "id",
        F.when(c("contested") > 0, "CONTESTED").when(F.coalesce("preferred_title", F.lit("")) != "", "RESOLVED").otherwise("UNRESOLVED").alias("identity"),
        F.when((c("edition_count") > 0) & (c("etext_count") > 0), "ETEXT").when(c("edition_count") > 0, "CATALOG").otherwise("NONE").alias("source"),
        F.when(c("full") > 0, "EXISTING").when(c("partial") > 0, "PARTIAL").when(c("machine") > 0, "MACHINE").when(c("translation_count") > 0, "EXISTING").otherwise("NONE_KNOWN").alias("translation"),
        F.when(c("scholarly") > 0, "COMPLETE").when(c("external_id_count") > 0, "PARTIAL").otherwise("NONE").alias("bibliography"),
        "assertion_count", "edition_count", "translation_count", "external_id_count",
    )


def completeness_stats(table: DataFrame) -> DataFrame:
    n = F.count("*")
    rate = lambda test: F.coalesce(F.try_divide(F.count_if(test).cast("double"), n), F.lit(0.0))
    return table.agg(n.alias("total"), rate(F.col("identity") == "RESOLVED").alias("resolved_rate"), rate(F.col("source") != "NONE").alias("source_rate"), rate(F.col("translation") != "NONE_KNOWN").alias("translation_rate"))


def needs(table: DataFrame, only: str | None = None) -> DataFrame:
    """What a work still needs, as a list; works that need nothing (or not ``only``) are left out."""
    lacks = F.array_compact(
        F.array(F.when(F.col("identity") != "RESOLVED", "identity"), F.when(F.col("source") == "NONE", "source"), F.when(F.col("translation") == "NONE_KNOWN", "translation"), F.when(F.col("bibliography") == "NONE", "bibliography"))
    )
    out = table.select("id", lacks.alias("needs")).where(F.size("needs") > 0)
    return out if only is None else out.where(F.array_contains("needs", only))


def availability(works: DataFrame, translations: DataFrame, external_ids: DataFrame) -> DataFrame:
    """Best translation state overall and in English, and whether the work is catalogued anywhere known."""
    rank = F.when(F.col("completeness") == "FULL", 3).when(F.col("completeness") == "PARTIAL", 2).otherwise(1)
    best = _per_work(translations, "work_id", F.max(rank).alias("best"), F.max(F.when(F.col("language") == "eng", rank)).alias("english"), F.count("*").alias("n_translations"))
    listed = _per_work(external_ids.where(F.col("scheme").isin("GRETIL", "DOI", "OPENALEX")), "entity_id", F.lit(True).alias("has_bibliography"))
    name = lambda x: F.when(F.col(x) == 3, "FULL").when(F.col(x) == 2, "PARTIAL").when(F.col(x) == 1, "EXISTING").otherwise("NONE_KNOWN")
    return works.select("id").join(best, "id", "left").join(listed, "id", "left").select("id", name("best").alias("state"), name("english").alias("english_state"), F.coalesce("n_translations", F.lit(0)).alias("n_translations"), F.coalesce("has_bibliography", F.lit(False)).alias("has_bibliography"))
