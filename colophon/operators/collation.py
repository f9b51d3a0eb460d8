"""Positional collation of witnesses, and the proofs and checks around translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.functions.scratch import cut
from colophon.functions.text import IAST, SOURCE_LETTERS, squeeze
from colophon.operators.containment import contained, possible


def witness_tokens(readings: DataFrame) -> DataFrame:
    """(work_id, siglum, position, token): white-space tokens by place; of two readings of one siglum the later wins at each place."""
    words = F.filter(F.split(squeeze(F.coalesce("text", F.lit(""))), " "), lambda w: w != "")
    flat = readings.select("work_id", "siglum", "ordinal", F.posexplode(words).alias("position", "token"))
    return flat.groupBy("work_id", "siglum", "position").agg(F.max_by("token", "ordinal").alias("token"))


def collate(tokens: DataFrame) -> DataFrame:
    """Per position: number of witnesses and of different tokens, and the consensus (most frequent, then least)."""
    votes = tokens.groupBy("work_id", "position", "token").agg(F.count("*").alias("n"))
    out = votes.groupBy("work_id", "position").agg(F.sum("n").alias("n_witnesses"), F.count("*").alias("n_tokens"), F.min_by("token", F.struct(-F.col("n"), "token")).alias("consensus"))
    return out.withColumn("is_variant", F.col("n_tokens") > 1)


def apparatus(collated: DataFrame, tokens: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` variant places of each work, with the reading of every siglum."""
    first = collated.where("is_variant").withColumn("place", F.row_number().over(Window.partitionBy("work_id").orderBy("position"))).where(F.col("place") <= n)
    read = tokens.groupBy("work_id", "position").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("siglum", "token")))).alias("readings"))  # one per siglum
    return first.join(read, ["work_id", "position"])


def collation_score(collated: DataFrame) -> DataFrame:
    """Variants, agreements and 1 - variants / places of each work."""
    v = F.count_if("is_variant")
    return collated.groupBy("work_id").agg(F.count("*").alias("n_places"), v.alias("n_variants"), (F.count("*") - v).alias("n_consensus"), (1 - F.try_divide(v.cast("double"), F.count("*"))).alias("score"))


#: Technical terms and the renderings that a translation may use beside them.
GLOSSARY = {
    "śiva": ("Shiva", "Śiva"),
    "śakti": ("Shakti", "Śakti"),
    "brahman": ("Brahman",),
    "ātman": ("Atman", "Ātman"),
    "dharma": ("Dharma",),
    "karman": ("Karma", "Karman"),
    "saṃsāra": ("Samsara", "Saṃsāra"),
    "mokṣa": ("Moksha", "Mokṣa"),
    "nirvāṇa": ("Nirvana", "Nirvāṇa"),
    "yoga": ("Yoga",),
    "tantra": ("Tantra",),
    "mantra": ("Mantra",),
    "yantra": ("Yantra",),
    "kuṇḍalinī": ("Kundalini", "Kuṇḍalinī"),
    "cakra": ("Chakra", "Cakra"),
    "prāṇa": ("Prana", "Prāṇa"),
    "pramāṇa": ("Pramana", "Pramāṇa"),
    "darśana": ("Darshana", "Darśana"),
    "vedānta": ("Vedanta", "Vedānta"),
    "nyāya": ("Nyaya", "Nyāya"),
    "vaiśeṣika": ("Vaisheshika", "Vaiśeṣika"),
    "mīmāṃsā": ("Mimamsa", "Mīmāṃsā"),
    "sāṃkhya": ("Samkhya", "Sāṃkhya"),
}


def alpha_tokens(text: Column, source: bool = False) -> Column:
    letters = "a-z" + (SOURCE_LETTERS if source else "")
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"([{letters}]+)"), F.lit(1)))


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def _violations(translation: Column, glossary: dict[str, tuple[str, ...]]) -> Column:
    """Terms that the translation has without any of their renderings."""
    low = F.lower(F.coalesce(translation, F.lit("")))
    without = lambda accepted: ~F.exists(F.array(*[F.lit(a.lower()) for a in accepted]), lambda a: F.contains(low, a))
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t.lower())) & without(a), F.lit(t)) for t, a in glossary.items()]))


def prove(pairs: DataFrame, glossary: dict[str, tuple[str, ...]] = GLOSSARY) -> DataFrame:
    """Three checks of a source and its translation, and the verdict that all pass.

    Binding: more than 0.1 of the source's words are in the translation.  Terms:
    none without a rendering.  Coverage: more than 0.3 words of translation per
    word of source.  Shares are rounded to three digits, half to even.  With a
    column ``gold``, ``semantic``: the share of its words that the translation has.
    """
    src, out = alpha_tokens(F.col("source"), True), alpha_tokens(F.col("translation"))
    words = lambda c: F.filter(F.split(squeeze(F.coalesce(c, F.lit(""))), " "), lambda w: w != "")
    n_source, matched = F.size(src), F.size(F.array_intersect(src, out))
    binding, coverage = _share(matched, n_source), _share(F.size(words(F.col("translation"))), F.size(words(F.col("source"))))
    sha = lambda c: F.substring(F.sha2(F.col(c).cast("binary"), 256), 1, 16)
    done = pairs.withColumns({
        "n_source_tokens": n_source, "n_matched": matched, "__binding": binding, "violations": _violations(F.col("translation"), glossary),
        "n_padas": F.size(F.regexp_extract_all(F.coalesce("source", F.lit("")), F.lit(r"\|\|\s*\d+\s*\|\|"), F.lit(0))), "n_words": F.size(words(F.col("translation"))), "__coverage": coverage,
        "source_sha": sha("source"), "translation_sha": sha("translation"),
    })
    if "gold" in pairs.columns:
        gold = F.array_distinct(words(F.lower("gold")))
        done = done.withColumn("semantic", F.when(F.col("gold") != "", F.bround(_share(F.size(F.array_intersect(gold, words(F.lower("translation")))), F.size(gold)), 3)))
    passed = (F.col("__binding") > 0.1) & (F.size("violations") == 0) & (F.col("__coverage") > 0.3)
    return done.withColumn("binding", F.bround("__binding", 3)).withColumn("coverage", F.bround("__coverage", 3)).withColumn("verdict", F.when(passed, "PASS").otherwise("FAIL")).drop("__binding", "__coverage")


def term_violations(pairs: DataFrame, glossary: DataFrame) -> DataFrame:
    """(id, term): the translation has the term and none of its renderings, for a glossary of any length in a table.

    Terms and renderings are looked up together, in letters of one case; a null translation has no term.  A term that the
    glossary lists twice is violated where any of its entries is.
    """
    rows = cut(pairs.select("id", F.lower("translation").alias("text")).withColumn("row", F.monotonically_increasing_id()))
    entries = cut(glossary.select("term", F.lower("term").alias("low"), F.transform("renderings", lambda r: F.lower(r)).alias("renderings")).withColumn("entry", F.monotonically_increasing_id()))
    wanted = entries.select("low").union(entries.select(F.explode("renderings").alias("low"))).distinct()
    has = cut(contained(rows, wanted, term="low"))
    found = has.join(entries.select("entry", F.col("low").alias("term")), "term").select("row", "entry")
    rendered = has.join(entries.select("entry", F.explode(F.array_distinct("renderings")).alias("term")), "term").select("row", "entry")
    bare = found.join(rendered, ["row", "entry"], "left_anti")
    return bare.join(entries.select("entry", "term"), "entry").join(rows.select("row", "id"), "row").select("row", "id", "term").distinct().select("id", "term")


def duplicate_hashes(table: DataFrame, text: str) -> DataFrame:
    return table.groupBy(F.sha2(F.col(text).cast("binary"), 256).alias("input_hash")).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def extractor_sanity(table: DataFrame, group: str, text: str) -> DataFrame:
    """Per group: rows, rows with a mark in the first 40 letters, and exact repeats; suspicious if too few or repeated."""
    marked = F.count_if(F.substring(F.lower(text), 1, 40).rlike(f"[{IAST[0]}äöüéèçñó]"))
    out = table.groupBy(group).agg(F.count("*").alias("n_rows"), marked.alias("n_marked"), (F.count("*") - F.countDistinct(text)).alias("n_repeats"))
    return out.withColumn("suspicious", (F.col("n_marked") < F.greatest(F.lit(1), F.floor(F.col("n_rows") / 2))) | (F.col("n_repeats") > 0))


def missed(curated: DataFrame, found: DataFrame) -> DataFrame:
    """Curated titles that neither contain nor are contained in a found title, whatever the case of their letters; each once."""
    left, right = cut(curated.select(F.lower("title").alias("title")).where("title is not null").distinct()), cut(found.select(F.lower("title").alias("title")).where("title is not null").distinct())
    holding = contained(left, possible(right, left, "title", "title"), "title", "title", "title").select(F.col("row").alias("title"))
    held = contained(right, left, "title", "title", "title").select(F.col("term").alias("title"))
    return left.join(holding.union(held), "title", "left_anti")


def source_binding(registry: DataFrame, verses: DataFrame) -> DataFrame:
    """Registered digests against recomputed ones: MATCH, MISMATCH or MISSING."""
    now = verses.select("object_id", F.sha2(F.col("text").cast("binary"), 256).alias("__now"))
    status = F.when(F.col("__now").isNull(), "MISSING").when(F.col("__now") == F.col("sha256"), "MATCH").otherwise("MISMATCH")
    return registry.join(now, "object_id", "left").select("object_id", status.alias("status"))
