"""Scalar functions on text as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of the scholarly transliteration and what they fold to.
IAST = ("āīūṛṝḷḹṃḥṅñṭḍṇśṣḻ", "aiurrllmhnntdnssl")
#: Letters of a source word in a proof.
SOURCE_LETTERS = "āīūṛṝḷḹṃṁñṅṇśṣṭḍḥ"
DEVANAGARI_DIGITS = ("०१२३४५६७८९", "0123456789")


def normalize_title(title: Column) -> Column:
    """Lower case, without leading article, trailing volume mark and punctuation, single spaces; null is empty."""
    x = F.lower(F.coalesce(title, F.lit("")))
    x = F.regexp_replace(x, r"(?U)^(the|a|an)\s+", "")
    x = F.regexp_replace(x, r"(?U)\s+(vol|volume|part|chapter)\s*\d*$", "")
    x = F.regexp_replace(x, r"(?U)[^\p{L}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def title_fingerprint(title: Column) -> Column:
    """16 hex digits of the sha256 of the first 100 letters, lower-cased and squeezed; empty for an empty title."""
    x = F.substring(squeeze(F.lower(F.coalesce(title, F.lit("")))), 1, 100)
    return F.when(x == "", "").otherwise(F.substring(F.sha2(x.cast("binary"), 256), 1, 16))


def biblio_fingerprint(title: Column, author: Column) -> Column:
    """16 hex digits over title and author; null without a title."""
    clean = lambda c: F.trim(F.lower(F.coalesce(c, F.lit(""))))
    return F.when(clean(title) != "", F.substring(F.sha2(F.concat(clean(title), F.lit("|"), clean(author)).cast("binary"), 256), 1, 16))


def tokens(text: Column) -> Column:
    """Distinct lower-case words at white space; empty array for null or blank."""
    x = squeeze(F.lower(F.coalesce(text, F.lit(""))))
    return F.when(x == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(x, " ")))


def word_jaccard(a: Column, b: Column) -> Column:
    x, y = tokens(a), tokens(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def fold_iast(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(text), *IAST), "[^a-z0-9 ]", "")


def variant_titles(title: Column) -> Column:
    """The title and its spelling variants, without repeats."""
    sw = F.regexp_replace(title, "sv", "sw")
    return F.array_distinct(F.array(title, sw, F.when(F.contains(title, F.lit("isvarapratyabhij")), F.lit("iswarapratyabhijna")).otherwise(title)))


def normalize_sanskrit(text: Column, dandas: bool = True) -> Column:
    """Trim, squeeze, digits to ASCII, dandas to a bar. Composition of marks: see ``functions.udfs.nfc``."""
    x = squeeze(F.translate(text, *DEVANAGARI_DIGITS))
    return F.translate(x, "॥।", "||") if dandas else x


def shingles(text: Column, k: int = 3) -> Column:
    """All runs of k letters, with repeats; none if the text is shorter."""
    runs = F.transform(F.array(F.split(text, "")), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - k), lambda i: F.concat(*[F.get(c, i + j) for j in range(k)])))[0]
    return F.when(F.char_length(text) >= k, runs).otherwise(F.array().cast("array<string>"))


def prefix_suffix_hash(text: Column) -> Column:
    """Struct of 16 hex digits of the first and the last 100 letters, and the length."""
    h = lambda x: F.substring(F.sha2(x.cast("binary"), 256), 1, 16)
    return F.struct(h(F.substring(text, 1, 100)).alias("prefix_hash"), h(F.right(text, F.lit(100))).alias("suffix_hash"), F.char_length(text).alias("n_letters"))


def fp_similarity(a: Column, b: Column) -> Column:
    """0.4 for equal prefixes, 0.4 for equal suffixes, 0.2 times the ratio of lengths."""
    ratio = F.coalesce(F.try_divide(F.least(a["n_letters"], b["n_letters"]).cast("double"), F.greatest(a["n_letters"], b["n_letters"])), F.lit(0.0))
    same = lambda f: F.when(a[f] == b[f], 0.4).otherwise(0.0)
    return same("prefix_hash") + same("suffix_hash") + 0.2 * ratio


def resolution_label(confidence: Column) -> Column:
    return F.when(confidence >= 0.95, "same").when(confidence >= 0.8, "probably same").when(confidence >= 0.6, "possibly same").otherwise("unresolved")


def slugify(text: Column) -> Column:
    x = F.lower(F.trim(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")))
    x = F.substring(F.regexp_replace(x, " ", "_"), 1, 60)
    return F.when(x == "", "work").otherwise(x)


def edition_tier(title: Column, author: Column, scholars: list[str]) -> Column:
    """C for machine-made titles, A for a known scholar's, else B."""
    known = F.lit(False)
    for s in scholars:
        known = known | F.contains(F.lower(F.coalesce(author, F.lit(""))), F.lit(s.lower()))
    return F.when(F.lower(title).rlike(r"\b(ai|hypertuned|auto)\b"), "C").when(known, "A").otherwise("B")


def coverage_from_title(title: Column) -> Column:
    return F.when(F.lower(title).rlike("excerpt|selection|extract|volume 1|vol\\. 1|part 1"), "partial").otherwise("full")


def classify_file(name: Column) -> Column:
    return F.when(F.endswith(name, F.lit("_djvu.txt")), "ocr_text").when(F.endswith(name, F.lit(".pdf")), "pdf").when(F.endswith(name, F.lit("_abbyy.gz")), "ocr_xml").otherwise("other")


def pick_language(languages: Column, title: Column) -> Column:
    """English before French, Hindi and German where listed; else by a word in the title."""
    out = F.when(F.lower(title).rlike(r"\benglish\b|translat"), "eng").otherwise("und")
    for code in ("ger", "hin", "fre", "eng"):
        out = F.when(F.array_contains(languages, code), code).otherwise(out)
    return out


def title_guard(work_title: Column, result_title: Column) -> Column:
    """Whether a long word of the work (5 letters or more), or its whole title without spaces, is in the result."""
    work, result = fold_iast(work_title), fold_iast(result_title)
    whole = F.regexp_replace(work, " ", "")
    by_word = F.exists(F.split(work, " "), lambda t: (F.char_length(t) >= 5) & F.contains(result, t))
    return by_word | ((F.char_length(whole) >= 8) & F.contains(F.regexp_replace(result, " ", ""), whole))


def epistemic_kind(verified: Column, derived: Column, observed: Column) -> Column:
    return F.when(verified, "VERIFIED").when(derived, "DERIVED").when(observed, "OBSERVED").otherwise("DECLARED")


def iso_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def prefixed_id(prefix: str, *keys: Column) -> Column:
    """A deterministic id: prefix and 32 hex digits of the keys' sha256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\u001f", *keys).cast("binary"), 256), 1, 32))


ANCHOR_SELECTOR = "struct<type:string,start:bigint,end:bigint,exact:string,prefix:string,suffix:string,xpath:string,xml_id:string>"


def text_anchor(source: Column, passage: Column, start: Column | None = None, end: Column | None = None, xpath: Column | None = None, xml_id: Column | None = None) -> Column:
    """A passage of a source by several selectors: positions, a quote, a path and an element id, each where it is given.

    The quote has the passage's first 100 letters, and its own first and last 20 letters if it has more than 20.  The digest
    is that of the passage; a null passage counts as empty.
    """
    text, null = F.coalesce(passage, F.lit("")), F.lit(None)
    part = lambda c: F.when(F.char_length(text) > 20, c).otherwise("")
    given = lambda c: null.cast("string") if c is None else c

    def selector(kind: str, when: Column, **values: Column) -> Column:
        names = ("start", "end", "exact", "prefix", "suffix", "xpath", "xml_id")
        return F.when(when, F.struct(F.lit(kind).alias("type"), *[values.get(n, null).alias(n) for n in names]).cast(ANCHOR_SELECTOR))

    low, high = (null.cast("long") if c is None else c for c in (start, end))
    selectors = F.array_compact(F.array(
        selector("TextPosition", low.isNotNull() & high.isNotNull(), start=low, end=high),
        selector("TextQuote", text != "", exact=F.substring(text, 1, 100), prefix=part(F.substring(text, 1, 20)), suffix=part(F.right(text, F.lit(20)))),
        selector("XPath", given(xpath) != "", xpath=given(xpath)),
        selector("XmlId", given(xml_id) != "", xml_id=given(xml_id)),
    ))
    digest = F.struct(F.lit("sha256").alias("algorithm"), F.sha2(text.cast("binary"), 256).alias("value"), F.lit("hex").alias("encoding"), null.cast("string").alias("canonicalization"))
    key = F.concat_ws("\u001f", source, F.to_json(selectors), digest["value"])
    return F.struct(prefixed_id("PTANC_", key).alias("id"), source.alias("source_artifact_id"), selectors.alias("selectors"), digest.alias("source_digest"), null.cast("string").alias("normalization_profile"))
