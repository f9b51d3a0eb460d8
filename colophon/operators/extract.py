"""Text extraction: links of HTML pages, verses of plain text, and TEI documents."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def html_links(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """On-site links of each page in order, first of each address: no fragments, queries or assets; tags stripped from the label."""
    pattern = r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
    pairs = F.arrays_zip(F.regexp_extract_all(F.col(html_col), F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all(F.col(html_col), F.lit(pattern), F.lit(2)).alias("label"))
    flat = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("base"), F.posexplode(pairs).alias("ordinal", "link")).select("id", "base", "ordinal", "link.href", "link.label")
    host = F.regexp_extract("base", r"^(https?://[^/]+)", 1)
    full = F.when(F.startswith("href", F.lit("/")), F.concat(host, F.col("href"))).otherwise(F.col("href"))
    kept = flat.withColumn("url", full).where((F.col("url").rlike("^https?://")) & F.startswith("url", host) & ~F.col("url").rlike(r"[#?]|\.(css|js|png|jpg|jpeg|gif|svg|ico|pdf)$"))
    first = F.row_number().over(Window.partitionBy("id", "url").orderBy("ordinal"))
    text = F.trim(F.regexp_replace(F.regexp_replace("label", "<[^>]*>", ""), r"\s+", " "))
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return kept.withColumn("__k", first).where("__k = 1").select("id", "ordinal", "url", text.alias("label"))


def iast_verses(lines: DataFrame, text: str = "line") -> DataFrame:
    """Lines that end in a numbered double bar and have a mark in their first 40 letters, without the number."""
    number = r"[|]{2}\s*\d+(?:/\d+)?\s*[|]{2}\s*$"
    return lines.where(F.col(text).rlike(number) & F.substring(F.lower(text), 1, 40).rlike("[āīūṛṝḷṃḥṅñṭḍṇśṣ]")).withColumn("verse", F.trim(F.regexp_replace(text, number, "")))


def devanagari_verses(lines: DataFrame, text: str = "line") -> DataFrame:
    """Lines that end in a double danda, with eight letters of the script or more, without dandas and number."""
    body = F.trim(F.regexp_replace(text, r"॥\s*[०-९0-9]*\s*॥?\s*$", ""))
    return lines.where(F.rtrim(F.col(text)).rlike("॥$")).withColumn("verse", body).where(F.char_length(F.regexp_replace("verse", r"[^ऀ-ॿ]", "")) >= 8)


def is_sanskrit_line(line: Column) -> Column:
    return F.char_length(F.regexp_replace(F.substring(F.lower(line), 1, 60), "[^āīūṛṝḷṃḥṅñṭḍṇśṣ]", "")) >= 3


def verse_rows(verses: DataFrame) -> DataFrame:
    """(work, ordinal, verse) to numbered objects; of equal verses of a work the first stays, numbers keep their gaps."""
    first = F.row_number().over(Window.partitionBy("work", "verse").orderBy("ordinal"))
    kept = verses.withColumn("__k", first).where("__k = 1")
    return kept.select(F.concat("work", F.lit(":v"), F.col("ordinal").cast("string")).alias("object_id"), "work", "ordinal", "verse", F.sha2(F.col("verse").cast("binary"), 256).alias("sha256"))


def tei_header(table: DataFrame, xml: str = "xml") -> DataFrame:
    one = lambda path: F.xpath_string(F.col(xml), F.lit(path))
    element = lambda name: f"//*[local-name()='{name}']"
    return table.select(
        "*", one(element("title")).alias("title"), one(element("author")).alias("author"), one(element("language") + "/@ident").alias("language"), one(element("licence") + "/@target").alias("licence"),
        one(element("publisher")).alias("publisher"), one(element("date") + "/@when-iso").alias("date"),
    )


_ID = "{http://www.w3.org/XML/1998/namespace}id"


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _words(e: ET.Element) -> str:
    return " ".join(" ".join(e.itertext()).split())


def _walk(make, columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, xml in zip(batch["id"], batch["xml"]):
                try:
                    root = ET.fromstring(xml)
                except (ET.ParseError, TypeError):
                    continue
                rows += [(key, k, *r) for k, r in enumerate(make(root))]
            yield pd.DataFrame(rows, columns=columns)

    return run


def tei_body(table: DataFrame) -> DataFrame:
    """One row per ``div`` in document order (inner ones also inside their outer ones): type, id and text. Broken XML gives none."""
    make = lambda root: [(e.get("type") or "section", e.get(_ID), _words(e)) for e in root.iter() if _name(e) == "div"]
    return table.select("id", "xml").mapInPandas(_walk(make, ["id", "ordinal", "kind", "xml_id", "text"]), "id string, ordinal int, kind string, xml_id string, text string")


def tei_apparatus(table: DataFrame) -> DataFrame:
    """One row per reading of each ``app``: lemma, witness and text."""

    def make(root):
        for app in (e for e in root.iter() if _name(e) == "app"):
            lemma = next((_words(e) for e in app if _name(e) == "lem"), "")
            yield from ((lemma, e.get("wit") or "", _words(e)) for e in app if _name(e) == "rdg")

    return table.select("id", "xml").mapInPandas(_walk(make, ["id", "ordinal", "lemma", "witness", "text"]), "id string, ordinal int, lemma string, witness string, text string")


def tei_witnesses(table: DataFrame) -> DataFrame:
    make = lambda root: [(e.get(_ID) or e.get("n") or "", _words(e)) for e in root.iter() if _name(e) == "witness"]
    return table.select("id", "xml").mapInPandas(_walk(make, ["id", "ordinal", "siglum", "description"]), "id string, ordinal int, siglum string, description string")


def tei_verses(table: DataFrame, element: str = "l") -> DataFrame:
    make = lambda root: [(_words(e),) for e in root.iter() if _name(e) == element and _words(e)]
    return table.select("id", "xml").mapInPandas(_walk(make, ["id", "ordinal", "verse"]), "id string, ordinal int, verse string")
