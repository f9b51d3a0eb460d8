"""Line deduplication: lines that many documents share stay in the first of them only.

Every text is split at line feeds.  A line's key is the line without ASCII white
space at both ends, A-Z in lower case.  Keys are known by 128 bits of hash.  A
first pass explodes the keyed lines to slim rows (document, place, hash) and
stores them; the distinct documents of each hash are counted with partial sums
before each shuffle; hashes of at least ``documents`` documents lose their lines
everywhere but in the document with the least id.  The places to drop are
gathered per text and the rest of its lines are put together again by place, as
slices between dropped places, so a text costs linear time however many lines
it loses.  No text leaves its row, and no Python worker runs.

A frequent line is one hash with many slim rows: they are counted before they are
shuffled, and the join with the counted hashes is a plain shuffled join that
adaptive execution splits.

Edge cases: a null or empty text is one empty line; keys shorter than ``least``
code points never count; rows with one id are one document, whatever their texts,
and rows without an id are together one document, the last; repeated rows lose
the same lines; an empty table gives an empty result; further columns pass
through under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.llm.storage import drop_stored, named, stored

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space around it; only A-Z change case (``lower`` does just that where all letters are ASCII)."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _hashes(value: Column, names: tuple[str, str]) -> list[Column]:
    """128 bits: two 64-bit hashes, the second from another seed."""
    return [F.xxhash64(value).alias(names[0]), F.xxhash64(F.lit(1), value).alias(names[1])]


def keyed_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 10) -> DataFrame:
    """(id, t1, t2, at, h1, h2): the hash of each line whose key is long enough, its place, and its text's hash."""
    text = F.coalesce(named(text_col), F.lit(""))
    each = docs.select(named(id_col).alias("id"), *_hashes(text, ("t1", "t2")), F.posexplode(lines_of(text)).alias("at", "line"))
    keyed = each.select("id", "t1", "t2", "at", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least)
    return keyed.select("id", "t1", "t2", "at", *_hashes(F.col("key"), ("h1", "h2")))


def shared_lines(lines: DataFrame, documents: int = 2) -> DataFrame:
    """(h1, h2, first): hashes that at least so many documents hold, and the least id among them."""
    counted = lines.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count_distinct("id").alias("known"), F.max(F.col("id").isNull().cast("int")).alias("unknown"))
    return counted.where(F.col("known") + F.col("unknown") >= documents).select("h1", "h2", "first")


def dropped_places(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 10, documents: int = 2) -> DataFrame:
    """(id, t1, t2, places): the ascending places of the lines that a text of a document loses, where it loses any."""
    lines = stored(keyed_lines(docs, id_col=id_col, text_col=text_col, least=least), "lines")
    shared = stored(shared_lines(lines, documents), "shared")
    lost = lines.join(shared, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("first")))
    out = stored(lost.groupBy("id", "t1", "t2").agg(F.sort_array(F.collect_set("at")).alias("places")), "places")
    drop_stored(lines, shared)
    return out


def kept_lines(lines: Column, places: Column) -> Column:
    """The lines between the dropped places, by slices: a place is looked at once."""
    edges = F.concat(F.array(F.lit(-1)), places, F.array(F.size(lines)))
    between = F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda k: F.slice(lines, F.get(edges, k - 1) + 2, F.get(edges, k) - F.get(edges, k - 1) - 1))
    return F.when(places.isNull(), lines).otherwise(F.flatten(between))


def _with_places(docs: DataFrame, id_col: str, text_col: str, least: int, documents: int) -> DataFrame:
    """(row, lines, places): each row whole, its lines, and what it loses (null: nothing)."""
    places = dropped_places(docs, id_col=id_col, text_col=text_col, least=least, documents=documents).select(F.col("id").alias("__id"), F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), "places")
    text = F.coalesce(named(text_col), F.lit(""))
    rows = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("row"), named(id_col).alias("id"), *_hashes(text, ("t1", "t2")))
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("t1") == F.col("__t1")) & (F.col("t2") == F.col("__t2"))
    return rows.join(places, same, "left").select("row", "id", lines_of(F.col("row").getField(text_col)).alias("lines"), "places")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 10, documents: int = 2) -> DataFrame:
    """``docs`` without the shared lines; null texts stay null, and all other columns are as they were."""
    kept = F.array_join(kept_lines(F.col("lines"), F.col("places")), "\n")
    field = F.col("row").getField
    out = [F.when(field(c).isNotNull(), kept).alias(c) if c == text_col else field(c).alias(c) for c in docs.columns]
    return _with_places(docs, id_col, text_col, least, documents).select(*out)


def line_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 10, documents: int = 2) -> DataFrame:
    """(id, n_lines, n_dropped, kept_sha256) of each row."""
    kept = F.array_join(kept_lines(F.col("lines"), F.col("places")), "\n")
    return _with_places(docs, id_col, text_col, least, documents).select(
        F.col("id").alias(id_col),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(kept.cast("binary"), 256).alias("kept_sha256"),
    )


#: The report in DuckDB's SQL, over a table whose ids are distinct.
REPORT_SQL = """
WITH line AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place FROM documents
), keyed AS (
    SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line
), shared AS (
    SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (first IS NOT NULL AND first <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (first IS NULL OR first = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN shared USING (key) GROUP BY doc_id
"""
