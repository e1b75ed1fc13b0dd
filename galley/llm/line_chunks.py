"""Line deduplication by content-defined chunks of lines, in DataFrame operations only.

A rolling hash over the hashes of the last two lines closes a chunk after about one line in four, wherever the lines
stand in a document: text that is inserted or shifted moves no boundary beyond its neighbourhood.  Chunks of two or
more lines that occur again anywhere in the corpus are removed, all but the first occurrence, after their bytes have
been compared with the first one's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bound, cut

#: One in so many rolling hashes closes a chunk; chunks of fewer lines than MIN_LINES are never removed.
DIVISOR, MIN_LINES = 4, 2


def chunks_of(text: Column) -> Column:
    """The chunks of a text, each an array of its lines; null and empty texts have one chunk with one empty line."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    hashes = lambda ls: F.transform(ls, lambda t: F.conv(F.substring(F.md5(t), 1, 7), 16, 10).cast("long"))
    rolled = lambda hs: F.zip_with(hs, F.concat(F.array(F.lit(0).cast("long")), F.slice(hs, 1, F.size(hs) - 1)), lambda h, before: (h * 31 + before) % DIVISOR)
    closed = lambda hs: F.filter(F.transform(rolled(hs), lambda r, i: F.when(r == 0, i + 1)), lambda e: e.isNotNull())
    starts = lambda ends: F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1))

    def cut_at(ls: Column) -> Column:
        ends = F.array_distinct(F.array_append(bound(hashes(ls), closed), F.size(ls)))
        return bound(ends, lambda es: F.zip_with(starts(es), es, lambda a, b: F.slice(ls, a + 1, b - a)))

    return bound(lines, cut_at)


def _text(chunk: Column) -> Column:
    return F.array_join(chunk, "\n")


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> the same rows and columns with the repeated chunks cut out of ``text``, and
    ``n_lines, n_removed_lines, n_removed_chunks``.

    The first occurrence is the one of the least (doc_id, place in the document); repeats within a document count as
    well.  A text that loses everything becomes empty; a null text stays null.  Rows that share a doc_id count as one
    document, and a null doc_id as an id of its own.  Other columns stay, but for those by the names of the added ones; an
    empty table stays empty.
    """
    added = ("n_lines", "n_removed_lines", "n_removed_chunks")
    docs = docs.drop(*added)
    keyed = docs.select("doc_id", "text")
    hashed = F.filter(F.transform(chunks_of(F.col("text")), lambda c, i: F.struct(i.alias("at"), F.size(c).alias("n"), F.xxhash64(_text(c)).alias("hash"))), lambda s: s["n"] >= MIN_LINES)
    # hashes and places only, a few bytes a chunk: read twice below, so kept instead of hashing every text again
    seen = cut(keyed.select("doc_id", F.explode(hashed).alias("c")).select("doc_id", "c.at", "c.hash"))
    repeated = seen.groupBy("hash").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "at")).alias("first")).where("times > 1").drop("times")
    marked = seen.join(repeated, "hash").select("doc_id", "at", "hash", F.struct("doc_id", "at").eqNullSafe(F.col("first")).alias("is_first"))
    per_doc = marked.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set(F.struct("at", "hash", "is_first")).alias("marks"))
    met = keyed.join(per_doc.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id")), "left").where("marks is not null")
    marked_parts = lambda chunks: F.transform("marks", lambda m: F.struct(m["at"].alias("at"), m["hash"].alias("hash"), m["is_first"].alias("is_first"), _text(F.get(chunks, m["at"])).alias("part")))
    parts = met.select("doc_id", F.explode(bound(chunks_of(F.col("text")), marked_parts)).alias("m")).select("doc_id", "m.*")
    firsts = parts.where("is_first").groupBy("hash").agg(F.min("part").alias("kept_part"))
    gone = parts.where("not is_first").join(firsts, "hash").where("part = kept_part")
    # names that no table has by chance
    lost = gone.groupBy(F.col("doc_id").alias("__lost_id")).agg(F.collect_set("at").alias("__lost"))
    out = docs.join(lost.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__lost_id")), "left").drop("__lost_id")
    # chunks are made again only for documents that lose some
    chunks, touched = chunks_of(F.col("text")), F.col("__lost").isNotNull()
    left = F.flatten(F.filter(chunks, lambda c, i: ~F.array_contains("__lost", i)))
    out = out.withColumn("__left", F.when(touched, left)).withColumn("n_lines", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long"))
    return out.select(
        *[F.when(touched, _text(F.col("__left"))).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        "n_lines",
        F.when(touched, F.col("n_lines") - F.size("__left")).otherwise(0).cast("long").alias("n_removed_lines"),
        F.when(touched, F.size("__lost")).otherwise(0).cast("long").alias("n_removed_chunks"),
    )


ORACLE_SQL = r"""
WITH lined AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
hashed AS (SELECT doc_id, text, ls, [CAST('0x' || md5(x)[1:7] AS BIGINT) for x in ls] AS hs FROM lined),
ended AS (SELECT *, list_distinct(list_append(list_filter(range(1, len(ls) + 1), lambda i: (hs[i] * 31 + CASE WHEN i > 1 THEN hs[i - 1] ELSE 0 END) % 4 = 0), len(ls))) AS e0 FROM hashed),
sorted AS (SELECT doc_id, text, ls, list_sort(e0) AS es FROM ended),
chunks AS (SELECT doc_id, i AS place, ls[CASE WHEN i = 1 THEN 1 ELSE es[i - 1] + 1 END : es[i]] AS c FROM (SELECT *, unnest(range(1, len(es) + 1)) AS i FROM sorted)),
ranked AS (SELECT *, len(c) >= 2 AND row_number() OVER (PARTITION BY array_to_string(c, chr(10)), len(c) ORDER BY doc_id, place) > 1 AS gone FROM chunks)
SELECT doc_id, CAST(sum(len(c)) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN len(c) ELSE 0 END) AS BIGINT) AS n_removed_lines,
  CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed_chunks,
  coalesce(string_agg(array_to_string(c, chr(10)), chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS text
FROM ranked GROUP BY doc_id
"""
