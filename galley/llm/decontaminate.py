"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A benchmark item is cut into windows of consecutive words.  The shingles of a window are its pairs of neighbouring
words, in the order of their rarity in the corpus; containment needs every one of them, so the rarest is the necessary
prefix.  Shingles of the documents are joined to these; the shingle's place in the window fixes where the window would
start, which bounds it by the document's length; what is left is verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bound, lower_ascii, stored

#: Words of an item's window.
WINDOW = 10
#: Up to this many benchmark shingles are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Windows are broadcast only if their words take up to this many bytes.
BROADCAST_BYTES = 64_000_000
#: Everything but digits, lower-case letters and characters beyond ASCII parts words (capitals are lowered before).
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased words of a text; null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAP), "")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows ``(window, words)`` with a number each, and ``(window, item)``, the items that hold them; an item
    shorter than a window, but not empty, is one window.  Both are written tables."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("all")).where("size(all) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - window + 1, F.lit(1)))
    cuts = stored(items.select("item", F.explode(F.transform(starts, lambda i: F.slice("all", i, window))).alias("words")).distinct())
    windows = stored(cuts.select("words").distinct().select(F.monotonically_increasing_id().alias("window"), "words"))
    return windows, stored(cuts.where("item is not null").join(windows, "words").select("window", "item"))


def shingles(words: Column, singles: bool) -> Column:
    """``(pos, token)`` of every pair of neighbouring words, as a hash that the exact check follows; the last word, and
    with ``singles`` every word, also stands alone."""
    hashed = lambda ws: F.transform(ws, lambda w, i: F.struct(i.alias("pos"), F.xxhash64(w, F.get(ws, i + 1)).alias("token")))
    alone = lambda ws: F.transform(ws, lambda w, i: F.struct(i.alias("pos"), F.xxhash64(w).alias("token")))
    return bound(words, lambda ws: F.concat(hashed(ws), alone(ws)) if singles else hashed(ws))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs(doc_id, text)``, ``benchmark(item_id, text)`` -> ``doc_id, n_words, n_hit, items, spans``, a row per document.

    spans are the (start, length) of occurring windows in words; n_hit counts the words inside any of them; items are
    the ids, as strings in order, of items with occurring windows.  Null and empty texts have no words.  A null item_id
    counts for hits but is not listed.  Repeated rows each get their row; an empty benchmark hits nothing; other columns
    are not looked at.  Shingles of up to ``broadcast_rows`` and windows of as many rows and BROADCAST_BYTES are broadcast;
    beyond, the corpus' counts are added up before they move, and only the rarest shingle of each window is joined by a
    shuffle.  Items of a window join once, after the exact check, per set of windows that a document holds.
    """
    docs = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    windows, holders = item_windows(benchmark, window)
    n_windows, n_bytes = windows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.array_join("words", " ")).cast("long")), F.lit(0))).first()
    singles = not windows.where("size(words) = 1").isEmpty()
    inner = F.slice(shingles(F.col("words"), False), F.lit(1), F.greatest(F.size("words") - 1, F.lit(1)))
    placed = windows.select("window", F.explode(inner).alias("s")).select("window", F.col("s.pos").alias("offset"), "s.token")
    vocabulary = placed.select("token").distinct()
    tokens = docs.select(F.explode(shingles(words_of(F.col("text")), singles)).alias("s")).select("s.token")
    if n_windows * window <= broadcast_rows:
        counts = tokens.join(F.broadcast(vocabulary), "token").groupBy("token").agg(F.count("*").alias("n"))
    else:
        counts = tokens.groupBy("token").agg(F.count("*").alias("n")).join(vocabulary, "token")
    # a shingle that no document has keeps its windows from occurring at all: those drop out
    rarest = placed.join(counts, "token", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "token")).alias("least"))
    prefix = stored(rarest.where("least.n > 0").join(windows, "window").select("least.token", "least.offset", "window", "words"))
    # the number of words is a column before the shingles are exploded, so no row of them carries the words
    sized = docs.select("doc_id", bound(words_of(F.col("text")), lambda all_: F.struct(F.size(all_).alias("n"), shingles(all_, singles).alias("all"))).alias("s"))
    places = sized.select("doc_id", F.col("s.n").alias("n_words"), F.col("s.all").alias("all")).select("doc_id", "n_words", F.explode("all").alias("s")).select("doc_id", "n_words", "s.pos", "s.token")
    small = n_windows <= broadcast_rows and n_bytes <= BROADCAST_BYTES
    met = places.join(F.broadcast(prefix) if small else prefix, "token").where("pos >= offset and pos - offset + size(words) <= n_words")
    candidates = met.groupBy("doc_id").agg(F.collect_set(F.struct((F.col("pos") - F.col("offset")).alias("start"), "words", "window")).alias("candidates"))
    candidates = candidates.withColumnRenamed("doc_id", "id").hint("shuffle_hash")
    joined = docs.join(candidates, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    none = F.array().cast("array<struct<start:int,length:int,window:bigint>>")
    exact = lambda all_: F.filter("candidates", lambda c: F.slice(all_, c["start"] + 1, F.size(c["words"])) == c["words"])
    short = lambda hits: F.transform(hits, lambda h: F.struct(h["start"].alias("start"), F.size(h["words"]).alias("length"), h["window"].alias("window")))
    checked = bound(words_of(F.col("text")), lambda all_: F.struct(F.size(all_).cast("long").alias("n"), F.coalesce(short(exact(all_)), none).alias("hits")))
    hit = joined.select("doc_id", checked.alias("checked")).select("doc_id", F.col("checked.n").alias("n_words"), F.col("checked.hits").alias("hits"))
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1))))
    found = stored(
        hit.select(
            "doc_id",
            "n_words",
            F.size(covered).cast("long").alias("n_hit"),
            F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["window"]))).alias("windows"),
            F.array_sort(F.array_distinct(F.transform("hits", lambda h: F.struct(h["start"].alias("start"), h["length"].alias("length"))))).alias("spans"),
        )
    )
    sets = found.where("n_hit > 0").select("windows").distinct()
    named = sets.select("windows", F.explode("windows").alias("window")).join(holders, "window").groupBy("windows").agg(F.array_sort(F.collect_set("item")).alias("items"))
    # documents that hold nothing stay where they are: only those with hits meet the sets
    hits, rest = found.where("n_hit > 0"), found.where("n_hit = 0")
    listed = hits.join(named, "windows", "left").union(rest.select("windows", "doc_id", "n_words", "n_hit", "spans", F.lit(None).cast("array<string>").alias("items")))
    return listed.select("doc_id", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans")


ORACLE_SQL = r"""
WITH low AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
cuts AS (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM items WHERE len(ws) > 0),
wins AS (SELECT DISTINCT item, array_to_string(ws[i:i + 9], ' ') AS w, len(ws[i:i + 9]) AS n FROM cuts),
lens AS (SELECT DISTINCT n FROM wins),
places AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM low),
hits AS (SELECT doc_id, i, n, item FROM (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM places, lens WHERE i + n - 1 <= len(ws)) JOIN wins USING (w, n)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
