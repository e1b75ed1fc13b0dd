"""Exact deduplication by a 128-bit content hash and a comparison of bytes, in DataFrame operations only.

Only hashes and ids move at first: rows are counted by hash.  The texts of hashes that more than one row has are then
grouped by hash and bytes, with partial sums in each task, so that a text with very many copies moves once a task, and
texts that share a hash without being equal come apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Up to this many shared hashes (of 16 bytes) are broadcast to keep unique texts where they are; beyond it every
#: distinct text moves once a task.
BROADCAST_HASHES = 500_000


def content_hash(text: Column) -> Column:
    """128 bits of a text's UTF-8 bytes."""
    return F.unhex(F.md5(text))


def group_copies(docs: DataFrame, keep: str = "least", digest: Callable[[Column], Column] = content_hash, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, hash, sha256, keep_id, group_size, kept``, a row per row.

    Of rows with the same bytes the one of the ``"least"`` or ``"greatest"`` doc_id is kept; a null text counts as
    empty.  A null doc_id is kept only where all of a group are null (keep_id is null then).  Of rows that repeat the
    kept id and text, one is kept.  Other columns are not looked at; an empty table gives an empty result.
    """
    chosen = {"least": F.min, "greatest": F.max}[keep]
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # written once, so that the rows' numbers, which tell repeated rows apart, stay what they are
    keyed = stored(rows.select("doc_id", digest(F.col("text")).alias("hash"), F.unhex(F.sha2("text", 256)).alias("sha256"), F.monotonically_increasing_id().alias("row")))
    shared = stored(keyed.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
    texts = rows.select("doc_id", "text", digest(F.col("text")).alias("hash"))
    if shared.count() <= broadcast_hashes:
        texts = texts.join(F.broadcast(shared), "hash", "left_semi")
    classes = texts.groupBy("hash", "text").agg(F.count("*").alias("n"), chosen("doc_id").alias("keep"))
    classes = stored(classes.where("n > 1").select("hash", F.unhex(F.sha2("text", 256)).alias("sha256"), "n", "keep"))
    # rows repeated with id and text: all but the first go; counted by id as well, so that a large group is no single key
    again = keyed.groupBy("doc_id", "hash", "sha256").agg(F.count("*").alias("times"), F.min("row").alias("first")).where("times > 1").select(F.col("doc_id").alias("id"), F.col("hash").alias("h"), F.col("sha256").alias("s"), "first")
    told = keyed.join(again, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("h")) & (F.col("sha256") == F.col("s")), "left")
    keep_id = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    kept = F.col("doc_id").eqNullSafe(keep_id) & (F.col("first").isNull() | (F.col("row") == F.col("first")))
    return told.join(classes, ["hash", "sha256"], "left").select("doc_id", "hash", "sha256", keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), kept.alias("kept"))


def deduplicate(docs: DataFrame, keep: str = "least", **how) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; of rows repeated with id and text, one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = group_copies(docs, keep, **how).where("kept").select(F.col("doc_id").alias("__kept_id"), F.col("sha256").alias("__kept_sha"))
    keyed = docs.withColumn("__sha", F.unhex(F.sha2(text, 256)))
    same = (F.col("__sha") == F.col("__kept_sha")) & F.col("doc_id").eqNullSafe(F.col("__kept_id"))
    left = keyed.join(kept.hint("shuffle_hash"), same, "left_semi")
    unique = keyed.groupBy("doc_id", "__sha").agg(F.count("*").alias("__n")).where("__n > 1").isEmpty()
    return (left if unique else left.dropDuplicates(["doc_id", "__sha"])).drop("__sha")


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
