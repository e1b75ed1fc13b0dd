"""The corpus queries: one per operator, over whole tables, with the digests that their contracts fix."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversation_trie, decontaminate, exact_dedup, language_id, line_chunks, ngram_join, periodic_runs, pii, quality_crf, runlength_dedup, toxicity, url_redirects
from .shared import stored

Query = Callable[[SparkSession, str], DataFrame]

#: The rules of the address query, as (verdict, host, path).
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: The rules that the SQL twin has: its third one says block, against the contract (REPLY_r03.md, F1).
SQL_RULES = [("block" if (host, path) == ("net", "/de/") else verdict, host, path) for verdict, host, path in URL_RULES]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict, and its alias group.  Null urls and such without ``://`` have empty host and path
    and are allowed; of rules of one length the lesser string wins; repeated pages each get their row.
    """
    return url_redirects.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near copies and its number of links.  Null texts and such without words link to nothing;
    repeated rows are copies of one another; class ids are the least doc_id, null only where all of a class are null.
    """
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data.  Null counts as empty; spans are ordered by start, ties by kind; repeated rows each get
    their row.
    """
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = {i})")).cast("long").alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


def op4_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated chunks of lines.  A null text stays null here and is empty in the twin's sense;
    of equal chunks the one of the least doc_id, then of the first place, stays; rows of one doc_id are one document.
    """
    return line_chunks.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base counts and verdict.  Null and empty texts fail the base rules; on ties a line is content; repeated
    rows each get their row.
    """
    docs = table(spark, sf_dir, "documents")
    return quality_crf.judge(docs, quality_crf.fit(docs, table(spark, sf_dir, "labels")))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids and decoded bytes, as digests.  Null counts as empty and has no ids; repeated rows and null
    doc_ids each get their row.
    """
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = F.array_join("ids", " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score.  Null and empty texts have the bias only; a null doc_id is not held out; repeated rows each get
    their row.
    """
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document and page.  Missing evidence says nothing; ties go to the lesser name; null ids stay null;
    repeated rows each get their row.
    """
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = language_id.text_model(docs.select("text", "lang", language_id.fold_of().alias("fold")))
    found = language_id.identify(language_id.document_records(docs).union(language_id.page_records(pages)), model)
    of = lambda kind: F.when(F.col("kind") == kind, F.col("id").cast("long"))
    return found.select(of("document").alias("doc_id"), of("page").alias("page_id"), "lang", "confidence", "text_lang")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside windows of benchmark items.  Null has no words; item ids are sorted as strings, a null one
    is not listed; repeated rows each get their row.
    """
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_runlength_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes under 400-byte strings that start elsewhere too.  Null counts as empty; repeated rows are copies of
    one another.
    """
    cleaned = runlength_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    n_removed = F.col("n_bytes") - F.octet_length("kept")
    return cleaned.select("doc_id", "n_bytes", n_removed.cast("long").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of conversations with shared heads.  Turns are ordered by number, null first, then by the digest of
    role and text; null role and text are empty; rows without conv_id belong to no conversation.
    """
    turns = stored(conversation_trie.turns_of(table(spark, sf_dir, "conversations")))
    length = turns.groupBy("conv_id").agg(F.count("*").alias("length"))
    nodes = conversation_trie.prefix_trie(*conversation_trie.with_shared_heads(turns, length))
    return nodes.withColumnRenamed("ends", "ends_sha256")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy that stays, the one of the largest doc_id.  Null counts as empty; a null doc_id stays only in a
    group of such; of rows repeated with id and text one stays.
    """
    grouped = exact_dedup.group_copies(table(spark, sf_dir, "documents"), keep="greatest")
    return grouped.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha256")).alias("text_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's periodic runs of words, of one in ten made periodic first.  Null has no words; a null doc_id is never made
    periodic; the greatest run is the longest, of equal ones the first, then that of the lesser period.
    """
    words = periodic_runs.planted_words(F.col("doc_id"), F.col("text"))
    found = periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), words)
    greatest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), greatest.alias("g"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("g.length").cast("long"), (-F.col("g.period")).cast("long")
    return told.select("doc_id", "n_runs", (-F.col("g.start")).cast("long").alias("start"), length.alias("length"), period.alias("period"), F.floor(length * 1000 / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES: dict[str, Query] = {
    "op1_url_redirects": op1_url_redirects,
    "op2_ngram_join": op2_ngram_join,
    "op3_pii": op3_pii,
    "op4_line_chunks": op4_line_chunks,
    "op5_quality_crf": op5_quality_crf,
    "op6_bpe": op6_bpe,
    "op7_toxicity": op7_toxicity,
    "op8_language_id": op8_language_id,
    "op9_decontaminate": op9_decontaminate,
    "op10_runlength_dedup": op10_runlength_dedup,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE_SQL: dict[str, str] = {
    "op1_url_redirects": url_redirects.oracle_sql(SQL_RULES),
    "op2_ngram_join": ngram_join.ORACLE_SQL,
    "op4_line_chunks": line_chunks.ORACLE_SQL,
    "op9_decontaminate": decontaminate.ORACLE_SQL,
    "op11_conversation_trie": conversation_trie.ORACLE_SQL,
    "op12_exact_dedup": exact_dedup.ORACLE_SQL,
}
