"""The corpus pipeline: toxic documents go, repeated chunks of lines go, one document of each group of near copies
stays, contaminated documents go, and what is left is coded by byte-level BPE and decoded again.

Each stage takes all rows its predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm import bpe, decontaminate, line_chunks, ngram_join, toxicity
from galley.llm.shared import checkpoint_dir

#: Toxicity is a trained model, which SQL cannot express.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model calls toxic go; it learns from the labelled ones outside the held-out fold."""
    weights = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.scorer(spark, weights)(F.col("text")) < toxicity.THRESHOLD)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines are cut out of the texts; n_chars follows."""
    out = line_chunks.deduplicate(docs)
    return out.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one row stays, that of the least doc_id and text digest; of rows repeated with both,
    one.  A row of null doc_id is kept or goes by its own text; texts without words all stay."""
    marked = ngram_join.near_duplicates(docs, mark=True).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest")).distinct()
    keyed = docs.withColumn("digest__", ngram_join.text_digest())
    same = F.col("digest__").eqNullSafe(F.col("kept_digest")) & F.col("doc_id").eqNullSafe(F.col("kept_id"))
    return keyed.join(marked.hint("shuffle_hash"), same, "left_semi").dropDuplicates(["doc_id", "digest__"]).drop("digest__")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.where("n_hit > 0").select(F.col("doc_id").alias("hit_id")).distinct()
    return docs.join(hit.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("hit_id")), "left_anti")


def coding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded bytes, as digests, of every document left."""
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=False)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_chunks", line_stage),
    ("ngram_join", near_duplicate_stage),
    ("decontaminate", decontamination_stage),
    ("bpe", coding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again by the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
