"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training runs on the executors over a bounded, documented sample of labelled rows: in every round each shard goes on
from the shared state with per-coordinate rates, and the shards' states, of bounded size, are averaged.  The L1
term leaves few weights other than zero; these (at most ``2 ** BITS`` by construction) are what scoring broadcasts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut

#: Fixed parameters of the model and its training.
BITS = 19
SAMPLE_ROWS = 24_000
SHARDS, ROUNDS = 4, 6
ALPHA, BETA, L1, L2 = 2.0, 1.0, 3.0, 1e-3
THRESHOLD = 0.3

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MASK = np.uint64((1 << BITS) - 1)
P1, P2, P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class _Hashes(dict):
    """Hashes of words; starts anew when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def features(text: str | None, hashes: _Hashes) -> np.ndarray:
    """Distinct buckets of a text's words, pairs of neighbours, and pairs with one word between; bucket 0 is the bias."""
    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    h = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
    pairs = (h[:-1] * P1) ^ (h[1:] * P2)
    skips = (h[:-2] * P2) ^ (h[2:] * P3)
    buckets = (np.concatenate([h, pairs, skips]) * P1) >> np.uint64(64 - BITS)
    return np.unique(np.concatenate([np.zeros(1, np.uint64), buckets])).astype(np.int32)


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """FTRL-proximal closed form: zero within the L1 ball, else shrunk and scaled by the coordinate's own rate."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _train_shard(rows: list[tuple[np.ndarray, int]], z: np.ndarray, n: np.ndarray) -> np.ndarray:
    touched = np.zeros(len(z), bool)
    for idx, label in rows:
        zi, ni = z[idx], n[idx]
        w = weights_of(zi, ni)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        root = np.sqrt(ni + g * g)
        z[idx] = zi + g - (root - np.sqrt(ni)) / ALPHA * w
        n[idx] = ni + g * g
        touched[idx] = True
    return touched


def _shard_step(shared):
    """One shard's pass over its rows from the shared state: the change of every coordinate that it met."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z, n = (a.astype(np.float64) for a in shared.value)
        rows = pd.concat([pd.DataFrame({"order": pd.Series(dtype="int64"), "label": pd.Series(dtype="int32"), "idx": []}), *batches])
        rows = rows.sort_values("order", kind="stable")
        met = _train_shard(list(zip(rows["idx"], rows["label"], strict=True)), z, n)
        yield pd.DataFrame({"met": [met.tobytes()], "dz": [(z - shared.value[0]).astype(np.float32).tobytes()], "dn": [(n - shared.value[1]).astype(np.float32).tobytes()]})

    return run


def train(examples: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """``examples(text, label, order)`` -> buckets and weights other than zero.

    The caller bounds the examples (see ``fit``); ``order`` is a hash, by which a shard goes through its rows.  Null
    texts count as empty, null labels are left out.  Without examples there are no weights.
    """
    spark = examples.sparkSession
    sample = examples.where("label is not null")

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for pdf in (whole.iloc[a : a + 500] for whole in batches for a in range(0, len(whole), 500)):
            yield pd.DataFrame({"order": pdf["order"], "label": pdf["label"], "idx": [features(t, hashes) for t in pdf["text"]]})

    # a shard is a partition of these rows, which stay where they were written: no round shuffles them
    data = cut(sample.select("order", F.col("label").cast("int").alias("label"), "text").repartition(SHARDS).mapInPandas(featurise, "order long, label int, idx array<int>"))
    size = 1 << BITS
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((z.astype(np.float32), n.astype(np.float32)))

        # one row of 9 bytes a coordinate from each shard: bounded by SHARDS and BITS, whatever the corpus
        states = data.mapInPandas(_shard_step(shared), "met binary, dz binary, dn binary").toArrow()
        met = sum(np.frombuffer(m.as_py(), bool).astype(np.float64) for m in states["met"])
        dz = sum(np.frombuffer(m.as_py(), np.float32).astype(np.float64) for m in states["dz"])
        dn = sum(np.frombuffer(m.as_py(), np.float32).astype(np.float64) for m in states["dn"])
        # a shard that has not met a coordinate has nothing to say on it: the mean is over those that have
        z += dz / np.maximum(met, 1)
        n += dn / np.maximum(met, 1)
        shared.unpersist()
    w = weights_of(z, n)
    at = np.flatnonzero(w)
    return at.astype(np.int32), w[at].astype(np.float32)


def scorer(spark: SparkSession, weights: tuple[np.ndarray, np.ndarray]):
    """A function of a text column: the probability of label 1.  Nothing but the text enters it.

    A null or empty text has the bias only; without any weights every score is 0.
    """
    shared = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, w = shared.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[at] = w
        hashes = _Hashes()
        for texts in batches:
            raw = np.array([dense[features(t, hashes)].sum(dtype=np.float64) for t in texts])
            yield pd.Series(1 / (1 + np.exp(-np.clip(raw, -700, 700))) if len(at) else np.zeros(len(texts)))

    return score_of


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs(key, text)`` -> ``key, score, predicted``."""
    out = docs.select(F.col(key).alias(key), scorer(docs.sparkSession, weights)(F.col(text)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def held_out(key: str = "doc_id"):
    """Rows that are never learned from: crc32 of the key as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Train on ``labels(doc_id, toxic)`` of documents outside the held-out fold.

    At most ``sample_rows`` label rows (those of the least hash) are joined to the documents, so the broadcast side of
    that join is bounded.
    """
    order = F.xxhash64("doc_id")
    sample = labels.select("doc_id", F.col("toxic").alias("label")).where(~held_out() & F.col("label").isNotNull()).orderBy(order, "doc_id").limit(sample_rows)
    return train(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "label", order.alias("order")))
