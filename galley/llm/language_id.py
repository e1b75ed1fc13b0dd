"""Language identification by fusing text, markup, address and host evidence in Bayes' rule.

Byte trigrams counted over all labelled documents give text likelihoods; a labelled document is judged by the counts of
the other folds only, and its label is no evidence on itself.  From the text posteriors of all records, grouped aggregations estimate how likely each language is to carry a declared tag or an address suffix, and
what a host prefers: host counts are smoothed by their domain's, these by their suffix's, these by the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, lower_ascii
from .url_redirects import host_path

#: Buckets of hashed byte trigrams; most languages; trigrams that a text's evidence counts for at most.
BUCKETS, MAX_LANGUAGES, TEXT_WEIGHT = 1 << 14, 200, 60
#: Pseudo-counts: of a trigram, of a tag or suffix given a language, of a parent's preference in a host's.
TRIGRAM_PRIOR, VALUE_PRIOR, PARENT_WEIGHT = 0.5, 1.0, 5.0
#: Labelled documents are dealt into so many folds by a hash of their id.
FOLDS = 2
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def visible_text(html: Column) -> Column:
    """Markup without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*+>.*?</\1\s*+>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"<[^>]*+>", " ")


def page_records(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` as records: declared is the markup's language tag, host and path the address."""
    html = F.coalesce(F.col("html"), F.lit(""))
    tag = F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1)
    rows = host_path(pages.select("page_id", "url", "html"))
    return rows.select(F.lit("page").alias("kind"), F.col("page_id").cast("string").alias("id"), visible_text(html).alias("text"), F.nullif(lower_ascii(tag), F.lit("")).alias("declared"), "host", "path", F.lit(None).cast("int").alias("fold"))


def fold_of(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % FOLDS, F.lit(0)).cast("int")


def document_records(docs: DataFrame) -> DataFrame:
    """``documents(doc_id, text, source)`` as records: the source stands for the host, there is no address and no markup.

    The ``lang`` of a document is the label that the text model learns from, so it is not taken as declared.
    """
    return docs.select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("declared"), F.coalesce("source", F.lit("")).alias("host"), F.lit("").alias("path"), fold_of().alias("fold"))


def _trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams of some texts, and where each text's end."""
    raw = [(t or "").encode("utf-8", "surrogatepass").translate(LOWER) for t in texts]
    b = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(len(raw), np.int64)
    codes = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    codes = ((codes ^ (codes >> np.uint32(15))) * np.uint32(0x27D4EB2F)) >> np.uint32(18)
    sizes = np.array([len(r) for r in raw])
    keep = np.ones(len(b), bool)  # no trigram runs over the end of a text
    ends = np.cumsum(sizes)
    for back in (1, 2):
        at = ends[sizes >= back] - back
        keep[at] = False
    return codes[keep[:-2]].astype(np.int64), np.cumsum(np.maximum(sizes - 2, 0))


def text_model(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """``labelled(text, lang[, fold])`` -> languages and log likelihoods of buckets, from counts over all rows: one set
    for each fold, without the rows of that fold, and last one of all rows.

    Null languages are left out; rows without a fold count in every set.  More than MAX_LANGUAGES are refused, so the
    model's size is bounded.
    """
    rows = labelled.where("lang is not null").select("text", "lang", *(["fold"] if "fold" in labelled.columns else [F.lit(None).cast("int").alias("fold")]))
    languages = sorted(r.lang for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    place = {lang: i for i, lang in enumerate(languages)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FOLDS + 1, len(place), BUCKETS), np.int64)
        for pdf in batches:
            for (lang, fold), texts in pdf.assign(fold=pdf["fold"].fillna(FOLDS).astype(int)).groupby(["lang", "fold"])["text"]:
                for a in range(0, len(texts), 1000):
                    total[fold, place[lang]] += np.bincount(_trigrams(texts.iloc[a : a + 1000].tolist())[0], minlength=BUCKETS)
        fold, lang, bucket = np.nonzero(total)
        yield pd.DataFrame({"fold": fold, "lang": lang, "bucket": bucket, "n": total[fold, lang, bucket]})

    counts = np.zeros((FOLDS + 1, len(languages), BUCKETS))
    got = rows.mapInPandas(run, "fold int, lang int, bucket int, n long").groupBy("fold", "lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[got["fold"].to_numpy(), got["lang"].to_numpy(), got["bucket"].to_numpy()] += got["n"].to_numpy()
    whole = counts.sum(axis=0)
    sets = np.stack([*(whole - counts[f] for f in range(FOLDS)), whole]) + TRIGRAM_PRIOR
    return languages, np.log(sets / sets.sum(axis=2, keepdims=True)).astype(np.float32)


def _likelihoods(records: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """Records with the log likelihoods of their text in place of the text."""
    shared = records.sparkSession.sparkContext.broadcast(model[1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        logs = shared.value
        for pdf in batches:
            out = []
            folds = pdf["fold"].fillna(FOLDS).astype(int).to_numpy()
            for a in range(0, len(pdf), 500):
                codes, ends = _trigrams(pdf["text"].iloc[a : a + 500].tolist())
                begins = np.concatenate([[0], ends[:-1]])
                n = np.maximum(ends - begins, 1)
                of_code = np.repeat(folds[a : a + 500], ends - begins)
                sums = np.empty((len(ends), logs.shape[1]))
                for k in range(logs.shape[1]):
                    run_sum = np.concatenate([[0], np.cumsum(logs[of_code, k, codes], dtype=np.float64)])
                    sums[:, k] = run_sum[ends] - run_sum[begins]
                out.extend((sums * np.minimum(1, TEXT_WEIGHT / n)[:, None]).round(6))
            yield pd.DataFrame({"kind": pdf["kind"], "id": pdf["id"], "declared": pdf["declared"], "host": pdf["host"], "path": pdf["path"], "text_log": out})

    return records.select("kind", "id", "text", "declared", "host", "path", "fold").mapInPandas(run, "kind string, id string, declared string, host string, path string, text_log array<double>")


def _softmax(logs: Column) -> Column:
    raised = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda s, y: s + y))


def _sums(df: DataFrame, keys: list[str], name: str, size: int) -> DataFrame:
    return df.groupBy(*keys).agg(F.array(*[F.round(F.sum(F.get("p", F.lit(i))), 6) for i in range(size)]).alias(name))


def _given_language(df: DataFrame, column: str, totals: list[float]) -> DataFrame:
    """Log probability of each value of ``column`` given each language, from soft counts with VALUE_PRIOR."""
    size = len(totals)
    counts = _sums(df.where(F.col(column).isNotNull()), [column], "n", size)
    logs = F.array(*[F.log((F.get("n", F.lit(i)) + VALUE_PRIOR) / F.lit(totals[i] + 10 * VALUE_PRIOR)) for i in range(size)])
    return counts.select(column, logs.alias(f"{column}_log"))


def identify(records: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``records(kind, id, text, declared, host, path, fold)`` -> ``kind, id, lang, confidence, text_lang``, a row per
    record, ids as text (null stays null; repeated rows each get their row and count each in their host's preference).

    Missing evidence (null or unseen tag, no host, empty text) says nothing; with none at all the corpus' commonest
    language comes out.  A record's own text does not count in what its host prefers.  Ties go to the lesser name.
    """
    languages = model[0]
    size = len(languages)
    if not size:
        return records.select("kind", "id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_lang"))
    scored = _likelihoods(records, model).withColumn("p", _softmax(F.col("text_log")))
    labels = F.split("host", r"\.")
    suffix = F.when(F.size(labels) > 1, F.element_at(labels, -1))
    segment = F.regexp_extract("path", r"^/([A-Za-z]{2})(?:/|$)", 1)
    scored = cut(
        scored.withColumn("suffix", suffix)
        .withColumn("segment", F.when(segment != "", lower_ascii(segment)))
        .withColumn("domain", F.when(F.size(labels) > 1, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(F.col("host")))
    )
    totals = scored.agg(F.array(*[F.sum(F.get("p", F.lit(i))) for i in range(size)]).alias("n")).first()["n"]
    totals = [float(t or 0.0) for t in totals]
    mass = sum(totals) + size
    world = F.array(*[F.lit((t + 1) / mass) for t in totals])
    out = scored
    for column in ("declared", "suffix", "segment"):
        out = out.join(_given_language(scored, column, totals), column, "left")
    hosts = _sums(scored.where("host <> ''"), ["host"], "host_n", size)
    domains = _sums(scored.where("host <> ''"), ["domain"], "domain_n", size)
    suffixes = _sums(scored.where("suffix is not null"), ["suffix"], "suffix_n", size)
    out = out.join(hosts, "host", "left").join(domains, "domain", "left").join(suffixes, "suffix", "left")

    def smoothed(name: str, parent: str) -> Column:
        """Counts without the record's own, drawn to the parent's preference."""
        own = F.when(F.col(name).isNotNull(), F.zip_with(name, "p", lambda n, p: F.greatest(n - p, F.lit(0.0)))).otherwise(F.array_repeat(F.lit(0.0), size))
        total = F.aggregate(own, F.lit(0.0), lambda s, x: s + x) + PARENT_WEIGHT
        return F.zip_with(own, parent, lambda n, q: (n + PARENT_WEIGHT * q) / total)

    out = out.withColumn("world", world).withColumn("by_suffix", smoothed("suffix_n", "world")).withColumn("by_domain", smoothed("domain_n", "by_suffix")).withColumn("by_host", smoothed("host_n", "by_domain"))
    nothing = F.array_repeat(F.lit(0.0), size)
    joint = F.transform("by_host", lambda q: F.log(q))
    for column in ("text_log", "declared_log", "suffix_log", "segment_log"):
        joint = F.zip_with(joint, F.coalesce(F.col(column), nothing), lambda a, b: a + b)
    out = out.withColumn("posterior", _softmax(joint))
    names = F.array(*[F.lit(x) for x in languages])
    best = lambda c: F.get(names, F.array_position(c, F.array_max(c)).cast("int") - 1)
    return out.select("kind", "id", best(F.col("posterior")).alias("lang"), F.round(F.array_max("posterior"), 6).alias("confidence"), best(F.col("text_log")).alias("text_lang"))
