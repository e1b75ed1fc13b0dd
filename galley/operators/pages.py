"""Pages of documents: embedded words, sizes, the choice between embedded and recognised text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.repair import correction_ratio, variant_score
from .correction import correct_text
from .layout import confidence_metrics, needs_page_ocr

# Points an inch, and dots an inch of recognition and of stated sizes.
POINTS, OCR_DPI, SIZE_DPI = 72.0, 300.0, 150.0
#: A second recognition pass is looked at below this mean confidence of the first.
SURE_PASS = 0.85


def ingest_embedded_words(words: DataFrame) -> DataFrame:
    """``words(asset_id, word_index, text, x0, x1, top, bottom)`` in points -> words in pixels of recognition, confidence 1;
    words of blanks only are left out."""
    scaled = lambda c: F.bround(c * F.lit(OCR_DPI / POINTS)).cast("int")
    positive = lambda c: F.greatest(F.lit(0.0), c)
    return words.where(F.trim("text") != "").select(
        "asset_id",
        "word_index",
        F.trim("text").alias("text"),
        scaled(F.col("x0")).alias("x"),
        scaled(F.col("top")).alias("y"),
        scaled(positive(F.col("x1") - F.col("x0"))).alias("w"),
        scaled(positive(F.col("bottom") - F.col("top"))).alias("h"),
        F.lit(1.0).alias("confidence"),
    )


def pdf_page_meta(pages: DataFrame) -> DataFrame:
    """``pages(asset_id, page_index, width, height)`` in points -> ``asset_id, width, height, page_count``: the first page's
    size in pixels."""
    size = lambda c: F.bround(F.min_by(c, "page_index") * F.lit(SIZE_DPI) / F.lit(POINTS)).cast("int").alias(c)
    return pages.groupBy("asset_id").agg(size("width"), size("height"), F.count("*").alias("page_count"))


def page_choice(embedded: Column, embedded_score: Column, ocr: Column, ocr_score: Column) -> Column:
    """``embedded``, ``ocr`` or ``merged``: what stands for a page of both readings."""
    a, b = F.trim(F.coalesce(embedded, F.lit(""))), F.trim(F.coalesce(ocr, F.lit("")))
    x, y = F.coalesce(embedded_score, F.lit(0.0)), F.coalesce(ocr_score, F.lit(0.0))
    short = F.when((F.length(b) > F.length(a)) | (y >= x), "ocr").otherwise("merged")
    return F.when(b == "", "embedded").when(a == "", "ocr").when(needs_page_ocr(a), short).when(x >= y, "embedded").otherwise("ocr")


def select_page_payload(embedded: DataFrame, recognised: DataFrame) -> DataFrame:
    """``embedded`` and ``recognised`` (asset_id, page_index, text, score) -> ``asset_id, page_index, choice, text``, a row
    for every page of ``embedded``."""
    ocr = recognised.select("asset_id", "page_index", F.col("text").alias("ocr"), F.col("score").alias("ocr_score"))
    both = embedded.join(ocr, ["asset_id", "page_index"], "left").withColumn("choice", page_choice(F.col("text"), F.col("score"), F.col("ocr"), F.col("ocr_score")))
    text = F.when(F.col("choice") == "embedded", F.trim(F.coalesce("text", F.lit("")))).when(F.col("choice") == "ocr", F.trim("ocr")).otherwise(T.merge_page_text(F.col("text"), F.col("ocr")))
    return both.select("asset_id", "page_index", "choice", text.alias("text"))


def pick_ocr_pass(passes: DataFrame) -> DataFrame:
    """``passes(asset_id, pass, avg_confidence, ...)``, pass 1 or 2 -> one row per asset: the second only if the first is
    below SURE_PASS and the second surer."""
    first = F.min(F.when(F.col("pass") == 1, F.col("avg_confidence")))
    second = F.max(F.when(F.col("pass") == 2, F.col("avg_confidence")))
    wanted = passes.groupBy("asset_id").agg(F.when(F.coalesce((first < SURE_PASS) & (second > first), first.isNull()), 2).otherwise(1).alias("pass"))
    return passes.join(wanted, ["asset_id", "pass"], "left_semi")


def pick_text_variant(variants: DataFrame) -> DataFrame:
    """``variants(asset_id, pos, text)`` -> ``asset_id, text``: the reading of most letters and digits, then of most words,
    then the first; empty if none has any."""
    rated = variants.withColumn("rate", variant_score(F.col("text")))
    best = F.max_by("text", F.struct("rate", (-F.col("pos")).alias("pos")))
    some = F.max(F.struct(F.col("rate.characters"), F.col("rate.words"))) > F.struct(F.lit(0), F.lit(0))
    return rated.groupBy("asset_id").agg(F.when(some, best).otherwise("").alias("text"))


def ocr_payload(texts: DataFrame, words: DataFrame) -> DataFrame:
    """``texts(asset_id, text)``, ``words(asset_id, confidence, ...)`` -> ``asset_id, raw_text, corrected_text,
    avg_confidence, min_confidence, score``; without words both confidences are 0, without text the score is null."""
    corrected = correct_text(texts).withColumnRenamed("text", "corrected_text")
    rows = texts.select("asset_id", F.coalesce("text", F.lit("")).alias("raw_text")).join(corrected, "asset_id").join(confidence_metrics(words), "asset_id", "left")
    known = rows.fillna(0.0, ["avg_confidence", "min_confidence"])
    ratio = correction_ratio(F.col("raw_text"), F.col("corrected_text"))
    return known.withColumn("score", T.ocr_score(F.col("avg_confidence"), F.col("min_confidence"), F.length(F.trim("raw_text")), ratio))
