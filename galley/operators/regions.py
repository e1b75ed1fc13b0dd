"""Joins of words, blocks and detected regions inside a piece, by asset and cell of a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import Box
from .spatial import holding, near

#: Region classes whose words count, and those whose words do not.
KEEP = ("campaign_area", "date_area", "info_card_area", "price_main_area", "price_secondary_area", "sku_area", "promo_badge_area", "logo_area")
EXCLUDE = ("product_photo_area",)
MAX_INCIDENTAL = 3


def areas_from_detections(detections: DataFrame) -> DataFrame:
    """Detections with ``role``: keep or exclude; other classes are left out."""
    role = F.when(F.col("class_name").isin(*EXCLUDE), "exclude").when(F.col("class_name").isin(*KEEP), "keep")
    return detections.withColumn("role", role).where("role is not null")


def _held_by(words: DataFrame, areas: DataFrame, how: str) -> DataFrame:
    box = Box.of()
    w, a = near(words, areas, box.cx, box.cy).where("near").drop("near").alias("w"), areas.select("asset_id", "x", "y", "w", "h").alias("a")
    box, area = Box.of("w"), Box.of("a")
    return w.join(a, (F.col("w.asset_id") == F.col("a.asset_id")) & area.holds(box.cx, box.cy), how)


def mask_words(words: DataFrame, detections: DataFrame) -> DataFrame:
    """Words but for those whose centre lies in an excluded area and in no area to keep; words without a box go."""
    whole = words.where("x is not null and y is not null and w is not null and h is not null")
    box, areas = Box.of(), areas_from_detections(detections)
    seen = near(whole, areas.where("role = 'exclude'"), box.cx, box.cy)
    doubtful = seen.where("near").drop("near")
    met = holding(doubtful.select("asset_id", "word_index", "x", "y", "w", "h"), areas, box.cx, box.cy, {"role": "role"})
    # exclude before keep by name: a word that is in both stays
    lost = met.groupBy("asset_id", "word_index").agg(F.max("role").alias("role")).where("role = 'exclude'")
    return seen.where("not near").drop("near").unionByName(doubtful.join(lost, ["asset_id", "word_index"], "left_anti"))


def incidental_words(words: DataFrame, detections: DataFrame, most: int = MAX_INCIDENTAL) -> DataFrame:
    """Words inside the first excluded areas of each asset."""
    first = areas_from_detections(detections).where("role = 'exclude'").withColumn("n", F.row_number().over(W.partitionBy("asset_id").orderBy("ord"))).where(F.col("n") <= most)
    return _held_by(words, first, "left_semi")


def block_region_class(blocks: DataFrame, detections: DataFrame) -> DataFrame:
    """``asset_id, block_order, region_class``: the class of the smallest detection that holds the block's centre, else null."""
    box = Box.of()
    areas = detections.withColumn("area", box.area)
    met = holding(blocks.select("asset_id", "block_order", "x", "y", "w", "h"), areas, box.cx, box.cy, {"class_name": "class_name", "area": "area", "ord": "ord"})
    least = met.groupBy("asset_id", "block_order").agg(F.min_by("class_name", F.struct("area", "ord")).alias("region_class"))
    return blocks.select("asset_id", "block_order").distinct().join(least, ["asset_id", "block_order"], "left")


def rank_regions(regions: DataFrame, most: int = 10) -> DataFrame:
    """The largest regions of each asset, the surer one first among equals."""
    order = W.partitionBy("asset_id").orderBy(F.desc(F.col("w") * F.col("h")), F.desc("confidence"), "ord")
    return regions.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def dedupe_regions(regions: DataFrame) -> DataFrame:
    """One region for each box of an asset, the first proposed."""
    order = W.partitionBy("asset_id", "x", "y", "w", "h").orderBy("ord")
    return regions.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
