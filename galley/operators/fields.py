"""Structured product fields from text blocks: scoping by region, candidate scores, one ranking window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import PRICE, SKU, collapse, date_hint, looks_like_brand, looks_like_campaign, looks_like_description, price_extract, sku_extract

#: The fields, and the region classes that each field is looked for in.
FIELDS = ("campaign", "date_range", "brand", "description", "sku", "price_main", "price_secondary")
REGIONS = {
    "campaign": ("campaign_area",),
    "date_range": ("date_area",),
    "brand": ("info_card_area",),
    "description": ("info_card_area",),
    "sku": ("sku_area", "info_card_area"),
    "price_main": ("price_main_area",),
}
CAMPAIGN_BLOCKS = 6


def prepare_blocks(blocks: DataFrame, excluded: tuple[str, ...] = ("product_photo_area",)) -> DataFrame:
    """Blocks with an id and text, without promo badges and blocks of excluded region classes; text on one line."""
    region = F.nullif(F.trim("region_class"), F.lit(""))
    out = blocks.withColumn("text", collapse(F.col("text"))).withColumn("region_class", region)
    return out.where((F.coalesce("block_id", F.lit("")) != "") & (F.col("text") != "") & (F.coalesce("type", F.lit("")) != "promo_badge") & ~F.coalesce(F.col("region_class").isin(*excluded), F.lit(False)))


def scope_blocks(prepared: DataFrame) -> DataFrame:
    """A row per block and field that it may serve: blocks of the field's regions if the asset has any, else all."""
    wanted = F.create_map(*[x for f, classes in REGIONS.items() for x in (F.lit(f), F.array(*map(F.lit, classes)))])
    long = prepared.withColumn("field", F.explode(F.array(*map(F.lit, REGIONS))))
    long = long.withColumn("wanted", F.coalesce(F.array_contains(F.try_element_at(wanted, F.col("field")), F.col("region_class")), F.lit(False)))
    any_wanted = F.max("wanted").over(W.partitionBy("asset_id", "field"))
    return long.withColumn("any_wanted", any_wanted).where("wanted or not any_wanted").drop("wanted", "any_wanted")


def _boost(kind: str, factor: float) -> Column:
    return F.when(F.col("type") == kind, F.lit(factor)).otherwise(F.lit(1.0))


def candidates(prepared: DataFrame) -> DataFrame:
    """``asset_id, field, block_order, block_id, value, score`` of every block that can supply a field."""
    text, conf = F.col("text"), F.col("confidence")
    named = text.rlike(SKU)
    place = F.row_number().over(W.partitionBy("asset_id", "field").orderBy("block_order"))
    rows = scope_blocks(prepared).withColumn("place", place)
    brand_like = looks_like_brand(text)
    value, score = {}, {}
    value["sku"], score["sku"] = sku_extract(text), _boost("sku", 1.10) * F.when(named, 0.98).otherwise(0.75) * conf
    value["date_range"], score["date_range"] = F.when(date_hint(text), text), _boost("date_range", 1.08) * 0.8 * conf
    value["price_main"], score["price_main"] = price_extract(text), _boost("price_main", 1.12) * (0.65 * conf + 0.35 * F.least(F.lit(1.0), F.coalesce(F.col("h"), F.lit(0)) / F.lit(120.0)))
    value["brand"], score["brand"] = F.when(brand_like, text), _boost("brand", 1.08) * 0.92 * conf
    value["campaign"], score["campaign"] = F.when((F.col("place") <= CAMPAIGN_BLOCKS) & looks_like_campaign(text) & ~brand_like, text), _boost("campaign", 1.05) * 0.75 * conf
    value["description"], score["description"] = F.when(looks_like_description(text) & ~brand_like & ~named, text), _boost("description", 1.05) * (0.70 * conf + F.least(F.lit(0.25), F.length(text) / F.lit(160.0)))

    def by_field(of: dict[str, Column]) -> Column:
        out = F.lit(None)
        for f, c in of.items():
            out = F.when(F.col("field") == f, c).otherwise(out)
        return out

    return rows.withColumn("value", by_field(value)).withColumn("score", by_field(score)).where("value is not null")


def extract_fields(blocks: DataFrame, digits: int = 4) -> DataFrame:
    """``asset_id, field, value, block_id, confidence, status``: all FIELDS of every asset; ties go to the earlier block.

    The secondary price is the best of the other price blocks, with a bonus for its type and for words that hint at it.
    """
    prepared = prepare_blocks(blocks)
    best = F.row_number().over(W.partitionBy("asset_id", "field").orderBy(F.desc("score"), "block_order"))
    ranked = candidates(prepared).withColumn("rank", best)
    first = ranked.where("rank = 1").select("asset_id", "field", "value", "block_id", "score")
    bonus = F.when(F.col("type") == "price_secondary", F.lit(0.16)).otherwise(0.0) + F.when(F.col("text").rlike(r"(?iu)\b(regular|antes|cmr)\b"), F.lit(0.08)).otherwise(0.0)
    rest = ranked.where("field = 'price_main' and rank > 1").withColumn("score", F.col("score") + bonus).withColumn("field", F.lit("price_secondary"))
    second = rest.withColumn("rank", best).where("rank = 1").select("asset_id", "field", "value", "block_id", "score")
    grid = blocks.select("asset_id").distinct().withColumn("field", F.explode(F.array(*map(F.lit, FIELDS))))
    found = grid.join(first.union(second), ["asset_id", "field"], "left")
    return found.select("asset_id", "field", "value", "block_id", F.bround(F.coalesce("score", F.lit(0.0)), digits).alias("confidence"), F.when(F.col("value").isNull(), "not_detected").otherwise("detected").alias("status"))


def assign_prices(fields: DataFrame, colors: DataFrame) -> DataFrame:
    """``asset_id, field, value, block_id, confidence, status`` of price_cmr, price_regular and price_before.

    ``colors(asset_id, main_color, color_confidence)``: red makes the main price the card price, black the regular one; any other colour
    leaves all three ambiguous; without a main price none is detected.
    """
    pick = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    wide = fields.groupBy("asset_id").agg(*[pick(f, c).alias(f"{a}_{b}") for f, a in (("price_main", "main"), ("price_secondary", "second")) for c, b in (("value", "value"), ("block_id", "block"))])
    wide = wide.join(colors, "asset_id", "left")
    conf = F.coalesce("color_confidence", F.lit(0.0))
    color = F.coalesce("main_color", F.lit("indeterminate"))

    def one(name: str, main_color: str | None, second_color: str | None) -> Column:
        main = color == main_color if main_color else F.lit(False)
        second = (color == second_color) & F.col("second_value").isNotNull() if second_color else F.lit(False)
        known = color.isin("red", "black")
        return F.struct(
            F.lit(name).alias("field"),
            F.when(F.col("main_value").isNull(), None).when(main, F.col("main_value")).when(second, F.col("second_value")).alias("value"),
            F.when(F.col("main_value").isNull(), None).when(main, F.col("main_block")).when(second, F.col("second_block")).alias("block_id"),
            F.bround(F.when(F.col("main_value").isNull(), 0.0).when(main, F.greatest(F.lit(0.6), conf)).when(second, F.greatest(F.lit(0.55), conf)).otherwise(0.0), 4).alias("confidence"),
            F.when(F.col("main_value").isNull(), "not_detected").when(main | second, "detected").when(known, "not_detected").otherwise("ambiguous").alias("status"),
        )

    rows = F.array(one("price_cmr", "red", None), one("price_regular", "black", "red"), one("price_before", None, "black"))
    return wide.select("asset_id", F.explode(rows).alias("x")).select("asset_id", "x.*")
