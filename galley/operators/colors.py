"""Colours of decoded pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import hex_of_rgb

#: Width of a colour bucket per channel.
STEP = 24


def dominant_colors(pixels: DataFrame, k: int = 5) -> DataFrame:
    """``asset_id, rank, hex, r, g, b, percentage`` of the k commonest colours in steps of STEP; ties by r, g, b from the top."""
    step = lambda c: (F.floor(F.col(c) / F.lit(STEP)) * STEP).cast("int").alias(c)
    counts = pixels.select("asset_id", step("r"), step("g"), step("b")).groupBy("asset_id", "r", "g", "b").agg(F.count("*").alias("n"))
    share = F.bround(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy("asset_id")), 2)
    order = W.partitionBy("asset_id").orderBy(F.desc("n"), F.desc("r"), F.desc("g"), F.desc("b"))
    ranked = counts.withColumn("percentage", share).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("asset_id", "rank", hex_of_rgb(F.col("r"), F.col("g"), F.col("b")).alias("hex"), "r", "g", "b", "percentage")


def price_block_color(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """Colour name (red, black, indeterminate) and its confidence from the median border colour."""
    luminance = 0.2126 * r + 0.7152 * g + 0.0722 * b
    redness = (r - F.greatest(g, b)).cast("double")
    black = (luminance <= 70) & (F.greatest(r, g, b) <= 110)
    red = ((r >= 125) & (g <= 120) & (b <= 120) & (redness >= 35)) | ((r >= 150) & (redness >= 25))
    unit = lambda v: F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)), 4)
    name = F.when(black & ~red, "black").when(red & ~black, "red").otherwise("indeterminate")
    confidence = F.when(black & ~red, unit((90.0 - luminance) / 60.0)).when(red & ~black, unit((redness - 25.0) / 60.0)).otherwise(0.0)
    return name, confidence


# Share of a box's longer side that is added around it, share of the shorter side that its border takes.
BORDER_PAD, BORDER_BAND = 0.18, 0.12


def border_median_rgb(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """``pixels(asset_id, px, py, r, g, b)``, ``boxes(asset_id, x, y, w, h, width, height)`` -> ``asset_id, r, g, b``: the
    medians of the border of the grown and clipped box, cut to whole numbers.  Pixels of its corners lie in two strips
    and count twice; boxes of hardly any pixels give no row."""
    pad = F.bround(F.greatest("w", "h") * F.lit(BORDER_PAD)).cast("int")
    clipped = boxes.select(
        "asset_id",
        F.greatest(F.lit(0), F.col("x") - pad).alias("x0"),
        F.greatest(F.lit(0), F.col("y") - pad).alias("y0"),
        F.least(F.col("width"), F.col("x") + F.col("w") + pad).alias("x1"),
        F.least(F.col("height"), F.col("y") + F.col("h") + pad).alias("y1"),
    ).where("x1 - x0 > 2 and y1 - y0 > 2")
    short = F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    band = F.greatest(F.lit(1), F.least(F.greatest(F.lit(2), F.bround(short * F.lit(BORDER_BAND)).cast("int")), F.floor(short / F.lit(3)).cast("int")))
    area = clipped.withColumn("band", band)
    x, y = F.col("px"), F.col("py")
    inside = (x >= F.col("x0")) & (x < F.col("x1")) & (y >= F.col("y0")) & (y < F.col("y1"))
    across = ((y < F.col("y0") + F.col("band")).cast("int") + (y >= F.col("y1") - F.col("band")).cast("int"))
    along = ((x < F.col("x0") + F.col("band")).cast("int") + (x >= F.col("x1") - F.col("band")).cast("int"))
    met = pixels.join(area, "asset_id").where(inside).withColumn("times", across + along).where("times > 0")
    each = met.select("asset_id", "r", "g", "b", F.explode(F.array_repeat(F.lit(1), F.col("times"))).alias("one"))
    return each.groupBy("asset_id").agg(*[F.floor(F.median(c)).cast("int").alias(c) for c in "rgb"])


def classification_strategy(color: Column) -> Column:
    """``(strategy, messages)`` that a main price block's colour leads to."""
    # Names of the strategies and what is said about them.
    return (
        F.when(color == "red", F.struct(F.lit("main_red_then_secondary_is_regular").alias("strategy"), F.array(F.lit("El precio principal se interpretó como precio CMR."), F.lit("El precio inferior (si existe) se interpretó como precio regular.")).alias("messages")))
        .when(color == "black", F.struct(F.lit("main_black_then_secondary_is_before").alias("strategy"), F.array(F.lit("El precio principal se interpretó como precio regular."), F.lit("El precio inferior (si existe) se interpretó como precio antes.")).alias("messages")))
        .otherwise(F.struct(F.lit("indeterminate_color").alias("strategy"), F.array(F.lit("La clasificación de precios quedó ambigua por color indeterminado.")).alias("messages")))
    )


def allowed_backgrounds(rules: DataFrame, palette: DataFrame) -> DataFrame:
    """``rules(rule_id, color_ids array)``, ``palette(rule_id, color_id)`` -> ``rule_id, color_ids``: those still in the
    palette, in the rule's order; rules that keep none have an empty array."""
    each = rules.select("rule_id", F.posexplode("color_ids").alias("pos", "color_id")).join(palette.select("rule_id", "color_id").distinct(), ["rule_id", "color_id"])
    kept = each.groupBy("rule_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "color_id"))), lambda s: s["color_id"]).alias("kept"))
    return rules.join(kept, "rule_id", "left").select("rule_id", F.coalesce("kept", F.slice("color_ids", 1, 0)).alias("color_ids"))
