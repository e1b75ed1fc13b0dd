"""Technical and layout rules for whole pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Technical requirements, layout rules by piece type, tolerance of a piece's proportions.
REQUIREMENTS = {"min_width": 1080, "min_height": 1080, "formats": ("JPEG", "PNG", "PDF"), "max_mb": 5, "min_pages": 1, "max_pages": 12, "required_text": "oferta"}
LAYOUT_RULES = (
    ("1:1", 1080.0, 1080.0, 1000.0, 1000.0, 540.0, 540.0),
    ("ST", 1080.0, 1920.0, 960.0, 1360.0, 540.0, 831.0),
)
# Expected logo and its container on the canvas by piece type, as x, y, width, height.
LOGOS = {"1:1": (989.0, 90.0, 71.0, 54.0), "ST": (946.0, 291.0, 71.0, 54.0)}
CONTAINERS = {"1:1": (946.0, 291.0, 102.0, 101.0), "ST": (989.0, 90.0, 102.0, 101.0)}
SIZE_TOLERANCE, POSITION_TOLERANCE = 0.10, 40.0
RATIO_TOLERANCE = 0.03
ALIASES = {"ST": "slideshow"}
SUPPORTED = ("slideshow", "mtlk")


def normalize_format(name: Column) -> Column:
    """Upper case without blanks at the ends; JPG is JPEG; null becomes empty."""
    t = F.upper(F.trim(F.coalesce(name, F.lit(""))))
    return F.when(t == "JPG", "JPEG").otherwise(t)


def aspect_ratio(w: Column, h: Column) -> Column:
    """``w:h`` in lowest terms; ``0:0`` unless both are positive.  Euclid's steps, enough of them for any int."""
    pair = F.struct(w.cast("long").alias("a"), h.cast("long").alias("b"))
    gcd = F.aggregate(F.sequence(F.lit(1), F.lit(48)), pair, lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.greatest(s["b"], F.lit(1))).alias("b"))), lambda s: s["a"])
    part = lambda v: (v / gcd).cast("long").cast("string")
    return F.when((w > 0) & (h > 0), F.concat(part(w), F.lit(":"), part(h))).otherwise("0:0")


def to_megabytes(kb: Column) -> Column:
    return F.format_string("%.2f MB", kb / F.lit(1024.0))


def piece_type(w: Column, h: Column) -> Column:
    """1:1 or ST by proportion, else null."""
    ratio = w / h.cast("double")
    near = lambda value: F.abs(ratio - F.lit(value)) <= RATIO_TOLERANCE
    return F.when((w > 0) & (h > 0), F.when(near(1.0), "1:1").when(near(1080.0 / 1920.0), "ST"))


def technical_validation(assets: DataFrame, rules: dict = REQUIREMENTS) -> DataFrame:
    """``asset_id, format_allowed, dimensions_valid, file_size_valid``; PDFs must also have the right pages and the required text."""
    fmt, pages = normalize_format(F.col("raw_format")), F.col("page_count")
    big = (F.col("width") >= rules["min_width"]) & (F.col("height") >= rules["min_height"])
    paged = F.coalesce((pages >= rules["min_pages"]) & (pages <= rules["max_pages"]), F.lit(False))
    worded = F.contains(F.lower(F.coalesce("extracted_text", F.lit(""))), F.lit(rules["required_text"].lower()))
    return assets.select(
        "asset_id",
        fmt.isin(*rules["formats"]).alias("format_allowed"),
        F.when(fmt == "PDF", big & paged & worded).otherwise(big).alias("dimensions_valid"),
        (F.col("file_size_kb") * 1024 <= rules["max_mb"] * 1024 * 1024).alias("file_size_valid"),
    )


def load_layout_rules(spark: SparkSession) -> DataFrame:
    """One row per piece type: canvas size and the safe area's size and centre."""
    return spark.createDataFrame(list(LAYOUT_RULES), "piece_type string, canvas_w double, canvas_h double, safe_w double, safe_h double, center_x double, center_y double")


def apply_layout_rules(assets: DataFrame) -> DataFrame:
    """Assets with the rule of their piece type, nulls without one; the rules are two rows, so they are broadcast."""
    typed = assets.withColumn("piece_type", piece_type(F.col("width"), F.col("height")))
    return typed.join(F.broadcast(load_layout_rules(assets.sparkSession)), "piece_type", "left")


def safe_area(assets: DataFrame) -> DataFrame:
    """``asset_id, piece_type, safe_x, safe_y, safe_width, safe_height`` in the piece's own pixels."""
    r = apply_layout_rules(assets)
    sx, sy = F.col("width") / F.col("canvas_w"), F.col("height") / F.col("canvas_h")
    return r.select(
        "asset_id",
        "piece_type",
        ((F.col("center_x") - F.col("safe_w") / 2.0) * sx).alias("safe_x"),
        ((F.col("center_y") - F.col("safe_h") / 2.0) * sy).alias("safe_y"),
        (F.col("safe_w") * sx).alias("safe_width"),
        (F.col("safe_h") * sy).alias("safe_height"),
    )


def effective_piece_format(given: Column, kind: Column) -> Column:
    """The given format in lower case, else the alias of the piece type, else null."""
    alias = F.lit(None)
    for k, v in ALIASES.items():
        alias = F.when(kind == k, v).otherwise(alias)
    return F.coalesce(F.nullif(F.lower(F.trim(given)), F.lit("")), alias)


def filter_accepted_uploads(assets: DataFrame) -> DataFrame:
    """``batch_id, accepted, ignored``: files whose extension is an image's or a document's, and the others."""
    ok = F.lower(F.trim("raw_format")).isin("jpg", "jpeg", "png", "pdf")
    return assets.groupBy("batch_id").agg(F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("ignored"))


def text_inside_safe_area(words: DataFrame, areas: DataFrame) -> DataFrame:
    """``asset_id, text_inside_safe_area``: every word of positive size lies in the asset's area; true without words or area.

    ``areas(asset_id, safe_x, safe_y, safe_width, safe_height)``; words are reduced to one box per asset before the join.
    """
    box = words.where("w > 0 and h > 0").groupBy("asset_id").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max(F.col("x") + F.col("w")).alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2"))
    inside = (F.col("x1") >= F.col("safe_x")) & (F.col("y1") >= F.col("safe_y")) & (F.col("x2") <= F.col("safe_x") + F.col("safe_width")) & (F.col("y2") <= F.col("safe_y") + F.col("safe_height"))
    return areas.join(box, "asset_id", "left").select("asset_id", F.coalesce(inside, F.lit(True)).alias("text_inside_safe_area"))


def layout_score(checks: DataFrame) -> DataFrame:
    """``asset_id, layout_score`` of five checks of equal weight; what concerns a logo counts only where one was found."""
    found = F.col("logo_detected")
    rules = (
        ~found | F.col("logo_inside_safe_area"),
        ~found | F.col("logo_position_valid"),
        ~found | F.col("logo_size_valid"),
        ~found | ~F.col("container_detected") | F.col("container_size_valid"),
        F.col("text_inside_safe_area"),
    )
    return checks.select("asset_id", (sum(r.cast("int") for r in rules) * 20).alias("layout_score"))


def is_supported(piece_format: Column, supported: tuple[str, ...] = SUPPORTED) -> Column:
    """Whether pieces of this format are compared with a catalog."""
    return F.coalesce(piece_format.isin(*supported), F.lit(False))


def excel_gate(has_catalog: Column, readable: Column, supported: Column) -> Column:
    """Why a piece is not compared with its catalog: ``not_executed``, ``not_applicable`` or ``error``; null if it is."""
    return F.when(~has_catalog, "not_executed").when(~supported, "not_applicable").when(~readable, "error")


def logo_checks(found: DataFrame) -> DataFrame:
    """``found(asset_id, piece_type, x, y, w, h, container_w, container_h)`` on the canvas -> ``asset_id, logo_size_valid,
    logo_position_valid, logo_inside_safe_area, container_size_valid``; null without a rule for the piece type."""
    table = lambda rules, i: F.create_map(*[F.lit(v) for k, box in rules.items() for v in (k, box[i])])
    rule = lambda rules, i: F.try_element_at(table(rules, i), F.col("piece_type"))
    near = lambda c, value: F.abs(F.col(c) - value) <= value * SIZE_TOLERANCE
    at = lambda c, value: F.abs(F.col(c) - value) <= POSITION_TOLERANCE
    safe = {k: (cx - sw / 2, cy - sh / 2, cx + sw / 2, cy + sh / 2) for k, _, _, sw, sh, cx, cy in LAYOUT_RULES}
    inside = (F.col("x") >= rule(safe, 0)) & (F.col("y") >= rule(safe, 1)) & (F.col("x") + F.col("w") <= rule(safe, 2)) & (F.col("y") + F.col("h") <= rule(safe, 3))
    return found.select(
        "asset_id",
        (near("w", rule(LOGOS, 2)) & near("h", rule(LOGOS, 3))).alias("logo_size_valid"),
        (at("x", rule(LOGOS, 0)) & at("y", rule(LOGOS, 1))).alias("logo_position_valid"),
        inside.alias("logo_inside_safe_area"),
        (near("container_w", rule(CONTAINERS, 2)) & near("container_h", rule(CONTAINERS, 3))).alias("container_size_valid"),
    )
