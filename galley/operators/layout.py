"""Reading order: words into lines, zones, and figures of recognised text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import written

KEYS = ("asset_id",)


def confidence_metrics(words: DataFrame) -> DataFrame:
    """``asset_id, avg_confidence, min_confidence``."""
    return words.groupBy("asset_id").agg(F.avg("confidence").alias("avg_confidence"), F.min("confidence").alias("min_confidence"))


#: Pieces whose splits or keys are broadcast (a few numbers each); more of them are joined by a shuffle.
BROADCAST_SPLITS = 1_000_000
#: Width of the cells that centres are gathered in: wider gaps are found by the cells alone.
CELL = 64


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS else df


def _with(items: DataFrame, found: DataFrame, keys: tuple[str, ...], how: str) -> DataFrame:
    """Items joined with a table of the same keys, null keys included, whose keys are left out."""
    named = found.withColumnsRenamed({k: f"__{k}" for k in keys})
    return items.join(_few(named), reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), how).drop(*[f"__{k}" for k in keys])


def _widest(placed: DataFrame, keys: tuple[str, ...], cell: int | None) -> DataFrame:
    """``keys, axis, gap, i, n, at, size``: of each group and axis the widest gap between neighbouring centres (of different
    cells), the first of equal ones; the centres up to it and in all; its middle; the common box's size."""
    axis = lambda name, low, size: F.struct(F.lit(name).alias("axis"), F.col(f"c{name}").cast("double").alias("v"), F.col(low).alias("low"), (F.col(low) + F.col(size)).alias("high"))
    both = placed.select(*keys, F.explode(F.array(axis("x", "x", "w"), axis("y", "y", "h"))).alias("a")).select(*keys, "a.*")
    at = F.floor(F.col("v") / cell) if cell else F.col("v")
    values = both.groupBy(*keys, "axis", at.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("first"), F.max("v").alias("last"), F.min("low").alias("low"), F.max("high").alias("high"))
    order = W.partitionBy(*keys, "axis").orderBy("cell")
    rows = values.withColumns({"next": F.lead("first").over(order), "i": F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0))})
    widest = F.max(F.when(F.col("next").isNotNull(), F.struct((F.col("next") - F.col("last")).alias("gap"), (-F.col("i")).alias("i"), "last", "next")))
    found = rows.groupBy(*keys, "axis").agg(widest.alias("g"), F.sum("n").alias("n"), (F.max("high") - F.min("low")).alias("size"))
    return found.select(*keys, "axis", F.col("g.gap").alias("gap"), (-F.col("g.i")).alias("i"), "n", ((F.col("g.last") + F.col("g.next")) / 2.0).alias("at"), "size")


def splits(placed: DataFrame, keys: tuple[str, ...], x_share: float, y_share: float, canvas: DataFrame | None = None) -> DataFrame:
    """``keys, sx, sy`` of items with centres ``cx, cy``: where the widest gap of an axis parts a group; groups without any
    split are left out.

    There is a split only for six or more values, if the gap is at least ``share`` of the span (the common box's, or
    ``width, height`` of ``canvas``) and leaves two values on both sides; of equal gaps the first counts.  Centres are
    gathered in cells before they move.  Where a gap narrower than a cell would do, the distinct centres of the group
    are looked at in a second pass.
    """
    share = F.when(F.col("axis") == "x", x_share).otherwise(y_share)

    def judged(cell: int | None, items: DataFrame) -> DataFrame:
        found = _widest(items, keys, cell).withColumn("share", share)
        if canvas is None:
            found = found.withColumn("span", F.col("size").cast("double"))
        else:
            found = found.join(canvas.select(*keys, "width", "height"), [*keys]).withColumn("span", F.when(F.col("axis") == "x", F.col("width")).otherwise(F.col("height")).cast("double"))
        sound = (F.col("n") >= 6) & (F.col("span") > 1e-6)
        cut = sound & (F.col("i") >= 2) & (F.col("n") - F.col("i") >= 2) & (F.col("gap") / F.col("span") >= F.col("share"))
        narrow = sound & (F.coalesce("gap", F.lit(0.0)) <= cell) & (F.col("share") * F.col("span") <= cell + 1) if cell else F.lit(False)
        return found.select(*keys, "axis", F.when(cut, F.col("at")).alias("split"), F.coalesce(narrow, F.lit(False)).alias("narrow")).where("split is not null or narrow")

    coarse = written(judged(CELL, placed))
    made = coarse.where("not narrow")
    narrow = coarse.where("narrow").select(*keys, "axis")
    if not narrow.isEmpty():
        fine = judged(None, _with(placed, narrow.select(*keys).distinct(), keys, "left_semi"))
        made = made.unionByName(_with(fine, narrow, (*keys, "axis"), "left_semi"))
    return made.groupBy(*keys).agg(*[F.max(F.when(F.col("axis") == a, F.col("split"))).alias(f"s{a}") for a in "xy"])


def _split(keys: tuple[str, ...], value: str, low: str, size: str, share: float) -> Column:
    """The same split as a column of the group's own rows: windows over one exchange by the keys, no join.  Ties need no
    further order, as only the values of the widest gap are used."""
    group, order = W.partitionBy(*keys), W.partitionBy(*keys).orderBy(value)
    after, i = F.lead(value).over(order), F.row_number().over(order)
    g = F.max(F.when(after.isNotNull(), F.struct((after - F.col(value)).alias("gap"), (-i).alias("i"), F.col(value).alias("v"), after.alias("next")))).over(group)
    n, span = F.count(F.lit(1)).over(group), F.max(F.col(low) + F.col(size)).over(group) - F.min(low).over(group)
    at = -g["i"]
    return F.when((n >= 6) & (at >= 2) & (n - at >= 2) & (span > 1e-6) & (g["gap"] / span >= share), (g["v"] + g["next"]) / 2.0)


def _zone(prefix: str) -> Column:
    v = F.when(F.col("sy").isNull(), "A").when(F.col("cy") < F.col("sy"), "T").otherwise("B")
    h = F.when(F.col("sx").isNull(), "A").when(F.col("cx") < F.col("sx"), "L").otherwise("R")
    none = F.col("sx").isNull() & F.col("sy").isNull()
    return F.when(none, f"{prefix}ALL").otherwise(F.concat(F.lit(prefix), v, h))


def _centred(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"cx": F.col("x") + F.col("w") / F.lit(2.0), "cy": F.col("y") + F.col("h") / F.lit(2.0)})


def macro_zones(items: DataFrame, keys: tuple[str, ...] = KEYS, x_share: float = 0.20, y_share: float = 0.22, prefix: str = "Z_") -> DataFrame:
    """Boxes with ``zone``: T or B and L or R by the splits of their centres; A where an axis has none, ALL for both; and their
    centres ``cx``, ``cy``.

    The spans are those of the group's common box.  ``items`` are read two or three times, for the splits and for their zones, and do not
    move: most groups have no split, and those of the others go to the items.
    """
    placed = _centred(items)
    return _with(placed, written(splits(placed, keys, x_share, y_share)), keys, "left").withColumn("zone", _zone(prefix)).select(*placed.columns, "zone")


def macro_zones_windowed(lines: DataFrame, keys: tuple[str, ...] = KEYS, x_share: float = 0.20, y_share: float = 0.22, prefix: str = "Z_") -> DataFrame:
    """The same of lines that are dear to make or lie by their keys already: they are read once; both axes share one exchange
    by the keys and take a sort each."""
    split = _centred(lines).withColumn("sx", _split(keys, "cx", "x", "w", x_share)).withColumn("sy", _split(keys, "cy", "y", "h", y_share))
    return split.withColumn("zone", _zone(prefix)).drop("sx", "sy")


def line_of_words(words: DataFrame, share: float = 0.6) -> DataFrame:
    """Words with ``line``: a new line begins where the next centre, from the top, is further down than ``share`` of the last height."""
    order = W.partitionBy("asset_id").orderBy("cy", "x", "word_index")
    placed = words.withColumn("cy", F.col("y") + F.col("h") / F.lit(2.0))
    new = F.coalesce(F.col("cy") - F.lag("cy").over(order) > share * F.lag("h").over(order), F.lit(True))
    return placed.withColumn("new", new.cast("int")).withColumn("line", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("new")


def line_rollup(lined: DataFrame) -> DataFrame:
    """``asset_id, line, text, x, y, w, h, confidence, n_words`` of words with ``line``."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "word_index", "text"))), lambda s: s["text"]), " ")
    return lined.groupBy("asset_id", "line").agg(
        text.alias("text"),
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"),
        (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"),
        F.bround(F.avg("confidence"), 4).alias("confidence"),
        F.count("*").alias("n_words"),
    )


def needs_page_ocr(text: Column) -> Column:
    """Less than 40 characters of embedded text."""
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < 40


def page_rollup(pages: DataFrame) -> DataFrame:
    """``asset_id, n_pages, text``: the non-empty page texts on lines, in page order."""
    kept = F.when(F.trim("text") != "", F.struct("page_index", F.trim("text").alias("text")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda s: s["text"]), "\n")
    return pages.groupBy("asset_id").agg(F.count("*").alias("n_pages"), text.alias("text"))
