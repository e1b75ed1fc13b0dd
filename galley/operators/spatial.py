"""Joins of boxes and points by the cells of a grid.

Boxes go to the cells of the finest grid whose cells are no smaller than they are, so a box has four cells at most
whatever its size; what meets a box of a coarser grid goes to the coarser cells.  The cell is part of the join's keys:
work follows the boxes that are near each other, and a piece with very many of them is spread over its cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Box
from .lineage import written

KEYS = ("asset_id",)
#: Widths of the grids' cells, each for boxes of at most that size; the last one holds any box.
GRIDS = (128, 1024, 8192, 65536, 2**31)
#: Pieces whose common boxes are broadcast (a row of six numbers each); more of them are joined by a shuffle.
BROADCAST_PIECES = 1_000_000
#: Boxes of a piece that meet one another in one go, where all pairs are wanted.
BLOCK = 2048


def grid_of(box: Box) -> Column:
    """The width of the finest cells that are no smaller than a box."""
    size = F.greatest(box.w, box.h)
    return reduce(lambda out, g: F.when(size <= g, g).otherwise(out), reversed(GRIDS[:-1]), F.when(size.isNotNull(), GRIDS[-1])).cast("long")


def _cells(box: Box, grid: Column) -> Column:
    """``array<struct<grid,gx,gy>>`` of the cells that a box touches."""
    at = lambda v: F.floor(v / grid)
    rows = F.sequence(at(box.y), at(box.y2))
    return F.flatten(F.transform(F.sequence(at(box.x), at(box.x2)), lambda gx: F.transform(rows, lambda gy: F.struct(grid.alias("grid"), gx.alias("gx"), gy.alias("gy")))))


def _grids(*boxes: DataFrame) -> list[int]:
    """The grids in use: a list of at most len(GRIDS)."""
    used = reduce(DataFrame.union, [b.select(grid_of(Box.of()).alias("g")) for b in boxes])
    return sorted(r.g for r in used.where("g is not null").distinct().collect()) or [GRIDS[0]]


def near(points: DataFrame, boxes: DataFrame, x: Column, y: Column, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Points with ``near``: whether ``(x, y)`` lies in the common box of all boxes of its keys.

    Others meet no box at all, and need not move: joins of many points with few boxes begin here.
    """
    whole = boxes.where("x is not null and y is not null and w is not null and h is not null")
    edges = [F.min("x").alias("__x1"), F.min("y").alias("__y1"), F.max(F.col("x") + F.col("w")).alias("__x2"), F.max(F.col("y") + F.col("h")).alias("__y2")]
    common = written(whole.groupBy(*keys).agg(*edges))
    if common.limit(BROADCAST_PIECES + 1).count() <= BROADCAST_PIECES:
        common = F.broadcast(common)
    inside = x.between(F.col("__x1"), F.col("__x2")) & y.between(F.col("__y1"), F.col("__y2"))
    return points.join(common, [*keys], "left").select(*[points[c] for c in points.columns], F.coalesce(inside, F.lit(False)).alias("near"))


def holding(points: DataFrame, boxes: DataFrame, x: Column, y: Column, take: dict[str, str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Every point ``(x, y)`` with every box of the same keys that holds it, edges included: the points' columns and the
    boxes' columns ``take`` under their new names.  Points or boxes with nulls meet nothing."""
    given = boxes.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c).alias(f"__box_{c}") for c in "xywh"], *[F.col(c).alias(n) for c, n in take.items()])
    box = Box(*(F.col(f"__box_{c}") for c in "xywh"))
    held = given.withColumn("__cell", F.explode(_cells(box, grid_of(box))))
    own = [F.struct(F.lit(g).cast("long").alias("grid"), F.floor(x / g).alias("gx"), F.floor(y / g).alias("gy")) for g in _grids(boxes)]
    placed = near(points, boxes, x, y, keys).where("near").drop("near").withColumns({"__x": x, "__y": y, "__at": F.explode(F.array(*own))})
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__{k}") for k in keys])
    same = same & reduce(lambda a, b: a & b, [F.col(f"__at.{c}") == F.col(f"__cell.{c}") for c in ("grid", "gx", "gy")])
    met = placed.join(held, same & box.holds(F.col("__x"), F.col("__y")))
    return met.select(*[F.col(f"`{c}`") for c in points.columns], *take.values())


def overlapping(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = KEYS, grids: tuple[int, ...] | None = None) -> DataFrame:
    """``a, b``: pairs, as structs of all columns, of a left and a right box of the same keys that share some area.

    Each pair is made once, in the cell of its common area's upper left corner.  Boxes with nulls or without area meet
    nothing.  ``grids`` saves the count of those in use; all of them are always right.
    """
    used = list(grids or _grids(left, right))

    def spread(df: DataFrame, name: str) -> DataFrame:
        own = grid_of(Box.of())
        cells = F.flatten(F.filter(F.array(*[F.when(own <= g, _cells(Box.of(), F.lit(g).cast("long"))) for g in used]), lambda c: c.isNotNull()))
        sound = df.where("w > 0 and h > 0 and x is not null and y is not null")
        return sound.select(F.struct(*[F.col(c) for c in df.columns]).alias(name), own.alias(f"{name}_grid"), F.explode(cells).alias("cell")).select(name, f"{name}_grid", *[F.col(f"{name}.{k}").alias(f"__{k}") for k in keys], "cell.*")

    a, b = Box.of("a"), Box.of("b")
    x, y = F.greatest(a.x, b.x), F.greatest(a.y, b.y)
    on = [*[f"__{k}" for k in keys], "grid", "gx", "gy"]
    ours, theirs = spread(left, "a"), spread(right, "b")
    # one of the two is at home on the grid where they meet, so small boxes never meet in large cells
    met = ours.where("a_grid = grid").join(theirs, on).unionByName(ours.where("a_grid < grid").join(theirs.where("b_grid = grid"), on))
    here = (F.floor(x / F.col("grid")) == F.col("gx")) & (F.floor(y / F.col("grid")) == F.col("gy"))
    return met.where(here & (x < F.least(a.x2, b.x2)) & (y < F.least(a.y2, b.y2))).select("a", "b")


def piece_pairs(boxes: DataFrame, order: str, keys: tuple[str, ...] = KEYS, size: int = BLOCK) -> DataFrame:
    """``a, b``: all pairs, as structs of all columns, of boxes of the same keys, the lesser ``order`` first.

    The pairs grow with the square of a piece's boxes; a large piece is dealt to blocks that meet two by two, so that no
    task holds more of it than two of them.
    """
    blocks = boxes.groupBy(*keys).agg(F.ceil(F.count("*") / size).alias("__n"))
    own = boxes.join(blocks, [*keys]).withColumn("own", F.pmod(F.xxhash64(order), F.col("__n")))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))

    def side(name: str) -> DataFrame:
        return met.select(*keys, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), F.col("own").alias(f"{name}_own"), F.struct(*[F.col(c) for c in boxes.columns]).alias(name))

    pairs = side("a").join(side("b"), [*keys, "low", "high"]).where(F.col(f"a.{order}") < F.col(f"b.{order}"))
    return pairs.where((F.least("a_own", "b_own") == F.col("low")) & (F.greatest("a_own", "b_own") == F.col("high"))).select("a", "b")
