import random

import pytest
from pyspark.sql import functions as F

from galley.functions.geometry import Box
from galley.operators import proposals, spatial

BOX = "asset_id long, ord long, x int, y int, w int, h int, extra string"


def boxes(rng, n, spread=900, sizes=(0, 5, 60, 129, 700, 9000)):
    return [(rng.randint(0, 2), i, rng.randint(-spread, spread), rng.randint(-spread, spread), rng.randint(0, rng.choice(sizes)), rng.randint(0, rng.choice(sizes)), "e") for i in range(n)]


def meets(a, b):
    return all(max(a[k], b[k]) < min(a[k] + a[k + 2], b[k] + b[k + 2]) for k in (2, 3))


def test_overlapping_pairs_of_all_sizes_come_once(spark):
    rng = random.Random(1)
    left, right = boxes(rng, 150), boxes(rng, 150)
    none = [(0, 900, None, 1, 5, 5, "e"), (None, 901, 1, 1, 5, 5, "e"), (0, 902, 1, 1, None, 5, "e")]
    got = spatial.overlapping(spark.createDataFrame(left + none, BOX), spark.createDataFrame(right + none, BOX)).select("a.ord", "b.ord").collect()
    assert sorted(map(tuple, got)) == sorted((a[1], b[1]) for a in left for b in right if a[0] == b[0] and meets(a, b))
    assert spatial.overlapping(spark.createDataFrame([], BOX), spark.createDataFrame(right, BOX)).count() == 0


def test_points_meet_the_boxes_that_hold_them(spark):
    rng = random.Random(2)
    points, areas = boxes(rng, 200), boxes(rng, 120)
    box = Box.of()
    got = spatial.holding(spark.createDataFrame(points, BOX), spark.createDataFrame(areas, BOX), box.cx, box.cy, {"ord": "area"})
    assert got.columns == [*[c.split()[0] for c in BOX.split(", ")], "area"]
    inside = lambda p, a: a[2] <= p[2] + p[4] / 2 <= a[2] + a[4] and a[3] <= p[3] + p[5] / 2 <= a[3] + a[5]
    assert sorted((r.ord, r.area) for r in got.collect()) == sorted((p[1], a[1]) for p in points for a in areas if p[0] == a[0] and inside(p, a))
    assert spatial.holding(spark.createDataFrame(points, BOX), spark.createDataFrame([], BOX), box.cx, box.cy, {"ord": "area"}).count() == 0


def plain_growth(rows, least):
    left, out = [(r[1], r[2], r[3], r[2] + r[4], r[3] + r[5]) for r in sorted(rows, key=lambda r: r[1])], []
    while left:
        box, grown = left.pop(0), True
        while grown:
            grown, rest = False, []
            for b in left:
                ix, iy = (max(0, min(box[k + 2], b[k + 2]) - max(box[k], b[k])) for k in (1, 2))
                whole = (box[3] - box[1]) * (box[4] - box[2]) + (b[3] - b[1]) * (b[4] - b[2]) - ix * iy
                if whole > 0 and ix * iy / whole >= least:
                    box, grown = (box[0], min(box[1], b[1]), min(box[2], b[2]), max(box[3], b[3]), max(box[4], b[4])), True
                else:
                    rest.append(b)
            left = rest
        out.append(box)
    return [(n, b[1], b[2], b[3] - b[1], b[4] - b[2]) for n, b in enumerate(out, 1)]


@pytest.mark.parametrize("least", [0.1, 0.3, 0.6])
def test_growth_with_cells_is_the_plain_growth(least):
    rng = random.Random(3)
    for _ in range(150):
        rows = boxes(rng, rng.randint(1, 40), rng.choice([20, 60, 200]), (5, 30, 60, 300))
        given = [(r[1], r[2], r[3], r[2] + r[4], r[3] + r[5]) for r in rows]
        assert [(n, b[1], b[2], b[3] - b[1], b[4] - b[2]) for n, b in enumerate(proposals._grow(given, least), 1)] == plain_growth(rows, least)


def test_groups_of_regions_grow_apart(spark):
    rng = random.Random(4)
    rows = boxes(rng, 240, 400, (10, 60, 90))
    got = proposals.merge_overlapping_regions(spark.createDataFrame(rows, BOX), 0.3).collect()
    assert sorted((r.asset_id, r.ord, r.x, r.y, r.w, r.h) for r in got) == sorted((a, *b) for a in range(3) for b in plain_growth([r for r in rows if r[0] == a], 0.3))
    groups = proposals.overlap_groups(spark.createDataFrame(rows, BOX).drop("extra")).collect()
    assert len({(r.asset_id, r.grp) for r in groups}) > 20


def test_very_many_regions_of_one_piece(spark):
    n = 30_000
    at = lambda salt, most: (F.crc32(F.concat(F.col("id").cast("string"), F.lit(salt))) % most).cast("int")
    rows = spark.range(n).select(F.lit(1).cast("long").alias("asset_id"), F.col("id").alias("ord"), at("x", 33_000).alias("x"), at("y", 33_000).alias("y"), (20 + at("w", 60)).alias("w"), (20 + at("h", 60)).alias("h"))
    made = proposals.merge_overlapping_regions(rows, 0.3)
    assert 0.5 * n < made.count() < n


@pytest.mark.parametrize("size", [7, 2048])
def test_all_pairs_of_a_piece_come_once(spark, size):
    rows = boxes(random.Random(5), 90) + [(None, 900, 1, 1, 5, 5, "e"), (0, 901, None, 1, 5, 5, "e")]
    got = spatial.piece_pairs(spark.createDataFrame(rows, BOX), "ord", size=size).select("a.ord", "b.ord").collect()
    assert sorted(map(tuple, got)) == sorted((a[1], b[1]) for a in rows for b in rows if a[0] is not None and a[0] == b[0] and a[1] < b[1])


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_near_points_are_those_in_the_common_box_of_their_piece(spark, monkeypatch, most):
    monkeypatch.setattr(spatial, "BROADCAST_PIECES", most)
    rng = random.Random(6)
    points = boxes(rng, 200) + [(None, 900, 1, 1, 5, 5, "e"), (0, 901, None, 1, 5, 5, "e"), (77, 902, 1, 1, 5, 5, "e")]
    areas = boxes(rng, 6, 200, (40, 90)) + [(0, 903, None, 1, 5, 5, "e")]
    box = Box.of()
    got = spatial.near(spark.createDataFrame(points, BOX), spark.createDataFrame(areas, BOX), box.cx, box.cy).collect()

    def inside(p):
        own = [a for a in areas if a[0] == p[0] and a[2] is not None]
        return bool(own) and p[2] is not None and all(min(a[k] for a in own) <= p[k] + p[k + 2] / 2 <= max(a[k] + a[k + 2] for a in own) for k in (2, 3))

    assert sorted((r.ord, r.near) for r in got) == sorted((p[1], inside(p)) for p in points)
    assert {r.near for r in got} == {True, False}
