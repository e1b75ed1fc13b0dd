"""Words that no area can hold do not move."""

import random

from galley.operators import regions

WORD = "asset_id long, word_index int, text string, x int, y int, w int, h int"
AREA = "asset_id long, ord long, class_name string, x int, y int, w int, h int"


def tables(spark, rng):
    words = [(rng.randint(0, 3), i, f"w{i}", rng.randint(0, 300), rng.randint(0, 3000), rng.randint(1, 60), rng.randint(1, 30)) for i in range(400)] + [(None, 900, "n", 1, 1, 5, 5)]
    areas = [(rng.randint(0, 2), i, rng.choice(["product_photo_area", "sku_area", "other"]), rng.randint(0, 200), rng.randint(0, 300), rng.randint(20, 200), rng.randint(20, 200)) for i in range(30)]
    return words, areas, spark.createDataFrame(words, WORD), spark.createDataFrame(areas, AREA)


def holds(a, w):
    return a[0] == w[0] and all(a[k + 3] <= w[k + 3] + w[k + 5] / 2 <= a[k + 3] + a[k + 5] for k in (0, 1))


def moved(frame):
    """Lines of the plan that look at the common boxes."""
    return [line for line in frame._jdf.queryExecution().optimizedPlan().toString().split("\n") if "__y2" in line]


def test_incidental_words(spark):
    words, areas, w, a = tables(spark, random.Random(1))
    got = regions.incidental_words(w, a)
    first = {p: sorted(x for x in areas if x[0] == p and x[2] == "product_photo_area")[:3] for p in range(4)}
    assert sorted(r.word_index for r in got.collect()) == sorted(x[1] for x in words if any(holds(f, x) for f in first.get(x[0], [])))
    assert moved(got)


def test_masked_words(spark):
    words, areas, w, a = tables(spark, random.Random(2))
    got = regions.mask_words(w, a)
    lost = lambda x: any(holds(f, x) for f in areas if f[2] == "product_photo_area") and not any(holds(f, x) for f in areas if f[2] == "sku_area")
    assert sorted(r.word_index for r in got.collect()) == sorted(x[1] for x in words if not lost(x))
    assert moved(got)
