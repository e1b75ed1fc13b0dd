"""Zones and halves from gathered centres, against windows over all items."""

import random

import pytest
from pyspark.sql import functions as F

from galley.operators import layout, proposals

BOX = "asset_id long, word_index int, x int, y int, w int, h int"


@pytest.mark.parametrize("scale", [1, 7, 200])
def test_zones_as_by_windows(spark, scale):
    rng = random.Random(scale)
    rows = []
    for a in [*range(40), None]:
        for i in range(rng.choice([3, 5, 6, 8, 12, 30])):
            far = rng.choice([0, 0, 60])
            rows.append((a, i, (rng.randint(0, 30) + far) * scale, (rng.randint(0, 30) + (0 if i % 3 else far)) * scale, rng.randint(1, 5), rng.choice([1, 2, 4, None]) if a == 5 else 3))
    items = spark.createDataFrame(rows, BOX)
    plain = lambda df: sorted((str(r.asset_id), r.word_index, r.zone) for r in df.collect())
    got = layout.macro_zones(items)
    assert plain(got) == plain(layout.macro_zones_windowed(items))
    assert len({r.zone for r in got.collect()}) > 3
    # the items themselves are not sorted or shuffled
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("scale", [1, 100])
def test_few_rows_of_a_piece_move(spark, scale):
    words = spark.range(3000).select(F.lit(1).cast("long").alias("asset_id"), F.col("id").cast("int").alias("word_index"), (F.col("id") % 10).cast("int").alias("x"), (F.col("id") % 1000 + F.when(F.col("id") % 1000 > 400, 700 * scale).otherwise(0)).cast("int").alias("y"), F.lit(2).alias("w"), F.lit(2).alias("h"))
    centred = words.withColumns({"cx": F.col("x") + 1.0, "cy": F.col("y") + 1.0})
    values = layout._widest(centred, ("asset_id",), layout.CELL)
    found = {r.axis: r for r in values.collect()}
    assert found["y"].n == 3000 and found["y"].gap == 700 * scale + 1 and found["x"].gap is None
    rows = proposals.propose_split_regions(words, spark.createDataFrame([(1, 20, 1000 + 700 * scale)], "asset_id long, width int, height int")).collect()
    assert [r.region_id for r in sorted(rows, key=lambda r: r.ord)] == ["region_tb_top", "region_tb_bottom", "region_full"]
    assert {r.region_id: r.h for r in rows}["region_tb_top"] == (401 + 401 + 700 * scale + 1) // 2
