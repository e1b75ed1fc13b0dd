import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from __spark_entry__ import queries
from galley.operators import grouping as G
from galley.sources.fixtures import fixture

QUERIES = queries()

WORD = "asset_id long, word_index int, text string, x int, y int, w int, h int, confidence double"
PIECE = [
    ("SEMANA", 10, 10, 120, 30), ("DE", 140, 10, 40, 30), ("OFERTAS", 190, 10, 140, 30),
    ("Del", 10, 80, 40, 18), ("lunes", 55, 80, 60, 18), ("21", 120, 80, 25, 18),
    ("SKU:", 10, 300, 60, 16), ("3719383", 75, 300, 90, 16),
    ("S/", 10, 400, 30, 40), ("25.90", 45, 400, 110, 40), ("CMR", 420, 405, 60, 30),
]


def words(spark, pieces=3):
    return spark.createDataFrame([(a, i, t, x, y, w, h, 0.9) for a in range(pieces) for i, (t, x, y, w, h) in enumerate(PIECE)], WORD)


def test_each_word_in_one_line_and_each_line_in_one_micro_block(spark):
    lines = G.group_lines(words(spark)).cache()
    used = lines.select("asset_id", F.explode("words").alias("i")).groupBy("asset_id", "i").count()
    assert used.where("count <> 1").count() == 0 and used.count() == 3 * len(PIECE)
    micros = G.group_micro_blocks(lines).cache()
    held = micros.select("asset_id", F.explode("lines").alias("l")).groupBy("asset_id", "l").count()
    assert held.where("count <> 1").count() == 0 and held.count() == lines.count()
    inside = lines.alias("l").join(micros.alias("m"), (F.col("l.asset_id") == F.col("m.asset_id")) & F.array_contains("m.lines", F.col("l.line")))
    assert inside.where("l.x < m.x or l.y < m.y or l.x + l.w > m.x + m.w or l.y + l.h > m.y + m.h").count() == 0


def test_promotional_words_stay_out_of_the_price(spark):
    rows = G.build_layout(words(spark, 1)).collect()
    roles = {r.role: r.text for r in rows}
    assert "CMR" in roles["promo_badge"] and "CMR" not in roles["price_main"]
    assert "SKU" in roles["sku"] and roles["campaign"] == "SEMANA DE OFERTAS" and roles["date_range"].startswith("Del lunes")


def test_split_point_takes_the_first_of_equal_gaps():
    assert G.split_point([0, 1, 10, 11, 20, 21], 21, 0.2) == 5.5
    assert G.split_point([0, 1, 2, 3, 4], 4, 0.2) is None
    assert G.split_point([0, 9, 10, 11, 12, 13], 13, 0.2) is None


def test_no_words(spark):
    assert G.build_layout(spark.createDataFrame([], WORD)).count() == 0


def long_piece(rng, n):
    """Words of rows that overlap here and there, with empty gaps between; some have no height."""
    out, y = [], 0
    while len(out) < n:
        y += rng.choice([3, 9, 14, 40])
        out += [(7, len(out) + k, rng.choice(["ab", "CMR", "12.90", "precio"]), x + rng.randint(0, 30), y + rng.randint(-4, 4), rng.randint(5, 60), rng.choice([0, 8, 12, 20]), 0.5 + rng.random() / 2) for k, x in enumerate(range(0, rng.choice([120, 500]), 70))]
    return out


def test_bundles_of_strips_give_the_lines_of_the_whole_piece(spark):
    rows = long_piece(random.Random(4), 1200)
    piece = spark.createDataFrame(rows, WORD)
    tall = spark.createDataFrame([*rows, (7, len(rows), "edge", 900, -50, 4, 10**6, 0.5)], WORD)
    held = G.bundles(piece, size=50).select("asset_id", "bundle", "y", "h").collect()
    assert len({r.bundle for r in held}) > 5
    edges = {}
    for r in held:
        low, high = edges.get(r.bundle, (r.y, r.y))
        edges[r.bundle] = (min(low, r.y), max(high, r.y + max(r.h, 1)))
    ordered = [edges[b] for b in sorted(edges)]
    assert all(a[1] <= b[0] for a, b in zip(ordered, ordered[1:]))
    whole = sorted(map(str, G.group_lines(piece, size=10**9).collect()))
    assert sorted(map(str, G.group_lines(piece, size=50).collect())) == whole
    # a word as high as the piece holds all strips together
    assert {r.bundle for r in G.bundles(tall, size=50).select("bundle").distinct().collect()} == {0}


def test_a_very_long_piece_is_spread_over_all_tasks(spark):
    n = 1_000_000
    words = spark.range(n).select(
        F.lit(1).cast("long").alias("asset_id"), F.col("id").cast("int").alias("word_index"), F.lit("a").alias("text"), ((F.col("id") % 8) * 120).cast("int").alias("x"),
        (F.floor(F.col("id") / 8) * 30).cast("int").alias("y"), F.lit(20).alias("w"), F.lit(18).alias("h"), F.lit(0.5).alias("confidence"),
    )
    shares = G.bundles(words).groupBy("bundle").count().collect()
    assert len(shares) == n // G.BUNDLE_WORDS and max(r["count"] for r in shares) == G.BUNDLE_WORDS
    tasks = G.bundles(words).repartition(32, "asset_id", "bundle").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 32 and max(r["count"] for r in tasks) < 4 * n / 32


def test_keys_of_several_columns(spark):
    two = words(spark, 2).withColumn("region_id", F.when(F.col("y") < 200, "r1").otherwise("r2"))
    made = G.build_layout(two, ("asset_id", "region_id"))
    assert made.columns[:2] == ["asset_id", "region_id"]
    one = G.build_layout(two.where("asset_id = 1 and region_id = 'r2'").drop("region_id"))
    same = made.where("asset_id = 1 and region_id = 'r2'").drop("region_id")
    assert sorted(map(str, same.collect())) == sorted(map(str, one.collect()))


def plain_simple(lines):
    """Each line against all blocks so far."""
    blocks = []
    for line in lines:
        for b in blocks:
            last = b[-1]
            x1, x2 = min(m[3] for m in b), max(m[3] + m[5] for m in b)
            by_last, by_block = G._share(last[3], last[3] + last[5], line[3], line[3] + line[5]), G._share(x1, x2, line[3], line[3] + line[5])
            far = abs(line[3] + line[5] / 2 - last[3] - last[5] / 2) > max(last[5], line[5]) * 0.95 and max(by_last, by_block) < 0.10
            if line[4] - last[4] - last[6] <= 1.55 * max(8.0, (line[6] + last[6]) / 2) and not far and (by_last >= 0.18 or by_block >= 0.22):
                b.append(line)
                break
        else:
            blocks.append([line])
    return [(n, [m[1] for m in b]) for n, b in enumerate(blocks, 1)]


def test_simple_blocks_are_those_of_all_comparisons(spark):
    rng = random.Random(8)
    lines, y = {}, 0
    for a in range(4):
        lines[a], y = [], 0
        for n in range(1, 150):
            y += rng.choice([-6, 0, 9, 25, 60])
            lines[a].append((a, n, f"l{n}", rng.randint(0, 400), y, rng.randint(10, 300), rng.choice([0, 8, 20, 20, 20, 400]), 0.8, [n]))
    frame = spark.createDataFrame([r for rows in lines.values() for r in rows], "asset_id long, line int, text string, x int, y int, w int, h int, confidence double, words array<int>")
    got = {}
    for r in G.group_blocks_simple(frame).orderBy("asset_id", "block").collect():
        got.setdefault(r.asset_id, []).append((r.block, r.lines))
    assert got == {a: plain_simple(rows) for a, rows in lines.items()}


def test_few_blocks_are_open_at_a_time():
    block = G._Simple(1)
    block.add(1, "a", 0, 0, 50, 20, 0.9, [1])
    assert block.closed(None, None) and block.closed(60, 45.0)
    assert not block.closed(60, 35.0) and not block.closed(30, 30.0)  # a tall line, or a near one, may still come


def test_long_and_short_pieces_have_the_lines_of_whole_ones(spark):
    rng = random.Random(9)
    rows = [(a, *r[1:]) for a, n in ((1, 300), (2, 30), (3, 700)) for r in long_piece(rng, n)]
    frame = spark.createDataFrame(rows, WORD)
    both = G.group_lines(frame, size=40, most=100)
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan  # some pieces in bundles, one as it is
    assert sorted(map(repr, both.collect())) == sorted(map(repr, G.group_lines(frame).collect()))


def test_words_of_short_pieces_move_once(spark):
    plan = G.group_lines(words(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_blocks_of_a_stream_are_those_of_the_grouping(spark):
    rng = random.Random(10)
    frame = spark.createDataFrame([(a, *r[1:]) for a in range(3) for r in long_piece(rng, 150)], WORD)
    micros = G.group_micro_blocks(G.group_lines(frame))
    got, want = G.build_layout(frame), G.block_rollup(micros)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_strips_in_step_are_placed_like_one_by_one(monkeypatch):
    rng = np.random.default_rng(11)
    sizes = rng.integers(1, 40, 400)
    starts, n = np.cumsum(sizes) - sizes, int(sizes.sum())
    x1, y1 = rng.integers(0, 400, n), rng.integers(0, 60, n)
    x2, y2 = x1 + rng.integers(0, 90, n), y1 + rng.integers(0, 40, n)
    in_step = G._placed_words(x1, y1, x2, y2, starts, sizes)
    monkeypatch.setattr(G, "IN_STEP", n)
    assert (in_step == G._placed_words(x1, y1, x2, y2, starts, sizes)).all()


def test_few_words_of_a_page_are_looked_at_one_by_one(monkeypatch):
    """Strips of similar sizes are placed in step: 50 000 words of short rows without a pass for each strip."""
    n = 50_000
    i = np.arange(n)
    words = {"word_index": i, "text": ["casa"] * n, "x": i % 8 * 120, "y": i // 8 * 30, "w": np.full(n, 60), "h": np.full(n, 18), "confidence": np.full(n, 0.5), "promo": np.zeros(n, bool)}
    placed, place = [], G._Words.place
    monkeypatch.setattr(G._Words, "place", lambda self: placed.append(len(self.x)) or place(self))
    piece, number, made = G._line_columns(np.zeros(n, int), pa.RecordBatch.from_pydict(words))
    assert sum(placed) < 100 and sorted(made[-1].flatten().to_pylist()) == list(range(n)) and number[-1] == len(number)


def test_means_are_those_of_pythons_sum():
    rng = random.Random(12)
    groups = [[rng.choice([rng.random(), 1e16 * rng.random(), -rng.random()]) for _ in range(rng.choice([1, 2, 5, 200]))] for _ in range(300)]
    sizes = np.array(list(map(len, groups)))
    assert G._means(np.concatenate(groups), np.cumsum(sizes) - sizes, sizes).tolist() == [sum(g) / len(g) for g in groups]


def test_pieces_whose_words_lie_together_do_not_move(spark):
    rng = random.Random(13)
    rows = [(a, *r[1:]) for a in range(5) for r in long_piece(rng, 120)]
    frame = spark.createDataFrame(rows, WORD).repartition(3, "asset_id").sortWithinPartitions("asset_id")
    exchanges = frame._jdf.queryExecution().executedPlan().toString().count("Exchange")
    for what in (G.group_lines, G.build_layout):
        near = what(frame, together=True)
        assert near._jdf.queryExecution().executedPlan().toString().count("Exchange") == exchanges
        assert sorted(map(repr, near.collect())) == sorted(map(repr, what(frame.repartition(4)).collect()))


def test_words_move_once_on_their_way_to_blocks(spark):
    assert G.build_layout(words(spark))._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_long_pieces_have_the_blocks_of_whole_ones(spark):
    rng = random.Random(14)
    frame = spark.createDataFrame([(a, *r[1:]) for a, n in ((1, 400), (2, 30)) for r in long_piece(rng, n)], WORD)
    both = G.build_layout(frame, most=100)
    assert "Union" in both._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(repr, both.collect())) == sorted(map(repr, G.build_layout(frame).collect()))


def test_simple_blocks_of_lines_that_lie_together_do_not_move(spark):
    rng = random.Random(15)
    frame = spark.createDataFrame([(a, *r[1:]) for a in range(5) for r in long_piece(rng, 200)], WORD).repartition(3, "asset_id").sortWithinPartitions("asset_id")
    near = G.group_blocks_simple(G.group_lines(frame, together=True), together=True)
    count = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert count(near) == count(frame)
    assert sorted(map(repr, near.collect())) == sorted(map(repr, G.group_blocks_simple(G.group_lines(frame.repartition(4))).collect()))


def test_simple_blocks_in_columns_are_those_of_all_comparisons():
    rng = random.Random(16)
    for _ in range(30):
        y, lines = 0, []
        for n in range(1, 120):
            y += rng.choice([-6, 0, 9, 25, 60])
            lines.append((1, n, "l", rng.randint(0, 400), y, rng.randint(0, 300), rng.choice([0, 8, 20, 20, 400]), 0.8, [n]))
        numbers = G._simple_blocks(*(np.array([line[i] for line in lines]) for i in range(3, 7))).tolist()
        assert [(b + 1, [n for n, of in enumerate(numbers, 1) if of == b]) for b in range(max(numbers) + 1)] == plain_simple(lines)


def test_texts_are_dealt_out_before_they_become_words(spark, tmp_path, monkeypatch):
    """The queries move documents, not words; one id in two rows is one piece, and very long texts go by bundles."""
    rng = random.Random(17)
    text = lambda n: " ".join(rng.choice(["casa", "de", "CMR", "12.90", "Oferta"]) for _ in range(n))
    rows = [(i, text(rng.choice([1, 20, 60]))) for i in range(30)] + [(3, text(40)), (40, None), (41, ""), (42, text(900))]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    d = str(tmp_path)
    lines = G.group_lines(fixture(spark, d, "fx_words"))
    joined = F.array_join(F.col("words").cast("array<string>"), ",")
    wants = {"group_lines": lines.withColumn("words", joined), "build_layout": G.build_layout(fixture(spark, d, "fx_words")).withColumn("words", joined), "group_blocks_simple": G.group_blocks_simple(lines)}
    for name, want in wants.items():
        # words of one number in one place of a piece have no order of their own: the two rows of id 3 are compared by count
        rest = lambda df: sorted(repr(r) for r in df.collect() if r.asset_id != 3)
        plan = QUERIES[name](spark, d)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
        assert rest(QUERIES[name](spark, d)) == rest(want)
        assert QUERIES[name](spark, d).where("asset_id = 3").count() == want.where("asset_id = 3").count()
        with monkeypatch.context() as m:
            m.setattr(G, "LONG_PIECE", 500)
            assert rest(QUERIES[name](spark, d)) == rest(want)
