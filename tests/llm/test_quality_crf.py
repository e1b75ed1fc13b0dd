import itertools
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from galley.llm import quality_crf as Q


def brute_counts(text):
    words = [w for w in "".join(" " if c in Q.SPACES else c for c in text).split(" ") if w]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [t for t in text.split("\n") if any(c not in Q.SPACES for c in t)]
    return len(words), sum(map(len, words)), sum(c in Q.SYMBOLS for c in text), sum(t in lines[:i] for i, t in enumerate(lines)), len(hit)


def test_base_counts_against_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choices(["a", "b", "é ", " ", "\n", "\t", "#", "|x ", " ", "\x1c"], k=rng.randrange(0, 80)))
        assert Q.base_counts(text) == brute_counts(text)


def test_viterbi_is_the_best_of_all_labellings():
    rng = np.random.default_rng(3)
    for n in range(1, 8):
        field = Q.Field(rng.normal(size=(2, len(Q.FEATURES))), rng.normal(size=(2, 2)))
        x = rng.normal(size=(n, len(Q.FEATURES)))
        score = lambda y: sum(x[i] @ field.emit[y[i]] for i in range(n)) + sum(field.move[a, b] for a, b in itertools.pairwise(y))
        best = max(itertools.product((0, 1), repeat=n), key=score)
        assert tuple(field.decode(x)) == best


def test_learns_content_from_junk(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        good = i % 3 > 0
        line = lambda: " ".join(f"w{rng.randrange(9999)}" for _ in range(25)) + "."
        junk = lambda: " | ".join(f"W{rng.randrange(9999)}" for _ in range(25)) + " !!"
        rows.append((i, "\n".join((line if good else junk)() for _ in range(6)), int(good), "x"))
    data = spark.createDataFrame(rows, "doc_id long, text string, quality int, kept string")
    train, test = data.where("doc_id % 2 = 0"), data.where("doc_id % 2 = 1")
    field = Q.fit(train.select("doc_id", "text"), train.select("doc_id", "quality"))
    got = {r.doc_id: r.kept for r in Q.judge(test, field).collect()}
    assert sum(got[r[0]] == bool(r[2]) for r in rows if r[0] in got) / len(got) > 0.97


def test_nulls_empty_long_and_unlabelled(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "word " * 40), (3, " ".join(f"w{i}" for i in range(60))), (4, "same " * 30000)], "doc_id long, text string")
    field = Q.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    rows = {r.doc_id: r for r in Q.judge(docs, field).collect()}
    assert [rows[k].kept for k in (1, 2, None, 3, 4)] == [False, False, False, True, False]
    assert rows[1].n_words == 0 and rows[4].n_repeat_words == 30000
    assert Q.judge(docs.limit(0), field).count() == 0


def test_expectations_against_all_labellings():
    rng = np.random.default_rng(5)
    s, move = rng.normal(size=(2, 4, 2)), rng.normal(size=(2, 2))
    on = np.array([[True] * 4, [True, True, False, False]])
    p, moves = Q.expectations(s, move, on)
    want_p, want_moves = np.zeros((2, 4, 2)), np.zeros((2, 2))
    for d, n in enumerate((4, 2)):
        paths = list(itertools.product((0, 1), repeat=n))
        mass = np.array([np.exp(sum(s[d, i, y[i]] for i in range(n)) + sum(move[a, b] for a, b in itertools.pairwise(y))) for y in paths])
        for y, m in zip(paths, mass / mass.sum()):
            for i, label in enumerate(y):
                want_p[d, i, label] += m
            for a, b in itertools.pairwise(y):
                want_moves[a, b] += m
    assert np.allclose(p, want_p) and np.allclose(moves, want_moves)


def test_labels_the_lines_inside_a_mixed_document():
    """Good documents open with a menu, bad ones are menus with a little prose: the chain tells the parts apart."""
    rng = random.Random(9)
    prose = lambda: " ".join(f"w{rng.randrange(9999)}" for _ in range(20)) + "."
    menu = lambda: " | ".join(f"W{rng.randrange(99)}" for _ in range(4))
    good = ["\n".join([menu() for _ in range(2)] + [prose() for _ in range(8)]) for _ in range(100)]
    bad = ["\n".join([menu() for _ in range(8)] + [prose() for _ in range(2)]) for _ in range(100)]
    field = Q.Field.fit([Q.line_features(t)[0] for t in good + bad], [1] * 100 + [0] * 100)
    assert field.decode(Q.line_features(good[0])[0]).tolist() == [0] * 2 + [1] * 8
    assert field.decode(Q.line_features(bad[0])[0]).tolist() == [0] * 8 + [1] * 2


def test_repeated_rows_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "y")], "doc_id long, text string, n_words string")
    assert [(r.doc_id, r.n_words) for r in Q.judge(docs, Q.Field.fit([], [])).collect()] == [(1, 2), (1, 2)]


def test_held_out_quality_labels_of_the_given_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    field = Q.fit(docs, labels.where(~held_out))
    rows = Q.judge(docs, field).join(labels, "doc_id").where(held_out & ~F.col("base_failed")).collect()
    assert len(rows) > 50 and sum(r.kept == (r.quality == 1) for r in rows) / len(rows) >= 0.95
