from pyspark.sql import functions as F

from galley.llm import exact_dedup as E

SCHEMA = "doc_id long, text string, hash string, row string, n string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "h", "r", "n") for i, t in rows], SCHEMA)


def grouped(spark, rows, keep="greatest", **how):
    return sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.keep_id is None else r.keep_id, r.group_size, r.kept) for r in E.group_copies(docs(spark, rows), keep, **how).collect())


def brute(rows, keep="greatest"):
    pick = max if keep == "greatest" else min
    out = []
    for i, t in rows:
        same = [j for j, u in rows if (u or "") == (t or "")]
        kept = pick(j for j in same)
        out.append((i, kept, len(same), i == kept))
    return sorted(out)


ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, ""), (5, None), (6, "a "), (7, "b"), (8, "é"), (9, "é"), (10, "x" * 3_000_000), (11, "x" * 3_000_000), (12, "x" * 2_999_999)]


def test_against_brute_force_by_broadcast_and_without(spark):
    for keep in ("least", "greatest"):
        for most in (E.BROADCAST_HASHES, 0):
            assert grouped(spark, ROWS, keep, broadcast_hashes=most) == brute(ROWS, keep)


def test_texts_that_share_a_hash_come_apart(spark):
    weak = lambda text: F.unhex(F.substring(F.md5(text), 1, 2)).cast("binary")
    rows = [(i, f"text {i // 3}") for i in range(1500)]
    for most in (E.BROADCAST_HASHES, 0):
        assert grouped(spark, rows, digest=weak, broadcast_hashes=most) == brute(rows)


def test_of_repeated_rows_one_stays_and_null_ids_come_last(spark):
    rows = [(1, "a"), (1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (2, "c")]
    got = grouped(spark, rows)
    assert [g for g in got if g[0] == 1] == [(1, 1, 4, False), (1, 1, 4, False), (1, 1, 4, True)]
    assert [g for g in got if g[0] == -1] == [(-1, -1, 2, False), (-1, -1, 2, True), (-1, 1, 4, False)]
    left = E.deduplicate(docs(spark, rows))
    assert left.columns == ["doc_id", "text", "hash", "row", "n"]
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, "b"), (1, "a"), (2, "c")]
    assert E.deduplicate(docs(spark, ROWS), "greatest").count() == 8


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert E.group_copies(empty).count() == 0 and E.deduplicate(empty).count() == 0
