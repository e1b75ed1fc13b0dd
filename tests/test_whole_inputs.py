"""The derived input tables hold the whole of the driver's tables, in Spark and in DuckDB."""

import duckdb
import pandas as pd
import pytest

from galley.operators import grouping as G
from galley.queries import QUERIES
from galley.sources.fixtures import duck, fixture


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 120, 121, 900)] + [None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    return d, texts


def twin(d, table, name, query):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{d}/{table}.parquet/*.parquet'")
    return con.sql(f"{duck(name)} {query}").fetchall()


def test_every_word_is_in_a_piece(spark, tables):
    d, texts = tables
    want = sorted((i, k, w) for i, t in enumerate(texts) for k, w in enumerate((t or "").split()))
    got = fixture(spark, d, "fx_words").select("asset_id", "word_index", "text").collect()
    assert sorted(map(tuple, got)) == want
    assert sorted(twin(d, "documents", "fx_words", "SELECT asset_id, word_index, text FROM fx_words")) == want


def piece(n):
    rows = [(1, i, f"w{i}", 10 + (i % 8) * 120, 10 + i // 8 * 30 + i % 3, 60, 18 + i % 4, 0.9, "unknown") for i in range(n)]
    rows += [(1, n, "tall", 1500, 10, 40, n // 8 * 30, 0.9, "unknown"), (1, n + 1, "side", 1545, n // 8 * 30, 40, 18, 0.9, "unknown")]
    return pd.DataFrame(rows, columns="asset_id word_index text x y w h confidence role".split())


def test_words_of_a_long_piece_are_compared_with_near_lines_only(monkeypatch):
    calls, fit = [], G._fit
    monkeypatch.setattr(G, "_fit", lambda *a: calls.append(1) or fit(*a))

    def compared(n):
        calls.clear()
        lines = G._lines(piece(n).head(n))
        assert sorted(i for words in lines["words"] for i in words) == list(range(n))
        return len(calls)

    assert compared(4000) < 5 * compared(1000)


def test_a_tall_word_still_meets_lines_far_above_its_centre():
    """Against the same pass over all lines."""
    pdf = piece(160)
    words = sorted(pdf.itertuples(index=False), key=lambda t: (t.y + t.h / 2, t.x + t.w / 2, t.word_index))
    lines = []
    for word in words:
        edges = (word.x, word.y, word.x + word.w, word.y + word.h)
        fits = [(score, -i) for i, line in enumerate(lines) if (score := G._fit([line.x1, line.y1, line.x2, line.y2], *edges)) is not None]
        if fits:
            lines[-max(fits)[1]].add(word)
        else:
            lines.append(G._Frame([word]))
    parts = [p for line in lines for c in G._columns(line) for p in G._badges(c)]
    want = sorted([m.word_index for m in sorted(p.members, key=lambda m: m.x)] for p in parts)
    assert sorted(G._lines(pdf)["words"]) == want


def test_every_event_is_a_detection(spark, tmp_path):
    rows = [(i, i % 3, "view") for i in range(60)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(r.event_id for r in fixture(spark, str(tmp_path), "fx_detections").collect()) == list(range(60))
    assert sorted(twin(tmp_path, "events", "fx_detections", "SELECT event_id FROM fx_detections")) == [(i,) for i in range(60)]


def test_pages_have_whole_texts(spark, tables):
    d, texts = tables
    query = "SELECT asset_id * 4 + page_index AS id, embedded_text, ocr_text FROM"
    want = [(i, "" if i % 7 == 0 else t, None if i % 5 == 0 or t is None else t.replace("er", "cr")) for i, t in enumerate(texts)]
    got = spark.sql(f"{query} {{pages}}", pages=fixture(spark, d, "fx_pages")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert sorted(twin(d, "documents", "fx_pages", f"{query} fx_pages")) == sorted(want)


def test_recognised_words_are_read_without_an_exchange(spark, tables):
    d, texts = tables
    got = QUERIES["ingest_ocr_words"](spark, d)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.asset_id, r.word_index, r.text) for r in got.collect()) == sorted((i, k, w) for i, t in enumerate(texts) for k, w in enumerate((t or "").split()))
