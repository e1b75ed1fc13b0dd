import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    line = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(14)) + "."
    doc = lambda n=8: "\n".join(line() for _ in range(n))
    item = " ".join(f"b{rng.randrange(999)}" for _ in range(25))
    texts = [doc() for _ in range(300)]
    toxic = {i for i in range(0, 240, 4)}
    for i in toxic:
        texts[i] = texts[i].replace(" ", " vile rotten ", 2)
    texts[241] = texts[241] + "\n" + item + "\n" + line()
    texts[243] = texts[242].replace(".", ",", 1)
    texts[245] = None
    texts[247] = ""
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, toxic


def test_run_keeps_and_drops_what_it_should(spark, tables):
    d, toxic = tables
    rows = {r.doc_id: r for r in pipeline.run(spark, d).collect()}
    clean = set(range(300)) - toxic - {241, 243}
    assert 241 not in rows
    assert rows[243].n_tokens < rows[242].n_tokens / 2  # the lines that it shares with 242 have gone
    assert len(toxic & set(rows)) <= 2 and len(clean - set(rows)) <= 2
    assert rows[245].n_tokens == 0 == rows[247].n_tokens


def test_stages_return_the_columns_of_documents(spark, tables):
    d, _ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).schema == docs.schema


def test_near_duplicate_stage_keeps_one_of_each_group(spark, tables):
    d, _ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {r.doc_id for r in pipeline.near_duplicate_stage(spark, docs, d).select("doc_id").collect()}
    assert set(range(300)) - kept == {243}
