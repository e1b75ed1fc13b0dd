import random

import numpy as np

from galley.llm import toxicity


def corpus(spark, n=600):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        toxic = int(i % 4 == 0)
        text = rng.choices(words, k=40)
        if toxic:
            text[rng.randrange(40)] = rng.choice(["vile", "rotten", "nasty"])
        rows.append((i, " ".join(text), toxic, "clash"))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int, score string")


def test_held_out_accuracy_and_sparsity(spark):
    data = corpus(spark)
    at, w = toxicity.fit(data.select("doc_id", "text"), data.select("doc_id", "toxic"))
    assert 0 < len(at) < 1 << toxicity.BITS and np.isfinite(w).all()
    rows = toxicity.score(data, (at, w)).join(data.select("doc_id", "toxic"), "doc_id").where(toxicity.held_out()).collect()
    assert len(rows) > 80
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.9


def test_score_is_the_logistic_of_the_plain_sum(spark):
    data = corpus(spark, 200)
    at, w = toxicity.fit(data.select("doc_id", "text"), data.select("doc_id", "toxic"))
    weight = dict(zip(at.tolist(), w.tolist(), strict=True))
    texts = data.limit(20).collect()
    scores = {r.doc_id: r.score for r in toxicity.score(data, (at, w)).collect()}
    for r in texts:
        total = sum(weight.get(int(i), 0.0) for i in toxicity.features(r.text, toxicity._Hashes()))
        assert abs(scores[r.doc_id] - 1 / (1 + np.exp(-total))) < 1e-5


def test_nulls_empty_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x y"), (2, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 4 and all(r.score == 0 and r.predicted == 0 for r in rows)
    assert toxicity.score(docs.limit(0), model).count() == 0
