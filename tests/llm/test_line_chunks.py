import random

from galley.llm import line_chunks as L


def deduplicate(spark, texts, **extra):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_lines string")
    return {r.doc_id: r for r in L.deduplicate(docs).collect()}


def chunks(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.c for r in docs.select("doc_id", L.chunks_of(docs.text).alias("c")).collect()}


def brute(parts):
    seen, out = set(), []
    for doc in parts:
        kept = []
        for chunk in doc:
            if len(chunk) >= L.MIN_LINES and tuple(chunk) in seen:
                continue
            if len(chunk) >= L.MIN_LINES:
                seen.add(tuple(chunk))
            kept += chunk
        out.append("\n".join(kept))
    return out


def corpus():
    rng = random.Random(9)
    line = lambda: f"line {rng.randrange(10**6)} é"
    passage = [line() for _ in range(30)]
    texts = ["", "one", "a\nb\nc\nd", "a\nb\nc\nd", "x\n" * 50, "\n\n\n"]
    for _ in range(25):
        own = [line() for _ in range(rng.randrange(0, 12))]
        texts.append("\n".join(own + passage + [line()]) if rng.random() < 0.6 else "\n".join(own))
    return texts + texts[6:9]


def test_against_brute_force(spark):
    texts = corpus()
    parts = chunks(spark, texts)
    assert all("\n".join(t for c in parts[i] for t in c) == t for i, t in enumerate(texts))
    got = deduplicate(spark, texts)
    assert [got[i].text for i in range(len(texts))] == brute([parts[i] for i in range(len(texts))])
    for i, t in enumerate(texts):
        assert got[i].n_lines == len(t.split("\n")) and (got[i].n_removed_lines > 0) == (got[i].n_removed_chunks > 0)


def test_boundaries_do_not_shift(spark):
    rng = random.Random(3)
    lines = [f"line {rng.randrange(10**6)}" for _ in range(200)]
    parts = chunks(spark, ["\n".join(lines), "\n".join(["new", "lines", *lines])])
    assert len({tuple(c) for c in parts[0]} & {tuple(c) for c in parts[1]}) >= len(parts[0]) - 2


def test_nulls_and_empty(spark):
    got = deduplicate(spark, [None, "", None])
    assert got[0].text is None and got[1].text == "" and got[2].n_removed_lines == 0
    assert L.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = L.deduplicate(spark.createDataFrame([(None, "p\nq\nr\ns\nt\nu\nv"), (1, "p\nq\nr\ns\nt\nu\nv")], "doc_id long, text string")).collect()
    assert len(rows) == 2


def test_clashing_names_and_repeated_rows(spark):
    text = "\n".join(f"line {i}" for i in range(60))
    rows = [(1, text, "i", "l", "t"), (1, text, "i", "l", "t"), (2, "x\n" + text, "j", "m", "u")]
    got = L.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, id string, lost string, left string")).collect()
    assert sorted((r.doc_id, r.id, r.lost, r.left) for r in got) == [(1, "i", "l", "t"), (1, "i", "l", "t"), (2, "j", "m", "u")]
    second = next(r for r in got if r.doc_id == 2)
    assert second.n_removed_lines > 30 and len(second.text) < len(text)
