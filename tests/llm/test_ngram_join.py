import random

import numpy as np

from galley.llm import ngram_join as J


def brute(texts):
    sets = [set(J.shingles(t, J._Hashes()).tolist()) for t in texts]
    n = len(texts)
    links = [[j for j in range(n) if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= J.PERCENT * len(sets[i] | sets[j])] for i in range(n)]
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            least = min([label[i], *(label[j] for j in links[i])])
            if least < label[i]:
                label[i], changed = least, True
    return [(label[i], len(links[i])) for i in range(n)]


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "  \n", "one two", "one  two", "A b C d E", "a B c D e"]
    for _ in range(12):
        base = rng.choices(words, k=rng.randrange(30, 300))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(0, 4)):
            near = list(base)
            for _ in range(rng.randrange(1, 1 + len(base) // 60 + 1)):
                near[rng.randrange(len(near))] = "changed"
            texts.append(" ".join(near))
    family = rng.choices(words, k=200)
    for i in range(60):
        near = list(family)
        near[rng.randrange(200)] = f"x{i}"
        texts.append(" ".join(near))
    texts += [texts[-1]] * 5
    return texts


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string")


def test_same_links_as_brute_force(spark):
    texts = corpus()
    rows = {r.doc_id: (r.class_id, r.n_links) for r in J.near_duplicates(table(spark, texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == brute(texts)


def test_large_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BRUTE", 4)
    monkeypatch.setattr(J, "BLOCK", 7)
    texts = corpus(4)
    rows = {r.doc_id: (r.class_id, r.n_links) for r in J.near_duplicates(table(spark, texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == brute(texts)


def test_recall_of_pairs_at_the_threshold(spark):
    """Pairs of 0.80 to 0.85 of texts that share nothing else: at least nine in ten are linked."""
    rng = random.Random(17)
    texts, near = [], 0
    for p in range(300):
        base = [f"p{p}w{i}" for i in range(rng.randrange(60, 200))]
        other = list(base)
        while True:
            trial = list(other)
            trial[rng.randrange(len(trial))] = f"c{p}x{rng.random()}"
            a, b = (set(J.shingles(" ".join(t), J._Hashes()).tolist()) for t in (base, trial))
            if len(a & b) / len(a | b) < 0.80:
                break
            other = trial
        texts += [" ".join(base), " ".join(other)]
    rows = {r.doc_id: r.n_links for r in J.near_duplicates(table(spark, texts)).collect()}
    want = [k for _, k in brute(texts)]
    assert sum(want) >= 500 and sum(rows[i] for i in range(len(texts))) >= 0.99 * sum(want)


def test_one_row_of_a_class_is_kept(spark):
    long = " ".join(map(str, range(60)))
    docs = spark.createDataFrame([(5, long), (5, long), (5, "other"), (7, long + " x"), (None, long), (None, "alone"), (8, None), (9, "")], "doc_id long, text string")
    rows = J.near_duplicates(docs, mark=True).collect()
    kept = sorted((r.doc_id or 0, r.class_id or 0) for r in rows if r.kept)
    assert kept == [(0, 0), (0, 5), (5, 5), (8, 8), (9, 9)]


def test_exact_links_by_matrix():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(25)]
    got = J.exact_links(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            x, y = set(a.tolist()), set(b.tolist())
            assert got[i, j] == (i != j and 100 * len(x & y) >= J.PERCENT * len(x | y))


def test_empty_table(spark):
    assert J.near_duplicates(table(spark, [])).count() == 0


def test_recall_counts_the_agreement_floor():
    """Drawn pairs at the threshold: embeddings agree by chance, then runs meet by chance."""
    assert J.recall_of(J.runs_needed()) >= J.TARGET_RECALL > J.recall_of(J.runs_needed() - 1)
    rng = np.random.default_rng(5)
    agree = rng.binomial(J.COORDINATES, J.PERCENT / 100, 400_000)
    met = np.ones(len(agree))
    for _ in range(J.LEVELS):
        met = 1 - np.exp(-J.SAMPLED * agree / J.COORDINATES * met)
    found = (agree >= J.AGREE * J.COORDINATES) * (1 - (1 - met) ** J.runs_needed())
    assert found.mean() >= J.TARGET_RECALL


def test_both_sides_of_a_large_bucket_are_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 10)
    monkeypatch.setattr(J, "BUCKET_BLOCK", 40)
    mixed = spark.createDataFrame([(7, i, i, i % 3 == 0, 600, 400) for i in range(600)], "path long, node long, component long, other boolean, n long, k long")
    tasks = {}
    for r in J._probe_blocks(mixed).collect():
        tasks.setdefault((r.x, r.y), ([], []))[r.probe].append(r.node)
    assert max(len(rows) + len(probes) for rows, probes in tasks.values()) < 120
    met = [(p, n) for rows, probes in tasks.values() for p in probes for n in rows]
    assert len(met) == len(set(met)) == 200 * 600


def test_a_bucket_that_its_leader_links_has_no_children(spark, monkeypatch):
    monkeypatch.setattr(J, "BRUTE", 8)
    made, cut = [], J.cut

    def counted(df):
        out = cut(df)
        if df.columns == ["node", "path"]:
            made.append(out.count())
        return out

    monkeypatch.setattr(J, "cut", counted)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base[:i], f"x{i}", *base[i + 1 :]]) for i in range(120)] + [" ".join(f"t{k}w{i}" for i in range(40)) for k in range(20)]
    rows = {r.doc_id: (r.class_id, r.n_links) for r in J.near_duplicates(table(spark, texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == brute(texts)
    assert made[0] > 120 * J.runs_needed() and sum(made[1:]) == 0
