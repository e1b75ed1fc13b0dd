import hashlib
import random
import zlib

import numpy as np
import pytest

from galley.llm import periodic_runs as P
from galley.llm.queries import op13_periodic_runs


def brute(w):
    out = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(6, 4 * q) and not any(w[s : e - r] == w[s + r : e] for r in range(1, q)):
                out.add((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng):
    n, kind, out = rng.randint(0, 90), rng.random(), []
    if kind < 0.3:
        return [rng.randint(0, 1) for _ in range(n)]
    if kind < 0.5:
        return [rng.randint(0, 40) for _ in range(n)]
    while len(out) < n:
        out += [rng.randint(0, 2) for _ in range(rng.randint(1, 12))] * rng.randint(1, 7)
    return out * rng.randint(1, 3)


def runs_of(docs):
    words = np.array([x for d in docs for x in d], np.int64)
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    first = np.cumsum([0] + [len(d) for d in docs])
    return [(int(doc[s]), int(s - first[doc[s]]), int(e - s), int(q)) for s, e, q in P.find_runs(words, doc)]


def test_against_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        docs = [random_words(rng) for _ in range(rng.randint(1, 5))]
        assert runs_of(docs) == [(k, *r) for k, d in enumerate(docs) for r in brute(d)]


def test_with_hashes_that_take_much_for_equal(monkeypatch):
    monkeypatch.setattr(P._Equal, "__call__", lambda self, a, n, shift: (self.sums[a + n] ^ self.sums[a]) & np.uint64(0) == 0)
    rng = random.Random(6)
    for _ in range(60):
        docs = [random_words(rng)]
        assert runs_of(docs) == [(0, *r) for r in brute(docs[0])]


def test_groups_and_tests_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(P, "GROUP_TESTS", 7)
    monkeypatch.setattr(P, "GROUP_WORDS", 50)
    import pyarrow as pa

    rng = random.Random(7)
    docs = [[str(x) for x in random_words(rng)] for _ in range(30)]
    got = P._analyse(pa.array(docs, pa.list_(pa.string())).slice(3)).to_pylist()
    assert [[(r["start"], r["length"], r["period"]) for r in g["runs"]] for g in got] == [brute(d) for d in docs[3:]]


def test_rules_derive_the_document():
    rng = random.Random(8)
    words = np.array(random_words(rng) + [5, 5, 5, 5, 5, 5, 5], np.int64)
    rule, start, middle, end = P.grammar(words, np.zeros(len(words), np.int64))
    assert ((start < middle) & (middle < end)).all()
    of = {}
    for r, s, m, e in zip(rule, start, middle, end, strict=True):
        assert of.setdefault(int(r), (m - s, words[s:e].tolist())) == (m - s, words[s:e].tolist())
    assert (0, len(words)) in set(zip(start.tolist(), end.tolist(), strict=True))


@pytest.mark.parametrize("n", [300_000])
def test_very_long_texts_stay_near_linear(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    for words in (np.zeros(n, np.int64), np.arange(n) % 977, np.array(b)):
        P.find_runs(words, np.zeros(len(words), np.int64))


def expected(doc_id, text):
    ws = [w for w in "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in text or "").split(" ") if w]
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(ws)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
    runs = brute(ws)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(ws) if i not in gone)))


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(10)
    texts = {i: " ".join(rng.choice("ab cd ef gh".split()) for _ in range(rng.randint(0, 60))) for i in range(80)}
    texts |= {100: None, 101: "", 102: "\t\n  \x0b", 103: "a b " * 8, 104: "x " * 9, None: "y y y y y y", 105: "no no no\nno no\tno  no"}
    rows = [*texts.items(), (104, texts[104])]
    spark.createDataFrame([(i, t, "w", "f") for i, t in rows], "doc_id long, text string, words string, found string").write.parquet(f"{tmp_path}/documents.parquet")
    columns = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = sorted((tuple(r) for r in op13_periodic_runs(spark, str(tmp_path)).select(*columns).collect()), key=repr)
    assert got == sorted((expected(i, t) for i, t in rows), key=repr)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(80))


def test_no_rows(spark):
    assert P.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
