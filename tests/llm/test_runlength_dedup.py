import random
from collections import Counter

import numpy as np

from galley.llm import runlength_dedup as R


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    times = Counter(hash(d[i : i + length]) for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if times[hash(d[i : i + length])] > 1:
                gone[i : i + length] = True
        spans = int(np.diff(np.concatenate([[0], gone]).astype(int)).clip(0).sum())
        out.append((len(d), int(gone.sum()), spans, bytes(np.frombuffer(d, np.uint8)[~gone])))
    return out


def test_statistics_against_brute_force():
    rng = random.Random(1)
    for _ in range(20):
        raw = bytes(rng.choices(b"ab" if rng.random() < 0.5 else b"abcdefgh", k=rng.randrange(1, 300))) * rng.choice([1, 2]) + R.SEPARATOR + R.TAIL
        got = R.matching_statistics(np.frombuffer(raw, np.uint8))
        for i in range(len(raw)):
            n = 0
            while any(raw[j : j + n + 1] == raw[i : i + n + 1] and len(raw[i : i + n + 1]) == n + 1 for j in range(len(raw)) if j != i):
                n += 1
            assert got[i] == n


def test_against_brute_force(spark):
    rng = random.Random(7)
    words = [f"wörd{i}" for i in range(500)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    shared, long = text(90), text(3000)
    texts = [None, "", "a" * 5000, "xyz " * 700, shared, text(50) + shared + text(60), shared + text(400) + shared, long, long[:9000] + "!" + long[9001:], text(200), text(1000), "q" * 399, "q" * 399, long, "ab" * 199 + "abc", "zab" * 133 + "z"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x")], "doc_id long, text string, kept string")
    rows = sorted(R.remove_repeats(docs).collect(), key=lambda r: r.doc_id)
    want = brute([*texts, texts[3]], R.LENGTH)
    want = sorted([*enumerate(want[:-1]), (3, want[-1])])
    assert [(r.doc_id, (r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), bytes(r.kept))) for r in rows] == want


def test_a_header_in_many_surroundings_is_dealt_out_again(spark):
    """Thousands of contexts share one 32-byte string; keys of more than 100 kB take several levels, up to whole windows."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    header = "=" * 40 + " " + " ".join(word() for _ in range(48))
    around = [" ".join(word() for _ in range(25)) for _ in range(40)]
    texts = [" ".join(word() for _ in range(60)) + " " + header + " " + " ".join(word() for _ in range(60)) for _ in range(2500)]
    texts += [f"{rng.choice(around)} {header} {rng.choice(around)}" for _ in range(300)] + ["z" * n for n in range(398, 900, 7)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = sorted(R.remove_repeats(docs, overfull=20_000).collect(), key=lambda r: r.doc_id)
    assert [(r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), bytes(r.kept)) for r in rows] == brute(texts, R.LENGTH)


def test_null_ids_and_one_id_for_several_texts(spark):
    long = " ".join(map(str, range(300)))
    docs = spark.createDataFrame([(None, long), (None, long), (None, "short"), (1, "x" + long), (1, "other"), (1, None)], "doc_id long, text string")
    rows = R.remove_repeats(docs).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, len(r.kept)) for r in rows) == [(0, 5, 5), (0, len(long), 0), (0, len(long), 0), (1, 0, 0), (1, 5, 5), (1, len(long) + 1, 1)]


def test_empty_table(spark):
    assert R.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
