import random
import re

from galley.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=D.WINDOW):
    cuts = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - window + 1, 1) if w else 0):
            cuts.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    out = []
    for text in docs:
        w = words(text)
        hit, ids = set(), set()
        for i in range(len(w)):
            for n in {len(c) for c in cuts}:
                found = cuts.get(tuple(w[i : i + n])) if i + n <= len(w) else None
                if found:
                    hit |= set(range(i, i + n))
                    ids |= found
        out.append((len(w), len(hit), sorted(ids)))
    return out


def run(spark, docs, items, **how):
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, words string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: (r.n_words, r.n_hit, r.items) for r in D.contamination(d, b, **how).collect()}


def test_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "ñandú", "Été"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.randrange(1, 30))) for i in range(12)] + [(50, None), (51, " .,! "), (3, "Q r. S"), (60, "only once here")]
    docs = [None, "", "..!"] + [text(rng.randrange(0, 200)) for _ in range(20)]
    docs += [text(10) + " " + rng.choice(items[:12])[1].upper().replace("W", "w") + ", " + text(5) for _ in range(15)]
    docs += [items[0][1] * 2, (items[1][1] + " ") * 400, "x q R s; q r s"]
    got = run(spark, docs, items)
    want = brute(docs, items)
    assert [got[i] for i in range(len(docs))] == want
    shuffled = run(spark, docs, items, broadcast_rows=0)
    assert [shuffled[i] for i in range(len(docs))] == want
    long_only = [x for x in items if len(words(x[1])) > 1]
    got = run(spark, docs, long_only)
    assert [got[i] for i in range(len(docs))] == brute(docs, long_only)


def test_nothing_to_find(spark):
    assert run(spark, ["a b c", None], []) == {0: (3, 0, []), 1: (0, 0, [])}
    assert run(spark, [], [(1, "a b")]) == {}


def test_null_and_repeated_ids(spark):
    d = spark.createDataFrame([(None, "one two three"), (1, "one two three"), (1, "one two three"), (1, "else")], "doc_id long, text string")
    rows = sorted((r.n_words, r.n_hit) for r in D.contamination(d, spark.createDataFrame([(9, "two three")], "item_id long, text string")).collect())
    assert rows == [(1, 0), (3, 2), (3, 2), (3, 2)]


def test_a_window_of_very_many_items(spark):
    """The items of a window stay out of candidates and broadcasts: one boilerplate sentence in 20 000 items."""
    n = 20_000
    line = "this is the same line of ten words in all"
    items = spark.range(n).selectExpr("id as item_id", f"'{line}' as text").union(spark.createDataFrame([(n, "x y z")], "item_id long, text string"))
    d = spark.createDataFrame([(i, line + (" x y z" if i == 5 else f" {i}")) for i in range(20)] + [(20, "x y")], "doc_id long, text string")
    rows = {r.doc_id: (r.n_hit, r.n) for r in D.contamination(d, items).selectExpr("doc_id", "n_hit", "size(items) as n").collect()}
    assert rows == {**{i: (10, n) for i in range(20)}, 5: (13, n + 1), 20: (0, 0)}


def test_windows_that_start_before_or_end_after_a_text(spark):
    assert run(spark, ["b c", "a b", "a b c", "c"], [(1, "a b c")]) == {0: (2, 0, []), 1: (2, 0, []), 2: (3, 3, ["1"]), 3: (1, 0, [])}
