import re
import time

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from galley.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for n, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), n, m.end()))
    return [(s, e, n) for s, n, e in sorted(out)]


CASES = [
    None, "", "a.b@c.d_x@y.zz", "é🙂 mail bob+1@ex-a.example.com.", "1.2.3.4.5.6.7.8 256.1.1.1 007.1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (415) 555-2671 x +49", "@" * 500, "a" * 20000 + "@", "9" * 30000, "1 " * 20000, "+1" * 3000, "a@b.c" * 50, "%@x.y..z@q.w", "10.0.0.1" + "." * 90 + "9.9.9.9",
]


def spans(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    return {r.doc_id: [tuple(s) for s in r.base] for r in pii.find(docs).collect()}


def test_base_spans_against_python(spark):
    got = spans(spark, CASES)
    for i, t in enumerate(CASES):
        assert got[i] == brute(t), (t or "")[:50]


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab@.+-() 019é\n%_", max_size=60), min_size=30, max_size=60))
def test_base_spans_on_random_texts(spark, texts):
    got = spans(spark, texts)
    assert all(got[i] == brute(t) for i, t in enumerate(texts))


def test_patterns_discover_unseen_identifiers(spark):
    texts = [f"please call office +1 (415) 555-26{i:02d} today" for i in range(12)] + ["please call office 415 555 9999 now", "the other number 415 555 8888 now", "call office 0171 5554321"]
    rows = {r.doc_id: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    phone = pii.KINDS.index("phone")
    assert [tuple(s) for s in rows[12].discovered] == [(19, 31, phone)]
    assert rows[13].discovered == []
    assert len(rows[14].discovered) == 1
    assert all(rows[i].discovered == [] and len(rows[i].base) == 1 for i in range(12))


def test_the_words_on_both_sides_discover_too(spark):
    texts = [f"w{i} dial +1 (415) 555-26{i:02d} today" for i in range(12)] + ["x9 dial 415 555 9999 today", "x9 dial 415 555 8888 never"]
    rows = {r.doc_id: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [tuple(s) for s in rows[12].discovered] == [(8, 20, pii.KINDS.index("phone"))] and rows[13].discovered == []


def test_null_ids_repeated_rows_and_clashing_names(spark):
    rows = [(None, "a@b.cc", 1), (None, "a@b.cc", 2), (1, None, 3), (1, "x a@b.cc", 4)]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string, spans int")).collect()
    assert sorted((r.doc_id or 0, len(r.base)) for r in got) == [(0, 1), (0, 1), (1, 0), (1, 1)]


def test_empty_table(spark):
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_runs_are_read_once(spark):
    n = 300_000
    runs = ["-" * n, "." * n, "_" * n, "%" * n, " " * n, "a" * n, "a." * n, "-a" * n, "@" * n]
    docs = spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string").repartition(len(runs))
    began = time.perf_counter()
    for pattern in [*pii.PATTERNS.values(), pii.LOOSE]:
        docs.select(F.size(pii.occurrences(F.col("text"), pattern))).write.format("noop").mode("overwrite").save()
    assert time.perf_counter() - began < 120
