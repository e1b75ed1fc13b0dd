import math
import random
from collections import defaultdict

import pytest

from galley.llm import language_id as L

WORDS = {"en": ["the", "with", "there", "house", "thing"], "fr": ["être", "avec", "maison", "chose", "où"], "de": ["nicht", "haus", "über", "schön", "dinge"]}


def text(rng, lang, n=30):
    return " ".join(rng.choices(WORDS[lang], k=n))


def documents(spark, n=150):
    rng = random.Random(6)
    langs = list(WORDS)
    return spark.createDataFrame([(i, text(rng, langs[i % 3]), langs[i % 3], f"src{i % 5}", "x") for i in range(n)], "doc_id long, text string, lang string, source string, kind string")


def test_trigrams_stay_inside_texts():
    codes, ends = L._trigrams(["abcd", None, "x", "ab", "bcd", "", "abc"])
    assert ends.tolist() == [2, 2, 2, 2, 3, 3, 4]
    assert codes[1] == codes[2] and codes[0] == codes[3]


def test_held_out_accuracy(spark):
    docs = documents(spark)
    model = L.text_model(docs.where("doc_id < 100").select("text", "lang"))
    rest = docs.where("doc_id >= 100")
    rows = L.identify(L.document_records(rest), model).collect()
    truth = {r.doc_id: r.lang for r in rest.collect()}
    assert len(rows) == 50 and sum(r.text_lang == truth[int(r.id)] for r in rows) >= 48


def test_evidence_decides_where_text_is_silent(spark):
    rng = random.Random(8)
    docs = documents(spark)
    model = L.text_model(docs.select("text", "lang"))
    page = lambda lang, body: f'<!DOCTYPE html><html lang="{lang}"><script>the with the</script><body>{body}</body></html>'
    rows = [(i, f"http://www.h{i % 4}.example.{'fr' if i % 2 else 'de'}/x{i}", page("fr" if i % 2 else "de", text(rng, "fr" if i % 2 else "de"))) for i in range(40)]
    rows += [(90, "http://new.example.fr/a", page("fr", "")), (91, "http://h2.example.de/b", "<html><body>?</body></html>"), (92, None, None), (93, "nonsense", "")]
    got = {int(r.id): r for r in L.identify(L.page_records(spark.createDataFrame(rows, "page_id long, url string, html string")), model).collect()}
    assert all(got[i].lang == ("fr" if i % 2 else "de") for i in range(40))
    assert got[90].lang == "fr" and got[91].lang == "de"
    assert got[92].lang in WORDS and got[93].lang in WORDS and len(got) == 44


def test_empty_tables(spark):
    docs = documents(spark).limit(0)
    model = L.text_model(docs.select("text", "lang"))
    assert L.identify(L.document_records(documents(spark, 3)), model).count() == 3
    assert L.identify(L.document_records(docs), model).count() == 0
    assert L.identify(L.document_records(docs), L.text_model(documents(spark).select("text", "lang"))).count() == 0


def brute(records, model):
    """The fusion in plain Python, record by record."""
    languages, logs = model
    size = range(len(languages))
    soft = lambda xs: [math.exp(x - max(xs)) / sum(math.exp(y - max(xs)) for y in xs) for x in xs]
    rows = []
    for r in records:
        codes = L._trigrams([r["text"]])[0]
        fold = L.FOLDS if r["fold"] is None else r["fold"]
        text_log = [float(sum(float(logs[fold, k, c]) for c in codes)) * min(1, L.TEXT_WEIGHT / max(len(codes), 1)) for k in size]
        labels = r["host"].split(".")
        first = r["path"].split("/")[1] if r["path"].startswith("/") else ""
        keys = {"suffix": labels[-1] if len(labels) > 1 else None, "domain": ".".join(labels[-2:]), "host": r["host"], "declared": r["declared"], "segment": first.lower() if len(first) == 2 and first.isascii() and first.isalpha() else None}
        rows.append((r, text_log, soft(text_log), keys))
    totals = [sum(p[k] for _, _, p, _ in rows) for k in size]
    sums = defaultdict(lambda: [0.0] * len(languages))
    for _, _, p, keys in rows:
        for name, value in keys.items():
            for k in size:
                sums[name, value][k] += p[k]
    out = []
    for r, text_log, p, keys in rows:
        prefer = [(t + 1) / (sum(totals) + len(languages)) for t in totals]
        for name in ("suffix", "domain", "host"):
            known = keys[name] is not None if name == "suffix" else r["host"] != ""
            own = [max(n - q, 0.0) for n, q in zip(sums[name, keys[name]], p)] if known else [0.0] * len(languages)
            prefer = [(n + L.PARENT_WEIGHT * q) / (sum(own) + L.PARENT_WEIGHT) for n, q in zip(own, prefer)]
        joint = [math.log(q) + x for q, x in zip(prefer, text_log)]
        for name in ("declared", "suffix", "segment"):
            if keys[name] is not None:
                joint = [j + math.log((n + L.VALUE_PRIOR) / (t + 10 * L.VALUE_PRIOR)) for j, n, t in zip(joint, sums[name, keys[name]], totals)]
        posterior = soft(joint)
        out.append((languages[posterior.index(max(posterior))], max(posterior)))
    return out


def test_fusion_against_plain_python(spark):
    rng = random.Random(12)
    model = L.text_model(documents(spark).select("text", "lang", L.fold_of().alias("fold")))
    records = []
    for i in range(60):
        lang = rng.choice(list(WORDS))
        other = rng.choice(list(WORDS))
        records.append({"kind": "page", "id": f"r{i}", "text": text(rng, lang, rng.choice([0, 1, 2, 30])), "declared": rng.choice([None, lang, other]), "host": rng.choice(["", "one", f"h{i % 3}.site.{lang}", "a.b.example.com"]), "path": rng.choice(["", f"/{lang}/x", "/EN", "/xyz/de"]), "fold": rng.choice([None, 0, 1])})
    records += [dict(records[0]), dict(records[0])]
    frame = spark.createDataFrame(records, "kind string, id string, text string, declared string, host string, path string, fold int")
    got = sorted((r.id, r.lang, r.confidence) for r in L.identify(frame, model).collect())
    want = sorted((r["id"], *b) for r, b in zip(records, brute(records, model)))
    assert [g[0] for g in got] == [w[0] for w in want]
    for (_, lang, sure), (_, expected, share) in zip(got, want):
        assert lang == expected and sure == pytest.approx(share, abs=1e-4)


def test_a_label_says_nothing_on_its_own_document(spark):
    docs = documents(spark, 60)
    lie = docs.selectExpr("doc_id", "text", "if(doc_id = 7, 'xx', lang) as lang", "source")
    model = L.text_model(lie.select("text", "lang", L.fold_of().alias("fold")))
    row = next(r for r in L.identify(L.document_records(lie), model).collect() if r.id == "7")
    assert row.lang == next(r.lang for r in docs.where("doc_id = 7").collect())


def test_clashing_names_null_ids_and_ties(spark):
    docs = spark.createDataFrame([(None, "", "en", "s", 1), (None, "", "fr", "s", 2), (5, None, None, None, 3)], "doc_id long, text string, lang string, source string, host int")
    rows = L.identify(L.document_records(docs.withColumnRenamed("host", "fold")), L.text_model(docs.select("text", "lang"))).collect()
    assert sorted((r.id or "", r.lang) for r in rows) == [("", "en"), ("", "en"), ("5", "en")]
