import json
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from galley.functions import text as T
from galley.functions.text import text_role
from galley.operators import dictionary as D
from galley.operators import grouping as G
from galley.operators import pages, proposals
from galley.sources import ingest

WORD = "asset_id long, word_index int, text string, x int, y int, w int, h int, confidence double"
BOX = "asset_id long, ord int, x int, y int, w int, h int"


def naive_lines(words):
    """Every word against every line so far, in reading order: word indexes of each line before it is parted."""
    lines = []
    for i, (_, x, y, w, h) in sorted(enumerate(words), key=lambda t: (t[1][2] + t[1][4] / 2, t[1][1] + t[1][3] / 2, t[0])):
        best = None
        for n, line in enumerate(lines):
            x1, y1, x2, y2 = line["box"]
            tall = max(1, y2 - y1)
            share = max(0, min(y2, y + h) - max(y1, y)) / max(1, min(tall, h))
            off, most = abs(y + h / 2 - (y1 + y2) / 2), max(tall, h)
            gap = max(0, x - x2, x1 - x - w)
            if gap <= max(10, 2.8 * most) and (share >= 0.45 or (share >= 0.25 and off <= max(3, 0.55 * most))):
                score = 3 * share - off / tall - gap / max(10, 2.8 * most)
                if best is None or score > best[0]:
                    best = (score, n)
        if best is None:
            lines.append({"box": [x, y, x + w, y + h], "members": [i]})
        else:
            line = lines[best[1]]
            a, b, c, e = line["box"]
            line["box"] = [min(a, x), min(b, y), max(c, x + w), max(e, y + h)]
            line["members"].append(i)
    return sorted(sorted(line["members"]) for line in lines)


def test_words_go_to_the_lines_that_a_naive_search_gives():
    rng = random.Random(5)
    for _ in range(40):
        words = [("w", rng.randrange(0, 600), rng.randrange(0, 120), rng.randrange(5, 90), rng.randrange(8, 40)) for _ in range(rng.randrange(1, 60))]
        named = sorted(((x, y, w, h, i) for i, (_, x, y, w, h) in enumerate(words)), key=lambda t: (t[1] + t[3] / 2, t[0] + t[2] / 2, t[4]))
        x, y, w, h, index = map(list, zip(*named))
        placed = G._Words({"x": x, "y": y, "w": w, "h": h, "word_index": index, "text": index, "confidence": index, "promo": index})
        assert sorted(sorted(index[m] for m in line) for line in placed.place()) == naive_lines(words)


def test_first_piece_of_the_known_cases(spark):
    piece = [("SOBRE", 10, 10, 100, 30), ("RUEDAS", 120, 10, 120, 30), ("Del", 10, 80, 40, 18), ("lunes", 55, 80, 60, 18), ("2", 120, 80, 12, 18), ("SKU:", 10, 300, 60, 16), ("3719383", 75, 300, 90, 16)]
    rows = G.build_layout(spark.createDataFrame([(1, i, t, x, y, w, h, 0.9) for i, (t, x, y, w, h) in enumerate(piece)], WORD)).collect()
    by_role = {r.role: r.text for r in rows}
    assert "SOBRE RUEDAS" in by_role["campaign"] and "Del lunes" in by_role["date_range"] and "SKU" in by_role["sku"]


def test_merging_regions_against_all_orders_of_growth(spark):
    rng = random.Random(2)
    rows = [(a, i, rng.randrange(0, 80), rng.randrange(0, 80), rng.randrange(10, 60), rng.randrange(10, 60)) for a in range(30) for i in range(rng.randrange(1, 9))]
    got = {}
    for r in proposals.merge_overlapping_regions(spark.createDataFrame(rows, BOX), 0.3).collect():
        got.setdefault(r.asset_id, []).append((r.x, r.y, r.w, r.h))

    def share(a, b):
        w, h = (max(0, min(a[k] + a[k + 2], b[k] + b[k + 2]) - max(a[k], b[k])) for k in (0, 1))
        return w * h / (a[2] * a[3] + b[2] * b[3] - w * h)

    for a in range(30):
        left, want = [r[2:] for r in rows if r[0] == a], []
        while left:
            base = left.pop(0)
            while True:
                before = len(left)
                for other in list(left):
                    if share(base, other) >= 0.3:
                        left.remove(other)
                        x, y = min(base[0], other[0]), min(base[1], other[1])
                        base = (x, y, max(base[0] + base[2], other[0] + other[2]) - x, max(base[1] + base[3], other[1] + other[3]) - y)
                if len(left) == before:
                    break
            want.append(base)
        assert sorted(got[a]) == sorted(want)


def test_regions_keep_their_own_layout(spark):
    words = spark.createDataFrame([(1, i, f"palabra{i}", 10 + 300 * (i % 2), 10 + 40 * (i // 2), 80, 20, 0.9, "left" if i % 2 == 0 else "right") for i in range(12)], WORD + ", region_id string")
    rows = proposals.hybrid_layout(words).collect()
    assert {r.region_id for r in rows} == {"left", "right"} and sorted(r.reading for r in rows) == list(range(1, len(rows) + 1))
    for r in rows:
        assert {i % 2 for i in r.words} == {0 if r.region_id == "left" else 1}


def test_simple_blocks(spark):
    lines = [(1, n, f"l{n}", x, y, 200, 20, 0.8, [n]) for n, (x, y) in enumerate([(10, 10), (12, 35), (400, 12), (10, 300)], 1)]
    frame = spark.createDataFrame(lines, "asset_id long, line int, text string, x int, y int, w int, h int, confidence double, words array<int>")
    assert [r.lines for r in G.group_blocks_simple(frame).orderBy("block").collect()] == [[1, 2], [3], [4]]


def longest(a, b):
    if not a or not b:
        return 0
    return longest(a[1:], b[1:]) + 1 if a[0] == b[0] else max(longest(a[1:], b), longest(a, b[1:]))


def test_dictionary_against_plain_search(spark):
    rng = random.Random(3)
    assert all(D.common_subsequence(a, b) == longest(a, b) for a, b in (("".join(rng.choices("abc", k=rng.randrange(0, 8))), "".join(rng.choices("abc", k=rng.randrange(0, 8)))) for _ in range(200)))
    tokens = ["S0DIMAC", "sodimacs", "Limaa", "promocion", "12345", "OFERTA5", "xyz", "ICA", "Lima"]
    got = {r.token: (r.term, round(r.score, 6)) for r in D.fuzzy_dictionary(spark.createDataFrame([(t,) for t in tokens], "token string")).collect()}
    for t in tokens:
        key, best = D._plain(t), (None, 0.0)
        for group in D.DICTIONARIES:
            for term in group:
                k = D._plain(term)
                score = 200 * D.common_subsequence(key, k) / (len(key) + len(k))
                if score >= D.THRESHOLD and score > best[1]:
                    best = (term, score)
        want = (best[0], round(best[1], 6)) if best[0] and any(c.isalpha() for c in t) else None
        assert got.get(t) == want, t


def test_entities(spark):
    rows = D.entity_text(spark.createDataFrame([(1, "Gran  0FERTAS en s0dimac,\nSan Isidro"), (2, None)], "asset_id long, text string")).orderBy("asset_id").collect()
    assert rows[0].text == "Gran OFERTAS en sodimac, San Isidro" and rows[0].brands == ["SODIMAC"] and rows[0].locations == ["SAN ISIDRO"]
    assert (rows[1].text, rows[1].brands) == ("", [])


def test_payload_of_a_text(spark):
    texts = spark.createDataFrame([(1, "CUALES EL MARTILLOIDEAL"), (2, None)], "asset_id long, text string")
    words = spark.createDataFrame([(1, 0, "CUALES", 0, 0, 10, 10, 0.95)], WORD)
    rows = pages.ocr_payload(texts, words).orderBy("asset_id").collect()
    assert rows[0].corrected_text == "¿Cuál es el martillo ideal?" and (rows[0].avg_confidence, rows[0].min_confidence) == (0.95, 0.95)
    assert 0 < rows[0].score <= 1 and rows[1].score is None and rows[1].corrected_text == ""


def png(width, height):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\x00" + b"\x10\x20\x30" * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_uploads_images_and_profiles(spark, tmp_path):
    for name, data in {"a.png": png(4, 3), "b.pdf": b"%PDF-1.4", "c.txt": b"text", "d.png": b"", "e.jpg": b"\xff\xd8\xff..ICC_PROFILE.."}.items():
        (tmp_path / name).write_bytes(data)
    good, bad = ingest.scan_uploads(spark, str(tmp_path))
    assert {r.filename: r.type for r in good.collect()} == {"a.png": "image", "b.pdf": "pdf", "e.jpg": "image"}
    assert {r.filename: r.reason for r in bad.collect()} == {"c.txt": "unsupported file type"}
    assert {r.filename for r in good.where(ingest.icc_present(F.col("content")).isNotNull()).collect()} == {"e.jpg"}
    image = ingest.scan_images(spark, str(tmp_path)).collect()
    assert [(r.width, r.height, bytes(r.data[:3])) for r in image] == [(4, 3, b"\x30\x20\x10")]


def test_rules_and_parameters(spark, tmp_path):
    rules = tmp_path / "rules.json"
    rules.write_text(json.dumps({"min_width_px": 1080, "min_height_px": 1080, "allowed_formats": ["JPEG"], "max_file_size_mb": 5, "required_text": "oferta"}))
    assert ingest.load_requirements(spark, str(rules))["formats"] == ("JPEG",)
    rules.write_text("{}")
    with pytest.raises(ValueError, match="no technical rules"):
        ingest.load_requirements(spark, str(rules))
    config = tmp_path / "job.json"
    config.write_text(json.dumps({"supported_piece_formats": [" MTLK "], "matching": {"min_score": 0.6}, "excel": {"max_rows": 0}}))
    got = ingest.load_job_config(spark, str(config))
    assert (got["supported"], got["min_score"], got["max_rows"], got["header_rows"]) == (("mtlk",), 0.6, 5000, 10)
    assert ingest.load_job_config(spark, str(tmp_path / "none.json"))["max_regions"] == 8


def test_malformed_responses(spark):
    rows = [(1, "{no json"), (2, None), (3, json.dumps({"ocr": {"rawText": "a", "lines": [{"text": "x", "bbox": [1, 2, 3, 4]}, {"text": "", "bbox": [1, 2, 3, 4]}, {"text": "y", "bbox": [1]}]}, "visualAnalysis": [{"hex": "#00ff00"}, {"hex": "green"}]}))]
    got = {r.asset_id: r for r in ingest.read_response_json(spark.createDataFrame(rows, "asset_id long, payload string")).collect()}
    assert got[1].corrupt and got[2].corrupt and not got[3].corrupt
    assert [(line.id, line.text) for line in got[3].lines] == [("line_1", "x")] and [c.hex for c in got[3].colors] == ["#00ff00"]
    assert got[3].corrected_text == "a" and got[3].overall_status == "not_executed"


def test_roles_of_short_texts(spark):
    frame = spark.createDataFrame([("CMR",), ("S/ 25.90",), ("SKU: 12345",)], "t string")
    assert [r[0] for r in frame.select(text_role(F.col("t"))).collect()] == ["promo_badge", "price_main", "sku"]


def test_plain_texts_have_the_roles_of_the_rules(spark, monkeypatch):
    """Texts at the edges of the short way: capitals, letters that are one of ASCII where case does not count, white space."""
    rng = random.Random(6)
    bits = ["sku", "ſku", "SKU", "s\u212au", "precıo", "PRECİO", "regular", "cmr", "DÉBITO", "exclusİvo con", "oportunidad", "A", "Ab", "aB", "ABC", "ABCd", "É", "é", "ß", "ǅ", "中", "a", "casa", "Haus", "  ", "\n", "\x0b", "\xa0", "-", "🎉", "lunes", "3", "10,50", "S/"]
    texts = [None, "", *("".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.choice([1, 2, 3, 6]))) for _ in range(3000))]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    short = frame.select(text_role(F.col("t"))).collect()
    plan = frame.select(text_role(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(T, "PLAIN_ROLE", "(?!)")  # no text is plain
    assert short == frame.select(text_role(F.col("t"))).collect()
    assert "Lu}0-9" in plan and len({r[0] for r in short}) == 9
