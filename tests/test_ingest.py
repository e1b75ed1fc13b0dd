import struct

from pyspark.sql import functions as F

from galley.sources import ingest as I


PNG, JPEG = b"\x89PNG\r\n\x1a\n", b"\xff\xd8"


def chunk(name, data):
    return struct.pack(">I", len(data)) + name + data + b"crc!"


def segment(marker, data):
    return b"\xff" + marker + struct.pack(">H", len(data) + 2) + data


def test_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"%PDF-1.7 rest")
    (tmp_path / "b.txt").write_bytes(PNG + b"rest")
    (tmp_path / "c.JPG").write_bytes(b"junk")
    (tmp_path / "d.txt").write_bytes(b"junk")
    (tmp_path / "e.pdf").write_bytes(b"")
    (tmp_path / "f.gif").write_bytes(b"GIF89a rest")
    (tmp_path / "g.bmp").write_bytes(b"BM rest")
    (tmp_path / "h.txt").write_bytes(b"%PDF 1")
    (tmp_path / "i.pdf").write_bytes(b"junk")
    files = I.scan_assets(spark, str(tmp_path))
    rows = {r.filename: r.kind for r in files.select("filename", I.file_type(F.col("content"), F.col("filename")).alias("kind")).collect()}
    assert rows == {"a.bin": "pdf", "b.txt": "image", "c.JPG": "image", "d.txt": None, "f.gif": None, "g.bmp": None, "h.txt": None, "i.pdf": "pdf"}


def test_declared_types_come_after_the_bytes(spark):
    rows = [(b"junk", "a", "image/PNG"), (b"junk", "b.txt", "application/pdf"), (b"%PDF-1", "c.png", "image/png"), (b"junk", "d.pdf", "image/jpeg"), (b"GIF8", "e", "image/gif"), (None, None, None)]
    df = spark.createDataFrame(rows, "content binary, filename string, type string")
    assert [r[0] for r in df.select(I.file_type(F.col("content"), F.col("filename"), F.col("type"))).collect()] == ["image", "pdf", "pdf", "image", None, None]


def test_rejected_uploads_have_reasons(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "in" / "b c+d.png").write_bytes(b"")
    (tmp_path / "in" / "e.txt").write_bytes(b"junk" * 512)
    taken, rejected = I.scan_uploads(spark, str(tmp_path))
    assert [(r.filename, r.type) for r in taken.collect()] == [("a.pdf", "pdf")]
    assert sorted((r.filename, r.file_size_kb, r.reason) for r in rejected.collect()) == [("b c+d.png", 0.0, "empty file"), ("e.txt", 2.0, "unsupported file type")]


def test_profiles_are_found_by_their_place(spark):
    comment = b"about iCCP and ICC_PROFILE\x00"
    head = chunk(b"IHDR", b"x" * 13)
    cases = [
        (PNG + head + chunk(b"tEXt", comment) + chunk(b"iCCP", b"icc") + chunk(b"IDAT", b"pixels"), "Embedded"),
        (PNG + head + chunk(b"tEXt", comment) + chunk(b"IDAT", b"iCCP"), None),
        (PNG + head + chunk(b"IDAT", b"p") + chunk(b"iCCP", b"late"), None),
        (PNG + head + b"\x00\x00", None),
        (JPEG + segment(b"\xe1", comment) + b"\xff" + segment(b"\xe2", b"ICC_PROFILE\x00\x01\x01icc") + segment(b"\xda", b"s"), "Embedded"),
        (JPEG + segment(b"\xfe", comment) + segment(b"\xda", b"s") + segment(b"\xe2", b"ICC_PROFILE\x00"), None),
        (JPEG + segment(b"\xe1", b"ICC_PROFILE\x00"), None),
        (comment, None),
        (b"", None),
        (None, None),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, content binary")
    assert [r[1] for r in sorted(df.select("i", I.icc_present(F.col("content"))).collect())] == [want for _, want in cases]


def test_words_with_bad_items(spark):
    payload = '[{"text": " a ", "box": [0.5, 1.5, 20000, 4], "confidence": 0.5}, {"text": "", "box": [1, 2, 3, 4]}, {"text": "b", "box": [1, 2]}, {"text": "c", "box": [1, 2, 3, 4]}]'
    rows = I.ingest_words(spark.createDataFrame([(1, payload), (2, None), (3, "no json")], "asset_id long, words string")).collect()
    assert [(r.word_index, r.text, r.x, r.y, r.w, r.confidence) for r in rows] == [(0, "a", 0, 2, 10000, 0.5), (3, "c", 1, 2, 3, 0.0)]


def test_quads_and_tsv(spark):
    row = spark.range(1).select(I.quad_to_xywh(F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((1.5, 2.0), (9.0, 2.4), (9.2, 7.0), (1.0, 6.9))])).alias("b")).first().b
    assert tuple(row) == (1, 2, 8, 5)
    rows = I.ingest_tsv_words(spark.createDataFrame([("a", "97"), (" ", "5"), ("b", "-1"), ("c", "x"), ("d", "140")], "text string, conf string")).collect()
    assert [(r.text, r.confidence) for r in rows] == [("a", 0.97), ("b", 0.0), ("c", 0.0), ("d", 1.0)]


def test_sheet_with_blank_rows_and_repeated_header(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text('0,Title,,,\n1,Marca, SKU ,Otro,marca\n2,,,,\n3,A,1,z,B\n4,C,,z,\n')
    rows = I.map_headers(I.read_grid(spark, str(path))).collect()
    assert [(r.row_index, r.brand, r.sku, r.campaign) for r in rows] == [(3, "B", "1", None), (4, None, None, None)]
