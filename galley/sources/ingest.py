"""Files and tool outputs as tables: pieces, recognised words, detections, catalog sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import norm_key

WORD = "array<struct<text:string,box:array<double>,confidence:double>>"
LIMIT = 10_000
# Spellings of each catalog column in a header.
HEADERS = {
    "campaign": ("CAMPANA", "CAMPAÑA", "CAMPAIGN", "CAMPAÑA/ENCABEZADO", "ENCABEZADO"),
    "brand": ("MARCA", "BRAND"),
    "description": ("DESCRIPCION", "DESCRIPCIÓN", "DESC", "DESCRIP"),
    "sku": ("SKU", "CODIGO", "CÓDIGO", "COD_PRODUCTO"),
    "price_cmr": ("PRECIO_CMR", "PRECIO_CMR_", "CMR", "PRECIO_CMR(S/)"),
    "price_regular": ("PRECIO_REGULAR", "PRECIO_REGULAR_", "REGULAR", "PRECIO_REGULAR(S/)"),
    "price_before": ("PRECIO_ANTES", "PRECIO_ANTES_", "ANTES", "PRECIO_ANTERIOR"),
}


# First bytes, extensions and content types of what is taken.
PDF_MAGIC, IMAGE_MAGIC = b"%PDF-", (b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff")
IMAGE_EXTENSIONS, IMAGE_TYPES, PDF_TYPE = ("jpg", "jpeg", "png"), ("image/jpeg", "image/png"), "application/pdf"


def scan_assets(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``path``: ``path, filename, file_size_kb, content``; empty files are left out (``scan_uploads`` names them)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where("length > 0").select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.round(F.col("length") / 1024.0, 2).alias("file_size_kb"), "content")


def file_type(content: Column, filename: Column, content_type: Column | None = None) -> Column:
    """pdf or image, else null: a PDF's first bytes, then an image's, then an image by extension or declared type, then a
    PDF by these.  Images of other formats count only if they are declared as one that is taken."""
    starts = lambda *magic: _any([F.substring(content, 1, len(m)) == F.lit(bytearray(m)) for m in magic])
    extension = F.lower(F.regexp_extract(filename, r"\.([A-Za-z0-9]+)$", 1))
    declared = F.lower(F.coalesce(content_type, F.lit(""))) if content_type is not None else F.lit("")
    return (
        F.when(starts(PDF_MAGIC), "pdf")
        .when(starts(*IMAGE_MAGIC), "image")
        .when(extension.isin(*IMAGE_EXTENSIONS) | declared.isin(*IMAGE_TYPES), "image")
        .when((extension == "pdf") | (declared == PDF_TYPE), "pdf")
    )


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def ingest_words(payloads: DataFrame, column: str = "words") -> DataFrame:
    """JSON lists of words -> ``asset_id, word_index, text, x, y, w, h, confidence``; items without text or a box of four go.

    Indexes are those of the list; coordinates are rounded half-even and held within the limit.
    """
    items = payloads.select("asset_id", F.posexplode(F.from_json(F.col(column), WORD)).alias("word_index", "word"))
    part = lambda i: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.bround(F.get("word.box", F.lit(i))).cast("int")))
    text = F.trim("word.text")
    kept = items.where((text != "") & (F.size("word.box") == 4) & ~F.exists("word.box", lambda v: v.isNull()))
    return kept.select("asset_id", "word_index", text.alias("text"), *[part(i).alias(c) for i, c in enumerate("xywh")], F.coalesce("word.confidence", F.lit(0.0)).alias("confidence"))


def quad_to_xywh(points: Column) -> Column:
    """The box around corner points ``array<array<double>>``, rounded half-even."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    r = lambda v: F.bround(v).cast("int")
    x, y = r(F.array_min(xs)), r(F.array_min(ys))
    return F.struct(x.alias("x"), y.alias("y"), F.greatest(F.lit(0), r(F.array_max(xs)) - x).alias("w"), F.greatest(F.lit(0), r(F.array_max(ys)) - y).alias("h"))


def ingest_tsv_words(rows: DataFrame) -> DataFrame:
    """Words with a confidence of 0 to 100 as text -> 0 to 1; blanks go, what is no number counts as 0."""
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("conf").try_cast("double"), F.lit(0.0)) / 100.0))
    return rows.where(F.trim("text") != "").withColumn("text", F.trim("text")).withColumn("confidence", value).drop("conf")


def ingest_detections(raw: DataFrame) -> DataFrame:
    """Corners ``x1, y1, x2, y2`` in any order -> boxes of whole pixels from 0 on, numbered in reading order."""
    lo = lambda a, b: F.greatest(F.lit(0), F.bround(F.least(a, b)).cast("int"))
    hi = lambda a, b: F.greatest(F.lit(0), F.bround(F.greatest(a, b)).cast("int"))
    x, y = lo("x1", "x2"), lo("y1", "y2")
    boxes = raw.select("asset_id", "class_name", x.alias("x"), y.alias("y"), (hi("x1", "x2") - x).alias("w"), (hi("y1", "y2") - y).alias("h"), F.bround("confidence", 4).alias("confidence"))
    order = W.partitionBy("asset_id").orderBy(F.col("y") + F.col("h") / 2.0, F.col("x") + F.col("w") / 2.0, "class_name")
    return boxes.withColumn("ord", F.row_number().over(order))


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """A sheet exported as CSV with a leading row number -> ``row_index, cells``, all cells as text."""
    raw = spark.read.option("header", "false").csv(path)
    return raw.select(F.col(raw.columns[0]).cast("long").alias("row_index"), F.array(*raw.columns[1:]).alias("cells"))


def find_header_row(grid: DataFrame, limit: int = 10) -> DataFrame:
    """``header_row``: the first of the first ``limit`` rows with two or more cells that are not blank (null if none is)."""
    filled = F.size(F.filter("cells", lambda c: F.coalesce(F.trim(c), F.lit("")) != ""))
    return grid.where((F.col("row_index") < max(1, limit)) & (filled >= 2)).agg(F.min("row_index").alias("header_row"))


def map_headers(grid: DataFrame, limit: int = 10, max_rows: int = 5000) -> DataFrame:
    """A sheet as catalog rows: columns by the first header that is a known spelling; blank rows go, blank cells are null."""
    at = find_header_row(grid, limit)
    named = grid.join(F.broadcast(at), grid.row_index == at.header_row).select(F.transform("cells", norm_key).alias("keys"), "header_row")
    spellings = {f: F.array(*[norm_key(F.lit(s)) for s in words]) for f, words in HEADERS.items()}
    rows = grid.join(F.broadcast(named), (grid.row_index > named.header_row) & (grid.row_index <= named.header_row + max_rows))
    rows = rows.where(F.exists("cells", lambda c: F.coalesce(F.trim(c), F.lit("")) != ""))

    def cell(field: str) -> Column:
        """The last cell under the field's header: a repeated header overwrites."""
        key = F.get(F.filter("keys", lambda k: F.array_contains(spellings[field], k)), F.lit(0))
        under = F.filter(F.zip_with("keys", "cells", lambda k, c: F.struct(k.alias("k"), c.alias("c"))), lambda p: p["k"] == key)
        return F.nullif(F.trim(F.try_element_at(under, F.lit(-1))["c"]), F.lit("")).alias(field)

    return rows.select("row_index", *[cell(f) for f in HEADERS])


def scan_uploads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Files under ``path`` in two tables: accepted ones with ``type`` (pdf or image), and rejected ones with ``reason``.

    Spark's readers make no row of an empty file; those are the listed files that have none.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    kind = file_type(F.col("content"), name)
    reason = F.when(kind.isNull(), "unsupported file type")
    rows = files.select("path", name.alias("filename"), F.round(F.col("length") / 1024.0, 2).alias("file_size_kb"), "content", kind.alias("type"), reason.alias("reason"))
    listed = spark.createDataFrame([(f,) for f in files.inputFiles()], "uri string")
    # the list is of escaped addresses, the rows have plain paths; both write the slashes of a scheme in their own way
    plain = F.url_decode(F.replace("uri", F.lit("+"), F.lit("%2B")))
    key = lambda c: F.regexp_replace(c, "^([A-Za-z0-9+.-]+):/+", "$1:/").alias("key")
    empty = listed.select(plain.alias("path"), key(plain)).join(files.select(key(F.col("path"))), "key", "left_anti")
    rejected = empty.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.lit(0.0).alias("file_size_kb"), F.lit("empty file").alias("reason"))
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null").select(rejected.columns).union(rejected)


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images under ``path``: ``path, width, height, channels, data`` (rows of blue, green, red); what is none is dropped."""
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", "true").load(path)
    return images.select(F.col("image.origin").alias("path"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")


def _number(content: Column, at: Column, size: int) -> Column:
    """The unsigned big-endian number of ``size`` bytes from byte ``at`` (from 0) on; null past the end."""
    raw = F.substring(content, at + 1, F.lit(size))
    return F.when(F.octet_length(raw) == size, F.conv(F.hex(raw), 16, 10).cast("long"))


def _walk(content: Column, start: int, least: int, found, ends, length) -> Column:
    """Whether ``found`` holds at some part of a file: parts begin at ``start``, each ``length(at)`` (at least ``least``)
    bytes long, until ``ends`` or the end of the file.  The state is the next part's place, -1 once found, null at the end."""
    step = lambda at, _: F.when(at.isNull() | (at < 0), at).when(found(at), F.lit(-1).cast("long")).when(ends(at), F.lit(None).cast("long")).otherwise(at + length(at))
    parts = F.sequence(F.lit(0), F.floor(F.octet_length(content) / least).cast("int"))
    return F.coalesce(F.aggregate(parts, F.lit(start).cast("long"), step) == -1, F.lit(False))


def icc_present(content: Column) -> Column:
    """``Embedded`` if an image carries a colour profile, else null: a PNG's ``iCCP`` chunk ahead of its pixels, or an
    ``ICC_PROFILE`` application segment of a JPEG ahead of its scan.  The same letters in a comment or in pixels are none."""
    part = lambda at, size: F.substring(content, at + 1, F.lit(size))
    is_ = lambda at, raw: part(at, len(raw)) == F.lit(bytearray(raw))
    png = _walk(content, 8, 12, lambda at: is_(at + 4, b"iCCP"), lambda at: is_(at + 4, b"IDAT") | is_(at + 4, b"IEND"), lambda at: _number(content, at, 4) + 12)
    profile = lambda at: is_(at, b"\xff\xe2") & is_(at + 4, b"ICC_PROFILE\x00")
    # a marker may be led by fill bytes, which are one byte long each
    jpeg = _walk(content, 2, 1, profile, lambda at: is_(at, b"\xff\xda") | is_(at, b"\xff\xd9") | ~is_(at, b"\xff"), lambda at: F.when(is_(at + 1, b"\xff"), F.lit(1).cast("long")).otherwise(_number(content, at + 2, 2) + 2))
    holds = lambda raw: F.contains(content, F.lit(bytearray(raw)))
    starts = lambda raw: F.substring(content, 1, len(raw)) == F.lit(bytearray(raw))
    # the letters are looked for first: only files that hold them somewhere are walked
    return F.when(starts(IMAGE_MAGIC[0]) & holds(b"iCCP"), F.when(png, "Embedded")).when(starts(IMAGE_MAGIC[1]) & holds(b"ICC_PROFILE"), F.when(jpeg, "Embedded"))


REQUIREMENTS = "min_width_px int, min_height_px int, allowed_formats array<string>, max_file_size_mb double, min_pages int, max_pages int, required_text string"


def load_requirements(spark: SparkSession, path: str) -> dict:
    """The technical rules of a JSON file; a missing or malformed file, or one without sizes and formats, is an error."""
    rows = spark.read.schema(REQUIREMENTS).option("mode", "FAILFAST").option("multiLine", True).json(path).limit(2).collect()
    if len(rows) != 1 or None in (rows[0].min_width_px, rows[0].min_height_px, rows[0].allowed_formats, rows[0].max_file_size_mb):
        raise ValueError(f"no technical rules in {path}")
    r = rows[0]
    return {"min_width": r.min_width_px, "min_height": r.min_height_px, "formats": tuple(r.allowed_formats), "max_mb": r.max_file_size_mb, "min_pages": r.min_pages or 1, "max_pages": r.max_pages or 2**31 - 1, "required_text": r.required_text or ""}


JOB = "supported_piece_formats array<string>, layout_piece_type_aliases map<string,string>, regional_ocr struct<max_regions int>, yolo struct<exclude_ocr_classes array<string>,allow_ocr_classes array<string>,min_regions_for_use int>, excel struct<header_row_search_limit int,max_rows int>, matching struct<min_score double,min_margin double>"


def load_job_config(spark: SparkSession, path: str) -> dict:
    """The job parameters of a JSON file, defaults for all it does not give; a missing file gives the defaults."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(JOB).option("multiLine", True).json(path).limit(1).collect()
    except AnalysisException:
        rows = []
    given = rows[0].asDict(True) if rows else {}
    part = lambda key, name, default: ((given.get(key) or {}).get(name)) or default
    return {
        "supported": tuple(f.strip().lower() for f in given.get("supported_piece_formats") or () if f and f.strip()),
        "aliases": dict(given.get("layout_piece_type_aliases") or {}),
        "max_regions": part("regional_ocr", "max_regions", 8),
        "exclude": tuple(part("yolo", "exclude_ocr_classes", ("product_photo_area",))),
        "allow": tuple(part("yolo", "allow_ocr_classes", ())),
        "min_regions": part("yolo", "min_regions_for_use", 2),
        "header_rows": part("excel", "header_row_search_limit", 10),
        "max_rows": part("excel", "max_rows", 5000),
        "min_score": part("matching", "min_score", 0.55),
        "min_margin": part("matching", "min_margin", 0.12),
    }


RESPONSE = (
    "struct<meta struct<filename string,format string,width int,height int,aspectRatio string,fileSizeKb double>,"
    "ocr struct<rawText string,correctedText string,words array<struct<text string,box array<double>,confidence double>>,confidence struct<avg double,min double>,score double,"
    "lines array<struct<id string,text string,bbox array<double>,confidence double,wordIndexes array<int>>>,blocks array<struct<id string,type string,text string,bbox array<double>,confidence double>>>,"
    "colorAnalysis array<struct<hex string,rgb array<int>,percentage double>>,visualAnalysis array<struct<hex string,rgb array<int>,percentage double>>,"
    "structuredFields map<string,struct<value string,sourceBlockId string,confidence double,status string,message string>>,"
    "excelValidation struct<enabled boolean,executed boolean,overallStatus string,matchedRowIndex int>>"
)


def read_response_json(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """JSON results, a row each, -> ``asset_id, meta, raw_text, corrected_text, words, lines, blocks, colors, fields,
    overall_status, corrupt``.

    Words, lines and blocks without text or a box of four go; lines without an id get ``line_n``; colours need a hex
    value and fall back to the other list; fields without a status are not_detected.  What is no JSON is ``corrupt``.
    """
    r = F.from_json(F.col(column), RESPONSE)
    rows = payloads.select("asset_id", r.alias("r"), (F.col(column).isNull() | F.get_json_object(column, "$").isNull()).alias("corrupt"))
    none = lambda kind: F.array().cast(kind)
    boxed = lambda b: b.isNotNull() & (F.size(b) == 4) & ~F.exists(b, lambda v: v.isNull())
    whole = lambda name, box: F.filter(F.col(f"r.ocr.{name}"), lambda x: (F.trim(F.coalesce(x["text"], F.lit(""))) != "") & boxed(x[box]))
    numbered = F.transform(whole("lines", "bbox"), lambda x, i: F.struct(F.coalesce(x["id"], F.concat(F.lit("line_"), (i + 1).cast("string"))).alias("id"), x["text"].alias("text"), x["bbox"].alias("bbox"), x["confidence"].alias("confidence"), x["wordIndexes"].alias("wordIndexes")))
    good = lambda name: F.filter(F.col(f"r.{name}"), lambda c: F.coalesce(c["hex"].rlike("^#[0-9A-Fa-f]{6}$"), F.lit(False)))
    colors = F.coalesce(good("colorAnalysis"), good("visualAnalysis"), none("array<struct<hex:string,rgb:array<int>,percentage:double>>"))
    fields = F.transform_values("r.structuredFields", lambda _, v: F.struct(v["value"].alias("value"), v["sourceBlockId"].alias("sourceBlockId"), v["confidence"].alias("confidence"), F.coalesce(v["status"], F.lit("not_detected")).alias("status")))
    return rows.select(
        "asset_id",
        F.col("r.meta").alias("meta"),
        F.coalesce("r.ocr.rawText", F.lit("")).alias("raw_text"),
        F.coalesce("r.ocr.correctedText", "r.ocr.rawText", F.lit("")).alias("corrected_text"),
        whole("words", "box").alias("words"),
        numbered.alias("lines"),
        whole("blocks", "bbox").alias("blocks"),
        colors.alias("colors"),
        fields.alias("fields"),
        F.coalesce("r.excelValidation.overallStatus", F.lit("not_executed")).alias("overall_status"),
        "corrupt",
    )
