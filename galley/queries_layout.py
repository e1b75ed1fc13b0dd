"""Queries of pages, regions, traces, labels and dictionaries, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as T
from .functions.geometry import Box, clamp, overlap_ratio, pad, union
from .operators import assets, batch, colors, correction, dictionary, fields, grouping, pages, proposals
from .plans import compliance
from .queries import KIND, ORACLE_SQL, of_pieces, query
from .sources import ingest
from .sources.fixtures import duck, fixture

CANVAS = "(SELECT 1000 AS width, 600 AS height)"


def _detections(spark, d):
    return fixture(spark, d, "fx_detections")


def _canvas(df):
    return df.select("asset_id").distinct().withColumns({"width": F.lit(1000), "height": F.lit(600)})


# --- pages ----------------------------------------------------------------------------------------------------------


@query("SELECT asset_id, word_index, text, CAST(round_even(x / 4.0 * (300.0::DOUBLE / 72), 0) AS INT) AS x, CAST(round_even(y / 4.0 * (300.0::DOUBLE / 72), 0) AS INT) AS y, CAST(round_even(w / 4.0 * (300.0::DOUBLE / 72), 0) AS INT) AS w, CAST(round_even(h / 4.0 * (300.0::DOUBLE / 72), 0) AS INT) AS h, 1.0::DOUBLE AS confidence FROM fx_words", "fx_words")
def ingest_embedded_words(spark, d):
    x, y, w, h = (F.col(c) / F.lit(4.0) for c in "xywh")
    return pages.ingest_embedded_words(fixture(spark, d, "fx_words").select("asset_id", "word_index", "text", x.alias("x0"), (x + w).alias("x1"), y.alias("top"), (y + h).alias("bottom")))


@query("SELECT asset_id, CAST(round_even(arg_min(595 + page_index * 7 + asset_id % 13, page_index) * 150 / 72, 0) AS INT) AS width, CAST(round_even(arg_min(842 - asset_id % 11, page_index) * 150 / 72, 0) AS INT) AS height, count(*) AS page_count FROM fx_pages GROUP BY 1", "fx_pages")
def pdf_page_meta(spark, d):
    sized = fixture(spark, d, "fx_pages").select("asset_id", "page_index", (595 + F.col("page_index") * 7 + F.col("asset_id") % 13).cast("double").alias("width"), (842 - F.col("asset_id") % 11).cast("double").alias("height"))
    return pages.pdf_page_meta(sized)


@query(
    """, p AS (SELECT asset_id, page_index, trim(CASE WHEN (asset_id + page_index) % 3 = 0 THEN 'Pagina ' || page_index || ' de la pieza ' || asset_id ELSE embedded_text END) AS a, 0.4::DOUBLE + (asset_id % 5) / 10.0 AS x, trim(CASE WHEN ocr_text IS NULL THEN '' WHEN asset_id % 4 = 2 THEN 'PIEZA ' || asset_id WHEN asset_id % 4 = 0 THEN 'oferta ' || page_index ELSE ocr_text END) AS b, ocr_avg::DOUBLE AS y FROM fx_pages),
    c AS (SELECT *, CASE WHEN b = '' THEN 'embedded' WHEN a = '' THEN 'ocr' WHEN length(a) < 40 THEN CASE WHEN length(b) > length(a) OR y >= x THEN 'ocr' ELSE 'merged' END WHEN x >= y THEN 'embedded' ELSE 'ocr' END AS choice,
      lower(trim(regexp_replace(a, '\\s+', ' ', 'g'))) AS na, lower(trim(regexp_replace(b, '\\s+', ' ', 'g'))) AS nb FROM p)
    SELECT asset_id, page_index, choice, CASE choice WHEN 'embedded' THEN a WHEN 'ocr' THEN b ELSE CASE WHEN na = nb THEN CASE WHEN length(a) >= length(b) THEN a ELSE b END WHEN contains(nb, na) THEN b WHEN contains(na, nb) THEN a ELSE a || chr(10) || b END END AS text FROM c""",
    "fx_pages",
)
def select_page_payload(spark, d):
    # whole texts; some pages hold only a label of their own, as short pages do
    p = fixture(spark, d, "fx_pages")
    a, i = F.col("asset_id"), F.col("page_index")
    embedded = p.select("asset_id", "page_index", F.when((a + i) % 3 == 0, F.format_string("Pagina %s de la pieza %s", i, a)).otherwise(F.col("embedded_text")).alias("text"), (0.4 + (a % 5) / 10.0).alias("score"))
    recognised = p.where("ocr_text is not null").select("asset_id", "page_index", F.when(a % 4 == 2, F.format_string("PIEZA %s", a)).when(a % 4 == 0, F.format_string("oferta %s", i)).otherwise(F.col("ocr_text")).alias("text"), F.col("ocr_avg").cast("double").alias("score"))
    return pages.select_page_payload(embedded, recognised)


@query(
    """, p AS (SELECT asset_id, page_index % 2 + 1 AS pass, avg(ocr_avg) AS avg_confidence FROM fx_pages GROUP BY 1, 2),
    w AS (SELECT asset_id, min(avg_confidence) FILTER (WHERE pass = 1) AS f, max(avg_confidence) FILTER (WHERE pass = 2) AS s FROM p GROUP BY 1)
    SELECT p.asset_id, CAST(pass AS INT) AS pass FROM p JOIN w USING (asset_id) WHERE pass = CASE WHEN f IS NULL OR (f < 0.85 AND s > f) THEN 2 ELSE 1 END""",
    "fx_pages",
)
def pick_ocr_pass(spark, d):
    passes = fixture(spark, d, "fx_pages").groupBy("asset_id", (F.col("page_index") % 2 + 1).cast("int").alias("pass")).agg(F.avg("ocr_avg").alias("avg_confidence"))
    return pages.pick_ocr_pass(passes).select("asset_id", "pass")


@query(
    r""", v AS (SELECT asset_id, page_index, embedded_text AS t, length(regexp_replace(embedded_text, '[^\p{L}\p{N}]', '', 'g')) AS c, len(list_filter(regexp_split_to_array(embedded_text, '\s+'), lambda w: regexp_matches(w, '\p{L}'))) AS n FROM fx_pages),
    r AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY c DESC, n DESC, page_index) AS k FROM v)
    SELECT asset_id, CASE WHEN c > 0 OR n > 0 THEN t ELSE '' END AS text FROM r WHERE k = 1""",
    "fx_pages",
)
def pick_text_variant(spark, d):
    return pages.pick_text_variant(fixture(spark, d, "fx_pages").select("asset_id", F.col("page_index").alias("pos"), F.col("embedded_text").alias("text")))


@query()
def ocr_payload(spark, d):
    return pages.ocr_payload(fixture(spark, d, "fx_raw_text"), fixture(spark, d, "fx_words"))


# --- boxes and regions ----------------------------------------------------------------------------------------------


@query("SELECT asset_id, word_index, text, x + asset_id % 50 AS x, y + asset_id % 70 AS y, w, h, coalesce(CASE WHEN word_index % 5 <> 0 THEN confidence END, 0.0) AS confidence FROM fx_words", "fx_words")
def translate_words(spark, d):
    words = fixture(spark, d, "fx_words").withColumns({"dx": F.col("asset_id") % 50, "dy": F.col("asset_id") % 70, "confidence": F.when(F.col("word_index") % 5 != 0, F.col("confidence"))})
    return proposals.translate_words(words)


@query(
    """, c AS (SELECT event_id, greatest(0, least(x, 599)) AS x, greatest(0, least(y, 399)) AS y, w, h FROM fx_detections),
    k AS (SELECT event_id, x, y, greatest(1, least(w, 600 - x)) AS w, greatest(1, least(h, 400 - y)) AS h FROM c),
    p AS (SELECT *, greatest(0, x - 9) AS px, greatest(0, y - 9) AS py, greatest(1, least(600, x + w + 9) - greatest(0, x - 9)) AS pw, greatest(1, least(400, y + h + 9) - greatest(0, y - 9)) AS ph FROM k)
    SELECT event_id, concat_ws(',', x, y, w, h) AS clamped, concat_ws(',', px, py, pw, ph) AS padded, concat_ws(',', 0, 0, greatest(100, x + w), greatest(100, y + h)) AS joined, x + w / 2.0 AS cx, y + h / 2.0 AS cy, x >= 50 AND y >= 50 AND x + w <= 550 AND y + h <= 350 AS inside FROM p""",
    "fx_detections",
)
def bbox_ops(spark, d):
    width, height = F.lit(600), F.lit(400)
    rows = _detections(spark, d)
    box = clamp(Box.of(), width, height)
    rows = rows.select("event_id", *[getattr(box, c).alias(c) for c in "xywh"])
    box = Box.of()
    text = lambda b: F.concat_ws(",", *[getattr(b, c).cast("string") for c in "xywh"])
    return rows.select(
        "event_id",
        text(box).alias("clamped"),
        text(pad(box, F.lit(9), width, height)).alias("padded"),
        text(union(box, Box(F.lit(0), F.lit(0), F.lit(100), F.lit(100)))).alias("joined"),
        box.cx.alias("cx"),
        box.cy.alias("cy"),
        box.inside(Box(F.lit(50), F.lit(50), F.lit(500), F.lit(300))).alias("inside"),
    )


OVERLAP = "SELECT event_id, greatest(0, least({0} + {1}, 300) - greatest({0}, 100)) / CAST(greatest(1, least({1}, 200)) AS DOUBLE) AS ratio FROM fx_detections"


@query(OVERLAP.format("x", "w"), "fx_detections")
def x_overlap_ratio(spark, d):
    return _detections(spark, d).select("event_id", overlap_ratio(F.col("x"), F.col("x") + F.col("w"), F.lit(100), F.lit(300)).alias("ratio"))


@query(OVERLAP.format("y", "h"), "fx_detections")
def y_overlap_ratio(spark, d):
    return _detections(spark, d).select("event_id", overlap_ratio(F.col("y"), F.col("y") + F.col("h"), F.lit(100), F.lit(300)).alias("ratio"))


def _gapped(spark, d):
    """Words with a wide gap in the middle of some pieces, so that splits occur."""
    words = fixture(spark, d, "fx_words").where("word_index >= 0")
    x = F.col("x") + F.when((F.col("asset_id") % 2 == 0) & (F.col("x") > 480), 400).otherwise(0)
    y = F.when(F.col("asset_id") % 3 == 0, F.col("y") + F.when(F.col("word_index") % 2 == 0, 2_000_000).otherwise(0)).otherwise(F.col("y"))
    return words.withColumns({"x": x.cast("int"), "y": y.cast("int")})


GAPPED = """, g AS (SELECT asset_id, word_index, CAST(x + CASE WHEN asset_id % 2 = 0 AND x > 480 THEN 400 ELSE 0 END AS INT) AS x, CAST(CASE WHEN asset_id % 3 = 0 AND word_index % 2 = 0 THEN y + 2000000 ELSE y END AS INT) AS y, w, h FROM fx_words),
size AS (SELECT asset_id, max(x + w) AS width, max(y + h) AS height FROM g GROUP BY 1),
c AS (SELECT asset_id, x + w / 2.0 AS cx, y + h / 2.0 AS cy FROM g WHERE w > 1 AND h > 1),
""" + ",\n".join(
    f"""g{a} AS (SELECT asset_id, c{a} AS v, lead(c{a}) OVER o AS nv, row_number() OVER o AS i, count(*) OVER (PARTITION BY asset_id) AS n FROM c WINDOW o AS (PARTITION BY asset_id ORDER BY c{a})),
s{a} AS (SELECT asset_id, CAST(floor((v + nv) / 2.0) AS INT) AS s FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY nv - v DESC, i) AS k FROM g{a} WHERE nv IS NOT NULL) JOIN size USING (asset_id)
  WHERE k = 1 AND n >= 6 AND i >= 2 AND n - i >= 2 AND (nv - v) / {span} >= 0.18)"""
    for a, span in (("x", "width"), ("y", "height"))
)


@query(
    GAPPED
    + """, a AS (SELECT size.*, sx.s AS sx, sy.s AS sy FROM size LEFT JOIN sx USING (asset_id) LEFT JOIN sy USING (asset_id)),
    r AS (SELECT asset_id, 1 AS ord, 'region_lr_left' AS region_id, 0 AS x, 0 AS y, sx AS w, height AS h FROM a WHERE sx IS NOT NULL
    UNION ALL SELECT asset_id, 2, 'region_lr_right', sx, 0, greatest(1, width - sx), height FROM a WHERE sx IS NOT NULL
    UNION ALL SELECT asset_id, 3, 'region_tb_top', 0, 0, width, sy FROM a WHERE sy IS NOT NULL
    UNION ALL SELECT asset_id, 4, 'region_tb_bottom', 0, sy, width, greatest(1, height - sy) FROM a WHERE sy IS NOT NULL
    UNION ALL SELECT asset_id, 5, 'region_q_tl', 0, 0, greatest(1, sx), greatest(1, sy) FROM a WHERE sx + sy IS NOT NULL
    UNION ALL SELECT asset_id, 6, 'region_q_tr', sx, 0, greatest(1, width - sx), greatest(1, sy) FROM a WHERE sx + sy IS NOT NULL
    UNION ALL SELECT asset_id, 7, 'region_q_bl', 0, sy, greatest(1, sx), greatest(1, height - sy) FROM a WHERE sx + sy IS NOT NULL
    UNION ALL SELECT asset_id, 8, 'region_q_br', sx, sy, greatest(1, width - sx), greatest(1, height - sy) FROM a WHERE sx + sy IS NOT NULL
    UNION ALL SELECT asset_id, 9, 'region_full', 0, 0, width, height FROM a)
    SELECT asset_id, region_id, x, y, w, h FROM r""",
    "fx_words",
)
def propose_split_regions(spark, d):
    words = _gapped(spark, d)
    canvas = words.groupBy("asset_id").agg(F.max(F.col("x") + F.col("w")).alias("width"), F.max(F.col("y") + F.col("h")).alias("height"))
    return proposals.propose_split_regions(words, canvas).select("asset_id", "region_id", *"xywh")


@query("SELECT event_id FROM fx_detections WHERE w * h > 1 AND w * h / 160000.0 BETWEEN 0.018 AND 0.65 AND w >= floor(400 * 0.12) AND h >= floor(400 * 0.08) AND w / CAST(greatest(1, h) AS DOUBLE) BETWEEN 0.18 AND 6.0", "fx_detections")
def filter_panel_rects(spark, d):
    return proposals.filter_panel_rects(_detections(spark, d).withColumns({"width": F.lit(400), "height": F.lit(400)})).select("event_id")


# One round of the recursion is one pass of the growing box over those left; a pass is a fold over rows of its own type.
SHARED = "(greatest(0, least(a.x2, e.x2) - greatest(a.x1, e.x1)) * greatest(0, least(a.y2, e.y2) - greatest(a.y1, e.y1)))"
AREA = "(({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1))"
GROWN = f"""WITH RECURSIVE seed AS (SELECT asset_id, list({{'x1': x, 'y1': y, 'x2': x + w, 'y2': y + h, 'left_over': CAST([] AS STRUCT(x1 INT, y1 INT, x2 INT, y2 INT)[]), 'grown': false}} ORDER BY ord) AS boxes FROM (FX) GROUP BY 1),
state(asset_id, ord, box, boxes, made) AS (
  SELECT asset_id, 1, boxes[1], boxes[2:], NULL::STRUCT(x1 INT, y1 INT, x2 INT, y2 INT) FROM seed
  UNION ALL
  SELECT asset_id, CASE WHEN p.grown THEN ord ELSE ord + 1 END, CASE WHEN p.grown THEN {{'x1': p.x1, 'y1': p.y1, 'x2': p.x2, 'y2': p.y2, 'left_over': CAST([] AS STRUCT(x1 INT, y1 INT, x2 INT, y2 INT)[]), 'grown': false}} ELSE rest[1] END,
    CASE WHEN p.grown THEN rest ELSE rest[2:] END, CASE WHEN NOT p.grown THEN {{'x1': p.x1, 'y1': p.y1, 'x2': p.x2, 'y2': p.y2}} END
  FROM (SELECT *, [{{'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2, 'left_over': CAST([] AS STRUCT(x1 INT, y1 INT, x2 INT, y2 INT)[]), 'grown': false}} for b in p.left_over] AS rest FROM (
    SELECT asset_id, ord, list_reduce(list_prepend(box, boxes), lambda a, e: CASE WHEN {SHARED} / CAST({AREA.format('a')} + {AREA.format('e')} - {SHARED} AS DOUBLE) >= 0.3
      THEN {{'x1': least(a.x1, e.x1), 'y1': least(a.y1, e.y1), 'x2': greatest(a.x2, e.x2), 'y2': greatest(a.y2, e.y2), 'left_over': a.left_over, 'grown': true}}
      ELSE {{'x1': a.x1, 'y1': a.y1, 'x2': a.x2, 'y2': a.y2, 'left_over': list_append(a.left_over, {{'x1': e.x1, 'y1': e.y1, 'x2': e.x2, 'y2': e.y2}}), 'grown': a.grown}} END) AS p
    FROM state WHERE box IS NOT NULL)))
SELECT asset_id, CAST(ord - 1 AS INT) AS ord, made.x1 AS x, made.y1 AS y, made.x2 - made.x1 AS w, made.y2 - made.y1 AS h FROM state WHERE made IS NOT NULL"""


@query(GROWN.replace("(FX)", f"({duck('fx_detections')} SELECT * FROM fx_detections)"))
def merge_overlapping_regions(spark, d):
    return proposals.merge_overlapping_regions(_detections(spark, d), 0.3)


PLANNED = f""", sem AS (SELECT asset_id, ord, 'yolo_' || ord AS region_id, 'semantic' AS kind, x, y, w, h FROM fx_detections WHERE class_name IN ('campaign_area', 'info_card_area', 'price_main_area', 'sku_area')),
enough AS (SELECT asset_id FROM sem GROUP BY 1 HAVING count(*) >= 2),
chosen AS (SELECT * FROM sem SEMI JOIN enough USING (asset_id) UNION ALL SELECT asset_id, 1, 'region_half', 'macro', 0, 0, 500, 600 FROM (SELECT DISTINCT asset_id FROM fx_detections) ANTI JOIN enough USING (asset_id) UNION ALL SELECT asset_id, 2, 'region_full', 'full', 0, 0, 1000, 600 FROM (SELECT DISTINCT asset_id FROM fx_detections) ANTI JOIN enough USING (asset_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY ord) AS n, bool_or(kind <> 'full') OVER (PARTITION BY asset_id) AS others FROM chosen, {CANVAS}),
held AS (SELECT asset_id, ord, region_id, width, height, greatest(0, least(x, width - 1)) AS x, greatest(0, least(y, height - 1)) AS y, w, h FROM ranked WHERE n <= 8 AND NOT (others AND kind = 'full')),
sized AS (SELECT asset_id, ord, region_id, width, height, x, y, greatest(1, least(w, width - x)) AS w, greatest(1, least(h, height - y)) AS h FROM held),
pads AS (SELECT *, CAST(floor(greatest(8.0, 0.03::DOUBLE * least(w, h))) AS INT) AS p FROM sized WHERE w * h >= floor(0.02::DOUBLE * width * height)),
plan AS (SELECT asset_id, ord, region_id, greatest(0, x - p) AS x, greatest(0, y - p) AS y, greatest(1, least(width, x + w + p) - greatest(0, x - p)) AS w, greatest(1, least(height, y + h + p) - greatest(0, y - p)) AS h FROM pads)"""


def _chosen(spark, d):
    det = _detections(spark, d)
    halves = F.array(*[F.struct(F.lit(o).cast("long").alias("ord"), F.lit(i).alias("region_id"), F.lit(k).alias("kind"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(w).alias("w"), F.lit(600).alias("h"), F.lit(0.5).alias("confidence")) for o, i, k, w in ((1, "region_half", "macro", 500), (2, "region_full", "full", 1000))])
    proposed = det.select("asset_id").distinct().select("asset_id", F.explode(halves).alias("r")).select("asset_id", "r.*")
    return proposals.choose_regions(det, proposed)


@query(PLANNED + " SELECT asset_id, ord, region_id, kind FROM chosen", "fx_detections")
def choose_regions(spark, d):
    return _chosen(spark, d).select("asset_id", "ord", "region_id", "kind")


@query(PLANNED + " SELECT asset_id, region_id, x, y, w, h FROM plan", "fx_detections")
def ocr_region_plan(spark, d):
    return proposals.ocr_region_plan(_chosen(spark, d), _canvas(_detections(spark, d))).select("asset_id", "region_id", *"xywh")


@query(PLANNED + " SELECT w.asset_id, word_index, region_id FROM fx_words w JOIN plan p ON p.asset_id = w.asset_id AND w.x + w.w / 2.0 BETWEEN p.x AND p.x + p.w AND w.y + w.h / 2.0 BETWEEN p.y AND p.y + p.h", "fx_detections", "fx_words")
def region_words_union(spark, d):
    return _region_words(spark, d).select("asset_id", "word_index", "region_id")


def _region_words(spark, d):
    plan = proposals.ocr_region_plan(_chosen(spark, d), _canvas(_detections(spark, d)))
    return proposals.region_words_union(fixture(spark, d, "fx_words"), plan)


@query()
def hybrid_layout(spark, d):
    return proposals.hybrid_layout(_region_words(spark, d))


def _layer(blocks, wanted):
    return blocks.where(wanted).select("asset_id", "block_order", "text")


@query(
    """, r AS (SELECT asset_id, block_order, text, 0 AS layer FROM fx_blocks WHERE asset_id % 3 = 0 AND region_class IS NOT NULL UNION ALL SELECT asset_id, block_order, text, 1 FROM fx_blocks WHERE asset_id % 2 = 0 AND block_order > 2 UNION ALL SELECT asset_id, block_order, text, 2 FROM fx_blocks),
    f AS (SELECT asset_id, min(layer) AS layer FROM r GROUP BY 1)
    SELECT asset_id, block_order, text, ['regional', 'masked', 'global'][layer + 1] AS source FROM r JOIN f USING (asset_id, layer)""",
    "fx_blocks",
)
def layout_precedence(spark, d):
    b = fixture(spark, d, "fx_blocks")
    return proposals.layout_precedence(_layer(b, "asset_id % 3 = 0 and region_class is not null"), _layer(b, "asset_id % 2 = 0 and block_order > 2"), _layer(b, "true"))


@query(
    "SELECT asset_id, block_order, 'block_' || row_number() OVER (PARTITION BY asset_id ORDER BY y + h / 2.0, x, block_order) AS own_id, coalesce(region_class, 'none') || '::block_' || row_number() OVER (PARTITION BY asset_id, coalesce(region_class, 'none') ORDER BY y + h / 2.0, x, block_order) AS region_block FROM fx_blocks",
    "fx_blocks",
)
def reading_ids(spark, d):
    b = fixture(spark, d, "fx_blocks").withColumns({"ord": F.col("block_order"), "region_id": F.coalesce("region_class", F.lit("none"))})
    own = proposals.reading_ids(b, "block").withColumnRenamed("id", "own_id")
    return proposals.reading_ids(own, "block", region=True).select("asset_id", "block_order", "own_id", F.col("id").alias("region_block"))


@query(
    """, f AS (SELECT asset_id, type AS field, CASE WHEN block_order % 4 <> 0 THEN block_id END AS block_id FROM fx_blocks),
    b AS (SELECT asset_id, block_id, region_class, CASE WHEN region_class IS NOT NULL AND block_order % 2 = 1 THEN 'r' || block_order END AS region_id FROM fx_blocks),
    r AS (SELECT asset_id, 'r' || block_order AS region_id, x, y, w, h FROM fx_blocks WHERE block_order % 2 = 1)
    SELECT f.asset_id, f.field, b.region_id, b.region_class, r.x AS region_x, r.h AS region_h, CASE WHEN b.block_id IS NULL THEN NULL WHEN b.region_id IS NOT NULL THEN 'regional_ocr' WHEN f.asset_id % 5 = 0 THEN 'yolo_masked_global' ELSE 'global_ocr' END AS strategy
    FROM f LEFT JOIN b ON b.asset_id = f.asset_id AND b.block_id = f.block_id LEFT JOIN r ON r.asset_id = f.asset_id AND r.region_id = b.region_id""",
    "fx_blocks",
)
def enrich_trace(spark, d):
    b = fixture(spark, d, "fx_blocks")
    odd = F.col("block_order") % 2 == 1
    name = F.concat(F.lit("r"), F.col("block_order").cast("string"))
    traced = proposals.enrich_trace(
        b.select("asset_id", F.col("type").alias("field"), F.when(F.col("block_order") % 4 != 0, F.col("block_id")).alias("block_id")),
        b.select("asset_id", "block_id", "region_class", F.when(odd & F.col("region_class").isNotNull(), name).alias("region_id")),
        b.where(odd).select("asset_id", name.alias("region_id"), *"xywh"),
        b.where("asset_id % 5 = 0").select("asset_id"),
    )
    return traced.select("asset_id", "field", "region_id", "region_class", "region_x", "region_h", "strategy")


@query()
def group_blocks_simple(spark, d):
    return of_pieces(spark, d, lambda words, together: grouping.group_blocks_simple(grouping.group_lines(words, together=together), together))


# --- gates, colours, labels -----------------------------------------------------------------------------------------

EFFECTIVE = f"coalesce(CASE WHEN asset_id % 3 = 0 THEN nullif(lower(trim(CASE WHEN asset_id % 2 = 0 THEN ' MTLK' ELSE raw_format END)), '') END, CASE WHEN {KIND} = 'ST' THEN 'slideshow' END)"


def _effective():
    given = F.when(F.col("asset_id") % 3 == 0, F.when(F.col("asset_id") % 2 == 0, F.lit(" MTLK")).otherwise(F.col("raw_format")))
    return assets.effective_piece_format(given, assets.piece_type(F.col("width"), F.col("height")))


@query(f"SELECT asset_id, coalesce({EFFECTIVE} IN ('slideshow', 'mtlk'), false) AS supported FROM fx_assets", "fx_assets")
def is_supported(spark, d):
    return fixture(spark, d, "fx_assets").select("asset_id", assets.is_supported(_effective()).alias("supported"))


@query(f"SELECT asset_id, CASE WHEN NOT asset_id % 4 <> 0 THEN 'not_executed' WHEN NOT coalesce({EFFECTIVE} IN ('slideshow', 'mtlk'), false) THEN 'not_applicable' WHEN asset_id % 7 = 0 THEN 'error' END AS status FROM fx_assets", "fx_assets")
def excel_not_applicable(spark, d):
    a = F.col("asset_id")
    return fixture(spark, d, "fx_assets").select("asset_id", assets.excel_gate(a % 4 != 0, a % 7 != 0, assets.is_supported(_effective())).alias("status"))


@query(
    """, f AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '1:1' WHEN 1 THEN 'ST' END AS piece_type, 900.0::DOUBLE + event_id % 130 AS x, 50.0::DOUBLE + event_id % 300 AS y, 60.0::DOUBLE + event_id % 20 AS w, 48.0::DOUBLE + event_id % 12 AS h, 90.0::DOUBLE + event_id % 25 AS cw, 90.0::DOUBLE + event_id % 23 AS ch FROM fx_detections),
    r(piece_type, lx, ly, sx1, sy1, sx2, sy2) AS (VALUES ('1:1', 989.0::DOUBLE, 90.0::DOUBLE, 40.0::DOUBLE, 40.0::DOUBLE, 1040.0::DOUBLE, 1040.0::DOUBLE), ('ST', 946.0, 291.0, 60.0, 151.0, 1020.0, 1511.0))
    SELECT event_id AS asset_id, CASE WHEN lx IS NOT NULL THEN abs(w - 71) <= 71 * 0.1::DOUBLE AND abs(h - 54) <= 54 * 0.1::DOUBLE END AS logo_size_valid, abs(x - lx) <= 40 AND abs(y - ly) <= 40 AS logo_position_valid,
      x >= sx1 AND y >= sy1 AND x + w <= sx2 AND y + h <= sy2 AS logo_inside_safe_area, CASE WHEN lx IS NOT NULL THEN abs(cw - 102) <= 102 * 0.1::DOUBLE AND abs(ch - 101) <= 101 * 0.1::DOUBLE END AS container_size_valid FROM f LEFT JOIN r USING (piece_type)""",
    "fx_detections",
)
def logo_checks(spark, d):
    e = F.col("event_id")
    part = lambda base, n: (F.lit(float(base)) + e % n).cast("double")
    found = _detections(spark, d).select(e.alias("asset_id"), F.when(e % 3 == 0, "1:1").when(e % 3 == 1, "ST").alias("piece_type"), part(900, 130).alias("x"), part(50, 300).alias("y"), part(60, 20).alias("w"), part(48, 12).alias("h"), part(90, 25).alias("container_w"), part(90, 23).alias("container_h"))
    return assets.logo_checks(found)


@query("SELECT asset_id, block_id, CASE main_color WHEN 'red' THEN 'main_red_then_secondary_is_regular' WHEN 'black' THEN 'main_black_then_secondary_is_before' ELSE 'indeterminate_color' END AS strategy, CASE WHEN main_color IN ('red', 'black') THEN 2 ELSE 1 END AS n_messages FROM fx_blocks", "fx_blocks")
def classification_strategy(spark, d):
    s = colors.classification_strategy(F.col("main_color"))
    return fixture(spark, d, "fx_blocks").select("asset_id", "block_id", s["strategy"].alias("strategy"), F.size(s["messages"]).alias("n_messages"))


@query(
    """, b AS (SELECT asset_id, greatest(0, 1 + asset_id % 3 - CAST(round_even(greatest(3 + asset_id % 4, 4) * 0.18, 0) AS INT)) AS x0, greatest(0, 1 - CAST(round_even(greatest(3 + asset_id % 4, 4) * 0.18, 0) AS INT)) AS y0, least(8, 1 + asset_id % 3 + 3 + asset_id % 4 + CAST(round_even(greatest(3 + asset_id % 4, 4) * 0.18, 0) AS INT)) AS x1, least(8, 1 + 4 + CAST(round_even(greatest(3 + asset_id % 4, 4) * 0.18, 0) AS INT)) AS y1 FROM (SELECT DISTINCT asset_id FROM fx_pixels)),
    k AS (SELECT *, greatest(1, least(greatest(2, CAST(round_even(least(x1 - x0, y1 - y0) * 0.12, 0) AS INT)), least(x1 - x0, y1 - y0) // 3)) AS band FROM b WHERE x1 - x0 > 2 AND y1 - y0 > 2),
    p AS (SELECT asset_id, pos % 8 AS px, pos // 8 AS py, r, g, b FROM fx_pixels),
    m AS (SELECT asset_id, r, g, b, CAST(py < y0 + band AS INT) + CAST(py >= y1 - band AS INT) + CAST(px < x0 + band AS INT) + CAST(px >= x1 - band AS INT) AS n FROM p JOIN k USING (asset_id) WHERE px >= x0 AND px < x1 AND py >= y0 AND py < y1),
    e AS (SELECT asset_id, r, g, b, unnest(range(n)) FROM m)
    SELECT asset_id, CAST(floor(median(r)) AS INT) AS r, CAST(floor(median(g)) AS INT) AS g, CAST(floor(median(b)) AS INT) AS b FROM e GROUP BY 1""",
    "fx_pixels",
)
def border_median_rgb(spark, d):
    p = fixture(spark, d, "fx_pixels").withColumns({"px": (F.col("pos") % 8).cast("int"), "py": F.floor(F.col("pos") / F.lit(8)).cast("int")})
    a = F.col("asset_id")
    boxes = p.select("asset_id").distinct().select("asset_id", (1 + a % 3).cast("int").alias("x"), F.lit(1).alias("y"), (3 + a % 4).cast("int").alias("w"), F.lit(4).alias("h"), F.lit(8).alias("width"), F.lit(8).alias("height"))
    return colors.border_median_rgb(p, boxes)


@query(
    """, r AS (SELECT asset_id AS rule_id, list(printf('#%02X%02X%02X', r, g, b) ORDER BY pos DESC) AS ids FROM fx_pixels WHERE pos < 12 GROUP BY 1),
    pal AS (SELECT asset_id AS rule_id, list(DISTINCT printf('#%02X%02X%02X', r, g, b)) AS ids FROM fx_pixels WHERE pos % 3 = 0 GROUP BY 1)
    SELECT rule_id, array_to_string(list_filter(r.ids, lambda c: list_contains(pal.ids, c)), ',') AS colors FROM r JOIN pal USING (rule_id)""",
    "fx_pixels",
)
def allowed_backgrounds(spark, d):
    p = fixture(spark, d, "fx_pixels").select(F.col("asset_id").alias("rule_id"), "pos", T.hex_of_rgb(F.col("r"), F.col("g"), F.col("b")).alias("color_id"))
    rules = p.where("pos < 12").groupBy("rule_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("pos")).alias("pos"), "color_id"))), lambda s: s["color_id"]).alias("color_ids"))
    return colors.allowed_backgrounds(rules, p.where("pos % 3 = 0")).select("rule_id", F.array_join("color_ids", ",").alias("colors"))


def _labels(kind, column):
    cases = " ".join(f"WHEN '{k}' THEN '{v}:{name}'" for k, (v, name) in batch.STATUS_LABELS[kind].items())
    return f"CASE {column} {cases} ELSE 'na:' || coalesce(nullif({column}, ''), '—') END"


@query(f"SELECT item_id, {_labels('state', 'state')} AS state_label, {_labels('field', 'f')} AS field_label FROM (SELECT *, CASE item_id % 5 WHEN 0 THEN 'detected' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'odd' WHEN 3 THEN '' END AS f FROM fx_items)", "fx_items")
def status_labels(spark, d):
    i = F.col("item_id") % 5
    f = F.when(i == 0, "detected").when(i == 1, "ambiguous").when(i == 2, "odd").when(i == 3, "")
    text = lambda s: F.concat(s["variant"], F.lit(":"), s["label"])
    return fixture(spark, d, "fx_items").select("item_id", text(batch.status_label("state", F.col("state"))).alias("state_label"), text(batch.status_label("field", f)).alias("field_label"))


CHECKS = ("format_allowed", "dimensions_valid", "file_size_valid")


@query(f"SELECT item_id, CAST({' + '.join(f'CAST({c} AS INT)' for c in CHECKS)} AS INT) AS passed, 3 AS total FROM fx_items", "fx_items")
def validation_pass_count(spark, d):
    n = batch.validation_pass_count(*map(F.col, CHECKS))
    return fixture(spark, d, "fx_items").select("item_id", n["passed"].alias("passed"), n["total"].alias("total"))


@query(f"SELECT item_id, CAST(round(({' + '.join(f'CAST({c} AS INT)' for c in CHECKS)}) * 100 / 3.0) AS INT) AS score FROM fx_items", "fx_items")
def technical_score(spark, d):
    return fixture(spark, d, "fx_items").select("item_id", batch.technical_score().alias("score"))


@query("SELECT item_id, CASE WHEN state = 'listo' THEN CASE WHEN NOT format_allowed THEN 'error' WHEN NOT (dimensions_valid AND file_size_valid) OR (layout_score IS NOT NULL AND NOT text_inside_safe_area) THEN 'alerta' ELSE 'ok' END WHEN state = 'error' THEN 'error' ELSE 'alerta' END AS status FROM fx_items", "fx_items")
def status_general(spark, d):
    return batch.cards(fixture(spark, d, "fx_items")).select("item_id", F.col("status_general").alias("status"))


# --- best fields, each by itself ------------------------------------------------------------------------------------


def _best(field):
    def run(spark, d):
        return fields.extract_fields(fixture(spark, d, "fx_blocks"), digits=9).where(F.col("field") == field).drop("field")

    return run


def _register_best():
    for field in fields.FIELDS:
        name = f"best_{field}"
        sql = ORACLE_SQL.get("extract_fields")
        query(name=name)(_best(field))
        if sql:
            ORACLE_SQL[name] = f"SELECT * EXCLUDE (field) FROM ({sql}) WHERE field = '{field}'"


_register_best()


# --- dictionaries ---------------------------------------------------------------------------------------------------


@query()
def fuzzy_dictionary(spark, d):
    words = fixture(spark, d, "fx_raw_text").select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(dictionary.WORD), F.lit(0)))).alias("token")).distinct()
    return dictionary.fuzzy_dictionary(words, threshold=60)


@query()
def entity_text(spark, d):
    out = dictionary.entity_text(fixture(spark, d, "fx_raw_text"), threshold=60)
    return out.select("asset_id", "text", F.array_join("brands", ",").alias("brands"), F.array_join("locations", ",").alias("locations"))


@query()
def normalize_case(spark, d):
    return correction.normalize_case(correction.split_lines(fixture(spark, d, "fx_raw_text")))




# --- results --------------------------------------------------------------------------------------------------------


def _assembled(spark, d):
    blocks = fixture(spark, d, "fx_blocks")
    color = blocks.groupBy("asset_id").agg(F.min("main_color").alias("main_color"), F.lit(0.7).alias("color_confidence"))
    return compliance.assemble_fields(blocks, color, 9).select("asset_id", "field", "value", "status")


query(name="assemble_fields")(_assembled)
ORACLE_SQL["assemble_fields"] = f"SELECT asset_id, field, value, status FROM ({ORACLE_SQL['extract_fields']}) UNION ALL SELECT asset_id, field, value, status FROM ({ORACLE_SQL['assign_prices']})"


@query(
    "SELECT asset_id, count(*) FILTER (WHERE block_order NOT IN (3, 6)) AS n_blocks, arg_min(text, block_order) FILTER (WHERE block_order NOT IN (3, 6)) AS first_text, CASE WHEN asset_id % 4 = 0 THEN 'not_executed' ELSE 'match' END AS overall_status, max(CASE WHEN block_order = 5 THEN text END) AS sku FROM fx_blocks GROUP BY asset_id",
    "fx_blocks",
)
def read_response_json(spark, d):
    b = fixture(spark, d, "fx_blocks")
    box = F.when(F.col("block_order") == 3, F.array("x", "y")).otherwise(F.array(*"xywh")).cast("array<double>")
    block = F.struct("block_order", F.col("block_id").alias("id"), "type", F.when(F.col("block_order") == 6, "  ").otherwise(F.col("text")).alias("text"), box.alias("bbox"), "confidence")
    sku = F.max(F.when(F.col("block_order") == 5, F.col("text")))
    made = b.groupBy("asset_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"), sku.alias("sku"))
    status = F.when(F.col("asset_id") % 4 != 0, F.struct(F.lit("match").alias("overallStatus")))
    payload = F.to_json(F.struct(F.struct("blocks").alias("ocr"), F.create_map(F.lit("sku"), F.struct(F.col("sku").alias("value"))).alias("structuredFields"), status.alias("excelValidation")))
    got = ingest.read_response_json(made.select("asset_id", payload.alias("payload")))
    return got.select("asset_id", F.size("blocks").cast("long").alias("n_blocks"), F.get("blocks", F.lit(0))["text"].alias("first_text"), "overall_status", F.try_element_at("fields", F.lit("sku"))["value"].alias("sku"))
