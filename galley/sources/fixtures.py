"""Input tables of the compliance queries, derived from the driver's tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (tables read, Spark SQL, DuckDB SQL)
FIXTURES: dict[str, tuple[tuple[str, ...], str, str]] = {
    "fx_assets": (
        ('part',),
        r"""
SELECT p_partkey AS asset_id, p_partkey % 20 AS batch_id,
  concat(replace(p_name, ' ', '_'), '_', CAST(p_partkey AS STRING)) AS filename,
  CASE p_size % 5 WHEN 0 THEN 'jpg' WHEN 1 THEN ' JPEG ' WHEN 2 THEN 'png' WHEN 3 THEN 'PDF' ELSE 'gif' END AS raw_format,
  CAST(CASE p_partkey % 4 WHEN 0 THEN 1080 WHEN 1 THEN 1080 WHEN 2 THEN 800 ELSE 2160 END AS INT) AS width,
  CAST(CASE p_partkey % 4 WHEN 0 THEN 1080 WHEN 1 THEN 1920 WHEN 2 THEN 600 ELSE 2200 END AS INT) AS height,
  floor(p_retailprice) * p_size / 4.0E0 AS file_size_kb,
  CAST(CASE WHEN p_size % 5 = 3 THEN p_partkey % 15 ELSE NULL END AS INT) AS page_count,
  CASE WHEN p_size % 3 = 0 THEN concat('oferta ', p_brand) ELSE p_name END AS extracted_text
FROM part
""",
        r"""
SELECT p_partkey AS asset_id, p_partkey % 20 AS batch_id,
  concat(replace(p_name, ' ', '_'), '_', CAST(p_partkey AS STRING)) AS filename,
  CASE p_size % 5 WHEN 0 THEN 'jpg' WHEN 1 THEN ' JPEG ' WHEN 2 THEN 'png' WHEN 3 THEN 'PDF' ELSE 'gif' END AS raw_format,
  CAST(CASE p_partkey % 4 WHEN 0 THEN 1080 WHEN 1 THEN 1080 WHEN 2 THEN 800 ELSE 2160 END AS INT) AS width,
  CAST(CASE p_partkey % 4 WHEN 0 THEN 1080 WHEN 1 THEN 1920 WHEN 2 THEN 600 ELSE 2200 END AS INT) AS height,
  floor(p_retailprice) * p_size / 4.0E0 AS file_size_kb,
  CAST(CASE WHEN p_size % 5 = 3 THEN p_partkey % 15 ELSE NULL END AS INT) AS page_count,
  CASE WHEN p_size % 3 = 0 THEN concat('oferta ', p_brand) ELSE p_name END AS extracted_text
FROM part
""",
    ),
    "fx_catalog": (
        ('part',),
        r"""
SELECT p_partkey AS row_index,
  CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_type END AS campaign,
  replace(p_brand, '#', '') AS brand, concat(p_name, ' ', p_type) AS description,
  CAST(1000000 + p_partkey - CASE WHEN p_partkey % 50 = 1 THEN 1 ELSE 0 END AS STRING) AS sku,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(CAST(floor(p_retailprice) AS INT) AS STRING) END AS price_cmr,
  concat(CAST(CAST(floor(p_retailprice) AS INT) AS STRING), '.90') AS price_regular,
  concat(CAST(CAST(floor(p_retailprice) AS INT) + 50 AS STRING), ',00') AS price_before
FROM part
""",
        r"""
SELECT p_partkey AS row_index,
  CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_type END AS campaign,
  replace(p_brand, '#', '') AS brand, concat(p_name, ' ', p_type) AS description,
  CAST(1000000 + p_partkey - CASE WHEN p_partkey % 50 = 1 THEN 1 ELSE 0 END AS STRING) AS sku,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(CAST(floor(p_retailprice) AS INT) AS STRING) END AS price_cmr,
  concat(CAST(CAST(floor(p_retailprice) AS INT) AS STRING), '.90') AS price_regular,
  concat(CAST(CAST(floor(p_retailprice) AS INT) + 50 AS STRING), ',00') AS price_before
FROM part
""",
    ),
    "fx_detected": (
        ('lineitem', 'part'),
        r"""
SELECT DISTINCT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)) AS asset_id,
  CASE WHEN l_linenumber = 7 AND l_orderkey % 20 = 0 THEN NULL WHEN l_partkey % 9 = 0 THEN concat('SKU: ', CAST(1000000 + l_partkey AS STRING))
       ELSE CAST(1000000 + l_partkey AS STRING) END AS sku,
  CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE upper(replace(p_brand, '#', '')) END AS brand,
  CASE WHEN l_suppkey % 5 = 0 THEN p_name ELSE concat(p_name, '  ', p_type) END AS description,
  p_type AS campaign,
  CASE WHEN l_linenumber = 2 THEN '1,00' ELSE CAST(CAST(floor(p_retailprice) AS INT) AS STRING) END AS price_cmr,
  concat(CAST(CAST(floor(p_retailprice) AS INT) AS STRING), ',90') AS price_regular,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE concat(CAST(CAST(floor(p_retailprice) AS INT) + 50 AS STRING), '.00') END AS price_before
FROM lineitem JOIN part ON l_partkey = p_partkey
""",
        r"""
SELECT DISTINCT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)) AS asset_id,
  CASE WHEN l_linenumber = 7 AND l_orderkey % 20 = 0 THEN NULL WHEN l_partkey % 9 = 0 THEN concat('SKU: ', CAST(1000000 + l_partkey AS STRING))
       ELSE CAST(1000000 + l_partkey AS STRING) END AS sku,
  CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE upper(replace(p_brand, '#', '')) END AS brand,
  CASE WHEN l_suppkey % 5 = 0 THEN p_name ELSE concat(p_name, '  ', p_type) END AS description,
  p_type AS campaign,
  CASE WHEN l_linenumber = 2 THEN '1,00' ELSE CAST(CAST(floor(p_retailprice) AS INT) AS STRING) END AS price_cmr,
  concat(CAST(CAST(floor(p_retailprice) AS INT) AS STRING), ',90') AS price_regular,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE concat(CAST(CAST(floor(p_retailprice) AS INT) + 50 AS STRING), '.00') END AS price_before
FROM lineitem JOIN part ON l_partkey = p_partkey
""",
    ),
    "fx_blocks": (
        ('part',),
        r"""
SELECT p_partkey AS asset_id, b AS block_order, concat('block_', CAST(b AS STRING)) AS block_id,
  CASE b WHEN 1 THEN 'campaign' WHEN 2 THEN 'date_range' WHEN 3 THEN 'brand' WHEN 4 THEN 'description' WHEN 5 THEN 'sku'
         WHEN 6 THEN 'price_main' WHEN 7 THEN 'price_secondary' ELSE 'promo_badge' END AS type,
  CASE b WHEN 1 THEN 'SEMANA DE OFERTAS PARA TU HOGAR' WHEN 2 THEN concat('Del lunes ', CAST(p_size AS STRING), ' al 28 de marzo')
         WHEN 3 THEN upper(p_name) WHEN 4 THEN concat(p_name, ' ', lower(p_type), ' x ', CAST(p_size AS STRING), ' unidades')
         WHEN 5 THEN CASE WHEN p_size % 4 = 0 THEN CAST(1000000 + p_partkey AS STRING) ELSE concat('SKU: ', CAST(1000000 + p_partkey AS STRING)) END
         WHEN 6 THEN concat('S/ ', CAST(CAST(floor(p_retailprice) AS INT) AS STRING), '.90')
         WHEN 7 THEN concat('Precio regular S/ ', CAST(CAST(floor(p_retailprice) AS INT) + 50 AS STRING), ',00') ELSE 'CMR' END AS text,
  CAST(10 + (p_partkey % 3) * 5 AS INT) AS x, CAST(40 * b AS INT) AS y, CAST(60 + 20 * b AS INT) AS w, CAST(18 + (p_size * b) % 60 AS INT) AS h,
  (60 + (p_partkey * 7 + b * 13) % 40) / 100.0E0 AS confidence,
  CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 17 = 1 AND b = 4 THEN 'product_photo_area'
       WHEN b = 1 THEN 'campaign_area' WHEN b = 2 THEN 'date_area' WHEN b IN (3, 4) THEN 'info_card_area' WHEN b = 5 THEN 'sku_area'
       WHEN b IN (6, 7) AND p_partkey % 2 = 0 THEN 'price_main_area' WHEN b = 6 THEN 'price_main_area' WHEN b = 7 THEN 'price_secondary_area' ELSE NULL END AS region_class,
  CASE p_size % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'black' ELSE 'indeterminate' END AS main_color
FROM part CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6), (7), (8)) AS v(b)
""",
        r"""
SELECT p_partkey AS asset_id, b AS block_order, concat('block_', CAST(b AS STRING)) AS block_id,
  CASE b WHEN 1 THEN 'campaign' WHEN 2 THEN 'date_range' WHEN 3 THEN 'brand' WHEN 4 THEN 'description' WHEN 5 THEN 'sku'
         WHEN 6 THEN 'price_main' WHEN 7 THEN 'price_secondary' ELSE 'promo_badge' END AS type,
  CASE b WHEN 1 THEN 'SEMANA DE OFERTAS PARA TU HOGAR' WHEN 2 THEN concat('Del lunes ', CAST(p_size AS STRING), ' al 28 de marzo')
         WHEN 3 THEN upper(p_name) WHEN 4 THEN concat(p_name, ' ', lower(p_type), ' x ', CAST(p_size AS STRING), ' unidades')
         WHEN 5 THEN CASE WHEN p_size % 4 = 0 THEN CAST(1000000 + p_partkey AS STRING) ELSE concat('SKU: ', CAST(1000000 + p_partkey AS STRING)) END
         WHEN 6 THEN concat('S/ ', CAST(CAST(floor(p_retailprice) AS INT) AS STRING), '.90')
         WHEN 7 THEN concat('Precio regular S/ ', CAST(CAST(floor(p_retailprice) AS INT) + 50 AS STRING), ',00') ELSE 'CMR' END AS text,
  CAST(10 + (p_partkey % 3) * 5 AS INT) AS x, CAST(40 * b AS INT) AS y, CAST(60 + 20 * b AS INT) AS w, CAST(18 + (p_size * b) % 60 AS INT) AS h,
  (60 + (p_partkey * 7 + b * 13) % 40) / 100.0E0 AS confidence,
  CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 17 = 1 AND b = 4 THEN 'product_photo_area'
       WHEN b = 1 THEN 'campaign_area' WHEN b = 2 THEN 'date_area' WHEN b IN (3, 4) THEN 'info_card_area' WHEN b = 5 THEN 'sku_area'
       WHEN b IN (6, 7) AND p_partkey % 2 = 0 THEN 'price_main_area' WHEN b = 6 THEN 'price_main_area' WHEN b = 7 THEN 'price_secondary_area' ELSE NULL END AS region_class,
  CASE p_size % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'black' ELSE 'indeterminate' END AS main_color
FROM part CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6), (7), (8)) AS v(b)
""",
    ),
    "fx_words": (
        ('documents',),
        r"""
SELECT asset_id, CAST(pos AS INT) AS word_index, word AS text,
  CAST(10 + (pos % 8) * 120 + asset_id % 5 AS INT) AS x, CAST(10 + floor(pos / 8) * 30 + pos % 3 AS INT) AS y,
  CAST(least(110, 12 * length(word)) AS INT) AS w, CAST(18 + pos % 4 AS INT) AS h,
  (50 + (asset_id * 31 + pos * 17) % 50) / 100.0E0 AS confidence FROM (SELECT doc_id AS asset_id, posexplode(filter(split(text, '[ \\t\\n\\r]+'), t -> t <> '')) AS (pos, word) FROM documents)
""",
        r"""
SELECT asset_id, CAST(pos AS INT) AS word_index, word AS text,
  CAST(10 + (pos % 8) * 120 + asset_id % 5 AS INT) AS x, CAST(10 + floor(pos / 8) * 30 + pos % 3 AS INT) AS y,
  CAST(least(110, 12 * length(word)) AS INT) AS w, CAST(18 + pos % 4 AS INT) AS h,
  (50 + (asset_id * 31 + pos * 17) % 50) / 100.0E0 AS confidence FROM (SELECT doc_id AS asset_id, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda t: t <> '') AS ws FROM documents))
""",
    ),
    "fx_pages": (
        ('documents',),
        r"""
SELECT CAST(floor(doc_id / 4.0E0) AS BIGINT) AS asset_id, CAST(doc_id % 4 AS INT) AS page_index,
  CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS embedded_text,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE replace(text, 'er', 'cr') END AS ocr_text,
  (doc_id % 50) / 100.0E0 + 0.5E0 AS ocr_avg
FROM documents
""",
        r"""
SELECT CAST(floor(doc_id / 4.0E0) AS BIGINT) AS asset_id, CAST(doc_id % 4 AS INT) AS page_index,
  CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS embedded_text,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE replace(text, 'er', 'cr') END AS ocr_text,
  (doc_id % 50) / 100.0E0 + 0.5E0 AS ocr_avg
FROM documents
""",
    ),
    "fx_raw_text": (
        ('documents',),
        r"""
SELECT doc_id AS asset_id, CASE doc_id % 6
  WHEN 0 THEN upper(t)
  WHEN 1 THEN concat('TRIVIA PRO', chr(10), 'CUALES EL MARTILLOIDEAL', chr(10), 'PARA TRABAJOS DE CARPINTERIA', chr(10), replace(t, '. ', concat('?', chr(10))), chr(10), 'A) MARTILLO DE BOLA', chr(10), 'B) TIPO "UNA', chr(39))
  WHEN 2 THEN replace(replace(t, '. ', concat(' .', chr(10), chr(10), chr(10))), ', ', ' ,')
  WHEN 3 THEN replace(replace(t, 'o', '0'), 'l', '1')
  WHEN 4 THEN replace(replace(replace(t, 'm', 'rn'), 'ñ', concat('n', chr(39))), ' de ', ' “de” ')
  ELSE concat('como esta "', t) END AS text
FROM (SELECT doc_id, replace(coalesce(text, ''), 'ß', 'ss') AS t FROM documents)
""",
        r"""
SELECT doc_id AS asset_id, CASE doc_id % 6
  WHEN 0 THEN upper(t)
  WHEN 1 THEN concat('TRIVIA PRO', chr(10), 'CUALES EL MARTILLOIDEAL', chr(10), 'PARA TRABAJOS DE CARPINTERIA', chr(10), replace(t, '. ', concat('?', chr(10))), chr(10), 'A) MARTILLO DE BOLA', chr(10), 'B) TIPO "UNA', chr(39))
  WHEN 2 THEN replace(replace(t, '. ', concat(' .', chr(10), chr(10), chr(10))), ', ', ' ,')
  WHEN 3 THEN replace(replace(t, 'o', '0'), 'l', '1')
  WHEN 4 THEN replace(replace(replace(t, 'm', 'rn'), 'ñ', concat('n', chr(39))), ' de ', ' “de” ')
  ELSE concat('como esta "', t) END AS text
FROM (SELECT doc_id, replace(coalesce(text, ''), 'ß', 'ss') AS t FROM documents)
""",
    ),
    "fx_detections": (
        ('events',),
        r"""
SELECT event_id, user_id AS asset_id, event_id AS ord,
  CASE event_type WHEN 'view' THEN 'info_card_area' WHEN 'click' THEN 'product_photo_area' WHEN 'purchase' THEN 'price_main_area'
       WHEN 'signup' THEN 'campaign_area' ELSE 'sku_area' END AS class_name,
  CAST((event_id * 37) % 900 AS INT) AS x, CAST((event_id * 53) % 450 AS INT) AS y,
  CAST(20 + (event_id * 11) % 200 AS INT) AS w, CAST(20 + (event_id * 7) % 120 AS INT) AS h,
  (50 + event_id % 50) / 100.0E0 AS confidence
FROM events
""",
        r"""
SELECT event_id, user_id AS asset_id, event_id AS ord,
  CASE event_type WHEN 'view' THEN 'info_card_area' WHEN 'click' THEN 'product_photo_area' WHEN 'purchase' THEN 'price_main_area'
       WHEN 'signup' THEN 'campaign_area' ELSE 'sku_area' END AS class_name,
  CAST((event_id * 37) % 900 AS INT) AS x, CAST((event_id * 53) % 450 AS INT) AS y,
  CAST(20 + (event_id * 11) % 200 AS INT) AS w, CAST(20 + (event_id * 7) % 120 AS INT) AS h,
  (50 + event_id % 50) / 100.0E0 AS confidence
FROM events
""",
    ),
    "fx_items": (
        ('events',),
        r"""
SELECT event_id AS item_id, user_id % 10 AS batch_id, ts,
  CASE event_type WHEN 'view' THEN 'listo' WHEN 'purchase' THEN 'listo' WHEN 'click' THEN 'analizando' WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'pendiente' ELSE 'subiendo' END ELSE 'error' END AS state,
  CAST(event_id % 101 AS INT) AS progress_percent,
  event_id % 13 <> 0 AS format_allowed, event_id % 5 <> 0 AS dimensions_valid, event_id % 7 <> 0 AS file_size_valid,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST((event_id % 6) * 20 AS INT) END AS layout_score,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 3 <> 0 END AS logo_detected,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 11 <> 0 END AS text_inside_safe_area,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE (event_id % 100) / 100.0E0 END AS ocr_score,
  (event_id % 100) / 100.0E0 AS ocr_avg
FROM events
""",
        r"""
SELECT event_id AS item_id, user_id % 10 AS batch_id, ts,
  CASE event_type WHEN 'view' THEN 'listo' WHEN 'purchase' THEN 'listo' WHEN 'click' THEN 'analizando' WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'pendiente' ELSE 'subiendo' END ELSE 'error' END AS state,
  CAST(event_id % 101 AS INT) AS progress_percent,
  event_id % 13 <> 0 AS format_allowed, event_id % 5 <> 0 AS dimensions_valid, event_id % 7 <> 0 AS file_size_valid,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST((event_id % 6) * 20 AS INT) END AS layout_score,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 3 <> 0 END AS logo_detected,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 11 <> 0 END AS text_inside_safe_area,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE (event_id % 100) / 100.0E0 END AS ocr_score,
  (event_id % 100) / 100.0E0 AS ocr_avg
FROM events
""",
    ),
    "fx_pixels": (
        ('embeddings',),
        r"""
SELECT vec_id AS asset_id, CAST(pos AS INT) AS pos, CAST(floor(abs(CAST(e AS DOUBLE)) * 997) % 256 AS INT) AS r, CAST(floor(abs(CAST(e AS DOUBLE)) * 499) % 256 AS INT) AS g, CAST(pos * 3 AS INT) AS b FROM (SELECT vec_id, posexplode(embedding) AS (pos, e) FROM embeddings)
""",
        r"""
SELECT vec_id AS asset_id, CAST(pos AS INT) AS pos, CAST(floor(abs(CAST(e AS DOUBLE)) * 997) % 256 AS INT) AS r, CAST(floor(abs(CAST(e AS DOUBLE)) * 499) % 256 AS INT) AS g, CAST(pos * 3 AS INT) AS b FROM (SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding) AS e FROM embeddings)
""",
    ),
}


def fixture(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """The fixture table over ``sf_dir``; the driver's tables (or those ``given`` in their place) are passed to the SQL text, no
    views are left behind."""
    tables, sql, _ = FIXTURES[name]
    frames = {t: given[t] if t in given else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    for t in tables:
        sql = _named(sql, t)
    return spark.sql(sql, **frames)


def _named(sql: str, table: str) -> str:
    """``FROM table`` and ``JOIN table`` as references to a DataFrame argument."""
    for word in ("FROM", "JOIN"):
        sql = sql.replace(f"{word} {table} ", f"{word} {{{table}}} ").replace(f"{word} {table}\n", f"{word} {{{table}}}\n").replace(f"{word} {table})", f"{word} {{{table}}})")
    return sql


def duck(*names: str) -> str:
    """A WITH clause of these fixtures for DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS ({FIXTURES[n][2].strip()})" for n in names)
