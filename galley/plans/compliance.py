"""From words, blocks and a catalog to one result row per piece."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assets, catalog, fields


#: The fields of a result and their names in it.
RESULT_FIELDS = {
    "campaign": "campaign", "date_range": "dateRange", "brand": "brand", "description": "description", "sku": "sku", "price_cmr": "priceCmr",
    "price_regular": "priceRegular", "price_before": "priceBefore", "price_main": "priceMain", "price_secondary": "priceSecondary",
}


def assemble_fields(blocks: DataFrame, colors: DataFrame, digits: int = 4) -> DataFrame:
    """``asset_id, field, value, block_id, confidence, status`` of all ten fields of every asset: the extracted ones and
    the three prices that the main block's colour assigns."""
    extracted = fields.extract_fields(blocks, digits)
    return extracted.unionByName(fields.assign_prices(extracted, colors))


def piece_results(pieces: DataFrame, blocks: DataFrame, colors: DataFrame, rows: DataFrame) -> DataFrame:
    """Technical checks, the ten fields (a map by their names in results) and the catalog's verdict of every piece."""
    long = assemble_fields(blocks, colors)
    value = lambda f: F.max(F.when(F.col("field") == f, F.col("value"))).alias(f)
    name = F.create_map(*[F.lit(x) for pair in RESULT_FIELDS.items() for x in pair])
    as_map = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.try_element_at(name, F.col("field")).alias("name"), F.struct("value", "block_id", "confidence", "status").alias("field"))))).alias("fields")
    by_asset = long.groupBy("asset_id").agg(as_map, *[value(f) for f in catalog.FIELDS])
    verdict = catalog.validate_catalog(by_asset.drop("fields"), rows)
    return assets.technical_validation(pieces).join(by_asset.select("asset_id", "fields"), "asset_id", "left").join(verdict, "asset_id", "left")


def write_results(results: DataFrame, path: str, run_id: str, by: str = "batch_id") -> bool:
    """Hands over the batches in ``results`` under ``path`` all at once; True if this call did it.

    A run's rows are staged in a folder of its own, then counted as written, and become visible with the one file of its
    manifest.  A run that dies before leaves what readers see as it was; its next attempt under the same ``run_id``
    replaces the staged rows.  A run that has its manifest does nothing.  Of several runs with a batch the last one
    counts; other batches stay.  One writer at a time; ``by`` may be null; columns ``run``, ``part`` and ``version`` are
    reserved; an empty table makes no manifest.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", run_id):
        raise ValueError(f"a run id is made of letters, digits, dots and dashes: {run_id!r}")
    taken = {"run", "part", "version"} & set(results.columns)
    if taken:
        raise ValueError(f"reserved columns: {sorted(taken)}")
    spark = results.sparkSession
    done = _manifests(spark, path)
    if done is not None and not done.where(F.col("run") == run_id).isEmpty():
        return False
    version = 1 if done is None else done.agg(F.max("version")).first()[0] + 1
    rows = f"{path}/rows/run=run-{run_id}"
    results.withColumn("part", F.col(by).cast("string")).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("part").parquet(rows)
    batches = spark.read.schema(results.schema).parquet(rows).groupBy(by).agg(F.count("*").alias("n_rows"))
    if batches.isEmpty():
        return False
    manifest = batches.select(F.col(by).alias("batch"), "n_rows", F.lit(run_id).alias("run"), F.lit(version).cast("long").alias("version"))
    # one file: it is there or it is not
    manifest.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/manifests/{run_id}")
    return True


def _manifests(spark: SparkSession, path: str) -> DataFrame | None:
    """``batch, n_rows, run, version`` of all finished runs under ``path``; None before the first."""
    try:
        return spark.read.option("recursiveFileLookup", True).parquet(f"{path}/manifests")
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_results(spark: SparkSession, path: str, by: str = "batch_id") -> DataFrame:
    """The rows that ``write_results`` made visible: of every batch those of its last run; an error before the first run."""
    done = _manifests(spark, path)
    if done is None:
        raise FileNotFoundError(f"no finished run under {path}")
    last = done.groupBy("batch").agg(F.max_by("run", F.struct("version", "run")).alias("last"))
    rows = spark.read.option("basePath", f"{path}/rows").option("mergeSchema", True).parquet(f"{path}/rows")
    met = rows.join(last, rows[by].eqNullSafe(last["batch"]) & (rows["run"] == F.concat(F.lit("run-"), last["last"])))
    return met.drop("run", "part", "batch", "last")


def envelopes(results: DataFrame) -> DataFrame:
    """``results(batch_id, asset_id, ...)`` as the nested records that are handed over: ``batch_id, asset_id, result`` with
    the checks, fields and catalog verdict as JSON by their names there."""
    checks = F.struct(F.col("format_allowed").alias("formatAllowed"), F.col("dimensions_valid").alias("dimensionsValid"), F.col("file_size_valid").alias("fileSizeValid"))
    verdict = F.struct(F.col("overall_status").alias("overallStatus"), F.col("matched_row").alias("matchedRowIndex"), F.col("match_strategy").alias("matchStrategy"))
    field = lambda _, v: F.struct(v["value"].alias("value"), v["block_id"].alias("sourceBlockId"), v["confidence"].alias("confidence"), v["status"].alias("status"))
    record = F.struct(checks.alias("technicalValidation"), F.transform_values("fields", field).alias("structuredFields"), verdict.alias("excelValidation"))
    return results.select("batch_id", "asset_id", F.to_json(record).alias("result"))
