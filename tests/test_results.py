"""The sink of results: whole runs or nothing, the same run once, the last run of a batch."""

import pytest
from pyspark.sql import functions as F

from galley.plans.compliance import envelopes, read_results, write_results
from galley.sources.ingest import read_response_json


def seen(spark, path):
    return sorted((r.batch_id, r.asset_id) for r in read_results(spark, path).collect())


def test_runs_are_whole_and_happen_once(spark, tmp_path):
    path = str(tmp_path / "out")
    frame = lambda rows: spark.createDataFrame(rows, "batch_id string, asset_id int")
    with pytest.raises(FileNotFoundError):
        read_results(spark, path)
    assert not write_results(frame([]), path, "none")
    assert write_results(frame([("001", 10), ("1", 20), ("1", 21)]), path, "a")
    assert seen(spark, path) == [("001", 10), ("1", 20), ("1", 21)]
    # a job that dies halfway: some tasks have written, nothing of it is seen
    dies = frame([("1", 30), ("2", 31), ("3", 32)]).repartition(3, "batch_id").withColumn("asset_id", F.when(F.col("batch_id") == "3", F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("asset_id")))
    with pytest.raises(Exception, match="lost"):
        write_results(dies, path, "b")
    assert seen(spark, path) == [("001", 10), ("1", 20), ("1", 21)]
    # its next attempt replaces what was staged; a third does nothing
    assert write_results(frame([("1", 40), ("2", 41)]), path, "b")
    assert not write_results(frame([("1", 50)]), path, "b")
    assert seen(spark, path) == [("001", 10), ("1", 40), ("2", 41)]
    assert write_results(frame([("001", 60)]), path, "0-c")
    assert seen(spark, path) == [("001", 60), ("1", 40), ("2", 41)]


def test_rows_staged_but_never_finished_are_not_seen(spark, tmp_path):
    path = str(tmp_path / "out")
    frame = spark.createDataFrame([(1, 10), (None, 11)], "batch_id int, asset_id int")
    assert write_results(frame, path, "a")
    frame.withColumn("asset_id", F.lit(99)).withColumn("part", F.col("batch_id").cast("string")).write.partitionBy("part").parquet(f"{path}/rows/run=run-b")
    assert sorted(r.asset_id for r in read_results(spark, path).collect()) == [10, 11]


def test_reserved_names(spark, tmp_path):
    with pytest.raises(ValueError):
        write_results(spark.createDataFrame([(1, 1)], "batch_id int, run int"), str(tmp_path), "a")
    with pytest.raises(ValueError):
        write_results(spark.createDataFrame([(1,)], "batch_id int"), str(tmp_path), "a/b")


def test_records_are_read_back_as_they_were(spark, tmp_path):
    schema = "batch_id int, asset_id long, format_allowed boolean, dimensions_valid boolean, file_size_valid boolean, overall_status string, matched_row int, match_strategy string, fields map<string,struct<value:string,block_id:string,confidence:double,status:string>>"
    fields = {"brand": ("Ñandú \"x\"\n", "b1", 0.75, "detected"), "sku": (None, None, None, "not_detected")}
    rows = [(1, 7, True, False, None, "match", 3, "sku", fields), (1, 8, None, None, None, None, None, None, None)]
    path = str(tmp_path / "out")
    assert write_results(envelopes(spark.createDataFrame(rows, schema)), path, "a")
    got = {r.asset_id: r for r in read_response_json(read_results(spark, path), "result").collect()}
    assert {k: tuple(v) for k, v in got[7].fields.items()} == fields and got[7].overall_status == "match"
    assert got[8].fields is None and got[8].overall_status == "not_executed" and not got[8].corrupt
