from galley.operators.batch import batch_findings
from galley.sources.fixtures import fixture
from galley.streaming import status

DATA = "/root/testdata/sf0.001"


def test_streams_agree_with_the_batch(spark, tmp_path):
    items = fixture(spark, DATA, "fx_items")
    path = str(tmp_path / "items")
    items.repartition(3).write.parquet(path)
    stream = spark.readStream.schema(items.schema).parquet(path)
    done = status.findings_per_hour(stream, "10000 days").writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    done.awaitTermination()
    got = {tuple(r) for r in spark.table("hours").collect()}
    assert got == {tuple(r) for r in status.findings_per_hour(items, None).collect()} and got
    totals = spark.table("hours").groupBy("key").sum("n").collect()
    assert {r[0]: r[1] for r in totals} == {r["key"]: r.n for r in batch_findings(items).collect()}


def test_latest_state_wins(spark, tmp_path):
    events = spark.createDataFrame([(1, 7, "subiendo", 5, "2024-01-01 00:00:00"), (1, 7, "listo", 100, "2024-01-01 02:00:00"), (1, 7, "error", 9, "2024-01-01 01:00:00"), (1, 8, "pendiente", 0, "2024-01-01 00:00:00")], "batch_id long, item_id long, state string, progress_percent int, ts string").selectExpr("*", "cast(ts as timestamp) t").drop("ts").withColumnRenamed("t", "ts")
    path = str(tmp_path / "events")
    events.write.parquet(path)
    stream = status.latest_states(spark.readStream.schema(events.schema).parquet(path))
    stream.writeStream.outputMode("complete").format("memory").queryName("states").trigger(availableNow=True).start().awaitTermination()
    summary = status.status_summary(spark.table("states")).first()
    assert (summary.total, summary.completadas, summary.pendientes, summary.con_error) == (2, 1, 1, 0)
