"""Live batch status from a stream of item events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.batch import item_findings

LATENESS = "2 hours"


def latest_states(events: DataFrame) -> DataFrame:
    """``batch_id, item_id, state, progress_percent, ts``: the last event of every item, in update mode.

    A retried item re-enters as pendiente simply by a later event.  Ties in time go to the greater event.
    """
    last = F.max_by(F.struct("state", "progress_percent", "ts"), F.struct("ts", "state"))
    return events.groupBy("batch_id", "item_id").agg(last.alias("last")).select("batch_id", "item_id", "last.*")


def recent_states(events: DataFrame, lateness: str = LATENESS, window: str = "1 day") -> DataFrame:
    """``latest_states`` within each ``window`` of ``ts``, for streams without end: the state of a window goes once the
    watermark has passed it, so what is held does not grow with the items ever seen."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    last = F.max_by(F.struct("state", "progress_percent", "ts"), F.struct("ts", "state"))
    return timed.groupBy(F.window("ts", window).alias("w"), "batch_id", "item_id").agg(last.alias("last")).select(F.col("w.start").alias("day"), "batch_id", "item_id", "last.*")


def status_summary(states: DataFrame) -> DataFrame:
    """Counts by state of every batch, from latest states (also inside foreachBatch)."""
    n = lambda *s: F.count_if(F.col("state").isin(*s))
    return states.groupBy("batch_id").agg(F.count("*").alias("total"), n("pendiente").alias("pendientes"), n("subiendo", "analizando").alias("en_proceso"), n("listo").alias("completadas"), n("error").alias("con_error"))


def findings_per_hour(items: DataFrame, lateness: str | None = LATENESS) -> DataFrame:
    """``hour, key, severity, n``: findings of finished items in tumbling hours of ``ts``.

    On a stream, ``lateness`` bounds the state: events later than that are dropped, as are repeats of an event within it
    (by ``event_id`` where there is one, so that a retried item's second result counts).  ``lateness=None`` is the batch form.
    """
    timed = items.withColumn("ts", F.col("ts").cast("timestamp"))
    if lateness:
        timed = timed.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"] if "event_id" in items.columns else ["item_id", "ts"])
    found = item_findings(timed)
    out = found.groupBy(F.window("ts", "1 hour").alias("w"), F.col("finding.key").alias("key"), F.col("finding.severity").alias("severity")).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("hour"), "key", "severity", "n")


def start_updates(stream: DataFrame, folder: str, available_now: bool = True) -> StreamingQuery:
    """Start a stream that keeps state, in update mode: the changed rows of each micro-batch go to ``folder``/updates.

    A micro-batch has a folder of its own, written whole or again: one that ran before the query was stopped, and runs
    once more after it, leaves the same rows.  ``folder``/checkpoint holds offsets and state, so that a later start goes
    on where this one ended.  Both must be where driver and executors see them.
    """

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/updates/micro_batch={batch}")

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(put)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_rows(stream: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """The rows of a stream started by ``start_updates`` as they are now: of each key those of its last micro-batch."""
    changed = stream.sparkSession.read.schema(f"{_ddl(stream)}, micro_batch long").parquet(f"{folder}/updates")
    rest = [c for c in stream.columns if c not in keys]
    last = F.max_by(F.struct(*rest), "micro_batch").alias("last")
    return changed.groupBy(*keys).agg(last).select(*keys, "last.*")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
