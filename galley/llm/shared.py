"""Helpers that several operators use: lineage cuts, connected components, hashing of words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pointers of a round of connected components are broadcast up to this number of nodes.
BROADCAST_NODES = 150_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where a session on one machine names none (tests).

    On a cluster a session without ``spark.checkpoint.dir`` is refused: executors cannot see the driver's own folders.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not named and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, as compressed Parquet in the shared folder: for larger tables that are read more than once."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row.

    An expression inside a lambda is computed again for every element, and the optimizer may move a column's expression
    there; a lambda's own variable is not.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(src, dst)`` of any orderable type -> ``(node, component)``, component = least node of it.

    Each round every node hooks onto its least neighbour, pointers are shortened twice and the edges are contracted to
    what they point at.  In even rounds "least" is by the nodes themselves, which settles stars and ordered paths at
    once; in odd rounds by a fresh hash, under which at least half of the nodes are expected to hook whatever the ids,
    so the rounds are logarithmic in the nodes.  All steps are joins and aggregations with partial sums, so a node with
    very many edges is no bottleneck.  Every round is written and read again: a plan never holds more than one round.
    Pointers are broadcast once they are counted and few, else joined by a shuffle.  Null ends and loops are ignored;
    an empty input gives an empty result.
    """
    both = edges.select("src", "dst").where("src <> dst")
    e = stored(both.union(both.select("dst", "src")).distinct())
    labels: DataFrame | None = None
    turn = 0
    while not e.isEmpty():
        order = (lambda c: F.struct(F.lit(0), F.col(c))) if turn % 2 == 0 else (lambda c, t=turn: F.struct(F.xxhash64(c, F.lit(t)), F.col(c)))
        nearest = e.groupBy("src").agg(F.min_by("dst", order("dst")).alias("dst"))
        parent = stored(nearest.select(F.col("src").alias("node"), F.when(order("dst") < order("src"), F.col("dst")).otherwise(F.col("src")).alias("root")))
        few = parent.count() <= BROADCAST_NODES
        sent = F.broadcast if few else (lambda df: df)
        for _ in range(2):
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            parent = parent.join(sent(up), "root").select("node", F.col("above").alias("root"))
        parent = stored(parent)
        if labels is None:
            labels = parent.select("node", F.col("root").alias("component"))
        else:
            step = parent.select(F.col("node").alias("component"), "root")
            labels = stored(labels.join(sent(step), "component", "left").select("node", F.coalesce("root", "component").alias("component")))
        src = parent.select(F.col("node").alias("src"), F.col("root").alias("a"))
        dst = parent.select(F.col("node").alias("dst"), F.col("root").alias("b"))
        e = stored(e.join(sent(src), "src").join(sent(dst), "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
        turn += 1
    if labels is None:
        return e.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    if turn < 2:  # hooked by the nodes themselves only: every root is its least node
        return labels
    # a root is any node of its component: the least one names it
    least = labels.groupBy("component").agg(F.min("node").alias("least"))
    return stored(labels.join(least, "component").select("node", F.col("least").alias("component")))
