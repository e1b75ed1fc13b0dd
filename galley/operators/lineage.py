"""Tables written between the rounds of an iteration."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, which all executors share.  Only a session on one machine that
    names no such folder gets one of its own."""
    folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder}/{name}-{uuid.uuid4()}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: a plan never holds more than one round, and a lost executor costs no
    recomputation of earlier ones."""
    spark = df.sparkSession
    path = shared_path(spark, "round")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
