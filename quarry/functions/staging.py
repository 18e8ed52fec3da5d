"""Cutting lineage in rounds of joins: checkpoints in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where none is set and the master is local, as in tests."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        there = context.getConf().get("spark.checkpoint.dir", None)
        if not there:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            there = "file://" + tempfile.mkdtemp(prefix="quarry-")
        context.setCheckpointDir(there)
    return context.getCheckpointDir().rstrip("/")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys in as many partitions as shuffles have (64 at least), whatever they weigh. Spark joins small partitions by their bytes in a shuffle;
    numbers that take a few bytes a row there take a hundred in a sort or hash table."""
    return df.repartition(max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def cut(df: DataFrame) -> DataFrame:
    """df computed and written to the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
