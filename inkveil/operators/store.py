"""Results that several steps read: computed once, kept where every executor finds them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of the session that the driver and all executors share (spark.checkpoint.dir).

    Where no folder is set, one is made, on a local master only."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="inkveil-"))
    return context._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """df, computed now and written to the shared folder: later steps read it and none computes it again, whatever
    executors are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """df in at least twice as many partitions as there are cores, for work that takes far longer than a
    shuffle of its input; a table of many partitions is left where it is."""
    wanted = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if not df.isStreaming and df.rdd.getNumPartitions() < wanted else df
