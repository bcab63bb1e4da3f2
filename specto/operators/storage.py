"""Where intermediate tables go: a folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, else the one that spark.checkpoint.dir names; a folder of this machine will do only where the master is local."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="specto-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and goes on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame | None:
    """The Parquet files of a folder; None if there are none yet."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores at least, for work that costs far more than the shuffle of its rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def dealt(df: DataFrame) -> DataFrame:
    """df dealt to four tasks a core; by the bytes of short rows, adaptive execution would give all that comes from a shuffle to one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *df.columns)


def evenly(df: DataFrame) -> DataFrame:
    """df dealt row by row to four tasks a core, for work that costs far more than the shuffle of its rows.

    A file of short rows comes in few tasks whatever its rows cost, and its row groups fill only some of many; equal rows are dealt apart.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
