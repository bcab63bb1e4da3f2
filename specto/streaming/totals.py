"""Totals of a stream that are kept in files and count each turn once, whatever is replayed.

A turn adds one folder with its own sums, so it costs what the turn holds and not what the totals hold; every so often the
sums so far become one folder. A line of the log, written last, makes a folder count: a turn that dies before leaves a
folder that nothing reads, and a turn that is replayed after its line is passed over.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from specto.operators.stats import measures, with_rates
from specto.operators.storage import stored

LOG = "turn long, whole boolean, folder string"


def turns(spark: SparkSession, path: str) -> list[Row]:
    """The lines of the log that count: the newest folder that holds all sums up to its turn, and those of the turns since, in order."""
    log = stored(spark, f"{path}/log", LOG)
    if log is None:
        return []
    base = log.agg(F.max(F.when(F.col("whole"), F.col("turn")))).first()[0]
    return log.where(F.col("turn") >= F.lit(-1 if base is None else base)).orderBy("turn").collect()


def summed(spark: SparkSession, path: str, lines: list[Row], keys: list[str]) -> DataFrame:
    parts = spark.read.parquet(*[f"{path}/sums/{x.folder}" for x in lines])
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in parts.columns if c not in keys])


def add_turn(sums: DataFrame, turn: int, path: str, keys: list[str], every: int = 50) -> bool:
    """Adds the sums of a turn (a row for each key) to the totals at `path`; False if this turn or a later one is in them already.

    Turns come in the order of their numbers and from one writer, as those of a stream do. Every `every` turns all sums
    are written as one folder, so that a reader opens few of them. All columns but the keys are added up; null keys are keys.
    """
    spark = sums.sparkSession
    lines = turns(spark, path)
    if lines and lines[-1].turn >= turn:
        return False
    folder = f"{turn}-{uuid.uuid4().hex}"
    whole = len(lines) >= every
    if whole:
        parts = summed(spark, path, lines, keys).unionByName(sums)
        sums = parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in parts.columns if c not in keys])
    sums.write.parquet(f"{path}/sums/{folder}")
    spark.createDataFrame([(turn, whole, folder)], LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")
    return True


def totals(spark: SparkSession, path: str, keys: list[str]) -> DataFrame | None:
    """The totals at `path`, from the folders that the log names when this is called; None before the first turn."""
    lines = turns(spark, path)
    return summed(spark, path, lines, keys) if lines else None


def keep_stats(log: DataFrame, server: str, raw: Column, compressed: Column, path: str, checkpoint: str, every: int = 50) -> StreamingQuery:
    """Adds what a stream of requests holds to the totals at `path`, turn by turn, and ends when all files at hand are read. The stream keeps no state."""
    add = lambda rows, turn: add_turn(rows.groupBy(server).agg(*measures(raw, compressed)), turn, path, [server], every)
    return log.writeStream.foreachBatch(lambda rows, turn: add(rows, turn) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_stats(spark: SparkSession, server: str, path: str) -> DataFrame | None:
    """What session_stats() gives of all requests that the totals at `path` hold."""
    found = totals(spark, path, [server])
    return None if found is None else with_rates(found)
