"""The request statistics over a stream of log files; complete results equal those of a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from specto.operators.stats import session_stats


def read_log(spark: SparkSession, path: str, schema: StructType, files_a_turn: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_turn).parquet(path)


def stream_stats(log: DataFrame, server: str, raw: Column, compressed: Column, name: str, checkpoint: str) -> StreamingQuery:
    """Keeps the totals of each server in the memory table `name` on the driver, for few servers, and ends when all files at hand are read."""
    totals = session_stats(log, server, raw, compressed)
    return totals.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_stats_to(log: DataFrame, server: str, raw: Column, compressed: Column, path: str, checkpoint: str) -> StreamingQuery:
    """The same for any number of servers: each turn, the executors replace the Parquet files at `path` by the totals so far."""
    totals = session_stats(log, server, raw, compressed)
    return totals.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
