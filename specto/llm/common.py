"""Small helpers that the corpus operators share."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Rows that a side may have to be broadcast; each row is a few dozen bytes, so a relation stays under about 30 MB.
BROADCAST_ROWS = 200_000
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, a null text as an empty one, so that no other column can clash or be carried."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; lower() does the same where all characters are ASCII, and faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver did, if it isn't installed there."""
    env, root = spark.sparkContext.environment, str(Path(__file__).parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow where `make` builds the per-batch function once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None:
                yield out

    importable(df.sparkSession)
    return df.mapInArrow(run, schema)


def semi_by_key(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of df whose key is in keys (distinct). Broadcasts the keys if they are few when counted; else a shuffled join."""
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(keys) if few else keys, on, "left_semi")


def join_by_key(df: DataFrame, side: DataFrame, on: list[str], rows: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join with the same check of the size of `side`, which has one row a key."""
    few = side.limit(rows + 1).count() <= rows
    return df.join(F.broadcast(side) if few else side, on)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder, else the one that spark.checkpoint.dir names.

    Only where the master is local, as in tests, a folder of this machine will do; on a cluster without one this raises.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="specto-checkpoint-"))
    return sc.getCheckpointDir()


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Rows go to Python in batches of about `most` bytes, whatever their number.

    An executor holds each batch several times over, as buffers beside the JVM's heap and in its Python workers, which
    keep the memory that they had at their peak. Spark's own bounds are 10,000 rows and 64 MB. A plan is made when it is
    run, so the setting has to stay until a result is written. A smaller own setting stays as it is.
    """
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_KEY)) > most:
        spark.conf.set(BATCH_KEY, str(most))


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Has Spark delete the shuffle files of a query as soon as it ends, instead of when the driver's garbage is collected.

    For queries whose result is in a table or on the driver by then. Where a plan is run again all the same, Spark makes its
    shuffles anew. The session's own setting is put back.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it from there, so that a lost executor costs no recomputing; no shuffle files stay."""
    shared_folder(df.sparkSession)
    with tidy(df.sparkSession):
        return df.select("*").checkpoint()  # a plan keeps the setting that it was made under


def anti_by_key(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of df whose key isn't in keys (distinct), with the same check of the size of `keys`."""
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(keys) if few else keys, on, "left_anti")
