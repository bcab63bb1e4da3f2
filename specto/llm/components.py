"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _lowest(edges: DataFrame) -> DataFrame:
    """u, v, m with m the smallest of u and its neighbours; a hub is added up before the shuffle and its join can be split."""
    # the hash is one key more than the groups have: the join deals its sides anew, and adaptive execution can split a hub
    low = edges.groupBy("u").agg(F.min("v").alias("low")).withColumn("k", F.xxhash64("u"))
    return edges.withColumn("k", F.xxhash64("u")).join(low, ["u", "k"]).select("u", "v", F.least("u", "low").alias("m"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component for every node of links (a, b): the smallest node that it is connected to.

    Each round moves neighbours to the smallest node in reach (Kiveris et al., "Connected Components in MapReduce and
    Beyond", 2014); the number of edges never grows and rounds grow with the logarithm of the size. Nothing but two
    numbers of the edge list comes to the driver. No links give no rows.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _lowest(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").distinct())
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
