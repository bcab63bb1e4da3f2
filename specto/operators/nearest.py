"""Exact nearest tools by clusters: those that a bound on the inner product rules out are passed over unread."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specto.operators.routing import matrix, top_k
from specto.operators.storage import cut
from specto.sources.python_path import importable

SLACK = 1e-6  # scores are rounded to six digits


@dataclass(frozen=True)
class Clusters:
    """Tools by cluster: rows (id, vector, cluster), and of each cluster the centre, how far its tools are from it at most, and how many it has."""

    rows: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray

    def highest(self, queries: np.ndarray) -> np.ndarray:
        """What the inner product of each query with a tool of each cluster can be at most: q.t = q.c + q.(t - c) <= q.c + |q| radius."""
        return queries @ self.centres.T + np.linalg.norm(queries, axis=1)[:, None] * self.radii


def centres_of(sample: np.ndarray, clusters: int, steps: int = 8) -> np.ndarray:
    """Centres by Lloyd's steps from the first vectors of the sample."""
    centres = sample[:clusters].copy()
    for _ in range(steps):
        own = nearest_centre(sample, centres)[0]
        for c in np.unique(own):
            centres[c] = sample[own == c].mean(0)
    return centres


def nearest_centre(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = ((centres**2).sum(1) - 2 * vectors @ centres.T).argmin(1)
    return own, np.linalg.norm(vectors - centres[own], axis=1)


def clustered(tools: DataFrame, clusters: int = 128, sample: int = 8_192) -> Clusters:
    """Deals every tool (id, vector) that has a vector to its nearest centre; the centres are fitted on at most `sample` tools, those with the smallest hash of their ids.

    The driver gets the sample, and two numbers of each cluster. Tools are written once to the shared folder, sorted by
    cluster within their partitions; nothing is shuffled, so a cluster that has most of the tools is no large group.
    """
    own = tools.where("vector is not null").select("id", F.col("vector").cast("array<double>").alias("vector"))
    given = own.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(sample).select("vector").toArrow()["vector"].combine_chunks()
    if not len(given):
        return Clusters(own.withColumn("cluster", F.lit(0)), np.zeros((0, 0)), np.zeros(0), np.zeros(0, np.int64))
    centres = centres_of(matrix(given), clusters)
    shared = tools.sparkSession.sparkContext.broadcast(centres)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, off = nearest_centre(matrix(batch.column(1)), shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster, pa.int32()), pa.array(off)], ["id", "vector", "cluster", "off"])

    importable(tools.sparkSession)
    rows = cut(own.mapInArrow(deal, f"id {dict(tools.dtypes)['id']}, vector array<double>, cluster int, off double").sortWithinPartitions("cluster"))
    radii, sizes = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for c, off, n in rows.groupBy("cluster").agg(F.max("off"), F.count("*")).collect():
        radii[c], sizes[c] = off + 1e-9, n
    return Clusters(rows.drop("off"), centres, radii, sizes)


def scored(index: Clusters, ids: pa.Array, queries: np.ndarray, asked: np.ndarray, n: int, id_type: str) -> DataFrame:
    """query_id, tool_id, score of the tools in the clusters that are asked (query by cluster): of each batch the n best a query, and what ties with them."""
    shared = index.rows.sparkSession.sparkContext.broadcast((ids, queries, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, wanted = shared.value
        for batch in batches:
            cluster, vectors = batch.column(2).to_numpy(), matrix(batch.column(1)) if batch.num_rows else None
            for c in np.unique(cluster):
                own, who = np.flatnonzero(cluster == c), np.flatnonzero(wanted[:, c])
                scores = vectors[own] @ q[who].T
                least = np.partition(scores, len(own) - n, axis=0)[len(own) - n] - SLACK if len(own) > n else -np.inf
                at, query = np.nonzero(scores >= least)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(who[query])), batch.column(0).take(pa.array(own[at])), pa.array(scores[at, query])], ["query_id", "tool_id", "score"])

    some = [int(c) for c in np.flatnonzero(asked.any(0))]
    return index.rows.where(F.col("cluster").isin(some)).mapInArrow(run, f"query_id {id_type}, tool_id {dict(index.rows.dtypes)['id']}, score double").withColumn("score", F.round("score", 6))


def bounded_top_k(queries: DataFrame, tools: DataFrame, k: int, index: Clusters | None = None, few: int = 2_000) -> tuple[DataFrame, float]:
    """The same rows as routing.top_k(queries, tools, k), and the share of the pairs of a query and a tool that were never scored.

    Each query is first held against the clusters with the highest products with their centres, as many as have k tools.
    The k-th score so found is one that every other cluster must be able to reach: those whose bound stays below it are
    ruled out, exactly. `index` is what clustered() gives of the tools, to be used again and again.

    Queries (id, vector), of different ids, are a stated set of up to `few`, by their count; more go the way of top_k(),
    with a share of 0. Null vectors have no rows, on both sides; ties go to the smaller id; no tools give no rows. How
    much can be passed over depends on the data: vectors without any grouping have bounds that rule nothing out.
    """
    if queries.limit(few + 1).count() > few:
        return top_k(queries, tools, k, few=few), 0.0
    index = index or clustered(tools)
    kind = dict(queries.dtypes)["id"]
    given = queries.where("vector is not null").select("id", F.col("vector").cast("array<double>").alias("vector")).toArrow().combine_chunks()
    if not given.num_rows or not len(index.sizes):
        return top_k(queries, tools, k, few=few), 0.0
    ids, q = given["id"].combine_chunks(), matrix(given["vector"].combine_chunks())
    order = np.argsort(-(q @ index.centres.T), axis=1, kind="stable")
    held = np.cumsum(index.sizes[order], axis=1) - index.sizes[order]  # tools in the clusters before
    first = np.zeros(order.shape, bool)
    np.put_along_axis(first, order, held < k, axis=1)
    found = cut(scored(index, ids, q, first, k, kind))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "tool_id"))
    kth = dict(found.withColumn("rank", rank).where(F.col("rank") == k).select("query_id", "score").collect())
    least = np.array([kth.get(i, -np.inf) for i in ids.to_pylist()])
    more = (index.highest(q) >= (least - SLACK)[:, None]) & ~first & (index.sizes > 0)
    if more.any():
        found = found.unionByName(scored(index, ids, q, more, k, kind))
    read = float(((first | more) * index.sizes).sum())
    return found.withColumn("rank", rank).where(F.col("rank") <= k), 1 - read / float(len(q) * index.sizes.sum())
