"""Aggregates over request logs, catalogs and repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specto.functions import costs


def measures(raw: Column, compressed: Column) -> list[Column]:
    return [F.count("*").alias("requests"), F.sum(costs.saved(raw, compressed)).alias("saved"), F.sum(raw).alias("raw")]


def with_rates(totals: DataFrame) -> DataFrame:
    """Adds the percentage saved and its worth."""
    pct = F.when(F.col("raw") != 0, F.round(F.col("saved") * 100.0 / F.col("raw"), 1)).otherwise(F.lit(0.0))
    return totals.withColumn("pct", pct).withColumn("usd", costs.input_cost(F.col("saved")))


def session_stats(log: DataFrame, server: str, raw: Column, compressed: Column) -> DataFrame:
    """Requests, tokens saved and raw tokens of each server. Works on a stream as on a table."""
    return with_rates(log.groupBy(server).agg(*measures(raw, compressed)))


def session_totals(log: DataFrame, server: str, raw: Column, compressed: Column) -> DataFrame:
    """The same with a row for all servers, whose server is null."""
    return with_rates(log.rollup(server).agg(*measures(raw, compressed)))


def first_wins(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """One row a key: the value that came first. No window, so partial results are combined before the shuffle."""
    return rows.groupBy(key).agg(F.min_by(value, order).alias(value), F.min(order).alias(order))


def first_row(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def mark_last(rows: DataFrame, keys: list[str], order: str, name: str = "cache_control") -> DataFrame:
    """Marks the last row of each ordered list as the end of what may be cached.

    Without keys all rows are one list, whose last row is found by an aggregate, not by sorting them in one task; of rows
    with the same order the one with the largest hash is the last, and rows that are equal in all are marked alike.
    """
    if keys:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
        return rows.withColumn(name, F.when(rank == 1, F.lit("ephemeral")))
    place = F.struct(F.col(order).alias("at"), F.xxhash64(*rows.columns).alias("h"))
    last = rows.agg(F.max(place).alias("__last"))
    return rows.join(F.broadcast(last)).withColumn(name, F.when(place == F.col("__last"), F.lit("ephemeral"))).drop("__last")  # one row beside each


def prefix_costs(rows: DataFrame, key: str, cost: str, tie: str, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """For each k, what the k dearest rows of a key cost together, and their share of all."""
    order = Window.partitionBy(key).orderBy(F.desc(cost), tie)
    ranked = rows.select(key, cost, tie).withColumn("k", F.row_number().over(order)).where(F.col("k") <= max(ks))
    running = ranked.withColumn("total", F.sum(cost).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("k").isin(*ks))
    all_rows = rows.groupBy(key).agg(F.sum(cost).alias("__all"))
    return running.join(all_rows, key).select(key, "k", "total", F.when(F.col("__all") != 0, F.round(F.col("total") / F.col("__all"), 6)).otherwise(F.lit(0.0)).alias("share"))


def interface_diff(old: DataFrame, new: DataFrame, key: str, signature: str, body: str) -> DataFrame:
    """What became of each function between two versions."""
    a, b = old.select(key, F.col(signature).alias("s1"), F.col(body).alias("b1")), new.select(key, F.col(signature).alias("s2"), F.col(body).alias("b2"))
    change = (
        F.when(F.col("s1").isNull(), "added")
        .when(F.col("s2").isNull(), "removed")
        .when(F.col("s1") != F.col("s2"), "breaking")
        .when(F.col("b1") != F.col("b2"), "body_only")
        .otherwise("unchanged")
    )
    return a.join(b, key, "full_outer").select(key, change.alias("change"))
