"""What a catalog costs in tokens: with all schemas loaded, with the short index, and with one schema on demand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specto.functions import costs
from specto.functions.tokens import Counter, pieces
from specto.operators import schemas
from specto.operators.storage import cut, dealt


def tool_costs(tools: DataFrame, count: Counter = pieces) -> DataFrame:
    """server, ord, name, raw, short, index: the tokens of each tool as it is listed, compressed, and in the index."""
    key = schemas.tool_key().alias("tool")
    # tools that are equal in name, description and schema have equal texts, so one of them is rendered
    texts = schemas.rendered(dealt(tools.select("name", "description", "input_schema").distinct()))
    # written once, as a report sums and ranks them; neither side is sent through the driver, whatever the size of its files
    counted = cut(texts.select("tool", *[count(F.col(c)).alias(c) for c in ("raw", "short", "index")]))
    return tools.select("server", "ord", "name", key).join(counted.hint("shuffle_merge"), "tool").drop("tool")


def token_totals(costed: DataFrame) -> DataFrame:
    """Tools and tokens of each server, raw and compressed, and a row for all of them (whose server is null)."""
    sums = costed.rollup("server").agg(F.count("*").alias("tools"), *[F.sum(c).alias(c) for c in ("raw", "short", "index")])
    return sums.withColumn("reduction_pct", costs.reduction_pct(F.col("raw"), F.col("index")))


def catalog_report(costed: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """server, tools, raw, index, k, tokens, reduction_pct: the index with the k dearest compressed tools of each server, for each k that it has tools for."""
    order = Window.partitionBy("server").orderBy(F.desc("short"), "ord")
    dearest = costed.withColumn("k", F.row_number().over(order)).where(F.col("k") <= max(ks))
    prefix = dearest.withColumn("prefix", F.sum("short").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("k").isin(*ks))
    sums = costed.groupBy("server").agg(F.count("*").alias("tools"), F.sum("raw").alias("raw"), F.sum("index").alias("index"))
    tokens = F.col("index") + F.col("prefix")
    return prefix.select("server", "k", "prefix").join(sums, "server").select("server", "tools", "raw", "index", "k", tokens.alias("tokens"), costs.reduction_pct(F.col("raw"), tokens).alias("reduction_pct"))


def query_comparison(routed: DataFrame, queries: DataFrame, costed: DataFrame, count: Counter = pieces) -> DataFrame:
    """For each query (id, text, server) and the tool that it was routed to (query_id, tool_id, the tool's `ord`): tokens and dollars without and with the index.

    Without, all schemas of the server are sent; with, its index and the one compressed schema, if there is one.
    """
    sums = costed.groupBy("server").agg(F.sum("raw").alias("all"), F.sum("index").alias("index"))
    own = queries.select(F.col("id").alias("query_id"), "server", count(F.col("text")).alias("query")).join(sums, "server").join(routed.select("query_id", "tool_id"), "query_id", "left")
    own = own.join(costed.select("server", F.col("ord").alias("tool_id"), "name", "short"), ["server", "tool_id"], "left")
    sent, kept = F.col("query") + F.col("all"), F.col("query") + F.col("index") + F.coalesce("short", F.lit(0))
    after = F.col("index") + F.coalesce("short", F.lit(0))
    return own.select("query_id", "name", sent.alias("tokens_without"), kept.alias("tokens_with"), costs.input_cost(sent).alias("usd_without"), costs.input_cost(kept).alias("usd_with"), costs.whole_pct(F.col("all"), after).alias("reduction_pct"), costs.input_cost(F.col("all") - after).alias("usd_saved"))


def as_json(df: DataFrame, name: str = "result") -> DataFrame:
    """Each row as JSON text, nulls too."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))
