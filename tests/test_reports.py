"""What the reports' plans do: render each tool once, in all tasks, and keep the catalog out of the driver."""

import json

from pyspark.sql import functions as F

from specto.operators import reports, schemas


def test_tools_are_rendered_once_and_not_broadcast(spark):
    tools = spark.range(40).select((F.col("id") % 2).cast("string").alias("server"), F.col("id").alias("ord"), F.concat(F.lit("t"), F.col("id") % 30).alias("name"), F.lit("Does it.").alias("description"), F.lit('{"type": "object"}').alias("input_schema"))
    report = reports.catalog_report(reports.tool_costs(tools))
    assert sorted((r.server, r.tools, r.k) for r in report.collect()) == [(s, 20, k) for s in "01" for k in (1, 3, 5)]
    plan = reports.tool_costs(tools)._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "BroadcastHashJoin" not in plan


def test_short_rows_are_dealt_to_all_tasks(spark):
    tools = spark.range(400).coalesce(1).select(F.col("id").alias("ord"), F.concat(F.lit("t"), F.col("id")).alias("name"), F.lit("Does it.").alias("description"), F.lit('{"type": "object"}').alias("input_schema"))
    for made in (schemas.compressed_tools(tools), schemas.input_schemas(tools)):
        assert made.select(F.spark_partition_id().alias("p")).distinct().count() == 4 * spark.sparkContext.defaultParallelism


def test_tools_of_one_name_are_served_once_each(spark):
    rows = [(0, "t", "A.", '{"properties": {"a": {"type": "string"}}}'), (1, "t", "B.", '{"properties": {"b": {"type": "string"}}}')]
    found = schemas.served(spark.createDataFrame(rows, "ord int, name string, description string, input_schema string")).collect()
    assert sorted((r.description, list(json.loads(r.input_schema)["properties"])) for r in found) == [("B.", ["a"]), ("B.", ["b"])]
