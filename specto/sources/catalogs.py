"""Tool catalogs and source trees as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPED = ["__pycache__", ".git", "venv", ".venv", "node_modules"]


def tools_of(text: Column) -> Column:
    """An array of (server, tool as JSON) of a catalog: a list of tools, {"tools": [...]}, or lists by server."""
    lists = F.from_json(text, "map<string,string>")
    entry = "array<string>"
    bare = F.transform(F.from_json(text, entry), lambda t: F.struct(F.lit("").alias("server"), t.alias("tool")))
    named = F.transform(F.from_json(F.get_json_object(text, "$.tools"), entry), lambda t: F.struct(F.lit("").alias("server"), t.alias("tool")))
    by_server = F.flatten(F.transform(F.map_entries(lists), lambda e: F.transform(F.coalesce(F.when(F.ltrim(e["value"]).startswith("["), F.from_json(e["value"], entry)), F.array().cast(entry)), lambda t: F.struct(e["key"].alias("server"), t.alias("tool")))))
    return F.when(F.ltrim(text).startswith("["), bare).when(F.ltrim(F.get_json_object(text, "$.tools")).startswith("["), named).otherwise(by_server)


def catalog(texts: DataFrame) -> DataFrame:
    """server, ord, name, description, input_schema, defs of every tool of the catalogs (text, and path if they are files); lists that are none are passed over.

    `ord` is text that sorts by path (for texts without one, by a hash of them) and then by position, whatever the partitions are.
    """
    path = F.col("path") if "path" in texts.columns else F.hex(F.xxhash64("text"))
    rows = texts.select(path.alias("path"), F.get_json_object("text", "$.$defs").alias("defs"), F.posexplode(tools_of(F.col("text"))).alias("pos", "t"))
    get = lambda key: F.get_json_object("t.tool", f"$.{key}")
    return rows.select(F.col("t.server").alias("server"), F.concat_ws("#", "path", F.lpad(F.col("pos").cast("string"), 10, "0")).alias("ord"), F.coalesce(get("name"), F.lit("")).alias("name"), F.coalesce(get("description"), F.lit("")).alias("description"), F.coalesce(get("inputSchema"), F.lit("{}")).alias("input_schema"), "defs")


def read_catalogs(spark: SparkSession, path: str) -> DataFrame:
    return catalog(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def read_sources(spark: SparkSession, root: str, max_depth: int = 3, strict: bool = True) -> DataFrame:
    """file (below root), text, error of source files less than `max_depth` folders deep, without folders that hold no own code."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{py,js,jsx,mjs,cjs,ts,tsx}").load(root)
    base = root.rstrip("/").rpartition("/")[2]
    rel = F.regexp_extract("path", rf"/\Q{base}\E/(.*)$", 1)
    parts = F.split(rel, "/")
    kept = found.withColumn("file", rel).where((F.size(parts) <= max_depth) & ~F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED))))
    raw = F.col("content").cast("string")
    text = F.make_valid_utf8(raw)
    broken = F.lit(strict) & ~F.is_valid_utf8(raw)
    return kept.select("file", F.when(~broken, text).alias("text"), F.when(broken, "not UTF-8").alias("error"))
