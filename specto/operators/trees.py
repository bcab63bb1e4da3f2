"""JSON trees as rows, walked in the JVM: the text is parsed once to VARIANT, and levels are expanded by expressions.

LEVELS levels of a tree are laid out within its row, by arrays of arrays, so that nothing is shuffled and no Python worker
starts; trees that go deeper send the nodes of their last level through the same expression again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specto.operators.storage import cut, spread

LEVELS = 4
MAP, LIST = "map<string,variant>", "array<variant>"


def member(node: Column, key: str) -> Column:
    """The value of a key of an object, as VARIANT; null where there is none."""
    return F.try_variant_get(node, f"$['{key}']", "variant")


def entries(node: Column) -> Column:
    """The key and value of each member of an object; empty for anything else."""
    return F.coalesce(F.map_entries(F.try_variant_get(node, "$", MAP)), F.array().cast(f"array<struct<key:string,value:variant>>"))


def elements(node: Column) -> Column:
    return F.coalesce(F.try_variant_get(node, "$", LIST), F.array().cast(LIST))


def kind(node: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, ... or VOID for a JSON null; null for null."""
    return F.regexp_extract(F.schema_of_variant(node), "^[A-Z]+", 0)


def is_object(node: Column) -> Column:
    return F.try_variant_get(node, "$", MAP).isNotNull()


def text(node: Column) -> Column:
    """A string as it is, anything else as JSON; numbers without trailing zeros. Null for null."""
    return F.when(node.isNotNull(), F.coalesce(F.try_variant_get(node, "$", "string"), F.lit("null")))


def holds(node: Column) -> Column:
    """Whether a value is there and isn't null, false, 0 or empty."""
    return F.coalesce(node.isNotNull() & ~text(node).isin("null", "false", "0", "", "{}", "[]"), F.lit(False))


def last_segment(node: Column) -> Column:
    return F.substring_index(text(node), "/", -1)


NODE = "array<struct<path:string,parent:string,depth:int,role:string,key:string,node:variant>>"


def child(parent: Column, role: str, name: Column, where: Column, node: Column) -> Column:
    return F.struct(F.concat(parent["path"], F.lit(f".{role}"), where).alias("path"), parent["path"].alias("parent"), (parent["depth"] + 1).alias("depth"), F.lit(role).alias("role"), name.alias("key"), node.alias("node"))


def under_keys(parent: Column, role: str) -> Column:
    """The objects in the object at a key, by their names."""
    return F.transform(entries(member(parent["node"], role)), lambda e: child(parent, role, e["key"], F.concat(F.lit("."), e["key"]), e["value"]))


def in_list(parent: Column, role: str) -> Column:
    """The objects in the list at a key, by their places."""
    return F.transform(elements(member(parent["node"], role)), lambda v, i: child(parent, role, F.lit(None).cast("string"), F.concat(F.lit("["), i.cast("string"), F.lit("]")), v))


def alone(parent: Column, role: str) -> Column:
    """The object at a key itself."""
    return F.array(child(parent, role, F.lit(None).cast("string"), F.lit(""), member(parent["node"], role)))


def levels(trees: DataFrame, root: Column, below: Callable[[Column], Column], deepest: int | None = None) -> list[DataFrame]:
    """The other columns of trees with `nodes`, an array of NODE: each object that `below` finds, from the root on.

    `below` gives the array of a node's children; those that are no objects are passed over. A null root has no nodes. The
    first table has a row for each tree; trees that go deeper have rows in further ones, for each node of a last level.
    `deepest` is how many levels the deepest tree has, the root's among them; where it isn't known, each table is walked
    once more to see whether its trees go on.
    """
    keys = trees.columns
    nodes = lambda level: F.filter(F.flatten(F.transform(level, below)), lambda n: is_object(n["node"]))
    start = F.struct(F.lit("$").alias("path"), F.lit("").alias("parent"), F.lit(0).alias("depth"), F.lit("root").alias("role"), F.lit(None).cast("string").alias("key"), root.alias("node"))
    first = F.when(is_object(root), F.array(start)).otherwise(F.array()).cast(NODE)
    rows = spread(trees).withColumn("__level0", first)
    found = []
    while True:
        own = LEVELS if deepest is None else max(1, min(LEVELS, deepest))
        for i in range(1, own + (deepest is None or deepest > LEVELS)):
            rows = rows.withColumn(f"__level{i}", nodes(F.col(f"__level{i - 1}")))
        found.append(rows.select(*keys, F.concat(*[f"__level{i}" for i in range(own)]).alias("nodes")))
        if deepest is not None:
            deepest -= LEVELS
        if (deepest <= 0) if deepest is not None else not rows.agg(F.bool_or(F.size(f"__level{LEVELS}") > 0)).first()[0]:
            return found
        deeper = rows.select(*keys, F.explode(f"__level{LEVELS}").alias("__node"))
        rows = cut(deeper).select(*keys, F.array("__node").alias("__level0"))


def expanded(trees: DataFrame, root: Column, below: Callable[[Column], Column]) -> DataFrame:
    """levels() as one table with a row for each node: the other columns of trees with path, parent, depth, role, key, node."""
    return reduce(DataFrame.unionByName, [laid_out(part, trees.columns, F.col("nodes")) for part in levels(trees, root, below)])


def laid_out(rows: DataFrame, keys: list, structs: Column) -> DataFrame:
    """The keys with the fields of each struct in an array.

    The outer form, whose rows for empty arrays go again: for the inner one, Spark would put a filter of the array's size
    before all that makes it, and so make it twice for each level.
    """
    out = rows.select(*keys, F.inline_outer(structs))
    return out.where(reduce(Column.__or__, [F.col(c).isNotNull() for c in out.columns[len(keys) :]]))
