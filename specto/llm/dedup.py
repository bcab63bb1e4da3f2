"""Exact deduplication by progressive refinement: length, then a hash of the prefix, then a hash of the whole text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import key_filter, passes, rows_without
from .common import ascii_lower, cut, semi_by_key

def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[Column] = (), prefix_chars: int = 128, digest: bool = False, max_bits: int = 1 << 28) -> DataFrame:
    """One row per input row: doc_id, the columns of `carry`, keep_id, group_size, kept, and with `digest` text_sha256 of every row.

    Texts are equal when identical after lower-casing A-Z; of equal texts the row with the largest id stays. Only rows
    whose length occurs twice get a prefix hash, and only rows whose length and prefix hash occur twice are hashed whole
    (SHA-256, taken as identity), at any size. Which rows those are is told at the scan by a bitmap of the groups that
    survive, of at most `max_bits` (32 MB, broadcast); a row that it lets through by chance has its text hashed in vain and
    finds no partner. So texts never enter a shuffle; ids, lengths and hashes do. With `digest`, every text is hashed whole
    once, as its digest is asked for, and that hash is used. A hot group is one row after map-side aggregation, and its
    rows meet that row in a join that adaptive execution can split.

    A null text counts as empty, and a text of any length is hashed whole. Rows that repeat an id and text count in
    group_size and are all kept if their id stays. Null ids lose to any id; a group of null ids alone keeps its rows.
    Columns of docs don't clash with those made here; carried ones must not have the names of the result. An empty table
    gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.struct(*carry).alias("carried") if carry else F.lit(None).alias("carried"), text.alias("text"), F.octet_length(text).alias("len"))
    whole = F.sha2(ascii_lower(F.col("text")).cast("binary"), 256)
    prefix = F.xxhash64(ascii_lower(F.substring("text", 1, prefix_chars)))

    lengths = rows.groupBy("len").count().where("count > 1").select("len")
    groups = cut(semi_by_key(rows.select("len", prefix.alias("prefix")), lengths, ["len"]).groupBy("len", "prefix").count().where("count > 1"))
    key = F.xxhash64("len", "prefix")
    rows = passes(rows.withColumn("prefix", prefix), key, *key_filter(groups, key, max_bits))
    if digest:
        rows = rows.withColumn("text_sha256", whole)
        whole = F.col("text_sha256")
    rows = rows.withColumn("hash", F.when(F.col("__pass"), whole)).drop("text", "__pass")
    equal = rows.where("hash is not null").groupBy("len", "hash").agg(F.first("prefix").alias("prefix"), F.max("doc_id").alias("keep"), F.count("*").alias("size")).where("size > 1")
    # the prefix is one key more than the groups have: the join deals its sides anew, and adaptive execution can split a hot group
    out = rows.join(equal, ["len", "prefix", "hash"], "left")
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return out.select("doc_id", *(["carried.*"] if carry else []), keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), *(["text_sha256"] if digest else []))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns, whatever their names. Only ids and hashes of those that go are moved.

    Nulls, repeated rows and empty tables are as in exact_dedup(); a row goes by its id and text, so an id that stands at
    several texts loses only those that have a copy.
    """
    mark = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    gone = cut(exact_dedup(docs, carry=[mark.alias("mark")]).where("not kept").select(F.col("doc_id").alias("id"), "mark").distinct())
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), mark.alias("mark"))
    return rows_without(packed, gone, ["id", "mark"]).select("row.*")


def op2_exact_dedup(docs: DataFrame) -> DataFrame:
    return exact_dedup(docs, digest=True)


OP2_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
