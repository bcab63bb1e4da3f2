"""Routing of queries to tools by vectors, with a threshold, and by keywords."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from specto.functions.text import distinct_words, plain_name, tool_text
from specto.operators import vectors
from specto.operators.storage import cut
from specto.sources.python_path import importable


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; the cosine, for unit vectors."""
    terms = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(terms, F.lit(0.0), lambda total, x: total + x)


def facing(tools: DataFrame, queries: DataFrame, few: int = 2_000, slices: int = 64) -> DataFrame:
    """Every tool beside every query of a stated set.

    Up to `few` queries are broadcast, by their count. More are cut into blocks of about `few`, and each block meets each
    of the slices of the tools in a cell of its own, so that no task holds more than one block and one slice's stream.
    """
    n = queries.count()
    if n <= few:
        return tools.join(F.broadcast(queries))
    blocks = -(-n // few)
    across = lambda width: F.explode(F.sequence(F.lit(0), F.lit(width - 1)))
    dealt = lambda width, key: F.pmod(F.xxhash64(key), F.lit(width)).cast("int")
    q = queries.withColumn("__block", dealt(blocks, "query_id")).withColumn("__slice", across(slices))
    t = tools.withColumn("__slice", dealt(slices, "tool_id")).withColumn("__block", across(blocks))
    return t.join(q, ["__block", "__slice"]).drop("__block", "__slice")


BLOCK, SLICE = 8_192, 8_192  # queries and tools that one task holds beside each other
TILE = 4_000_000  # scores that it makes at once


def best_of(scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Query and tool (places of rows and columns) of the n best scores of each query, and of what ties with them; scores are rounded later."""
    tools = scores.shape[1]
    if tools <= n:
        return tuple(x.ravel() for x in np.indices(scores.shape))
    least = scores.max(1) if n == 1 else np.partition(scores, tools - n, axis=1)[:, tools - n]
    return np.nonzero(scores >= least[:, None] - 1e-6)


def near_blocks(tools: DataFrame, queries: DataFrame, n: int, block: int = BLOCK, width: int = SLICE) -> DataFrame:
    """query_id, tool_id, score of any number of queries: each block of them meets each slice of the tools in one task, as a matrix product.

    Blocks and slices are so many that they hold `block` queries and `width` tools on average, so a task holds no more as
    tables grow. A query has its n best of each slice, and what ties with them. Nothing passes through the driver.
    """

    def dealt(df: DataFrame, parts: int, own: str, other: str, others: int) -> DataFrame:
        """Each row in a part by its hash, once for each of the other side's parts; under names of its own, as Spark mixes up the columns of one table that meets itself."""
        kept = df.where("vector is not null").select("id", F.col("vector").cast("array<double>").alias("vector"))
        part = F.pmod(F.xxhash64("id", "vector", F.lit(own)), F.lit(parts)).cast("int")
        return kept.select(part.alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other), F.col("id").alias(f"{own}_id"), F.col("vector").alias(f"{own}_vector"))

    def meet(tools: pa.Table, queries: pa.Table) -> pa.Table:
        found = [kinds.empty_table()]
        if tools.num_rows and queries.num_rows:
            (tool_ids, t), (query_ids, q) = ((x[f"{own}_id"].combine_chunks(), matrix(x[f"{own}_vector"].combine_chunks())) for x, own in ((tools, "slice"), (queries, "block")))
            step = max(1, TILE // len(t))
            for at in range(0, len(q), step):
                scores = q[at : at + step] @ t.T
                query, tool = best_of(scores, n)
                found.append(pa.table([query_ids.take(pa.array(query + at)), tool_ids.take(pa.array(tool)), pa.array(scores[query, tool])], schema=kinds))
        return pa.concat_tables(found)

    blocks, slices = (max(1, -(-df.count() // size)) for df, size in ((queries, block), (tools, width)))
    t = dealt(tools, slices, "slice", "block", blocks)
    q = dealt(queries, blocks, "block", "slice", slices)
    names = {"query_id": queries.schema["id"].dataType, "tool_id": tools.schema["id"].dataType, "score": DoubleType()}
    kinds = to_arrow_schema(StructType([StructField(k, v) for k, v in names.items()]))
    importable(tools.sparkSession)
    return t.groupBy("block", "slice").cogroup(q.groupBy("block", "slice")).applyInArrow(meet, ", ".join(f"{k} {v.simpleString()}" for k, v in names.items()))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def near_ones(tools: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """query_id, tool_id, score of few queries: each Arrow batch of tools is one matrix product, of which a task keeps the n best a query and what ties with them.

    The queries go to all tasks; their number has been counted. Null vectors are passed over.
    """
    named = queries.where("vector is not null").select("id", F.col("vector").cast("array<double>").alias("vector"))
    given = named.toArrow().combine_chunks()
    ids, q = given["id"].combine_chunks() if given.num_rows else None, np.array(given["vector"].to_pylist(), np.float64)
    shared = tools.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        for batch in batches:
            if ids is None or not batch.num_rows:
                continue
            scores = q @ matrix(batch.column(1)).T
            query, at = best_of(scores, n)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(query)), batch.column(0).take(pa.array(at)), pa.array(scores[query, at])], ["query_id", "tool_id", "score"])

    importable(tools.sparkSession)
    schema = f"query_id {dict(queries.dtypes)['id']}, tool_id {dict(tools.dtypes)['id']}, score double"
    return tools.where("vector is not null").select("id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, schema)


def top_k(queries: DataFrame, tools: DataFrame, k: int, itself: bool = True, few: int = 2_000) -> DataFrame:
    """The k tools nearest to each query (id, vector), without the one of its own id if not `itself`; ties go to the smaller id.

    A null vector, of a query or a tool, has no rows.

    Each task ranks its own before they are shuffled. More than `few` queries meet the tools in blocks, as near_blocks() deals them.
    """
    if queries.limit(few + 1).count() <= few:
        scored = near_ones(tools, queries, k + (not itself)).withColumn("score", F.round("score", 6))
    else:
        scored = near_blocks(tools, queries, k + (not itself)).withColumn("score", F.round("score", 6))
    scored = scored if itself else scored.where("query_id <> tool_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "tool_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def route(queries: DataFrame, tools: DataFrame, min_score: float) -> DataFrame:
    """The nearest tool of each query, or null below the threshold (which itself is enough)."""
    return above(top_k(queries, tools, 1), min_score)


def above(best: DataFrame, min_score: float) -> DataFrame:
    return best.select("query_id", F.when(F.col("score") >= min_score, F.col("tool_id")).alias("tool_id"), "score")


GRAM = 3  # characters of the longest grams


def grams_of(text: Column, sizes: tuple[int, ...] = tuple(range(1, GRAM + 1))) -> Column:
    """The different runs of so many characters in a text."""
    runs = [F.when(F.char_length(text) >= n, F.transform(F.sequence(F.lit(1), F.char_length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>")) for n in sizes]
    return F.array_distinct(F.concat(*runs))


def gram_index(tools: DataFrame) -> DataFrame:
    """gram, tool_id: the runs of one to GRAM characters of each tool's name and description."""
    blank = F.lit("")
    grams = F.array_union(grams_of(F.coalesce("name", blank)), grams_of(F.coalesce("description", blank)))
    return tools.select(F.explode(grams).alias("gram"), F.col("id").alias("tool_id"))


def rarest_grams(queries: DataFrame, index: DataFrame) -> DataFrame:
    """query_id, words, needles: of each query the words that may be in a tool, each as (n, gram), the rarest first.

    A word that is no longer than a gram is one itself; of a longer one, the gram that the fewest tools have stands for it.
    A word with a gram that no tool has is in none and is left out.
    """
    counts = index.groupBy("gram").agg(F.count("*").alias("n"))
    words = queries.select(F.explode("words").alias("word")).distinct()
    own = words.select("word", F.explode(F.when(F.char_length("word") <= GRAM, F.array("word")).otherwise(grams_of(F.col("word"), (GRAM,)))).alias("gram"))
    best = own.join(counts, "gram", "left").groupBy("word").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("needle")).where("needle.n > 0")
    found = queries.select("query_id", F.explode("words").alias("word")).join(best, "word").groupBy("query_id").agg(F.sort_array(F.collect_list("needle")).alias("needles"))
    empty = F.array().cast("array<struct<n:bigint,gram:string>>")
    return queries.join(found, "query_id", "left").select("query_id", "words", F.coalesce("needles", empty).alias("needles"))


def keyword_route(queries: DataFrame, tools: DataFrame, first: int = 16) -> DataFrame:
    """For each query (id, words) the tool (id, name, description) whose name or description holds most of its words; the smaller id on ties, null without tools.

    Candidates come from an inverted index of short runs of characters: the tools that have the rarest run of one of a
    query's `first` rarest words are scored whole. A tool that isn't among them lacks all those words, so a query is done
    when its best candidate has more words than are left; else four times as many words are looked up, in the end all. What
    equals the best of a query is always among its candidates. Ids may be of any type that sorts.
    """
    q = queries.select(F.col("id").alias("query_id"), "words")
    index = cut(gram_index(tools))
    open_ones = cut(rarest_grams(q, index))
    texts = tools.select(F.col("id").alias("tool_id"), "name", "description")
    hit = F.size(F.filter("words", lambda w: F.contains(F.coalesce("name", F.lit("")), w) | F.contains(F.coalesce("description", F.lit("")), w)))
    done, k = [], first
    while True:
        asked = open_ones.select("query_id", F.explode(F.array_distinct(F.transform(F.slice("needles", 1, k), lambda x: x["gram"]))).alias("gram"))
        met = asked.join(index, "gram").select("query_id", "tool_id").distinct()
        scored = met.join(texts, "tool_id").join(open_ones.select("query_id", "words"), "query_id").select("query_id", "tool_id", hit.alias("score"))
        # the best score of each query first, then the smallest id among those that have it: both are combined before the shuffle
        best = scored.groupBy("query_id", "score").agg(F.min("tool_id").alias("tool_id")).groupBy("query_id").agg(F.max_by("tool_id", "score").alias("tool_id"), F.max("score").alias("score"))
        left = F.size("needles") - k
        now = cut(open_ones.join(best, "query_id", "left").withColumn("sure", F.coalesce(F.col("score") > left, F.lit(False)) | (left <= 0)))
        done.append(now.where("sure").select("query_id", "tool_id", "score"))
        open_ones = now.where("not sure").select("query_id", "words", "needles")
        if open_ones.isEmpty():
            break
        k *= 4
    found = reduce(DataFrame.unionByName, done)
    # no word of the query is in any tool: all tools are equal then
    none = tools.agg(F.min("id").alias("__first")).withColumn("__zero", F.when(F.col("__first").isNotNull(), 0))
    some = F.col("score") > 0
    return found.join(F.broadcast(none)).select("query_id", F.when(some, F.col("tool_id")).otherwise(F.col("__first")).alias("tool_id"), F.when(some, F.col("score")).otherwise(F.col("__zero")).alias("score"))  # one row beside each


def route_with_fallback(queries: DataFrame, tools: DataFrame, min_score: float) -> DataFrame:
    """By vectors (queries: id, vector, words; tools: id, vector, name, description), and by keywords where those stay below the threshold or a query has no vector."""
    near = cut(route(queries, tools, min_score).where("tool_id is not null").select("query_id", "tool_id", F.lit(False).alias("fallback")))
    left = queries.join(near.select(F.col("query_id").alias("id")), "id", "left_anti")
    return near.unionByName(keyword_route(left, tools).select("query_id", "tool_id", F.lit(True).alias("fallback")))


def route_texts(queries: DataFrame, tools: DataFrame, min_score: float, width: int = vectors.WIDTH) -> DataFrame:
    """query_id, tool_id, fallback for queries (id, text) and tools (id, name, description), all from their texts.

    Vectors are made of the texts, weighted by the tools' own; where the nearest one stays below the threshold, or a query
    shares no feature with any tool, keywords decide.
    """
    own = tools.select("id", "name", "description", tool_text(F.col("name"), F.col("description")).alias("text"))
    known = cut(vectors.weights(own.select("id", "text")))
    of = lambda df: cut(vectors.vectors(df.select("id", "text"), known, width))
    q = queries.select("id", "text", distinct_words(F.col("text")).alias("words"))
    asked = of(q).join(q.select("id", "words"), "id")
    plain = own.select("id", plain_name(F.col("name")).alias("name"), F.lower("description").alias("description"))
    return route_with_fallback(asked, of(own).join(plain, "id"), min_score)
