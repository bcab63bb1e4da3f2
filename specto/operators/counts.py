"""Exact token counts by a dictionary: each different pre-token of a table is encoded once, by the ranks of a vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specto.operators.storage import cut
from specto.sources.python_path import importable

COMMON = 50_000  # pre-tokens that are sent to all tasks, the most frequent ones
SHORT = 64  # bytes of one of them at most, so that they stay under a few MB


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def parts(word: bytes, ranks: dict[bytes, int]) -> int:
    """Into how many tokens a pre-token falls: of adjacent parts those with the lowest rank are joined, the leftmost first, until none has a rank.

    A heap holds the pairs, so a pre-token of a million bytes takes no longer for each byte than a short one but for a logarithm.
    """
    n = left = len(word)
    if n < 2 or word in ranks:
        return min(n, 1)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts here; an end of 0: joined to another
    pairs = [(rank, i) for i in range(n - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
    heapify(pairs)
    while pairs:
        rank, i = heappop(pairs)
        j = end[i]
        if not j or j == n or ranks.get(word[i : end[j]]) != rank:
            continue  # one of the two has been joined since
        end[i], end[j] = end[j], 0
        left -= 1
        if end[i] < n:
            before[end[i]] = i
        for at in (i, before[i]):
            if at >= 0 and end[at] < n and (rank := ranks.get(word[at : end[end[at]]])) is not None:
                heappush(pairs, (rank, at))
    return left


def count_tokens(texts: DataFrame, ranks: dict[bytes, int], pattern: str, common: int = COMMON) -> DataFrame:
    """id, tokens of every row of texts (id, text), by ranks and a pre-token pattern that every character of a text falls under.

    The JVM cuts texts and counts the different pre-tokens; each of those is encoded once. The most frequent ones are sent
    to all tasks, by number and length, so what they are worth is added up within the row of a text, and no word that is in
    every text becomes a hot key. Of a text only the rarer pre-tokens are shuffled to meet their counts.

    A null text counts as empty: 0 tokens. Rows that repeat an id, with the same text or another, are counted each by
    themselves; a null id is one like others. Texts may have any length, an empty table gives no rows. White space and
    letters are those of Unicode as the JVM knows it.
    """
    shared = texts.sparkSession.sparkContext.broadcast(ranks)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            n = pa.array([parts(w.encode(), own) for w in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, n], ["word", "n", "parts"])

    importable(texts.sparkSession)
    found_words = F.regexp_extract_all("text", F.lit(f"(?U){pattern}"), F.lit(0))
    own = texts.select("id", F.coalesce("text", F.lit("")).alias("text"))
    known = cut(own.select(F.explode(found_words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).mapInArrow(encode, "word string, n long, parts long"))
    frequent = known.where(F.octet_length("word") <= SHORT).orderBy(F.desc("n"), "word").limit(common).select("word", "parts")
    common_words = [(r.word, r.parts) for r in frequent.collect()]  # at most `common` of SHORT bytes
    told = texts.sparkSession.sparkContext.broadcast((pa.array([w for w, _ in common_words], pa.string()), np.array([n for _, n in common_words] + [0], np.int64)))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, worth = told.value
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):  # a few texts at a time, as each word takes some numbers
            lists = batch.column(1)
            ends, found = lists.offsets.to_numpy(), lists.values
            ends, found = ends - ends[0], found.slice(ends[0], ends[-1] - ends[0])
            at = pc.index_in(found, value_set=dictionary.cast(found.type)).fill_null(-1).to_numpy(zero_copy_only=False)
            sums = np.concatenate([[0], np.cumsum(worth[at])])[ends]
            other = np.concatenate([[0], np.cumsum(at < 0)])[ends]
            rare = pa.ListArray.from_arrays(pa.array(other, pa.int32()), found.filter(pa.array(at < 0)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(sums)), rare], ["id", "parts", "rare"])

    kind = texts.schema["id"].dataType.simpleString()
    per_row = own.select("id", found_words.alias("words")).mapInArrow(add_up, f"id {kind}, parts long, rare array<string>")
    sums = cut(per_row.withColumn("row", F.monotonically_increasing_id()))  # written with the number that its rarer words carry
    rest = sums.select("row", F.explode("rare").alias("word")).join(known.select("word", F.col("parts").alias("more")), "word")
    rest = rest.groupBy("row").agg(F.sum("more").alias("more"))
    return sums.select("row", "id", "parts").join(rest, "row", "left").select("id", (F.col("parts") + F.coalesce("more", F.lit(0))).alias("tokens"))
