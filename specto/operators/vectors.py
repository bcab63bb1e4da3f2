"""Vectors of texts without a model: hashed words and character grams, weighted by how rare they are, projected by random signs.

All of it is expressions and aggregates in the JVM. Texts that share rare words, or words that are spelt alike, get near
vectors; the width is fixed, so that routing by vectors takes them as it takes those of a model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specto.functions.text import distinct_words

WIDTH = 256
BITS = 64  # of one hash


def features(text: Column) -> Column:
    """The different features of a text: its words (w:), and the runs of three characters in each word between < and > (g:)."""
    words = distinct_words(text)
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w)), lambda i: F.concat(F.lit("g:"), F.substring(F.concat(F.lit("<"), w, F.lit(">")), i, F.lit(3))))
    return F.array_distinct(F.concat(F.transform(words, lambda w: F.concat(F.lit("w:"), w)), F.flatten(F.transform(words, runs))))


def weights(texts: DataFrame) -> DataFrame:
    """feature, df, idf over texts (id, text): in how many texts each feature is, and how much it says. A null text has none."""
    n = texts.agg(F.count("*").alias("__n"))
    found = texts.select(F.explode(features(F.col("text"))).alias("feature")).groupBy("feature").agg(F.count("*").alias("df"))
    return found.join(F.broadcast(n)).select("feature", "df", (F.log((1.0 + F.col("__n")) / (1.0 + F.col("df"))) + 1).alias("idf"))  # one row beside each


def vectors(texts: DataFrame, known: DataFrame, width: int = WIDTH) -> DataFrame:
    """id, vector of texts (id, text): the sum of the signs of each known feature, times its idf, of length 1; null where no feature is known.

    The signs are the bits of hashes of the feature. The features of a text are summed before and after the shuffle, so a
    long text is no large group; a feature that very many texts have is a key that adaptive execution splits.
    """
    own = texts.select("id", F.explode(features(F.col("text"))).alias("feature")).join(known.select("feature", "idf"), "feature")
    hashes = [F.xxhash64(F.lit(seed), "feature").alias(f"h{seed}") for seed in range(-(-width // BITS))]
    own = own.select("id", "idf", *hashes)
    sign = lambda i: F.lit(1) - 2 * F.shiftrightunsigned(F.col(f"h{i // BITS}"), i % BITS).bitwiseAND(F.lit(1))
    sums = own.groupBy("id").agg(*[F.sum(F.col("idf") * sign(i)).alias(f"v{i}") for i in range(width)])
    whole = sums.select("id", F.array(*[f"v{i}" for i in range(width)]).alias("v"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = whole.select("id", F.transform("v", lambda x: F.round(x / size, 9)).alias("vector"))
    return texts.select("id").distinct().join(unit, "id", "left")
