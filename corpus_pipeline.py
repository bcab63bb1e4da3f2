"""A corpus pipeline of five stages over `documents`; each stage takes what the one before kept.

Null ids and texts, repeated rows, ties and texts of any length are handled as the stages' operators say; an empty table
gives empty stages. Further columns of documents, whatever their names, come along to the last stage but one. Each stage
sets how many bytes the session hands to Python at once, as its result is planned when it is written; run() puts that back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from specto.llm import bpe, dedup, jaccard, langid, mixing
from specto.llm.common import BATCH_KEY, shared_folder, small_batches, table, tidy

#: The token budget of the mixture, as a share of the tokens that reach it.
TOKEN_SHARE = 0.75
#: Weights by source, lang or topic, as {"lang": {"en": 2, "fr": 1}}; None evens out the shares that the documents have.
TARGETS: mixing.Targets | None = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in none of the learned languages go; the others get the predicted one as their `lang`, which the mixture goes by.

    The classifier learns from a bounded sample of the labelled documents.
    """
    small_batches(spark)
    return langid.keep_identified(docs, langid.train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the one with the largest id stays."""
    small_batches(spark)
    return dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of documents linked by a similarity of 0.8 on five-word shingles, the one with the smallest id stays."""
    small_batches(spark)
    return jaccard.drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of TOKEN_SHARE of all tokens, with shares of sources, languages and topics as near the target as what there is allows.

    TARGETS, where given, are the weights; else the shares are evened out.
    """
    small_batches(spark)
    return mixing.sample_mixture(docs, TOKEN_SHARE, TARGETS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, their digest, and the proof that they decode."""
    small_batches(spark)
    return bpe.bpe_roundtrip(docs, keep_ids=True)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixture", mixture), ("tokens", tokens)]

#: SQL can express neither the classifier nor the encoder; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH_KEY)
    try:
        for i, (name, stage) in enumerate(STAGES):
            path = f"{folder}/{i}-{name}"
            with tidy(spark):
                stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(BATCH_KEY, before)
    return docs
