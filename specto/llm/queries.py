"""The registered queries of these operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, bpe, dedup, edits, html, jaccard, langid, license, mixing, packing, repair, substring, trie
from .common import table


def documents(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"))


def conversations(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(table(spark, sf_dir, "conversations"))


def pages(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": documents(lambda docs: langid.identify(docs, langid.train(docs))),
    "op2_exact_dedup": documents(dedup.op2_exact_dedup),
    "op3_audio_features": documents(audio.op3_audio_features),
    "op4_ngram_jaccard": documents(jaccard.op4_ngram_jaccard),
    "op5_token_counts": documents(edits.edited_counts),
    "op6_license_scan": documents(license.op6_license_scan),
    "op7_substring_dedup": documents(substring.op7_substring_dedup),
    "op8_bpe": documents(bpe.bpe_roundtrip),
    "op9_html_text": pages(html.op9_html_text),
    "op10_source_mixing": documents(mixing.op10_source_mixing),
    "op11_packing": documents(packing.op11_packing),
    "op12_conversation_trie": conversations(trie.op12_conversation_trie),
    "op13_conversation_repair": conversations(repair.op13_conversation_repair),
}

SQL: dict[str, str] = {"op2_exact_dedup": dedup.OP2_SQL, "op10_source_mixing": mixing.op10_sql()}
