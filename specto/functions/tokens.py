"""Counters of tokens: expressions from a text column to a number. Any function of that kind can be given where tokens are counted."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Counter = Callable[[Column], Column]


def pieces(text: Column) -> Column:
    """Runs of letters, digits and underscores (ASCII), and single other characters but white space: a JVM-side estimate that needs no vocabulary."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]")).cast("long")


def vocabulary(path: str, pattern: str) -> Counter:
    """Tokens by a rank file (a base64 token and its rank a line) and its pre-token pattern, in Arrow batches; null counts as empty."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            yield batch.fillna("").map(lambda t: len(encode(t)))

    return count
