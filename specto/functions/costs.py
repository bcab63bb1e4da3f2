"""Token, percentage and cost expressions. Amounts are whole numbers of 1e-8 dollars until one last division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dollars for a million tokens (input, cache write, cache read; the second model's input and output) and its output tokens.
INPUT, CACHE_WRITE, CACHE_READ = 3.00, 3.75, 0.30
MODEL_INPUT, MODEL_OUTPUT, OUTPUT_TOKENS = 1.00, 5.00, 500


def reduction_pct(before: Column, after: Column) -> Column:
    """Percent saved, to one digit; 0 where there was nothing."""
    return F.when(before != 0, F.round((1 - after / before) * 100, 1)).otherwise(F.lit(0.0))


def whole_pct(before: Column, after: Column) -> Column:
    return F.when(before != 0, F.bround((1 - after / before) * 100, 0)).otherwise(F.lit(0.0)).cast("long")


def saved(raw: Column, compressed: Column) -> Column:
    """Tokens saved, never below 0."""
    return F.greatest(F.lit(0), raw - compressed)


def input_cost(tokens: Column) -> Column:
    return (tokens * 300).cast("double") / 1e8


def request_cost(before: Column, after: Column) -> dict[str, Column]:
    """Costs of a request by the second model before and after, the percentage and what the input side saves (it may be negative)."""
    output = int(OUTPUT_TOKENS * MODEL_OUTPUT * 100)
    return {
        "cost_before": (before * 100 + output).cast("double") / 1e8,
        "cost_after": (after * 100 + output).cast("double") / 1e8,
        "pct": F.when(before != 0, F.round((before - after) * 100.0 / before, 6)).otherwise(F.lit(0.0)),
        "savings": ((before - after) * 100).cast("double") / 1e8,
    }


def cache_estimate(tokens: Column, requests: Column) -> dict[str, Column]:
    """Costs of sending a prefix every time, and of writing it to a cache once and reading it after that."""
    plain = tokens * 300 * requests
    cached = tokens * 375 + tokens * 30 * F.greatest(F.lit(0), requests - 1)
    gain = F.greatest(F.lit(0), plain - cached)
    return {
        "cost_plain": plain.cast("double") / 1e8,
        "cost_cached": cached.cast("double") / 1e8,
        "saving": gain.cast("double") / 1e8,
        "saving_pct": F.when(plain > 0, F.round(gain * 100.0 / plain, 1)).otherwise(F.lit(0.0)),
    }


def risk_level(n: Column) -> Column:
    return F.when(n > 5, "HIGH").when(n > 2, "MEDIUM").otherwise("LOW")


def role(internal: Column, other: Column) -> Column:
    """By how many internal and other dependencies a function has; one internal call alone is still pure."""
    return F.when(internal >= 2, "ORCH").when(other > 0, "TOOL").otherwise("PURE")
