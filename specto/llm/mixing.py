"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

DIMENSIONS = ("source", "lang", "topic")
NULL = "\u0000null"
#: How far the share of each value is evened out (1 keeps the shares, 0 makes all equal).
EVENNESS = {"source": 0.8, "lang": 0.9, "topic": 0.9}
CYCLES = 12
CYCLES_AT_ONCE = 4


def tokens_of(text: Column) -> Column:
    """Words between white space (ASCII)."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def topic_of(text: Column) -> Column:
    """A coarse topic by the kind of text: tables, shouting, code or secrets, numbers, licensed work, else prose."""
    return (
        F.when(text.isNull(), "none")
        .when(text.contains(" | "), "table")
        .when(text.contains("!! "), "loud")
        .when(text.contains("licensed under the") | text.contains("Licensed under the") | text.contains("Released under the"), "licensed")
        .when(text.contains("### ") | text.contains("$$$ "), "noisy")
        .otherwise("prose")
    )


def cell(name: str) -> Column:
    """A null value is a value of its own."""
    return F.coalesce(F.col(name).cast("string"), F.lit(NULL)).alias(f"__{name}")


Targets = dict[str, dict[str | None, float]]


def marginals(cells: DataFrame, targets: Targets | None = None) -> DataFrame:
    """Adds the target share of each cell's source, lang and topic.

    A dimension that `targets` gives weights for has those, scaled to sum to 1 over the values that have tokens; a value
    that they don't name gets none. Else the target is the value's share of all tokens to a power, scaled to sum to 1.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    for d in DIMENSIONS:
        own = cells.groupBy(f"__{d}").agg(F.sum("tokens").alias("t"))
        if given := (targets or {}).get(d):
            rows = [(NULL if k is None else k, float(v)) for k, v in given.items()]
            own = own.join(F.broadcast(cells.sparkSession.createDataFrame(rows, f"__{d} string, p double")), f"__{d}", "left")
            own = own.withColumn("p", F.when(F.col("t") > 0, F.coalesce("p", F.lit(0.0))).otherwise(F.lit(0.0)))
        else:
            own = own.withColumn("p", F.pow(F.col("t") / F.lit(float(total)), F.lit(EVENNESS[d])))
        sum_p = own.agg(F.sum("p")).first()[0] or 1.0
        cells = cells.join(own.select(f"__{d}", (F.col("p") / F.lit(sum_p)).alias(f"target_{d}")), f"__{d}")
    return cells


def deviation(cells: DataFrame) -> float:
    """How far the weights of any source, lang or topic are from its target at most."""
    parts = [cells.groupBy(f"__{d}").agg(F.abs(F.sum("w") - F.first(f"target_{d}")).alias("off")).select("off") for d in DIMENSIONS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(F.max("off")).first()[0] or 0.0


def rake(cells: DataFrame, cycles: int = CYCLES, targets: Targets | None = None, tolerance: float = 1e-12) -> DataFrame:
    """Scales the weights to each marginal in turn, `cycles` times over, or until no marginal is off by more than `tolerance`.

    Only cells move: one row for each source, lang and topic that occur together.
    """
    cells = cut(marginals(cut(cells), targets).withColumn("w", F.col("tokens").cast("double")))
    for done in range(1, cycles + 1):
        for d in DIMENSIONS:
            share = F.sum("w").over(Window.partitionBy(f"__{d}"))
            cells = cells.withColumn("w", F.when(share > 0, F.col("w") * F.col(f"target_{d}") / share).otherwise(F.lit(0.0)))
        if done % CYCLES_AT_ONCE == 0 or done == cycles:
            cells = cut(cells)
            if deviation(cells) <= tolerance:
                break
    return cells


def level(rows: DataFrame, x: str, cap: str, total: float) -> float:
    """The factor for which `x` times it, at most `cap`, sums to `total` over all rows (or to all caps, if those are less).

    From the factor that would do without caps, rows over their cap are set to it and the rest is given to the others,
    until no more are; only sums come to the driver.
    """
    factor, fixed = 0.0, -1
    while True:
        free = F.col(cap) > F.col(x) * factor if factor else F.lit(True)
        row = rows.where(F.col(x) > 0).agg(F.sum(F.when(free, F.col(x))), F.sum(F.when(~free, F.col(cap))), F.count_if(~free)).first()
        if row[2] == fixed or not row[0]:
            return factor if row[0] or row[2] else 0.0
        fixed, factor = row[2], (total - (row[1] or 0.0)) / row[0]


def capped(df: DataFrame, by: list[str], x: str, cap: str, total: Column) -> DataFrame:
    """Replaces `x` of each row by `x` times one factor a group, at most `cap`, so that a group sums to `total` (or all its caps, if those are less).

    If the rows from some cap / x on stay free, their factor is what the caps of the others leave of the total, over their
    x. It is greatest for the right number of free rows.
    """
    group = Window.partitionBy(*by)
    free = group.orderBy(F.when(F.col(x) > 0, F.col(cap) / F.col(x)).desc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.sum(x).over(free)
    factor = F.when(own > 0, (total - F.sum(cap).over(group) + F.sum(cap).over(free)) / own)
    df = df.withColumn("__factor", factor)
    most = F.max("__factor").over(group)
    return df.withColumn(x, F.coalesce(F.least(F.col(cap).cast("double"), F.col(x) * most), F.lit(0.0))).drop("__factor")


def fit_budget(cells: DataFrame, share: float, cycles: int = CYCLES) -> DataFrame:
    """Adds `x`, the tokens to take of each raked cell, which sum to `share` of all tokens; a cell gives no more than it has.

    A value of source, lang or topic that has fewer tokens than its target is asked for all of them, and the others for
    the rest in proportion to their targets. Cells are raked to that from their weights; within a value, what a whole
    cell lacks is asked of the others.
    """
    total = (cells.agg(F.sum("tokens")).first()[0] or 0) * share
    for d in DIMENSIONS:
        own = cells.groupBy(f"__{d}").agg(F.sum("tokens").alias("t"), F.first(f"target_{d}").alias("x"))
        factor = level(own, "x", "t", total)
        asked = F.when(F.col("x") > 0, F.least(F.col("t").cast("double"), F.col("x") * factor)).otherwise(F.lit(0.0))
        cells = cells.join(own.select(f"__{d}", asked.alias(f"asked_{d}")), f"__{d}")
    cells = cut(cells.withColumn("x", F.col("w")))
    for _ in range(cycles):
        for d in DIMENSIONS:
            cells = capped(cells, [f"__{d}"], "x", "tokens", F.col(f"asked_{d}"))
        cells = cut(cells)
    return cells


def shares_reached(docs: DataFrame, share: float, targets: Targets | None = None, topic: Column | None = None) -> DataFrame:
    """dimension, value (null for null), target, reached: the shares of tokens asked for and those that the probabilities give."""
    text = F.col("text")
    kind = topic_of(text) if topic is None else topic
    cells = docs.select(*map(cell, ("source", "lang")), F.coalesce(kind, F.lit(NULL)).alias("__topic"), tokens_of(text).cast("long").alias("tokens")).groupBy(*[f"__{d}" for d in DIMENSIONS]).agg(F.sum("tokens").alias("tokens"))
    cells = fit_budget(rake(cells, targets=targets), share)
    parts = [cells.groupBy(F.lit(d).alias("dimension"), F.col(f"__{d}").alias("value")).agg(F.first(f"target_{d}").alias("target"), F.sum("x").alias("x")) for d in DIMENSIONS]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    value = F.when(F.col("value") != NULL, F.col("value"))
    return out.select("dimension", value.alias("value"), "target", (F.col("x") / F.sum("x").over(Window.partitionBy("dimension"))).alias("reached"))


def mix(docs: DataFrame, cycles: int = CYCLES, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), share: float | None = None, targets: Targets | None = None, topic: Column | None = None) -> DataFrame:
    """Every row with its cell's calibrated probability and whether it is in the sample.

    doc_id, the columns of `carry`, tokens, source, lang, topic, weight (the share of all tokens that the cell should
    have), probability and sampled. Weights are raked to token-weighted marginals over source, lang and topic. A row is
    in the sample if the hash of its id lies below the probability. Equal ids share a fate.

    `targets` gives the weights of values by dimension, as {"source": {"web": 3, "books": 1}}; see marginals(). `topic` is
    an expression over docs for the topic of a row; the default is a coarse one by the kind of text.

    With a `share`, the sample is calibrated to that share of all tokens: cells that have too few are kept whole, and the
    others make up for them, so that a tiny cell doesn't set the size (shares_reached tells the shares that result).
    Without one, the probability is proportional to weight over tokens, and 1 in the cell that is furthest below its
    weight: the weights hold exactly, but one row in a rare cell can halve the sample.

    Null sources and langs are values of their own, a null text has no tokens. Cells without tokens have weight 0 and
    probability 1: keeping their rows changes no share. A null id counts as an empty one. An empty table gives no rows.
    The rows aren't shuffled: cells are broadcast while few when counted, else joined, and adaptive execution splits hot ones.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), *carry, tokens_of(text).cast("long").alias("tokens"), F.col("source"), F.col("lang"), (topic_of(text) if topic is None else topic).alias("topic"))
    keys = [cell(d) for d in DIMENSIONS]
    cells = rake(rows.groupBy(*keys).agg(F.sum("tokens").alias("tokens")), cycles, targets)
    if share is None:
        ratio = F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens"))
        ratio = ratio / F.lit(cells.agg(F.max(ratio)).first()[0] or 1.0)
    else:
        cells = fit_budget(cells, share, cycles)
        ratio = F.when(F.col("tokens") > 0, F.col("x") / F.col("tokens"))
    cells = cut(cells.select(*[f"__{d}" for d in DIMENSIONS], F.col("w").alias("weight"), F.coalesce(ratio, F.lit(1.0)).alias("probability")))
    names = [f"__{d}" for d in DIMENSIONS]
    few = cells.count() <= 100_000
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 12), 16, 10).cast("double") / float(1 << 48)
    out = rows.select("*", *keys).join(F.broadcast(cells) if few else cells, names, "left")
    return out.drop(*names).withColumn("sampled", draw < F.col("probability"))


def sample_mixture(docs: DataFrame, share: float | None = None, targets: Targets | None = None) -> DataFrame:
    """The documents of the sample, with all their columns, whatever their names; with a `share` of all tokens and `targets` as in mix()."""
    packed = docs.select(F.col("doc_id"), F.col("text"), F.col("source"), F.col("lang"), F.struct(*docs.columns).alias("__row"))
    return mix(packed, carry=("__row",), share=share, targets=targets).where("sampled").select("__row.*")


def op10_source_mixing(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "source", "lang", "topic", "tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "sampled")


def op10_sql() -> str:
    """The same for DuckDB: a common table expression for each scaling."""
    steps, last = [], "c0"
    for i in range(CYCLES):
        for d in DIMENSIONS:
            name = f"c{i + 1}_{d}"
            steps.append(f"{name} AS (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY s_{d}) > 0 THEN w * target_{d} / sum(w) OVER (PARTITION BY s_{d}) ELSE 0 END AS w) FROM {last})")
            last = name
    targets = ", ".join(f"t_{d} AS (SELECT s_{d}, p / sum(p) OVER () AS target_{d} FROM (SELECT s_{d}, pow(sum(tokens) / (SELECT sum(tokens) FROM cells), {EVENNESS[d]}) AS p FROM cells GROUP BY ALL))" for d in DIMENSIONS)
    return f"""
WITH d AS (
  SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens,
    CASE WHEN text IS NULL THEN 'none' WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '!! ') THEN 'loud'
      WHEN contains(text, 'licensed under the') OR contains(text, 'Licensed under the') OR contains(text, 'Released under the') THEN 'licensed'
      WHEN contains(text, '### ') OR contains(text, '$$$ ') THEN 'noisy' ELSE 'prose' END AS topic
  FROM documents),
k AS (SELECT *, coalesce(source, chr(1)) AS s_source, coalesce(lang, chr(1)) AS s_lang, topic AS s_topic FROM d),
cells AS MATERIALIZED (SELECT s_source, s_lang, s_topic, sum(tokens)::BIGINT AS tokens FROM k GROUP BY ALL),
{targets},
c0 AS (SELECT s_source, s_lang, s_topic, tokens, tokens::DOUBLE AS w, target_source, target_lang, target_topic
  FROM cells JOIN t_source USING (s_source) JOIN t_lang USING (s_lang) JOIN t_topic USING (s_topic)),
{", ".join(steps)},
r AS (SELECT *, CASE WHEN tokens > 0 THEN w / tokens END AS ratio FROM {last}),
p AS (SELECT s_source, s_lang, s_topic, w AS weight, coalesce(ratio / max(ratio) OVER (), 1.0) AS probability FROM r)
SELECT doc_id, source, lang, topic, tokens, round(weight, 6) AS weight, round(probability, 6) AS probability,
  ('0x' || substr(sha256('mix' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 < probability AS sampled
FROM k JOIN p USING (s_source, s_lang, s_topic)
"""
