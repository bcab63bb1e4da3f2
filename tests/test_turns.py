"""Totals that count each turn once, exact nearest tools by clusters, and token counts by a dictionary."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from specto.operators import counts, nearest, routing, stats
from specto.streaming import totals


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_turns_are_added_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert totals.totals(spark, path, ["k"]) is None
    turn = lambda n: spark.createDataFrame([("a", n), (None, 1)], "k string, x long")
    for n in range(6):
        assert totals.add_turn(turn(n), n, path, ["k"], every=2)
        assert not totals.add_turn(turn(n), n, path, ["k"], every=2)  # replayed
    assert not totals.add_turn(turn(9), 3, path, ["k"])
    assert rows_of(totals.totals(spark, path, ["k"])) == [("a", 15), (None, 6)]
    assert len(totals.turns(spark, path)) <= 3


def test_turn_that_dies_before_its_line_counts_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    some = spark.createDataFrame([("a", 5)], "k string, x long")
    totals.add_turn(some, 0, path, ["k"])
    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", lambda *a, **b: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            totals.add_turn(some, 1, path, ["k"])
    assert rows_of(totals.totals(spark, path, ["k"])) == [("a", 5)]
    assert totals.add_turn(some, 1, path, ["k"])
    assert rows_of(totals.totals(spark, path, ["k"])) == [("a", 10)]


def test_stream_started_anew_counts_nothing_twice(spark, tmp_path):
    log = spark.createDataFrame([("s", 500), ("s", 300), ("t", 50), (None, 7)], "server string, raw long")
    for i in range(3):
        log.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    def run(checkpoint):
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
        totals.keep_stats(stream, "server", F.col("raw"), F.lit(100), str(tmp_path / "t"), str(tmp_path / checkpoint), every=2).awaitTermination()
        return rows_of(totals.kept_stats(spark, "server", str(tmp_path / "t")))

    want = rows_of(stats.session_stats(spark.read.parquet(str(tmp_path / "log")), "server", F.col("raw"), F.lit(100)))
    assert run("a") == want
    assert run("b") == want  # a lost checkpoint: the turns come again, with the same numbers
    log.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    assert run("a") == rows_of(stats.session_stats(spark.read.parquet(str(tmp_path / "log")), "server", F.col("raw"), F.lit(100)))


def test_bounded_top_k_is_exact(spark):
    r = np.random.default_rng(1)
    hubs = r.normal(size=(12, 16)) * 4
    rows = [(i, (hubs[i % 12] + r.normal(size=16) * 0.2).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[i][1]) for i in range(20)] + [(3000, None), (3001, [0.0] * 16)]  # ties, null and zero
    tools = spark.createDataFrame(rows, "id long, vector array<double>").repartition(5)
    queries = tools.where("id % 20 = 0 or id >= 3000")
    for k in (1, 3, 200):
        got, skipped = nearest.bounded_top_k(queries, tools, k)
        assert rows_of(got) == rows_of(routing.top_k(queries, tools, k))
        assert skipped > (0.5 if k < 100 else -1)
    index = nearest.clustered(tools, clusters=5, sample=50)
    assert rows_of(nearest.bounded_top_k(queries, tools, 3, index)[0]) == rows_of(routing.top_k(queries, tools, 3))
    assert nearest.bounded_top_k(queries, tools.where("false"), 3)[0].count() == 0
    assert nearest.bounded_top_k(queries.where("false"), tools, 3)[0].count() == 0
    assert rows_of(nearest.bounded_top_k(queries, tools, 3, few=10)[0]) == rows_of(routing.top_k(queries, tools, 3))


def test_token_counts_equal_those_of_the_library(spark):
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.tiktoken")
    ranks = counts.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(2)
    odd = ["", " ", "a", "don't  stop\n\n now", " x  y", "Straße 日本語 42½", "x" * 3000, " \t\r\n" * 50, "abcdefgh" * 4000, "\U0001f600́é"]
    odd += ["".join(random.choice("aeinst ABC'.,!12\n\té ß日") for _ in range(random.randrange(200))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(odd)] + [(0, "again"), (3, odd[3]), (None, "no id"), (99, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    want = sorted(((i, len(library.encode_ordinary(t or ""))) for i, t in rows), key=str)
    for common in (counts.COMMON, 5):
        assert rows_of(counts.count_tokens(df, ranks, public.PATTERN, common)) == want
    assert counts.count_tokens(df.where("false"), ranks, public.PATTERN).count() == 0


def test_texts_are_counted_within_their_rows(spark, monkeypatch):
    public, plans, cut = pytest.importorskip("public_tokenizers"), [], counts.cut
    monkeypatch.setattr(counts, "cut", lambda df: plans.append(df._jdf.queryExecution().toString()) or cut(df))
    df = spark.createDataFrame([(i, f"a a b w{i}") for i in range(2400)], "id long, text string")
    ranks = {bytes([b]): b for b in range(256)}
    for common in (0, 2):
        assert rows_of(counts.count_tokens(df, ranks, public.PATTERN, common)) == sorted(((i, 7 + len(str(i))) for i in range(2400)), key=str)
    assert "Exchange" in plans[0] and "Exchange" not in plans[1]  # words are dealt by word, texts aren't dealt
