"""Routing by the inverted index and by vectors of texts against plain scoring of every pair."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from specto.operators import routing, vectors

WORDS = ["list", "files", "send", "mail", "the", "a", "of", "é", "😀x", "calendar", "events", "ev", "x_y", "100%", "Zz"]


def plain(queries, tools):
    out = {}
    for q, words in queries:
        scores = {t: sum(w in (n or "") or w in (d or "") for w in words) for t, n, d in tools}
        best = max(scores.values(), default=None)
        out[q] = (min((t for t, s in scores.items() if s == best), default=None), best)
    return out


def test_keyword_route_is_that_of_every_pair(spark):
    rng = random.Random(6)
    tools = [(i, rng.choice(["tool " + rng.choice(WORDS), "", None]), rng.choice([None, "", " ".join(rng.choices(WORDS, k=rng.randrange(9)))])) for i in range(60)]
    tools += [(100 + i, "common", "the a of list files send mail") for i in range(20)]
    queries = [(i, list(dict.fromkeys(rng.choices([*WORDS, "nowhere", "mailx", "fil", "il", "q"], k=rng.randrange(12))))) for i in range(40)]
    queries += [(90, []), (91, ["nowhere", "qqq"]), (92, ["the"]), (93, ["nowhere", "mail"])]
    t = spark.createDataFrame(tools, "id long, name string, description string")
    q = spark.createDataFrame(queries, "id long, words array<string>")
    for first in (1, 4, 50):
        got = {r.query_id: (r.tool_id, r.score) for r in routing.keyword_route(q, t, first).collect()}
        assert got == plain(queries, tools)
    assert {(r.query_id, r.tool_id, r.score) for r in routing.keyword_route(q, t.limit(0)).collect()} == {(i, None, None) for i, _ in queries}
    assert routing.keyword_route(q.limit(0), t).count() == 0


def test_keyword_route_has_no_nested_loop_over_pairs(spark):
    t = spark.createDataFrame([(1, "a b", "c d")], "id long, name string, description string")
    q = spark.createDataFrame([(1, ["c"])], "id long, words array<string>")
    plan = routing.keyword_route(q, t)._jdf.queryExecution().toString()
    assert plan.count("BroadcastNestedLoopJoin") <= 2 and "contains" not in plan  # one row beside each result, no pairs
    grams = spark.createDataFrame([("abca",), ("é",), ("",)], "t string").select(F.sort_array(routing.grams_of(F.col("t"), (1, 3))).alias("g"))
    assert [r.g for r in grams.collect()] == [["a", "abc", "b", "bca", "c"], ["é"], []]


def test_texts_find_their_tools(spark):
    tools = [(0, "list_files", "Lists the files of a folder."), (1, "send_mail", "Sends a message to somebody."), (2, "add_event", "Adds an event to the calendar."), (3, "bare", None)]
    asked = [("exact", "Sends a message to somebody"), ("spelt", "calendars eventful"), ("words", "zzz file"), ("none", "qqqq"), ("null", None)]
    t = spark.createDataFrame(tools, "id int, name string, description string")
    q = spark.createDataFrame(asked, "id string, text string")
    got = {r.query_id: (r.tool_id, r.fallback) for r in routing.route_texts(q, t, 0.2).collect()}
    assert set(got) == {i for i, _ in asked}
    assert got["exact"] == (1, False) and got["spelt"] == (2, False) and got["none"] == (0, True) and got["null"][1]
    assert routing.route_texts(q, t, 0.99).where("not fallback").isEmpty()


def test_vectors_are_sums_of_signs(spark):
    texts = [(0, "a bee"), (1, "bee"), (2, "bee  a"), (3, None), (4, "")]
    df = spark.createDataFrame(texts, "id long, text string")
    known = vectors.weights(df)
    idf = {r.feature: (r.df, r.idf) for r in known.collect()}
    assert set(idf) == {"w:a", "w:bee", "g:<a>", "g:<be", "g:bee", "g:ee>"} and idf["w:bee"][0] == 3
    assert abs(idf["w:a"][1] - (math.log(6 / 3) + 1)) < 1e-12
    rows = {r.id: r.vector for r in vectors.vectors(df, known, 100).collect()}
    assert rows[0] == rows[2] and rows[3] is None and rows[4] is None and len(rows[1]) == 100
    assert all(abs(sum(x * x for x in v) - 1) < 1e-6 for v in rows.values() if v)
    near = sum(x * y for x, y in zip(rows[0], rows[1], strict=True))
    assert 0.5 < near < 0.95


def test_many_queries_meet_tools_in_blocks(spark):
    """More queries than go to all tasks: products of blocks, with the rows of the plain way, ties and nulls too."""
    rng = np.random.default_rng(3)
    rows = [(i, None if i % 41 == 0 else [float(x) for x in rng.integers(-2, 3, 6)]) for i in range(400)]
    tools = spark.createDataFrame(rows, "id long, vector array<float>")
    queries = tools.where("id % 3 = 0")
    for k, itself in ((1, False), (3, True)):
        want = {tuple(r) for r in routing.top_k(queries, tools, k, itself).collect()}
        assert {tuple(r) for r in routing.top_k(queries, tools, k, itself, few=10).collect()} == want
        blocks = routing.near_blocks(tools, queries, k + (not itself), block=30, width=50)
        assert "MapInArrow" not in blocks._jdf.queryExecution().toString() and "CoGroup" in blocks._jdf.queryExecution().toString()
        best: dict = {}
        for q, t, score in blocks.collect():
            if itself or q != t:
                best.setdefault(q, set()).add((-round(score, 6), t))
        assert {(q, t, -s, i + 1) for q, found in best.items() for i, (s, t) in enumerate(sorted(found)[:k])} == want
    assert routing.top_k(queries, tools.limit(0), 3, few=10).count() == 0
    plan = routing.top_k(queries, tools, 3, few=10)._jdf.queryExecution().toString()
    assert "zip_with" not in plan and "CoGroup" in plan
