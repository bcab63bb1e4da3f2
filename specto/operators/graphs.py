"""Closures over edge tables: what a change reaches, and nodes on cycles. A step is a join; only counts come to the driver.

Chains are taken out first: a node with one way on follows it by pointers that double their reach in each step, so a chain
of n nodes takes log n steps. What is left are the branches; steps over them are as many as a shortest path has branches.
Several steps make one job, whose result is written to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specto.functions.costs import risk_level
from specto.operators.storage import cut

STEPS = 4  # in one job


def followed(ways: DataFrame) -> DataFrame:
    """node, end, steps: where the only way on from each node (node, to) ends, in doubling steps.

    The end is the first node that isn't in `ways` itself. Nodes that come to no end, on a ring of such nodes or on the way
    to one, have a null end.
    """
    n = ways.count()
    at = ways.select("node", F.col("to").alias("end"), F.lit(1).cast("long").alias("steps"), F.lit(False).alias("done"))
    reached = 1
    while True:
        for _ in range(2):  # each step reads what it starts from twice
            far = at.select(F.col("node").alias("end"), F.col("end").alias("next"), F.col("steps").alias("more"), F.col("done").alias("there"))
            met = at.where("not done").join(far, "end", "left")
            on = F.col("next").isNotNull()
            met = met.select("node", F.coalesce("next", "end").alias("end"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), (~on | F.col("there")).alias("done"))
            at = at.where("done").unionByName(met)
            reached *= 2
        at = cut(at)
        if reached > n or at.where("not done").isEmpty():
            return at.select("node", F.when(F.col("done"), F.col("end")).alias("end"), "steps")


def reach_back(edges: DataFrame, target) -> DataFrame:
    """node, depth of all that lead to the target by edges (src, dst); the target itself is left out, even on a cycle."""
    edges = cut(edges.select("src", "dst").where("src <> dst").distinct())
    branches = edges.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("to"))
    ends = followed(branches.where((F.col("n") == 1) & (F.col("src") != F.lit(target))).select(F.col("src").alias("node"), "to"))
    # edges of the branching nodes alone, each to where the chain that it leads to ends
    forks = edges.join(branches.where((F.col("n") > 1) & (F.col("src") != F.lit(target))).select("src"), "src", "left_semi")
    forks = forks.join(ends.withColumnRenamed("node", "dst"), "dst", "left").where("steps is null or end is not null")
    forks = cut(forks.groupBy("src", F.coalesce("end", "dst").alias("dst")).agg(F.min(F.coalesce("steps", F.lit(0)) + 1).alias("steps")))
    seen = cut(edges.sparkSession.createDataFrame([(target, 0)], f"node {dict(edges.dtypes)['src']}, depth long"))
    while True:
        start = seen
        for _ in range(STEPS):
            given = forks.join(seen.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), (F.col("depth") + F.col("steps")).alias("depth"))
            seen = seen.unionByName(given).groupBy("node").agg(F.min("depth").alias("depth"))
        seen = cut(seen)
        if seen.join(start.withColumnRenamed("depth", "before"), "node", "left").where("before is null or depth < before").isEmpty():
            break
    chains = ends.join(seen.withColumnRenamed("node", "end"), "end").select("node", (F.col("steps") + F.col("depth")).alias("depth"))
    return cut(seen.where(F.col("node") != F.lit(target)).unionByName(chains).select("node", F.col("depth").cast("int")))


def blast_radius(edges: DataFrame, target) -> DataFrame:
    """Callers that a change of the target reaches, the direct ones marked, with the count and its risk level on each row."""
    hit = reach_back(edges, target)
    n = hit.agg(F.count("*").alias("impacted"))
    return hit.select("node", (F.col("depth") == 1).alias("direct")).join(F.broadcast(n)).withColumn("level", risk_level(F.col("impacted")))


def peeled(edges: DataFrame) -> DataFrame:
    """Without the edges of nodes that have no way in or no way out, a few layers of them: those are on no cycle."""
    for _ in range(STEPS):
        ways_in, ways_out = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = edges.join(ways_in, "src", "left_semi").join(ways_out, "dst", "left_semi").select("src", "dst")
    return cut(edges)


def trimmed(edges: DataFrame) -> DataFrame:
    """The same until all have both."""
    n = edges.count()
    while n:
        edges = peeled(edges)
        left = edges.count()
        if left == n:
            break
        n = left
    return edges


def highest_ancestor(edges: DataFrame) -> DataFrame:
    """node, label: the largest node that reaches each node, itself included."""
    labels = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct().withColumn("label", F.col("node"))
    while True:
        start = labels
        for _ in range(STEPS):
            given = edges.join(labels.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "label")
            labels = labels.unionByName(given).groupBy("node").agg(F.max("label").alias("label"))
        labels = cut(labels)
        if labels.join(start.withColumnRenamed("label", "before"), "node").where("label <> before").isEmpty():
            return labels


def contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges without the nodes that have one way in and one way out, and inner: node, head, tail of those, null on a ring of nothing else.

    A chain of such nodes becomes one edge from its head to its tail, which may be the same node.
    """
    out = edges.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("to")).where("n = 1").select(F.col("src").alias("node"), "to")
    back = edges.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("of")).where("n = 1").select(F.col("dst").alias("node"), "of")
    simple = cut(out.join(back, "node"))
    if simple.isEmpty():
        return edges, simple.select("node", F.col("of").alias("head"), F.col("to").alias("tail"))
    tails = followed(simple.select("node", "to")).select("node", F.col("end").alias("tail"))
    heads = followed(simple.select("node", F.col("of").alias("to"))).select("node", F.col("end").alias("head"))
    inner = cut(tails.join(heads, "node"))
    names = simple.select("node")
    whole = edges.join(names.withColumnRenamed("node", "src"), "src", "left_anti").join(names.withColumnRenamed("node", "dst"), "dst", "left_anti")
    short = inner.where("head is not null and tail is not null").select(F.col("head").alias("src"), F.col("tail").alias("dst"))
    return cut(whole.select("src", "dst").unionByName(short).distinct()), inner


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves: those of strongly connected components of two and more nodes, and those with an edge to themselves.

    What no cycle can hold is peeled off and chains are contracted, as long as that makes the table smaller; a chain is on a cycle if its ends are one node or lie in one
    component, and a ring of nothing else is one. Each node that is left is labelled with its highest
    ancestor; a component lies within one label, and what leads back to the node of the label's own name, within the label,
    is its component, for all labels at once. It is taken out, and the rest is trimmed and labelled anew. No table grows
    beyond the edges.
    """
    edges = cut(edges.select("src", "dst").distinct())
    found = edges.where("src = dst").select(F.col("src").alias("node"))
    rest, chains = edges.where("src <> dst"), []
    n = rest.count()
    while n:
        rest, inner = contracted(peeled(rest))
        if not inner.isEmpty():
            chains.append(inner)
            # an edge to the node itself stands for a chain that is a cycle with it
            found = found.unionByName(rest.where("src = dst").select(F.col("src").alias("node")))
            rest = cut(rest.where("src <> dst"))
        left = rest.count()
        if left == n:
            break
        n = left
    members = components(rest)
    found = found.unionByName(members.select("node"))
    for inner in reversed(chains):
        ends = inner.join(members.select(F.col("node").alias("head"), F.col("component").alias("a")), "head", "left").join(members.select(F.col("node").alias("tail"), F.col("component").alias("b")), "tail", "left")
        cyclic = cut(ends.where("head is null and tail is null or head = tail or a = b").select("node", F.coalesce("a", "head", "node").alias("component")))
        found = found.unionByName(cyclic.select("node"))
        members = cut(members.unionByName(cyclic).unionByName(inner.join(cyclic.select("node"), "node", "left_semi").where("head = tail").select(F.col("head").alias("node"), F.col("head").alias("component"))).groupBy("node").agg(F.min("component").alias("component")))
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component of the nodes of strongly connected components of two and more nodes."""
    found = None
    rest = trimmed(edges)
    while not rest.isEmpty():
        labels = highest_ancestor(rest)
        ends = rest.join(labels.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst")
        within = cut(ends.where("a = b").select("src", "dst"))
        part = labels.where("node = label").select("node")
        n = part.count()
        while True:
            for _ in range(STEPS):
                part = part.unionByName(within.join(part.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"))).distinct()
            part = cut(part)
            more = part.count()
            if more == n:
                break
            n = more
        named = part.join(labels, "node")
        sizes = named.groupBy("label").agg(F.count("*").alias("size")).where("size > 1")
        some = cut(named.join(sizes, "label", "left_semi").select("node", F.col("label").alias("component")))
        found = some if found is None else found.unionByName(some)
        outside = within.join(part.withColumnRenamed("node", "src"), "src", "left_anti").join(part.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
        rest = trimmed(cut(outside))
    return found if found is not None else edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
