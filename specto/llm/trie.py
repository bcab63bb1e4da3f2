"""The prefix trie of conversations, without a trie: intervals of sorted sequences.

A conversation is the list of the running digests of its turns, so two share a prefix of d turns if their d-th digests are
equal. The different lists are sorted over the cluster and taken in shards, each one batch of neighbours. In a shard, the
prefixes that a row doesn't share with the row above it are the candidates. A sparse table of minima over the lengths that
neighbours share lets each candidate search its right end, and each row's longest shared prefix its left end, by halving
steps, all at once and independently. Sums over an interval are differences of running sums, as the candidates
in row order come top first.

A prefix of a shard's first or last row may go on in another shard. Those are counted in parts, added up by digest, and what
such prefixes are to each other is settled in a small table: two rows a shard, as many digests as they have turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, importable, join_by_key

WIDTH = 16  # bytes of a digest
ROOT = b"\0" * WIDTH
#: Members of one node whose ids are joined at once, before a stream hashes the parts in order.
CHUNK = 1024


def head_length(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % 6


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turns: the turns of each conversation in order, as digest of role and text and code points of the text."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    key = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    lean = turns.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.struct(F.col("turn").cast("long").alias("turn"), key.alias("key"), F.char_length(text).cast("long").alias("chars")).alias("t"))
    whole = F.sort_array(F.collect_list("t"))
    return lean.groupBy("conv_id").agg(whole.alias("w")).select("conv_id", F.transform("w", lambda t: F.struct(t["key"], t["chars"])).alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, turns: the first turns of the conversation whose id is the next lower multiple of 100, then its own after as many."""
    own = cut(ordered_turns(turns))
    heads = own.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 5).alias("head"))
    h = head_length(F.col("conv_id")).cast("int")
    given = own.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base")).join(heads, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return given.select("conv_id", F.concat(head, rest).alias("turns"))


def paths(whole: DataFrame) -> DataFrame:
    """conv_id, tail, path, chars: running digests of each conversation's turns in one string of bytes, and the last of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = batch.column("turns")
            ends, inner = turns.offsets.to_numpy(), turns.values
            keys = inner.field(0).to_pylist()
            out = []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                digest, path = ROOT, []
                for key in keys[a:b]:
                    digest = hashlib.md5(digest + key, usedforsecurity=False).digest()
                    path.append(digest)
                out.append((digest, b"".join(path)))
            chars = pa.ListArray.from_arrays(turns.offsets, inner.field(1))
            tails, whole = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(tails, pa.binary()), pa.array(whole, pa.binary()), chars], names=["conv_id", "tail", "path", "chars"])

    importable(whole.sparkSession)
    return whole.select("conv_id", "turns").mapInArrow(run, "conv_id long, tail binary, path binary, chars array<long>")


def distinct_paths(lists: DataFrame) -> DataFrame:
    """path, chars, n, first, ends_sha256 of each different conversation: how many are equal, the smallest id, the digest of all ids in order.

    Ids are first joined in chunks of neighbouring ids, on all workers; the task of a very common conversation then only reads chunks.
    """
    part = F.floor(F.col("conv_id") / CHUNK)
    chunks = lists.withColumn("part", part).groupBy("tail", "part").agg(F.first("path").alias("path"), F.first("chars").alias("chars"), F.count("*").alias("n"), F.min("conv_id").alias("first"), F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    chunks = chunks.repartition("tail").sortWithinPartitions("tail", "part").select("tail", "path", "chars", "n", "first", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []
        tail, sha, one = None, hashlib.sha256(), []
        for batch in batches:
            tails, n, first, ids = (batch.column(c).to_pylist() for c in ("tail", "n", "first", "ids"))
            for i, t in enumerate(tails):
                if t != tail:
                    if one:
                        out.append([*one, sha.hexdigest()])
                    tail, sha = t, hashlib.sha256(ids[i].encode())
                    one = [batch.column("path")[i].as_py(), batch.column("chars")[i].as_py(), n[i], first[i]]
                else:
                    sha.update(("," + ids[i]).encode())
                    one[2] += n[i]
                    one[3] = min(one[3], first[i])
            if out:
                yield table(out)
                out = []
        if one:
            yield table([[*one, sha.hexdigest()]])

    def table(out: list[list]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["path", "chars", "n", "first", "ends_sha256"])

    importable(lists.sparkSession)
    return chunks.mapInArrow(run, "path binary, chars array<long>, n long, first long, ends_sha256 string")


class SparseTable:
    """Minima of all stretches of 1, 2, 4, ... values; extents are searched by halving steps."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]
        while (width := 1 << len(self.levels)) <= len(values):
            low = self.levels[-1]
            self.levels.append(np.minimum(low[: len(values) - width + 1], low[width // 2 : width // 2 + len(values) - width + 1]))

    def right(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last row to which all values after row `at` are `depth` at least."""
        at, last = at.copy(), len(self.levels[0]) - 1
        for k in range(len(self.levels) - 1, -1, -1):
            fits = at + (1 << k) <= last
            start = np.where(fits, at + 1, 0)
            start[start >= len(self.levels[k])] = 0
            at += np.where(fits & (self.levels[k][start] >= depth), 1 << k, 0)
        return at

    def left(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first row from which all values up to row `at` are `depth` at least."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            start = at - (1 << k) + 1
            fits = start >= 1
            start = np.where(fits, start, 0)
            at -= np.where(fits & (self.levels[k][start] >= depth), 1 << k, 0)
        return at

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least value from a to b."""
        k = np.frexp(b - a + 1)[1] - 1
        out = np.empty(len(a), np.int64)
        for level in np.unique(k):
            here = k == level
            values = self.levels[level]
            out[here] = np.minimum(values[a[here]], values[b[here] - (1 << level) + 1])
        return out


NODE = "digest binary, depth long, parent binary, parent_first long, chars long, first long, n_convs long, n_children long, n_leaves long, saved long, ends_sha256 string, edge int, edge_row long, own boolean"
KINDS = (pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.bool_())


def shard(batch: pa.RecordBatch, name: int) -> pa.RecordBatch:
    """The nodes of a batch of sorted, different paths; edge is 0 for those that lie inside it, else 1 for a prefix of its first row and 2 for one of its last.

    Nodes inside are complete but for what they take from a parent at the edge (parent_first is null there). Of the others
    the counts are those of this shard, and n_leaves and saved leave out what nodes at the edges themselves add. Both
    edge rows list all their prefixes; `own` marks the one listing that carries the counts.
    """
    path, chars = batch.column("path"), batch.column("chars")
    raw = np.frombuffer(path.buffers()[2] or b"", np.uint8)
    bounds = np.frombuffer(path.buffers()[1], np.int32, len(path) + 1, 4 * path.offset)
    digests = raw[bounds[0] : bounds[-1]].view(f"S{WIDTH}") if bounds[-1] > bounds[0] else np.zeros(0, f"S{WIDTH}")
    pairs = raw[bounds[0] : bounds[-1]].view(np.uint64).reshape(-1, 2)
    rows = len(path)
    size = np.diff(bounds) // WIDTH  # turns of each row
    base = np.concatenate([[0], np.cumsum(size)])  # of each row's turns
    points = chars.values.to_numpy()[chars.offsets[0].as_py() :]
    n, first = batch.column("n").to_numpy(), batch.column("first").to_numpy()
    ends = batch.column("ends_sha256").to_pylist()

    # lengths that neighbours share: digests run on, so once they differ they stay different
    least = np.minimum(size[1:], size[:-1])
    inner = np.arange(least.sum()) - np.repeat(np.concatenate([[0], np.cumsum(least)[:-1]]), least) if rows > 1 else np.zeros(0, int)
    same = (pairs[np.repeat(base[1:-1], least) + inner] == pairs[np.repeat(base[:-2], least) + inner]).all(1)
    lcp = np.zeros(rows, np.int64)
    lcp[1:] = np.bincount(np.repeat(np.arange(1, rows), least), same, rows)[1:]

    # candidates: the root in the first row, and in each row the prefixes that the row above doesn't have
    low = lcp.copy()
    low[0] = -1
    new = size - low
    start = np.concatenate([[0], np.cumsum(new)])  # of each row's candidates
    at = np.repeat(np.arange(rows), new)
    depth = np.arange(len(at)) - start[at] + low[at] + 1
    table, smallest = SparseTable(np.where(np.arange(rows) == 0, -1, lcp)), SparseTable(first)
    right = table.right(at, depth)
    weight = np.concatenate([[0], np.cumsum(n)])
    n_convs = weight[right + 1] - weight[at]
    lowest = smallest.least(at, right)

    # the parent of a row's first candidate is its longest shared prefix, which begins where the search to the left ends
    parent = np.arange(len(at)) - 1
    heads = np.flatnonzero((depth == low[at] + 1) & (at > 0))
    owner = table.left(at[heads], lcp[at[heads]])
    parent[heads] = start[owner] + lcp[at[heads]] - low[owner] - 1

    last = rows - 1
    edge = at == 0
    # prefixes of the last row: owned by the row where each begins
    own_last = np.arange(size[last] + 1)
    owner = table.left(np.full(len(own_last), last), own_last)
    owner[0] = 0
    lasts = start[owner] + own_last - low[owner] - 1
    edge[lasts] = True

    value = np.where(depth > 0, (n_convs - 1) * points[np.minimum(base[at] + np.maximum(depth, 1) - 1, max(0, len(points) - 1))] if len(points) else 0, 0)
    children = np.bincount(parent[1:], ~edge[1:], len(at)).astype(np.int64)
    whole = np.bincount(parent[1:], minlength=len(at))
    leaf = (whole == 0) & ~edge
    until = start[right + 1]
    sums = lambda x: (c := np.concatenate([[0], np.cumsum(x)]))[until] - c[: len(at)]
    saved, leaves = sums(np.where(edge, 0, value)), sums(leaf)

    digest_of = lambda i: ROOT if depth[i] == 0 else raw[bounds[at[i]] + WIDTH * (depth[i] - 1) : bounds[at[i]] + WIDTH * depth[i]].tobytes()
    whole_row = depth == size[at]
    out: list[tuple] = []

    def put(i: int, kind: int, own: bool) -> None:
        p = parent[i] if depth[i] else -1
        out.append((digest_of(i), int(depth[i]), None if p < 0 else digest_of(p), None if p < 0 or edge[p] else int(lowest[p]), int(points[base[at[i]] + depth[i] - 1]) if depth[i] else 0, int(lowest[i]) if own else None, int(n_convs[i]) if own else 0, int(children[i]) if own else 0, int(leaves[i]) if own else 0, int(saved[i]) if own else 0, ends[at[i]] if own and whole_row[i] else None, kind, 2 * name + (kind == 2) if kind else None, own))

    del digests
    for i in np.flatnonzero(~edge).tolist():
        put(i, 0, True)
    for i in range(int(size[0]) + 1):
        put(i, 1, True)
    shared = set(range(int(size[0]) + 1))
    if last:
        for i in lasts.tolist():
            put(i, 2, i not in shared)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), KINDS, strict=True)], names=[c.split()[0] for c in NODE.split(", ")])


def shards(different: DataFrame) -> DataFrame:
    """NODE rows of all shards. A range of the sorted paths is a partition, and each of its batches a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = TaskContext.get().partitionId() << 24
        for batch in batches:
            if batch.num_rows:
                yield shard(batch, name)
                name += 1

    importable(different.sparkSession)
    ranges = different.repartitionByRange(*[F.col("path")]).sortWithinPartitions("path")
    return ranges.mapInArrow(run, NODE)


def settled(edges: DataFrame) -> DataFrame:
    """The nodes at the edges of shards, put together: digest, depth, parent, first, n_convs, n_children, n_leaves, saved, ends_sha256.

    What a node adds to those above it is counted in one of the rows that it is a prefix of; there, a running sum from the
    row's end gives what each of its prefixes gets.
    """
    from pyspark.sql import Window

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    nodes = edges.groupBy("digest", "depth", "parent", "chars").agg(F.min("first").alias("first"), F.min("edge_row").alias("row"), F.max("ends_sha256").alias("ends_sha256"), *sums)
    below = nodes.where("parent is not null").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("more"))
    nodes = nodes.join(below, "digest", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    nodes = nodes.withColumn("value", (F.col("n_convs") - 1) * F.col("chars")).withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    nodes = cut(nodes)
    listed = edges.select("digest", F.col("depth"), F.col("edge_row")).join(nodes.select("digest", "row", "value", "leaf"), "digest")
    mine = F.col("edge_row") == F.col("row")
    up = Window.partitionBy("edge_row").orderBy(F.desc("depth"))
    listed = listed.select("digest", F.sum(F.when(mine, F.col("value")).otherwise(0)).over(up).alias("value"), F.sum(F.when(mine, F.col("leaf")).otherwise(0)).over(up).alias("leaf"))
    added = listed.groupBy("digest").agg(F.sum("value").alias("value"), F.sum("leaf").alias("leaves"))
    out = nodes.drop("value").join(added, "digest")
    return out.select("digest", "depth", "parent", "first", "n_convs", "n_children", (F.col("n_leaves") + F.col("leaves")).alias("n_leaves"), (F.col("saved") + F.col("value")).alias("saved"), "ends_sha256")


def prefix_trie(whole: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations given as conv_id and turns (an array of digest and code points).

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, as op12 describes them.
    """
    found = cut(shards(cut(distinct_paths(paths(whole)))))
    edges = cut(settled(found.where("edge > 0")))
    columns = ["depth", "first", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256"]
    inside = found.where("edge = 0")
    parents = edges.select(F.col("digest").alias("parent"), F.col("first").alias("parent_conv_id"))
    lower = join_by_key(inside.where("parent_first is null").select("parent", *columns), parents, ["parent"]).select("parent_conv_id", *columns)
    upper = edges.select("parent", *columns).join(parents, "parent", "left").select("parent_conv_id", *columns)
    every = inside.where("parent_first is not null").select(F.col("parent_first").alias("parent_conv_id"), *columns).unionByName(lower).unionByName(upper)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return every.select(F.col("first").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"))


def op12_conversation_trie(turns: DataFrame) -> DataFrame:
    """The prefix trie of the rebuilt conversations.

    A null role or text counts as empty, a null turn comes first; equal turns are ordered by a digest of role and text, so
    repeated rows stand side by side and count as turns. Rows without a conv_id are in no conversation. The lower multiple
    of 100 is the one nearer to 0. Texts of any length are held as their digest; a conversation of any length is one row
    of some 40 bytes a turn. Other columns are passed over. An empty table has no conversations and no nodes.
    """
    return prefix_trie(rebuilt(turns))
