"""Similarity join on word n-grams by prefix trees.

Sets are held in one global order, rare n-grams first. Two sets as similar as asked must share enough n-grams among
the first ones of either, which proposes pairs; the proposals of one set are laid out as a trie of their ordered
n-grams, and the set is sent down the trie: branches share the overlap counted so far, and a subtree is left where
even all that remains could not reach the overlap needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import Bloom, gather, rows_of, rows_without
from .common import cut, importable, map_batches, narrow, tidy
from .components import components

MIX = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1024  # sketch cells in a row


@dataclass(frozen=True)
class Jaccard:
    words: int = 5
    percent: int = 80  # two sets link when 100 * overlap >= percent * union

    def prefix(self, n: int) -> int:
        """How many first n-grams of a set of n must hold one that it shares with a similar set."""
        return n - -(-n * self.percent // 100) + 1

    def needed(self, a: Column, b: Column) -> Column:
        """The least overlap of two sets of these sizes."""
        total = (a + b) * self.percent
        return F.ceil(total / (100 + self.percent))

    def sizes_fit(self, a: Column, b: Column) -> Column:
        return F.least(a, b) * 100 >= F.greatest(a, b) * self.percent


def shingles(text: str, words: int) -> np.ndarray:
    """Distinct hashes (64 bits, ascending) of the runs of `words` words; of the whole sequence if it is shorter."""
    w = text.encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    k = min(words, len(w))
    n = len(w) - k + 1
    x = np.full(n, k, np.uint64)
    for j in range(k):
        x = x * MIX + h[j : j + n]
        x ^= x >> np.uint64(29)
    return np.unique(x)


def sketch(docs: DataFrame, words: int, cells: int) -> np.ndarray:
    """How often n-grams fall into each of `cells` cells, as powers of two above the mean: 0 for all but frequent ones.

    Every n-gram of every document is counted. Tasks send their counts as rows of CHUNK cells that are added up by
    cell; the driver gets one byte a cell, and the number of cells is bounded.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(cells, np.uint32)
        for batch in batches:
            for some in range(0, batch.num_rows, 500):
                found = np.concatenate([shingles(t, words) for t in batch.column(1)[some : some + 500].to_pylist()])
                np.add.at(own, (found & np.uint64(cells - 1)).view(np.int64), np.uint32(1))
        rows = own.reshape(-1, CHUNK)
        for some in range(0, len(rows), 512):
            used = some + np.flatnonzero(rows[some : some + 512].any(1))
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(used, pa.int32()), "counts": pa.array([rows[i].tobytes() for i in used], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, np.uint32).astype(np.uint64)
        if sums:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(sums), pa.int32()), "counts": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    importable(docs.sparkSession)
    schema = "chunk int, counts binary"
    out = np.zeros((cells // CHUNK, CHUNK), np.uint64)
    with tidy(docs.sparkSession):
        for chunk, counts in docs.mapInArrow(count, schema).repartition(F.col("chunk")).mapInArrow(add, schema).collect():
            out[chunk] = np.frombuffer(bytes(counts), np.uint64)
    mean = max(1.0, 4 * out.mean())
    return np.concatenate([np.minimum(np.ceil(np.log2(np.maximum(1, some / mean))), 62).astype(np.uint8) for some in out])


def in_order(s: np.ndarray, level: np.ndarray) -> np.ndarray:
    """A set of n-grams as numbers that sort in the global order: by level of frequency, rare ones first, then by hash."""
    at = (s & np.uint64(len(level) - 1)).view(np.int64)
    return (level[at].astype(np.uint64) << np.uint64(57)) | (s >> np.uint64(7))


def ordered_sets(docs: DataFrame, rule: Jaccard, levels: np.ndarray) -> DataFrame:
    """doc_id, n, two longs that identify the set, the keys of its prefix in the global order, and the last of them.

    Any order would give the right pairs; this one keeps n-grams that are everywhere out of the prefixes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def make():
        level = shared.value

        def one(text: str) -> tuple[int, int, int, np.ndarray, int]:
            s = shingles(text, rule.words)
            n = len(s)
            if not n:
                return 0, 0, 0, np.zeros(0, np.int64), 0
            keys, p = in_order(s, level), rule.prefix(n)
            first = np.sort(np.partition(keys, p - 1)[:p] if p < n else keys).view(np.int64)
            return n, *set_key(s), first, int(first[-1])

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [one(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(r[3]) for r in rows)])
            prefix = pa.LargeListArray.from_arrays(ends, np.concatenate([r[3] for r in rows])).cast(pa.list_(pa.int64()))
            return pa.RecordBatch.from_pydict({"doc_id": batch.column(0).cast(pa.int64()), "n": pa.array([r[0] for r in rows], pa.int64()), "d1": pa.array([r[1] for r in rows], pa.int64()), "d2": pa.array([r[2] for r in rows], pa.int64()), "prefix": prefix, "last": pa.array([r[4] for r in rows], pa.int64())})

        return work

    return map_batches(docs, make, "doc_id long, n long, d1 long, d2 long, prefix array<long>, last long")


class Trie:
    """Ordered sets as a trie in array form: sets sorted, each with the depth at which it leaves the path of the one before."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        names = [s.astype(">u8").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=names.__getitem__)
        self.sets = sets
        n = len(sets)
        self.depth = [0] * n
        for at in range(1, n):
            a, b = sets[self.order[at - 1]], sets[self.order[at]]
            m = min(len(a), len(b))
            differ = a[:m] != b[:m]
            self.depth[at] = int(differ.argmax()) if differ.any() else m
        self.jump = [n] * n  # the next set that leaves the path higher up
        waiting: list[int] = []
        for at in range(n):
            while waiting and self.depth[waiting[-1]] > self.depth[at]:
                self.jump[waiting.pop()] = at
            waiting.append(at)
        sizes = [len(s) for s in sets]
        self.least, self.most = min(sizes, default=0), max(sizes, default=0)

    def similar(self, one: np.ndarray, percent: int, step: int = 128) -> list[int]:
        """Which sets are as similar to `one` as asked.

        `seen[d]` is the overlap of the path's first d n-grams, which the sets below it share. Where even the largest set of
        the trie could not gain what the smallest one needs, all sets below that point of the path are left out unread.
        """
        out, n, at = [], len(self.order), 0
        seen, reached = np.zeros(self.most + 1, np.int64), 0  # how far the path has been read
        least = -(-(len(one) + self.least) * percent // (100 + percent))
        while at < n:
            own, d = self.sets[self.order[at]], min(self.depth[at], reached)
            need = -(-(len(one) + len(own)) * percent // (100 + percent))
            count, kept, after = int(seen[d]), True, at + 1
            while d < len(own):
                rest = len(one) - (int(np.searchsorted(one, own[d - 1], "right")) if d else 0)
                if count + min(self.most - d, rest) < least:
                    kept = False
                    while after < n and self.depth[after] >= d:
                        after = self.jump[after] if self.depth[after] > d else after + 1
                    break
                if count + min(len(own) - d, rest) < need:
                    kept = False
                    break
                part = own[d : d + step]
                where = np.minimum(np.searchsorted(one, part), len(one) - 1)
                seen[d + 1 : d + 1 + len(part)] = count + np.cumsum(one[where] == part)
                d += len(part)
                count = int(seen[d])
            reached = d
            if kept and 100 * count >= percent * (len(one) + len(own) - count):
                out.append(self.order[at])
            at = after
        return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    """Two longs (d1, d2) that identify a set of n-grams."""
    digest = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def whole_sets(docs: DataFrame, ids: DataFrame, rule: Jaccard, levels: np.ndarray, keyed: bool = False) -> DataFrame:
    """id, own (a hash of the set), grams in the global order, of the documents with these ids (distinct doc_id); with `keyed` also d1, d2."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            plain = [shingles(t, rule.words) for t in batch.column(1).to_pylist()]
            sets = [np.sort(in_order(s, shared.value)).view(np.int64) for s in plain]
            ends = np.cumsum([0, *map(len, sets)])
            grams = pa.LargeListArray.from_arrays(ends, np.concatenate(sets)).cast(pa.list_(pa.int64()))
            columns = {"id": batch.column(0).cast(pa.int64()), "own": pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in sets], pa.int64()), "grams": grams}
            if keyed:
                columns |= {c: pa.array(v, pa.int64()) for c, v in zip(("d1", "d2"), zip(*map(set_key, plain), strict=True), strict=True)}
            return pa.RecordBatch.from_pydict(columns)

        return work

    sets = cut(map_batches(rows_of(docs, ids, ["doc_id"]).select("doc_id", "text"), make, "id long, own long, grams array<long>" + ", d1 long, d2 long" * keyed))
    if sets.groupBy("id", "own").count().where("count > 1").limit(1).count():  # rows that repeat an id and text
        sets = cut(sets.dropDuplicates(["id", "own"]))
    return sets


def verified(pairs: DataFrame, docs: DataFrame, rule: Jaccard, levels: np.ndarray, block: int = 512) -> DataFrame:
    """The pairs (a, b) of ids whose whole sets are similar. The sets proposed for one `a` meet in blocks of about `block`, each a trie.

    Where an id stands at several texts, each of them counts.
    """
    pairs = cut(pairs.select("a", "b"))
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = whole_sets(docs, ids, rule, levels)
    sizes = pairs.groupBy("a").agg(F.count("*").alias("size"))
    pairs = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / block)).alias("block"))
    pairs = pairs.join(sets.select(F.col("id").alias("a"), "own"), "a")
    members = pairs.join(sets.select(F.col("id").alias("b"), "grams"), "b").select("a", "own", "block", "b", "grams")
    heads = pairs.select("a", "own", "block").distinct()
    heads = heads.join(sets.select(F.col("id").alias("a"), "own", "grams"), ["a", "own"]).select("a", "own", "block", F.lit(None).cast("long").alias("b"), "grams")
    laid = heads.unionByName(members).repartition("a", "own", "block").sortWithinPartitions("a", "own", "block", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            grams = batch.column(4)
            ends, values = grams.offsets.to_numpy(), grams.values.to_numpy().view(np.uint64)
            found, i = [], 0
            while i < len(a):
                if b[i] is None:
                    head = values[ends[i] : ends[i + 1]]
                    i += 1
                    continue
                j = i
                while j < len(a) and b[j] is not None:
                    j += 1
                trie = Trie([values[ends[x] : ends[x + 1]] for x in range(i, j)])
                found += [i + x for x in trie.similar(head, rule.percent)]
                head, i = head.copy(), j
            head = head.copy()  # the batch goes
            yield pa.RecordBatch.from_pydict({"a": pa.array([a[x] for x in found], pa.int64()), "b": pa.array([b[x] for x in found], pa.int64())})

    return laid.mapInArrow(run, "a long, b long")


def enough(rule: Jaccard) -> Column:
    """Whether a pair that shares `shared` n-grams of its prefixes can reach the overlap needed: beyond the prefix that ends first, no more can follow than that set has left."""
    rest = F.when(F.col("la") <= F.col("lb"), F.col("na")).otherwise(F.col("nb"))
    return F.col("shared") + F.ceil(rest * rule.percent / 100) - 1 >= rule.needed(F.col("na"), F.col("nb"))


def shared_lists(classes: DataFrame, sizes: DataFrame, max_bits: int = 1 << 29) -> DataFrame:
    """key, id, n, last, size: which sets have a key in their prefix, and how many, for keys that two sets have.

    Only keys are counted; a filter of those that occur twice lets few others through, and what it lets through is joined
    with the counts, where adaptive execution can split a key that very many sets have.
    """
    counts = cut(classes.select(F.explode("prefix").alias("key")).groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    bloom = gather(counts.select("key"), max_bits)
    shared = classes.sparkSession.sparkContext.broadcast((bloom.bits, bloom.data))

    def make():
        own = Bloom(*shared.value)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            prefix = batch.column(1)
            ends, keys = prefix.offsets.to_numpy(), prefix.values.to_numpy()
            keys, lengths = keys[ends[0] : ends[-1]], np.diff(ends)
            at = np.flatnonzero(own.has(keys))
            rows = pa.array(np.repeat(np.arange(len(lengths)), lengths)[at])
            return pa.RecordBatch.from_pydict({"id": batch.column(0).take(rows), "key": pa.array(keys[at]), "n": batch.column(2).take(rows), "last": batch.column(3).take(rows)})

        return work

    postings = map_batches(classes.join(sizes, "id").select("id", "prefix", "n", "last"), make, "id long, key long, n long, last long")
    return cut(postings.join(counts, "key").select("key", "id", "n", "last", "size"))


def proposed(pairs: DataFrame, rule: Jaccard) -> DataFrame:
    """The pairs a, b (with sizes na, nb and last keys la, lb; one row a shared key) that can still reach the overlap needed."""
    pairs = pairs.where(rule.sizes_fit(F.col("na"), F.col("nb")))
    return pairs.groupBy("a", "b", "na", "nb", "la", "lb").agg(F.count("*").alias("shared")).where(enough(rule))


def against_hub(lists: DataFrame, rule: Jaccard) -> DataFrame:
    """Each set of a list with the one of the list that meets most others over all lists, as the origin of near copies does."""
    met = lists.groupBy("id").agg(F.sum("size").alias("met"))
    lists = lists.join(met, "id")
    hubs = lists.groupBy("key").agg(F.max(F.struct("met", (-F.col("id")).alias("first"), "id", "n", "last")).alias("hub"))
    stars = lists.join(hubs, "key").where("id <> hub.id")
    return proposed(stars.select(F.col("hub.id").alias("a"), F.col("id").alias("b"), F.col("hub.n").alias("na"), F.col("n").alias("nb"), F.col("hub.last").alias("la"), F.col("last").alias("lb")), rule)


def across_parts(lists: DataFrame, joined: DataFrame, rule: Jaccard, block: int = 256) -> DataFrame:
    """The sets of a list that are in different components so far, as pairs that can be similar.

    The sets of a key are dealt in blocks: those of a component with many in blocks of its own, the others together.
    Blocks of a key meet in pairs, but never two of one component, so sets that are linked already aren't tried with
    each other; within a pair of blocks only sets of different components and fitting sizes come out.
    """
    part = F.coalesce("component", "id").alias("part")
    parts = lists.join(joined, lists.id == joined.node, "left").select("key", "id", "n", "last", part)
    per_part = parts.groupBy("key", "part").agg(F.count("*").alias("many"))
    mixed = per_part.groupBy("key").agg(F.count("*").alias("parts"), F.sum(F.when(F.col("many") <= block, F.col("many"))).alias("few")).where("parts > 1")
    per_part = cut(per_part.join(mixed.select("key", "few"), "key"))
    own = parts.join(per_part, ["key", "part"])
    large = F.col("many") > block
    name = F.struct(F.when(large, F.col("part")).alias("p"), F.when(large, F.pmod(F.xxhash64("id"), F.ceil(F.col("many") / block))).otherwise(F.pmod(F.xxhash64("part"), F.ceil(F.col("few") / block))).alias("i"))
    blocks = own.groupBy("key", name.alias("name")).agg(F.collect_list(F.struct("part", "id", "n", "last")).alias("sets"), F.min("part").alias("low"), F.max("part").alias("high"))
    blocks = cut(blocks)
    left, right = blocks.select("key", F.col("name").alias("x"), F.col("sets").alias("xs"), F.col("low").alias("xl"), F.col("high").alias("xh")), blocks.select("key", F.col("name").alias("y"), F.col("sets").alias("ys"), F.col("low").alias("yl"), F.col("high").alias("yh"))
    one_part = (F.col("xl") == F.col("xh")) & (F.col("yl") == F.col("yh")) & (F.col("xl") == F.col("yl"))
    met = left.join(right, "key").where((F.col("x") <= F.col("y")) & ~one_part).select("key", (F.col("x") == F.col("y")).alias("same"), "ys", F.explode("xs").alias("s"))
    # the filter runs inside the array, so only pairs that can be similar become rows
    fits = lambda t: (t["part"] != F.col("s.part")) & (~F.col("same") | (F.col("s.id") < t["id"])) & rule.sizes_fit(F.col("s.n"), t["n"])
    met = met.select("s", F.explode(F.filter("ys", fits)).alias("t"))
    first = F.col("s.id") < F.col("t.id")
    pick = lambda f, swap: F.when(first != swap, F.col(f"s.{f}")).otherwise(F.col(f"t.{f}"))
    no, yes = F.lit(False), F.lit(True)
    return proposed(met.select(pick("id", no).alias("a"), pick("id", yes).alias("b"), pick("n", no).alias("na"), pick("n", yes).alias("nb"), pick("last", no).alias("la"), pick("last", yes).alias("lb")), rule)


def count_links(classes: DataFrame, docs: DataFrame, rule: Jaccard, levels: np.ndarray, block: int = 512) -> DataFrame:
    """d1, d2, links: how many documents are linked with each set (d1, d2, the id of one that has it, component, weight, its number of documents), those of other sets.

    The sets of a component are dealt in blocks; each block is a trie that the sets of it and of later blocks are sent
    down, a pair of blocks at a time, and only sums leave a pair. Exact at any size, but with the square of the number of
    different sets in a component.
    """
    several = classes.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    own = cut(classes.join(several, "component"))
    sets = whole_sets(docs, own.select(F.col("id").alias("doc_id")).distinct(), rule, levels, keyed=True)
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = own.join(sets, ["id", "d1", "d2"]).withColumn("block", F.pmod(F.xxhash64("d1"), blocks).cast("int"))
    every = F.sequence(F.lit(0), blocks - 1)
    cells = F.transform(every, lambda j: F.struct(F.least(F.col("block"), j).alias("i"), F.greatest(F.col("block"), j).alias("j")))
    laid = own.select("component", "d1", "d2", "weight", "grams", "block", F.inline(cells)).select("component", "i", "j", "block", "d1", "d2", "weight", "grams")
    laid = laid.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "block")

    def cell(part: pa.Table) -> pa.RecordBatch:
        first = part["block"].to_numpy() == part["i"][0].as_py()
        weight, grams = part["weight"].to_numpy(), part["grams"].combine_chunks()
        ends, values = grams.offsets.to_numpy(), grams.values.to_numpy().view(np.uint64)
        sets = [values[ends[x] : ends[x + 1]] for x in range(len(weight))]
        inside = np.flatnonzero(first)
        trie, links = Trie([sets[x] for x in inside]), np.zeros(len(weight), np.int64)
        alone = part["i"][0].as_py() == part["j"][0].as_py()
        for x in inside.tolist() if alone else np.flatnonzero(~first).tolist():
            met = inside[trie.similar(sets[x], rule.percent)]
            met = met[met != x]
            links[x] += weight[met].sum()
            if not alone:
                links[met] += weight[x]
        return pa.RecordBatch.from_pydict({"d1": part["d1"].combine_chunks(), "d2": part["d2"].combine_chunks(), "links": pa.array(links)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and [held[-1].column(c)[0].as_py() for c in range(3)] != keys[:, a].tolist():
                    yield cell(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield cell(pa.Table.from_batches(held))

    return laid.mapInArrow(run, "d1 long, d2 long, links long").groupBy("d1", "d2").agg(F.sum("links").alias("links"))


def near_duplicates(docs: DataFrame, rule: Jaccard = Jaccard(), id_col: str = "doc_id", text_col: str = "text", max_cells: int = 1 << 24, links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, and with `links` also n_links: how many other documents it is linked with.

    Copies of a set become one set. Links are proposed in two turns, so that a group of near copies makes no pairs
    among all its members: first each set of a list of sets that share an n-gram is held against the best-connected one,
    and what is verified is joined to components; then pairs are proposed from lists only between components. In both,
    the shared n-grams of a pair are counted and must leave the needed overlap in reach. No list, set or link is cut
    short, and no link that would join two components is left out. With `links`, the sets of each component are then
    counted out by count_links().

    A null text counts as empty: n_shingles 0, linked with nothing, component_id its own id. A row with a null id takes
    part in no link and has a null component_id. A document is an id with one set: rows that repeat both count once among
    links, and none is its own link. Rows that repeat an id with different sets are documents of one id: they share a
    component, and each counts the documents that its own set is linked with. A text of any length is one set. Other
    columns are passed over. An empty table gives no rows.
    """
    own = narrow(docs, id_col, text_col)
    rows = own.count()
    cells = min(max_cells, max(1 << 14, 1 << (4 * max(1, rows)).bit_length() - 1))
    levels = sketch(own, rule.words, cells)
    sets = cut(ordered_sets(own, rule, levels))
    some = sets.where("n > 0 and doc_id is not null")
    classes = some.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.first("prefix").alias("prefix"))
    sizes = some.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("last").alias("last")).select("id", "n", "last")
    lists = shared_lists(classes, sizes)
    found = cut(verified(against_hub(lists, rule), own, rule, levels))
    more = cut(verified(across_parts(lists, components(found), rule), own, rule, levels))

    # documents of one set are linked to its first; a document of an id that stands at several sets links those
    # (n is one key more than the groups have, so that the joins deal them anew and can split a hot one)
    first = some.groupBy("d1", "d2").agg(F.first("n").alias("n"), F.min("doc_id").alias("id"), F.count_distinct("doc_id").alias("weight"))
    member = some.select("doc_id", "d1", "d2", "n").join(first, ["d1", "d2", "n"]).select("doc_id", "id")
    several = member.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("a", "b")
    whole = components(found.unionByName(more).unionByName(several))
    if links:
        alike = count_links(cut(first.select("d1", "d2", "id", "weight").join(whole, F.col("id") == F.col("node")).select("d1", "d2", "id", "component", "weight")), own, rule, levels)
        first = first.join(cut(alike), ["d1", "d2"], "left")
    out = sets.join(first, ["d1", "d2", "n"], "left").join(whole, F.col("id") == F.col("node"), "left")
    linked = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "id"))
    columns = [F.col("doc_id"), F.col("n").alias("n_shingles"), F.coalesce(linked, F.col("doc_id")).alias("component_id")]
    if links:
        copies = F.when(linked.isNotNull(), F.col("weight") - 1)
        columns.append(F.coalesce(F.coalesce("links", F.lit(0)) + copies, F.lit(0)).cast("long").alias("n_links"))
    return out.select(*columns)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each group stays, the one with the smallest id, and every document that is in no group.

    Nulls, ties, repeated rows and empty tables are as in near_duplicates(); all columns stay, whatever their names. A row
    goes by its id, so rows that repeat an id share one fate.
    """
    gone = cut(near_duplicates(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct())
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"))
    return rows_without(packed, gone, ["id"]).select("row.*")


def op4_ngram_jaccard(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, links=True)
