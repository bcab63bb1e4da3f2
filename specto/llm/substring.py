"""Removal of passages that occur in an earlier document, by compressed FM-indexes over shards of the text.

Every window of 50 words holds a smallest 25-gram, its anchor; equal windows have equal anchors, so comparing the
windows of one anchor with each other compares all. Stretches around anchors that several documents have are dealt by
anchor to shards; each shard indexes its stretches and streams them backward through the index.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import Bloom, gather, key_filter, passes
from .common import cut, importable, map_batches, narrow, shared_folder, tidy
from .fmindex import FmIndex, matched_windows

SHARD_WORDS = 250_000


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()  # on bytes: ASCII white space only


def rolling(words: list[bytes], k: int) -> np.ndarray:
    """A hash of the k words from each position on."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - k + 1
    x, done, width = np.zeros(n, np.uint64), 0, 1
    with np.errstate(over="ignore"):
        while True:  # runs of 1, 2, 4, ... words are put together to k
            if k & width:
                x = x * np.uint64(0xC2B2AE3D27D4EB4F) + h[done : done + n]
                x ^= x >> np.uint64(31)
                done += width
            if done == k:
                return x * np.uint64(0xD6E8FEB86659FD93) ^ (x >> np.uint64(29))
            h = h[: len(h) - width] * np.uint64(0x9E3779B97F4A7C15) + h[width:]
            h ^= h >> np.uint64(29)
            width *= 2


def anchors(words: list[bytes], width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each anchor, the first window that it is the smallest of (the leftmost, on ties), and how many follow on."""
    grams = rolling(words, k)
    own = width - k + 1
    low = grams
    span = 1  # sliding minimum by doubling, with where it stands
    at = np.arange(len(grams))
    while span < own:
        step = min(span, own - span)
        left, right = low[:-step], low[step:]
        take = right < left
        low, at = np.where(take, right, left), np.where(take, at[step:], at[:-step])
        span += step
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return grams[at[first]].view(np.int64), first, np.diff(np.append(first, len(at)))


def shared_anchors(docs: DataFrame, width: int, k: int, max_bits: int) -> Bloom:
    """A filter of the anchors that two documents have; it also lets some others through, which then meet no partner."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [np.unique(anchors(w, width, k)[0]) if len(w := words_of(t)) >= width else np.zeros(0, np.int64) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, found)])
            return pa.RecordBatch.from_pydict({"doc_id": batch.column(0).cast(pa.int64()), "anchors": pa.LargeListArray.from_arrays(ends, np.concatenate(found)).cast(pa.list_(pa.int64()))})

        return work

    own = map_batches(docs.select("doc_id", "text"), make, "doc_id long, anchors array<long>").select("doc_id", F.explode("anchors").alias("key"))
    shared = own.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("key")
    path = f"{shared_folder(docs.sparkSession)}/anchors-{uuid.uuid4().hex}"
    shared.write.parquet(path)
    shared = docs.sparkSession.read.parquet(path)
    return gather(shared, max_bits)


def stretches(docs: DataFrame, bloom: Bloom, width: int, k: int) -> DataFrame:
    """key, content, doc_id, mark, start, windows, words: for each anchor that passes the filter, the words of the windows it is the smallest of.

    Where a batch holds equal stretches, the words are given with the first only.
    """
    shared = docs.sparkSession.sparkContext.broadcast((bloom.bits, bloom.data))

    def make():
        own = Bloom(*shared.value)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, marks, keys, starts, counts, texts, contents = [], [], [], [], [], [], []
            given: set[tuple[int, int]] = set()
            for doc, mark, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = words_of(text)
                if len(words) < width:
                    continue
                key, start, count = anchors(words, width, k)
                at = np.flatnonzero(own.has(key))
                for i, s, n in zip(at.tolist(), start[at].tolist(), count[at].tolist(), strict=True):
                    body = b" ".join(words[s : s + n + width - 1])
                    content = xxhash.xxh3_64_intdigest(body) - (1 << 63)
                    known = (int(key[i]), content)
                    keys.append(known[0])
                    starts.append(s)
                    counts.append(n)
                    texts.append(None if known in given else body)
                    contents.append(content)
                    given.add(known)
                ids += [doc] * len(at)
                marks += [mark] * len(at)
            return pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "content": pa.array(contents, pa.int64()), "doc_id": pa.array(ids, pa.int64()), "mark": pa.array(marks, pa.int64()), "start": pa.array(starts, pa.int32()), "windows": pa.array(counts, pa.int32()), "words": pa.array(texts, pa.binary())})

        return work

    return map_batches(docs, make, "key long, content long, doc_id long, mark long, start int, windows int, words binary")


def search_shards(rows: DataFrame, width: int) -> DataFrame:
    """key, content, starts of rows (shard, role, key, content, doc, words): the windows of each content that a smaller document has.

    Rows come sorted by shard and one shard is held at a time. Role 0 is indexed and searched, 1 only indexed, 2 only searched.
    """

    def search(part: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(part)
        numbers: dict[bytes, int] = {}
        table = table.sort_by("role")  # so that the indexed words are numbered first
        segments = [np.array([numbers.setdefault(w, len(numbers) + 1) for w in body.split(b" ")], np.int64) for body in table["words"].to_pylist()]
        owners = np.unique(table["doc"].to_numpy(), return_inverse=True)[1].astype(np.int64)
        role = table["role"].to_numpy()
        indexed = int((role < 2).sum())
        searched = np.flatnonzero(role != 1)
        if not indexed or len(segments) < 2 or not len(searched):
            return None
        index = FmIndex(segments[:indexed], owners[:indexed])
        known = len(index.first) - 2  # a word that the index lacks becomes 0, which has no match
        starts = matched_windows(index, [np.where(s <= known, s, 0) for s in (segments[i] for i in searched.tolist())], owners[searched], width)
        at = [int(searched[i]) for i, s in enumerate(starts) if len(s)]
        starts = [s for s in starts if len(s)]
        return pa.RecordBatch.from_pydict({"key": table["key"].take(pa.array(at, pa.int64())).combine_chunks(), "content": table["content"].take(pa.array(at, pa.int64())).combine_chunks(), "starts": pa.array(starts, pa.list_(pa.int32()))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            shard = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:]):
                if held and held[-1].column(0)[0].as_py() != shard[a]:
                    if (found := search(held)) is not None:
                        yield found
                    held = []
                held.append(batch.slice(a, b - a))
        if held and (found := search(held)) is not None:
            yield found

    importable(rows.sparkSession)
    return rows.mapInArrow(run, "key long, content long, starts array<int>")


def shared_pieces(bodies: DataFrame, width: int) -> DataFrame:
    """key, content, doc, offset, windows, piece, words: what is left of stretches (key, content, doc, words) without windows that only one document has.

    Around a passage that many documents share, each has other words, so its stretches all differ though what they share
    doesn't. Cut down to windows that two documents have, by a hash of each window, they become few.
    """
    spark = bodies.sparkSession

    def make_windows():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [rolling(body.split(b" "), width).view(np.int64) for body in batch.column(3).to_pylist()]
            counts = np.array([len(f) for f in found])
            at = np.concatenate([np.arange(n) for n in counts])
            rows = pa.array(np.repeat(np.arange(len(counts)), counts))
            return pa.RecordBatch.from_pydict({"key": batch.column(0).take(rows), "content": batch.column(1).take(rows), "doc": batch.column(2).take(rows), "at": pa.array(at, pa.int32()), "hash": pa.array(np.concatenate(found))})

        return work

    path = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    map_batches(bodies.select("key", "content", "doc", "words"), make_windows, "key long, content long, doc long, at int, hash long").write.parquet(path)
    windows = spark.read.parquet(path)
    shared = windows.groupBy("hash").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b").select("hash")
    kept = windows.join(shared, "hash", "left_semi").groupBy("key", "content").agg(F.sort_array(F.collect_set("at")).alias("at"))

    def make_pieces():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, offsets, counts, pieces, texts = [], [], [], [], []
            for i, (body, at) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                words, own = body.split(b" "), np.array(at)
                breaks = (np.flatnonzero(np.diff(own) != 1) + 1).tolist()
                for a, b in zip([0, *breaks], [*breaks, len(own)], strict=True):
                    start, n = int(own[a]), b - a
                    piece = b" ".join(words[start : start + n + width - 1])
                    rows.append(i)
                    offsets.append(start)
                    counts.append(n)
                    pieces.append(xxhash.xxh3_64_intdigest(piece) - (1 << 63))
                    texts.append(piece)
            at = pa.array(rows, pa.int64())
            own = {n: batch.column(i).take(at) for i, n in enumerate(("key", "content", "doc"))}
            return pa.RecordBatch.from_pydict(own | {"offset": pa.array(offsets, pa.int32()), "windows": pa.array(counts, pa.int32()), "piece": pa.array(pieces, pa.int64()), "words": pa.array(texts, pa.binary())})

        return work

    cut_down = map_batches(bodies.join(kept, ["key", "content"]).select("key", "content", "doc", "words", "at"), make_pieces, "key long, content long, doc long, offset int, windows int, piece long, words binary")
    path = f"{shared_folder(spark)}/pieces-{uuid.uuid4().hex}"
    cut_down.write.parquet(path)
    return spark.read.parquet(path)


def repeated_windows(pieces: DataFrame, width: int, block: int) -> DataFrame:
    """key, content, starts: where windows begin in different pieces (key, content, doc, windows, words) that a smaller document has too.

    An anchor with more than `block` different pieces is dealt in blocks, and each block is searched in the index of each,
    a pair of blocks at a time, so that a shard stays small whatever the anchor has.
    """
    many = pieces.groupBy("key").agg(F.count("*").alias("size"), F.sum(F.col("windows") + width - 1).alias("words_of_key")).where("size > 1")
    many = cut(many)
    shards = (many.agg(F.sum("words_of_key")).first()[0] or 0) // SHARD_WORDS + 1
    blocks = F.ceil(F.col("size") / block).cast("int")
    own_block = F.pmod(F.xxhash64("content"), blocks).cast("int")
    every = F.sequence(F.lit(0), blocks - 1)
    cells = F.array_distinct(F.concat(F.transform(every, lambda j: F.struct(own_block.alias("i"), j.alias("j"))), F.transform(every, lambda i: F.struct(i.alias("i"), own_block.alias("j")))))
    dealt = pieces.join(many.select("key", "size"), "key").select("key", "content", "doc", "words", own_block.alias("own"), F.inline(cells))
    role = F.when(F.col("i") == F.col("j"), 0).when(F.col("i") == F.col("own"), 1).otherwise(2)
    dealt = dealt.select(F.pmod(F.xxhash64("key", "i", "j"), F.lit(shards)).cast("int").alias("shard"), role.alias("role"), "key", "content", "doc", "words")
    return search_shards(dealt.repartition(shards, "shard").sortWithinPartitions("shard"), width)


def repeated_spans(docs: DataFrame, width: int = 50, k: int = 25, block: int = 2048, max_bits: int = 1 << 29) -> DataFrame:
    """doc_id, mark, spans: for each document (doc_id, mark, text) with repeated passages, the starts and ends of its words in them.

    Of equal stretches, all but that of the smallest document are repeated whole. Where an anchor has different ones, that
    one is cut down to windows that two documents have; of equal pieces again all but the first are repeated whole, and
    the first of each is searched in the indexes of the others.
    """
    spark = docs.sparkSession
    own = docs.where("doc_id is not null")
    bloom = shared_anchors(own, width, k, max_bits)
    path = f"{shared_folder(spark)}/stretches-{uuid.uuid4().hex}"
    with tidy(spark):
        stretches(own.select("doc_id", "mark", "text"), bloom, width, k).write.parquet(path)
    found = spark.read.parquet(path)

    different = found.groupBy("key", "content").agg(F.min("doc_id").alias("doc"), F.first("windows").alias("windows"))
    many = different.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    several = different.join(many, "key").select("key", "content", "doc")
    bodies = found.where("words is not null").select("key", "content", "words").join(several, ["key", "content"])
    bodies = bodies.groupBy("key", "content").agg(F.first("words").alias("words"), F.first("doc").alias("doc"))
    pieces = shared_pieces(bodies, width)

    firsts = cut(pieces.groupBy("key", "piece").agg(F.min("doc").alias("first"), F.first("windows").alias("windows"), F.first("words").alias("words")))
    hits = repeated_windows(firsts.select("key", F.col("piece").alias("content"), F.col("first").alias("doc"), "windows", "words"), width, block)
    hits = hits.groupBy("key", "content").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))
    whole = F.sequence(F.lit(0), F.col("windows") - 1)
    cut_down = pieces.select("key", "content", "doc", "offset", "piece").join(firsts.drop("words"), ["key", "piece"]).join(hits.withColumnRenamed("content", "piece"), ["key", "piece"], "left")
    told = cut_down.select("key", "content", "offset", F.when(F.col("doc") > F.col("first"), whole).otherwise(F.col("starts")).alias("starts"))
    told = told.where("starts is not null").select("key", "content", F.transform("starts", lambda x: x + F.col("offset")).alias("starts"))
    told = told.groupBy("key", "content").agg(F.flatten(F.collect_list("starts")).alias("starts"))

    # windows is one key more than the groups have: the join deals its sides anew, and adaptive execution can split a hot stretch
    fate = different.join(told, ["key", "content"], "left")
    places = found.select("key", "content", "doc_id", "mark", "start", "windows").join(fate, ["key", "content", "windows"])
    span = lambda a, b: F.struct(a.alias("from"), b.alias("to"))
    start = F.col("start")
    later = F.when(F.col("doc_id") > F.col("doc"), F.array(span(start, start + F.col("windows") - 1 + width)))
    first = F.transform("starts", lambda x: span(start + x, start + x + width))
    spans = places.select("doc_id", "mark", F.explode(later.otherwise(first)).alias("span"))
    return spans.groupBy("doc_id", "mark").agg(F.collect_set("span").alias("spans"))


def drop_repeated_passages(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (with keep_text also the kept words) of every row.

    Removed is each word covered by a window of `width` words that also starts in a document with a smaller id; windows
    are judged on the texts as given. A null text has no words. A row with a null id is neither smaller nor larger than
    another and stays whole; rows that repeat an id and text share one fate. A text of any length is cut into stretches,
    and other columns are passed over. An empty table gives no rows.
    """
    own = narrow(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    spark, path = docs.sparkSession, f"{shared_folder(docs.sparkSession)}/spans-{uuid.uuid4().hex}"
    with tidy(spark):
        repeated_spans(own.select("doc_id", "mark", "text"), width).write.parquet(path)
    spans = spark.read.parquet(path)
    # only texts that a bitmap of the documents with spans lets through are shuffled to them
    key = F.xxhash64("doc_id", "mark")
    told = passes(own, key, *key_filter(spans.select("doc_id", "mark"), key))
    touched = told.where("__pass").join(spans, ["doc_id", "mark"], "left").select("doc_id", "text", "spans")
    marked = told.where("not __pass").select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")).unionByName(touched)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            total, removed, digests, kept_texts = [], [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = words_of(text)
                kept = words
                if spans:
                    edges = np.zeros(len(words) + 1, np.int64)
                    for s in spans:
                        edges[s["from"]] += 1
                        edges[s["to"]] -= 1
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
                body = b" ".join(kept)
                total.append(len(words))
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(body).hexdigest())
                if keep_text:
                    kept_texts.append(body.decode("utf-8", "surrogatepass"))
            columns = {"doc_id": batch.column(0).cast(pa.int64()), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
            return pa.RecordBatch.from_pydict(columns | ({"kept": pa.array(kept_texts, pa.string())} if keep_text else {}))

        return work

    return map_batches(marked, make, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)


def op7_substring_dedup(docs: DataFrame) -> DataFrame:
    return drop_repeated_passages(docs)
