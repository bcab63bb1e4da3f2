"""Harmonic packing of token sequences.

The sizes of pieces are the whole reciprocals of the capacity: capacity // k for k = 1, 2, 3, ... A piece of that size
belongs to class k, and a sequence of class k holds exactly k of them. A text is cut into the fewest such pieces, so a
full sequence wastes less than its k-th part of a token a piece. Each worker (a task) fills its own sequences of each
class while it reads; nothing is shuffled. What is left in open sequences when its rows end fills mixed sequences one
after another, the last of them cut at powers of two.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import importable, narrow

CAPACITY, END_ID = 2048, 1
PACKED = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Fixed value: the pre-token pattern of byte-level vocabularies whose file names none of its own.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def encoder(path: str) -> Callable[[str], list[int]]:
    """The ids that the tokenizers library gives for the file at `path`, added tokens in the text included, none put in.

    A plain byte-level vocabulary whose ids are its merge ranks goes to tiktoken, which gives the same ids in a third of
    the time; any other file goes to the tokenizers library.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, first = spec["model"], spec["pre_tokenizer"]
    vocab: dict[str, int] = model["vocab"]
    merged = [vocab["".join(pair if isinstance(pair, list) else pair.split(" "))] for pair in model["merges"]]
    plain = not any(spec.get(k) for k in ("normalizer", "post_processor")) and first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space")
    plain = plain and merged == list(range(256, len(vocab))) and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])
    if not plain or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
        import tokenizers

        whole = tokenizers.Tokenizer.from_file(path)
        whole.no_truncation()
        whole.no_padding()
        return lambda text: whole.encode(text, add_special_tokens=False).ids
    import tiktoken

    byte = {c: b for b, c in enumerate(byte_alphabet())}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items()}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    known = tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: known.encode(text, allowed_special="all", disallowed_special=())


@cache
def cuts(capacity: int) -> tuple[tuple[int, ...], ...]:
    """For each length under the capacity the fewest sizes of classes that add up to it, and of those the ones that waste least, largest first."""
    sizes = np.array(sorted({capacity // k for k in range(1, capacity + 1)}))
    cost = 1 + (capacity / (capacity // sizes) - sizes) / capacity
    best, last = np.zeros(capacity), np.zeros(capacity, int)
    for r in range(1, capacity):
        fit = np.searchsorted(sizes, r, "right")
        tried = best[r - sizes[:fit]] + cost[:fit]
        last[r] = sizes[at := int(tried.argmin())]
        best[r] = tried[at]
    out: list[tuple[int, ...]] = [()]
    for r in range(1, capacity):
        out.append(tuple(sorted((*out[r - last[r]], int(last[r])), reverse=True)))
    return tuple(out)


class Worker:
    """The open sequences of one task. A piece is (doc_id, start, ids as bytes, doc_tokens)."""

    def __init__(self, capacity: int, name: int) -> None:
        self.capacity, self.next = capacity, name << 32
        self.open: dict[int, list[tuple]] = {}
        self.cuts = cuts(capacity)
        self.done: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.done.append((doc, start, n, ids, total, self.next, at))
            at += n
        self.next += 1

    def add(self, doc: int | None, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        for size in (*(self.capacity,) * (total // self.capacity), *self.cuts[total % self.capacity]):
            held = self.open.setdefault(size, [])
            held.append((doc, start, ids[4 * start : 4 * (start + size)], total))
            start += size
            if len(held) == self.capacity // size:
                self.close(self.open.pop(size))

    def finish(self) -> None:
        """Whole sequences of what is left, then one for each power of two in the rest."""
        left = [p for size in sorted(self.open, reverse=True) for p in self.open.pop(size)]
        n = sum(len(p[2]) // 4 for p in left)
        rest = n % self.capacity
        sizes = [self.capacity] * (n // self.capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        left.reverse()
        for size in sizes:
            taken = []
            while size:
                doc, start, ids, total = left.pop()
                here = min(size, len(ids) // 4)
                taken.append((doc, start, ids[: 4 * here], total))
                if 4 * here < len(ids):
                    left.append((doc, start + here, ids[4 * here :], total))
                size -= here
            self.close(taken)

    def rows(self) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        names = [c.split()[0] for c in PACKED.split(", ")]
        columns = [pa.array(c, t) for c, t in zip(zip(*self.done, strict=True) if self.done else [()] * 7, kinds, strict=True)]
        self.done = []
        return pa.RecordBatch.from_arrays(columns, names=names)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all texts: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Each text's ids are followed by `end_id`; a null text counts as empty and is that one id. A null id stays null; rows
    that repeat an id or a text are packed each for itself; a text of any length is cut. Other columns are passed over. An
    empty table gives no rows. A worker's memory holds one batch of texts and less than one sequence of each class (some
    ninety classes). Sequence ids are unique but not gapless: the task's number in the upper half, a count in the lower.
    Layout follows the order of rows in a partition, and so do ties; all sequences of a worker come from one attempt of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path or default_path())
        worker = Worker(capacity, TaskContext.get().partitionId())
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                worker.add(doc, np.array([*encode(text.as_py()), end_id], "<u4").tobytes())
                if len(worker.done) >= 4096:
                    yield worker.rows()
        worker.finish()
        yield worker.rows()

    own = narrow(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text")
    importable(docs.sparkSession)
    return own.mapInArrow(run, PACKED)


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_tokens, ids of each sequence: its pieces in order, padded to the capacity unless n_tokens is a power of two.

    A sequence has no more than `capacity` ids, which bounds its group. The doc_ids tell the pieces apart for masks:
    doc_ids and starts (where in the sequence each begins). An empty table gives no rows.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("n_tokens"))
    ids = F.aggregate("parts", F.lit(b""), lambda whole, p: F.concat(whole, p["ids"]))
    full = F.when(F.bit_count("n_tokens") == 1, F.col("n_tokens")).otherwise(F.lit(capacity)) * 4
    padded = F.rpad(ids, full.cast("int"), F.lit(int(pad_id).to_bytes(4, "little")))
    return rows.select("sequence_id", "n_tokens", padded.alias("ids"), F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"), F.transform("parts", lambda p: p["offset"]).alias("starts"))


def op11_packing(docs: DataFrame) -> DataFrame:
    """The layout of pack(), with the CRC of each piece's ids in their place."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
