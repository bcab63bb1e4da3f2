"""BPE encoding and decoding over a contiguous array of ranks.

A word is held as two arrays: where its parts begin, and for each pair of neighbouring parts the rank of their merge.
The smallest rank is looked for by a plain scan, the boundary between that pair is deleted, and only the two ranks
beside it are computed again. Words are short, so scans of a contiguous array beat a heap; long words go to a heap.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
import unicodedata
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_batches, narrow

NEVER = 1 << 30
LONG_WORD = 96
CACHE_WORDS = 200_000
HIGH = regex.compile("[\u0530-\U0010ffff]").search
#: The letters and numbers that Unicode 16.0 added to 15.1 (code points in base 16).
UNICODE_16 = "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d40-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b 1138e 11390-113b5 113b7 113d1 113d3 116d0-116e3 11bc0-11be0 11bf0-11bf9 13460-143fa 16100-1611d 16130-16139 16d40-16d6c 16d70-16d79 18cff 1ccf0-1ccf9 1e5d0-1e5ed 1e5f0-1e5fa"
#: The lower-case letters of Unicode 16.0 and 17.0 (first, last, first lower-case one; code points in base 16).
LOWER_16_17 = "1c89 1c89 1c8a, a7cb a7cb 264, a7cc a7cc a7cd, a7ce a7ce a7cf, a7d2 a7d2 a7d3, a7d4 a7d4 a7d5, a7da a7da a7db, a7dc a7dc 19b, 10d50 10d65 10d70, 16ea0 16eb8 16ebb"
LOWER = {c: c - a + low for a, b, low in ([int(x, 16) for x in r.split()] for r in LOWER_16_17.split(", ")) for c in range(a, b + 1)}
#: Combining marks after Unicode 9.0, which the library's NFC neither moves nor composes, and a later pair.
MARKS_AFTER_9 = "7fd 898-89f 8ca-8d3 9fe c3c d3b-d3c eba 1715 1abf-1ace 1df6-1dfa a82c 10d24-10d27 10eab-10eac 10efd-10eff 10f46-10f50 10f82-10f85 11070 1133b 1145e 11839-1183a 11930 11938 1193d-1193e 11943 119e0 11a34 11a47 11a99 11d42 11d44-11d45 11d97 11f41-11f42 16ff0-16ff1 1e08f 1e130-1e136 1e2ae 1e2ec-1e2ef 1e4ec-1e4ef"
INERT = regex.compile("([" + "".join(f"\\U{int(a, 16):08x}-\\U{int(b or a, 16):08x}" for a, _, b in (x.partition("-") for x in MARKS_AFTER_9.split())) + "])")
LETTER_OR_NUMBER = regex.compile(r"[\p{L}\p{N}]")


def byte_alphabet() -> list[str]:
    """The printable character of each byte in a byte-level vocabulary: printable bytes stand for themselves, the rest follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    own = set(shown)
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


@cache
def newer_letters() -> str:
    """Ranges, for a character class, of letters and numbers of the regex module that are newer than Unicode 16.0, the version of the tokenizers library."""
    known = {c for a, _, b in (x.partition("-") for x in UNICODE_16.split()) for c in range(int(a, 16), int(b or a, 16) + 1)}
    out = []
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c)) == "Cn" and c not in known and LETTER_OR_NUMBER.match(chr(c)):
            out.append(f"\\U{c:08x}")
    return "".join(out)


class WordBpe(dict):
    """The encoder of one tokenizer file; as a mapping it gives the ids of a word as little-endian bytes, kept for later if the word is short."""

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.ranks: dict[int, int] = {}  # by left id << 32 | right id
        self.made: list[int] = []  # what the merge of each rank makes
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.vocab[left] << 32 | self.vocab[right]] = rank
            self.made.append(self.vocab[left + right])
        self.tokens = [""] * (1 + max(max(self.vocab.values()), *(t["id"] for t in spec["added_tokens"])))
        for token, i in self.vocab.items():
            self.tokens[i] = token
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.added.items():
            self.tokens[i] = token
        self.split_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(pattern).findall
        self.newer = regex.compile(f"[{newer_letters()}]").search
        # with newer letters in a text: they are taken out of the first two classes and put into the last
        old = pattern.replace(r"[\p{L}]+", f"[[\\p{{L}}]--[{newer_letters()}]]+").replace(r"[\p{N}]", f"[[\\p{{N}}]--[{newer_letters()}]]")
        self.find_old = regex.compile(old.replace(r"[^\s\p{L}\p{N}]+", f"(?:[^\\s\\p{{L}}\\p{{N}}]|[{newer_letters()}])+"), regex.V1).findall
        alphabet = byte_alphabet()
        self.inner = [self.vocab[c] for c in alphabet]
        self.last = [self.vocab[c + self.suffix] for c in alphabet]

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.merge(word.encode("utf-8")), "<u4").tobytes()
        if len(word) <= LONG_WORD:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def merge(self, word: bytes) -> list[int]:
        parts = [self.inner[b] for b in word]
        parts[-1] = self.last[word[-1]]
        if len(parts) > LONG_WORD:
            return self.merge_long(parts)
        rank = self.ranks.get
        ranks = [rank(a << 32 | b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) != NEVER:
            at = ranks.index(best)
            parts[at] = made = self.made[best]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] << 32 | made, NEVER)
            if at < len(ranks):
                ranks[at] = rank(made << 32 | parts[at + 1], NEVER)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges in the same order by a heap over a linked list: n log n for a word of any length."""
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (rank := self.ranks.get(parts[i] << 32 | parts[j])) is not None:
                heapq.heappush(heap, (rank, i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j < 0 or parts[j] != right:
                continue
            parts[i], parts[j] = self.made[rank], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p >= 0]

    def normalise(self, text: str) -> str:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = "".join(unicodedata.normalize("NFC", part) for part in INERT.split(text))
        # runs of white space need no replacing, as the pre-tokeniser drops them
        if HIGH(text):
            text = text.translate(LOWER)
        return text.lower() if "Σ" not in text else "".join(map(str.lower, text))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Strings of added tokens count as those tokens."""
        if self.split_added and "<|" in text:
            parts = self.split_added.split(text)
            return b"".join(np.array([self.added[p]], "<u4").tobytes() if p in self.added else self.words(p) for p in parts if p)
        return self.words(text)

    def words(self, text: str) -> bytes:
        text = self.normalise(text)
        find = self.find if text.isascii() or not HIGH(text) or not self.newer(text) else self.find_old
        return b"".join(map(self.__getitem__, find(text)))

    def decode(self, ids: bytes) -> str:
        """Tokens joined by one space, as a file without a decoder asks for."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=1)
def encoder(path: str) -> WordBpe:
    """One for all tasks of a worker, one after the other: a worker that makes its own in each task holds two at times."""
    return WordBpe(path)


def bpe_roundtrip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Ids of every whole text and the text they decode to, as counts and digests (with keep_ids also the ids themselves).

    No shuffle; one text at a time, so memory is bounded by the longest text and the word cache. A null text counts as
    empty: no tokens, digests of nothing. Repeated rows give repeated rows; a null id stays null; an empty table gives none.
    Other columns are passed over. Letters, lower case and combining marks are those of the library's Unicode versions.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def make():
        bpe = encoder(path or default_path())

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, a, b, kept = [], [], [], []
            for value in batch.column(1):
                ids = bpe.encode(value.as_py())
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
                if keep_ids:
                    kept.append(ids)
            columns = {"doc_id": batch.column(0).cast(pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}
            if keep_ids:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(np.frombuffer(b"".join(kept), "<u4").astype(np.int32)))
            return pa.RecordBatch.from_pydict(columns)

        return work

    return map_batches(narrow(docs, id_col, text_col), make, schema)
