"""Token counts that follow edits: a segment tree of counts over pre-token aligned leaves of each document."""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_batches, narrow

#: What the default query edits: runs of four or more digits, and mail addresses.
REDACT = r"[0-9]{4,}|[A-Za-z0-9._+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"


def byte_bpe(path: str | None = None) -> Callable[[str], list[int]]:
    """The encoder of a rank file, with its vocabulary's own pre-token pattern; text never counts as a special token."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("specto", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def can_cut(text: str, at: int) -> bool:
    """Whether a pre-token must begin at a character whatever stands further away: a lone space between two other characters."""
    return 0 < at < len(text) - 1 and text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace()


class CountedText:
    """A text in leaves of about `leaf` characters, cut where pre-tokens must begin, and a tree of their token counts.

    Node 1 is the root; the children of node i are 2i and 2i + 1; the leaves stand at the end. Edits are applied from
    the last to the first, so earlier offsets hold. An edit touches the leaves it overlaps; a neighbour is drawn in
    where the new characters beside a cut no longer allow it. Only those leaves are encoded again.
    """

    def __init__(self, text: str, encode: Callable[[str], list[int]], leaf: int = 256) -> None:
        self.encode, self.leaf, self.encoded = encode, leaf, 0
        self.leaves = self.split(text)
        self.build([self.count(x) for x in self.leaves])

    def split(self, text: str) -> list[str]:
        cuts, at = [0], self.leaf
        while at < len(text) - 1:
            at = text.find(" ", at)
            if at < 0:
                break
            if can_cut(text, at):
                cuts.append(at)
                at += self.leaf
            else:
                at += 1
        return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]

    def count(self, text: str) -> int:
        self.encoded += len(text)
        return len(self.encode(text))

    def build(self, counts: list[int]) -> None:
        self.size = 1 << max(0, (len(counts) - 1).bit_length())
        self.tree = [0] * self.size + counts + [0] * (self.size - len(counts))
        for i in range(self.size - 1, 0, -1):
            self.tree[i] = self.tree[2 * i] + self.tree[2 * i + 1]
        self.starts = [0]
        for x in self.leaves[:-1]:
            self.starts.append(self.starts[-1] + len(x))

    def put(self, i: int, count: int) -> None:
        """Sets the count of a leaf and the sums above it."""
        i += self.size
        change = count - self.tree[i]
        while i and change:
            self.tree[i] += change
            i //= 2

    @property
    def total(self) -> int:
        return self.tree[1]

    def fits(self, left: str, right: str) -> bool:
        return can_cut(left[-1:] + right[:2], 1)

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces spans of the text (ordered, apart from each other) and brings the counts up to date."""
        merged = False
        for start, stop, new in reversed(edits):
            a = bisect_right(self.starts, start) - 1
            b = max(a, bisect_right(self.starts, max(start, stop - 1)) - 1)
            base = self.starts[a]
            text = "".join(self.leaves[a : b + 1])
            text = text[: start - base] + new + text[stop - base :]
            while a > 0 and not self.fits(self.leaves[a - 1], text):
                a -= 1
                text = self.leaves[a] + text
            while b < len(self.leaves) - 1 and not self.fits(text, self.leaves[b + 1]):
                b += 1
                text += self.leaves[b]
            # leaves drawn in stay as empty ones till the end, so that no other leaf moves in the tree meanwhile
            self.leaves[a] = text
            self.put(a, self.count(text))
            for i in range(a + 1, b + 1):
                self.leaves[i] = ""
                self.put(i, 0)
            merged |= b > a
        if merged:
            kept = [i for i, x in enumerate(self.leaves) if x] or [0]
            counts = [self.tree[self.size + i] for i in kept]
            self.leaves = [self.leaves[i] for i in kept]
            self.build(counts)

    def text(self) -> str:
        return "".join(self.leaves)


def edited_counts(docs: DataFrame, pattern: str = REDACT, replacement: str = "[removed]", path: str | None = None, leaf: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of every whole text before and after its edits (each match of `pattern` becomes `replacement`).

    doc_id, n_tokens, n_edits, n_tokens_edited, and n_chars_encoded_again, the characters in leaves that edits touched.
    No shuffle. A null text counts as empty: no tokens, no edits. Repeated rows give repeated rows, an empty table none.
    """

    def make():
        encode, find = byte_bpe(path), regex.compile(pattern).finditer

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in batch.column(1).to_pylist():
                own = CountedText(text, encode, leaf)
                before, read = own.total, own.encoded
                edits = [(m.start(), m.end(), replacement) for m in find(text)]
                own.edit(edits)
                rows.append((before, len(edits), own.total, own.encoded - read))
            names = ["n_tokens", "n_edits", "n_tokens_edited", "n_chars_encoded_again"]
            return pa.RecordBatch.from_pydict({"doc_id": batch.column(0).cast(pa.int64())} | {n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})

        return work

    return map_batches(narrow(docs, id_col, text_col), make, "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_chars_encoded_again long")
