"""An FM-index over word numbers: suffix array, Burrows-Wheeler transform in a wavelet matrix of packed bits, backward search in lanes."""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes by doubling the compared length until all differ. The text must end with a symbol of its own."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key)
        own = key[order]
        rank[order] = np.cumsum(np.append(0, own[1:] != own[:-1]))
        if rank[order[-1]] == n - 1 or k >= n:
            return order
        k *= 2


class WaveletMatrix:
    """Rank queries on a sequence of numbers: a level for each bit, 64 bits to a word, with the ones before each word counted."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = max(1, int(values.max(initial=1)).bit_length())
        self.n = len(values)
        self.words, self.before, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            words = np.zeros(self.n // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            self.words.append(words)
            self.before.append(np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]).astype(np.int32))
            self.zeros.append(self.n - int(bit.sum()))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def ones(self, level: int, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        mask = (ONE << (i & 63).astype(np.uint64)) - ONE
        return self.before[level][at] + np.bitwise_count(self.words[level][at] & mask)

    def ranks(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol stands before lo and before hi, counted from the first place of the symbol."""
        k = len(symbols)
        ends = np.concatenate((lo, hi, np.zeros(k, lo.dtype)))
        for level in range(self.levels):
            ones = self.ones(level, ends)
            bit = np.tile((symbols >> (self.levels - 1 - level)) & 1, 3).astype(bool)
            ends = np.where(bit, self.zeros[level] + ones, ends - ones)
        start = ends[2 * k :]
        return ends[:k] - start, ends[k : 2 * k] - start


def minima(values: np.ndarray, levels: int) -> list[np.ndarray]:
    """The smallest of each stretch of 1, 2, 4, ... values, for up to so many doublings."""
    out = [values]
    while len(out) <= levels and 1 << len(out) <= len(values):
        half = 1 << (len(out) - 1)
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


class LowestOwner:
    """Smallest owner of a stretch of rows: by doublings up to a block of 2^BLOCK rows, and by doublings over whole blocks beyond it."""

    BLOCK = 4

    def __init__(self, owner: np.ndarray) -> None:
        self.near = minima(owner, self.BLOCK)
        size = 1 << self.BLOCK
        whole = owner[: len(owner) // size * size].reshape(-1, size)
        self.far = minima(whole.min(1), 32) if len(whole) else []

    @staticmethod
    def over(tables: list[np.ndarray], lo: np.ndarray, hi: np.ndarray, most: int) -> np.ndarray:
        """Minimum of two stretches of a power of two that cover lo to hi."""
        level = np.minimum(np.frexp((hi - lo).astype(np.float64))[1] - 1, most)
        out = np.empty(len(lo), np.int32)
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(tables[k][lo[at]], tables[k][hi[at] - (1 << k)])
        return out

    def query(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out = self.over(self.near, lo, hi, self.BLOCK)  # all of a short stretch, both ends of a long one
        first, last = (lo + (1 << self.BLOCK) - 1) >> self.BLOCK, hi >> self.BLOCK
        long = np.flatnonzero((hi - lo > 2 << self.BLOCK) & (first < last))
        if len(long):
            out[long] = np.minimum(out[long], self.over(self.far, first[long], last[long], 32))
        return out


class FmIndex:
    """Segments of word numbers (1 and up), each owned by a document; search tells whether a smaller document holds what was read."""

    def __init__(self, segments: list[np.ndarray], owners: np.ndarray) -> None:
        sizes = np.array([len(s) for s in segments])
        ends = np.cumsum(sizes + 1)
        marks = len(segments)
        text = np.zeros(int(ends[-1]), np.int64)
        for s, end in zip(segments, ends.tolist(), strict=True):
            text[end - 1 - len(s) : end - 1] = s + (marks - 1)
        text[ends - 1] = np.arange(marks)  # each segment ends with a mark of its own, smaller than any word
        order = suffix_array(text)
        text = np.maximum(text - (marks - 1), 0)  # from here on all marks are 0
        symbols = text[order - 1]
        self.n = len(text)
        self.tree = WaveletMatrix(symbols)
        self.first = np.searchsorted(text[order], np.arange(int(text.max()) + 2)).astype(np.int64)
        owner = np.repeat(owners, sizes + 1)[order].astype(np.int32)
        self.low = LowestOwner(owner)

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of each pattern with one more word before it; none for 0, a word that isn't in the index."""
        a, b = self.tree.ranks(symbols, lo, hi)
        return self.first[symbols] + a, self.first[symbols] + np.where(symbols > 0, b, a)

    def smallest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The smallest owner of rows lo to hi, which aren't empty."""
        return self.low.query(lo, hi)


def matched_windows(index: FmIndex, segments: list[np.ndarray], owners: np.ndarray, width: int) -> list[np.ndarray]:
    """For each segment, where windows of `width` words begin that stand in a segment of a smaller owner.

    A lane per segment reads it backward from the end of its last undecided window for as long as a smaller owner holds
    what was read: its matching statistics from that end. Where word q ends a match, windows over q are decided in one
    go if a few words from q on have no match; 2, 8, 32 of them are tried.
    """
    lanes = len(segments)
    base = np.cumsum([0, *(len(s) for s in segments)])[:-1]
    words = np.concatenate(segments)
    out: list[list[tuple[int, int]]] = [[] for _ in range(lanes)]
    nxt = np.array([len(s) for s in segments]) - width  # the last undecided window
    end = nxt + width
    pos, lo, hi = end - 1, np.zeros(lanes, np.int64), np.full(lanes, index.n, np.int64)
    probe, q, m = np.zeros(lanes, bool), np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    live = np.flatnonzero(nxt >= 0)
    while len(live):
        a, b = index.extend(words[base[live] + pos[live]], lo[live], hi[live])
        good = a < b
        good[good] = index.smallest(a[good], b[good]) < owners[live[good]]
        lo[live], hi[live] = a, b
        on, off = live[good], live[~good]
        pos[on] -= 1
        whole = on[~probe[on] & (pos[on] < 0)]  # read to the start: all windows left match
        for i in whole.tolist():
            out[i].append((0, int(nxt[i]) + 1))
        nxt[whole] = -1
        passed = on[probe[on] & (pos[on] < q[on])]  # these few words do have a match: try more
        m[passed] *= 4
        scan = off[~probe[off]]
        for i in scan[pos[scan] < nxt[scan]].tolist():
            out[i].append((int(pos[i]) + 1, int(nxt[i]) + 1))
        q[scan], m[scan], probe[scan] = pos[scan], 2, True
        missed = off[~np.isin(off, scan, assume_unique=True)]
        again = np.concatenate((passed, scan))
        spent = again[q[again] + m[again] >= end[again]]
        more = again[q[again] + m[again] < end[again]]
        pos[more] = q[more] + m[more] - 1
        lo[more], hi[more] = 0, index.n
        done = np.concatenate((missed, spent))
        reach = np.minimum(q[done] + m[done], end[done])
        nxt[done] = np.minimum(np.minimum(q[done], nxt[done] - 1), reach - width - 1)
        end[done] = nxt[done] + width
        pos[done] = end[done] - 1
        lo[done], hi[done], probe[done] = 0, index.n, False
        live = live[nxt[live] >= 0]
    return [np.concatenate([np.arange(a, b) for a, b in spans]) if spans else np.zeros(0, np.int64) for spans in out]
