"""FM-index over sequences of integer symbols, with a wavelet matrix, searched for many patterns at once.

The index keeps packed bits and rank counts, the documents of the suffixes, and a sample of their positions; the text and
the suffix array, from which it is made, are not kept.
"""

from __future__ import annotations

import numpy as np

_WORD = np.uint64(64)


class BitRank:
    """Packed bits with a running count for each 64 of them."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.uint32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block].astype(np.int64) + np.bitwise_count(self.words[block] & mask)


class WaveletMatrix:
    """rank(symbol, position) over a sequence of symbols below 2**levels."""

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        self.levels, self.rows, self.zeros = levels, [], []
        for level in range(levels - 1, -1, -1):
            bits = (symbols >> level) & 1
            self.rows.append(BitRank(bits.astype(np.uint8)))
            self.zeros.append(int(len(bits) - bits.sum()))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def symbols(self, at: np.ndarray) -> np.ndarray:
        """The symbols at these positions."""
        at, out = at.copy(), np.zeros(len(at), np.int64)
        for k, row in enumerate(self.rows):
            ones = row.ones(at)
            one = row.ones(at + 1) > ones
            out = (out << 1) | one
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return out

    def ranks(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each symbol, the occurrences before ``low`` and before ``high``."""
        start = np.zeros(len(symbols), np.int64)
        for k, row in enumerate(self.rows):
            one = ((symbols >> (self.levels - 1 - k)) & 1).astype(bool)
            for x in (start, low, high):
                ones = row.ones(x)
                x[:] = np.where(one, self.zeros[k] + ones, x - ones)
        return low - start, high - start


def symbols_per_key(top: int) -> int:
    """How many symbols up to ``top`` fit into 63 bits; three for all but huge vocabularies."""
    return 3 if top < 2**21 else 2


def _packed(text: np.ndarray, at: np.ndarray, per: int) -> np.ndarray:
    """Some symbols in one integer; those behind a 0 count as 0."""
    out = last = text[np.minimum(at, len(text) - 1)]
    for k in range(1, per):
        last = np.where(last > 0, text[np.minimum(at + k, len(text) - 1)], 0)
        out = (out << np.int64(63 // per)) | last
    return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of ``text`` (ending in 0) by their suffixes up to the first 0, ties by position."""
    per = symbols_per_key(int(text.max(initial=0)))
    tail = np.int64(2 ** (63 // per) - 1)
    key = _packed(text, np.arange(len(text)), per)
    order = np.argsort(key, kind="stable")
    key = key[order]
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
    live = (key & tail) > 0
    depth = per
    while True:
        same = np.concatenate([[False], group[1:] == group[:-1], [False]])
        rest = np.flatnonzero((same[1:] | same[:-1]) & live)
        if not len(rest):
            return order
        key = _packed(text, order[rest] + depth, per)
        by = np.lexsort((order[rest], key, group[rest]))
        old, key = group[rest][by], key[by]
        order[rest] = order[rest][by]
        live = np.zeros(len(text), bool)
        live[rest] = (key & tail) > 0
        fresh = np.concatenate([[False], (key[1:] != key[:-1]) & (old[1:] == old[:-1])])
        step = np.zeros(len(text), np.int64)
        step[rest] = fresh
        boundary = np.concatenate([[0], (group[1:] != group[:-1]).astype(np.int64)])
        group = np.cumsum(boundary + step)
        depth += per


class RangeMinimum:
    """The least of values[a:b], from the minima of all runs whose length is a power of two."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = [values]
        while 2 ** len(self.rows) <= len(values):
            last, half = self.rows[-1], 2 ** (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For a < b."""
        level = np.frexp(b - a)[1] - 1
        out = np.empty(len(a), self.rows[0].dtype)
        for k in np.unique(level):
            own = np.flatnonzero(level == k)
            row = self.rows[k]
            out[own] = np.minimum(row[a[own]], row[b[own] - (1 << int(k))])
        return out


class FMIndex:
    """Index of symbol sequences, each ended by a 0; ``owner`` names the document of each position."""

    SAMPLE = 16

    def __init__(self, text: np.ndarray, owner: np.ndarray | None = None) -> None:
        order = suffix_order(text)
        self.size = len(text)
        top = int(text.max(initial=0)) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top))])
        last = text[order - 1]
        self.tree = WaveletMatrix(last, max(1, top.bit_length()))
        # positions are known at every SAMPLE-th place and at the sequences' starts, where the walk back ends
        known = (order % self.SAMPLE == 0) | (last == 0)
        self.sampled, self.positions = BitRank(known.astype(np.uint8)), order[known].astype(np.uint32 if len(text) < 2**32 else np.int64)
        self.owners = RangeMinimum(np.zeros(len(text), np.int32) if owner is None else owner[order])

    @property
    def suffixes(self) -> np.ndarray:
        return self.locate(np.arange(self.size))

    def locate(self, ranks: np.ndarray) -> np.ndarray:
        """Positions in the text of the suffixes of these ranks, by walking back to a known one."""
        at, walked = ranks.copy(), np.zeros(len(ranks), np.int64)
        todo = np.arange(len(ranks))
        while True:
            todo = todo[self.sampled.ones(at[todo] + 1) == self.sampled.ones(at[todo])]
            if not len(todo):
                return self.positions[self.sampled.ones(at)].astype(np.int64) + walked
            symbol = self.tree.symbols(at[todo])
            at[todo] = self.before[symbol] + self.tree.ranks(symbol, at[todo].copy(), at[todo].copy())[0]
            walked[todo] += 1

    def longest_before(self, text: np.ndarray, end: np.ndarray, most: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics: the longest text[end - n + 1 : end + 1], n <= ``most``, that stands in a document less than ``below``.

        Backward search from each end, as far as the run of suffixes still holds such a document.  Gives n, and the least
        document of the longest match (``below`` itself where there is none).
        """
        symbol = text[end]
        low, high = self.before[symbol], self.before[symbol + 1]
        length, least, live = np.zeros(len(end), np.int64), below.copy(), np.arange(len(end))
        a, b = low, high
        while True:
            first = self.owners.least(a, b)
            good = first < below[live]
            live, a, b = live[good], a[good], b[good]
            length[live] += 1
            least[live] = first[good]
            more = length[live] < most[live]
            live, a, b = live[more], a[more], b[more]
            symbol = text[end[live] - length[live]]
            base = self.before[symbol]
            a, b = self.tree.ranks(symbol, a, b)
            a, b = base + a, base + b
            some = a < b
            live, a, b = live[some], a[some], b[some]
            if not len(live):
                return length, least

    def search(self, pattern_at: np.ndarray, text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search for text[p : p + length] for each p in ``pattern_at``.

        Gives the run of suffixes and the matching statistic: how much of the pattern's end occurs.
        """
        m = len(pattern_at)
        low, high = np.zeros(m, np.int64), np.full(m, self.size, np.int64)
        matched = np.zeros(m, np.int64)
        live = np.arange(m)
        for k in range(length - 1, -1, -1):
            symbol = text[pattern_at[live] + k]
            a, b = self.tree.ranks(symbol, low[live], high[live])
            base = self.before[symbol]
            low[live], high[live] = base + a, base + b
            live = live[a < b]
            matched[live] += 1
            if not len(live):
                break
        return low, high, matched
