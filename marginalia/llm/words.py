"""Vectorised tokenising and hashing of whole texts, for use inside Spark tasks.

Texts are laid end to end in one byte buffer and cut into words by a byte class, so
that a batch of documents becomes a few numpy arrays.  Hashes are 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text stands alone.
CHUNK_BYTES = 1_000_000
#: Bytes of text that are hashed at once; a longer word stands alone.
HASHED_BYTES = 64_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEP = _U(0xD6E8FEB86659FD93)


def _byte_class(separators: Sequence[tuple[int, int]]) -> np.ndarray:
    is_word = np.ones(256, bool)
    for low, high in separators:
        is_word[low : high + 1] = False
    return is_word


#: ``[^\x20\x09-\x0D]+``
SPACED = _byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, meant for lower-cased texts
ALNUM = _byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: ASCII letters, and whatever is not ASCII
LETTERS = _byte_class([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every other."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_powers = np.ones(1, _U), np.ones(1, _U)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, HASHED_BYTES)
        with np.errstate(over="ignore"):
            up, down = np.full(size, _BASE, _U), np.full(size, _INVERSE, _U)
            up[0] = down[0] = 1
            _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


@dataclass
class Words:
    """Words of a few documents: byte spans in ``buffer``; those of document d are first[d]:first[d+1]."""

    buffer: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        out, i = np.empty(len(self.starts), _U), 0
        while i < len(out):
            # a block of whole words at a time, whose arrays stay in a core's cache
            a = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, a + HASHED_BYTES, "right")))
            size = self.ends[j - 1] - a
            up, down = _power_tables(size)
            run = np.zeros(size + 1, _U)
            with np.errstate(over="ignore"):
                np.cumsum(_BYTE[self.buffer[a : a + size]] * up[:size], out=run[1:])
                starts, ends = self.starts[i:j] - a, self.ends[i:j] - a
                out[i:j] = (run[ends] - run[starts]) * down[starts]
            i = j
        with np.errstate(over="ignore"):
            return mix(out)

    def word(self, i: int) -> bytes:
        return self.buffer[self.starts[i] : self.ends[i]].tobytes()

    def lines(self, chosen: np.ndarray) -> bytes:
        """The chosen words, a line end behind each."""
        sizes = self.ends[chosen] - self.starts[chosen] + 1  # the byte behind a word is in the buffer too
        stops = np.cumsum(sizes)
        out = self.buffer[np.repeat(self.starts[chosen] - (stops - sizes), sizes) + np.arange(sizes.sum())]
        out[stops - 1] = 10
        return out.tobytes()


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct hashes, where each is first, and which of them is where: np.unique, by a hash table and not a sort of all."""
    coded = pa.array(hashes).dictionary_encode()
    found, codes = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    order = np.argsort(found)
    rank = np.empty(len(found), np.int64)
    rank[order] = np.arange(len(found))
    where = np.empty(len(found), np.int64)
    where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return found[order], where[order], rank[codes]


def encode(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def split_words(raw: Sequence[bytes], is_word: np.ndarray) -> Words:
    """Cut encoded texts (lower-cased or not, as the caller likes) into words."""
    joined = b"\n" + b"\n".join(raw) + b"\n"
    buffer = np.frombuffer(joined, np.uint8)
    inside = is_word[buffer]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    bounds = np.cumsum([1] + [len(x) + 1 for x in raw])
    return Words(buffer, starts, ends, np.searchsorted(starts, bounds))


def chunks(texts: Sequence[str | None], lower: bool, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs [i, j) of the texts with about ``size`` bytes together, encoded."""
    start, held, total = 0, [], 0
    for k, text in enumerate(texts):
        raw = encode(text if isinstance(text, str) else None)
        if held and total + len(raw) > size:
            yield start, k, held
            start, held, total = k, [], 0
        held.append(raw.lower() if lower else raw)
        total += len(raw)
    if held:
        yield start, start + len(held), held


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (positions too near the end are left out)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        out = hashes[:m].copy()
        for k in range(1, n):
            out *= _STEP
            out += hashes[k : k + m]
        return mix(out)


def inside_documents(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Of the positions that grams() covers: does the gram end in its own document?"""
    ok = np.ones(max(0, total - n + 1), bool)
    for end in first[1:-1]:
        ok[max(0, end - n + 1) : end] = False
    return ok


def covered(n_words: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Marks the words that any of the spans [start, start+length) covers."""
    delta = np.zeros(n_words + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + lengths, -1)
    return np.cumsum(delta[:-1]) > 0
