"""Removal of repeated passages, found by FM-indexes over shards of the corpus.

A window is some consecutive words of a document; it is removed where the same words also start
in a document with a smaller id.  Each window is sent to the shard that its minimizer names (the least
hash among the short word sequences within it), so equal windows meet.  Only minimizers that stand
in two documents are sent at all, with the words of their windows, equal ones of a block once.
The windows of a minimizer with many different neighbourhoods are dealt by their own words instead.
A shard builds a compressed FM-index of what it gets, each distinct piece once with the least document that
has it, and streams all pieces through it: backward search from every word gives the matching statistics against
documents with smaller ids, the longest sequence that ends there and stands in one of them.
Intervals of a window or more are reported, and go back with that document.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import words as W
from .fm_index import FMIndex

WINDOW = 13
SEED = 7
#: Distinct pieces of a seed, about, beyond which its windows are dealt one by one.
HOT_PIECES = 2**14
_NONE = np.iinfo(np.int64).max


class _Block:
    """Windows of a block of documents, grouped into pieces that share one minimizer occurrence."""

    def __init__(self, group: pa.Table) -> None:
        keys = group["key"].to_pylist()
        self.order = sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i] or 0))
        self.keys = [keys[i] for i in self.order]
        texts = group["text"].to_pylist()
        self.raw = [W.encode(texts[i]) for i in self.order]
        self.found = found = W.split_words(self.raw, W.SPACED)
        self.hashes = found.hashes()
        docs = np.array([_NONE if k is None else k for k in self.keys], np.int64)
        m = len(self.hashes) - WINDOW + 1
        self.seed = np.zeros(0, np.uint64)  # of each piece
        self.start = self.size = self.doc = np.zeros(0, np.int64)  # its first window, how many windows, the document's key
        if m <= 0:
            return
        inside = W.inside_documents(found.first, WINDOW, len(self.hashes))
        seeds = W.grams(self.hashes, SEED)
        span = WINDOW - SEED + 1
        least, at = seeds[:m].copy(), np.arange(m)
        for k in range(1, span):
            later = seeds[k : k + m]
            better = later < least
            least[better] = later[better]
            at[better] = np.arange(k, k + m)[better]
        fresh = np.concatenate([[True], (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])])
        start = np.flatnonzero(fresh)
        size = np.diff(np.append(start, m))
        real = inside[start]
        self.start, self.size = start[real], size[real]
        self.seed = least[self.start]
        self.doc = docs[found.doc_of()[self.start]]

    def repeated_here(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct seeds, and for each a code: 1 + 2 * log2 of its distinct pieces here, rounded up, + 1 if it is in two documents."""
        order = np.lexsort((self.doc, self.seed))
        seed, doc = self.seed[order], self.doc[order]
        new = np.concatenate([[True], seed[1:] != seed[:-1]])[: len(seed)]
        other = np.concatenate([[False], (seed[1:] == seed[:-1]) & (doc[1:] != doc[:-1])])[: len(seed)]
        starts = np.flatnonzero(new)
        if not len(starts):
            return seed, np.zeros(0, np.uint8)
        many = np.diff(np.append(starts, len(seed)))
        again = order[np.repeat(many > 1, many)]
        if len(again):
            first, last = self.ends(self.start[again], self.size[again])
            by = np.lexsort((last, first, self.size[again], self.seed[again]))
            same = np.stack([x[by][1:] == x[by][:-1] for x in (self.seed[again], self.size[again], first, last)]).all(0)
            seeds = self.seed[again][by][np.concatenate([[True], ~same])]
            many[many > 1] = np.unique(seeds, return_counts=True)[1]
        code = 1 + 2 * np.ceil(np.log2(many)).astype(np.int64) + (np.add.reduceat(other.astype(np.int64), starts) > 0)
        return seed[starts], code.astype(np.uint8)

    def ends(self, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first and the last window; with the size they name a piece."""
        windows = W.grams(self.hashes, WINDOW)
        return windows[start], windows[start + size - 1]

    def answers(self, replies: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct seeds, and whether they are in one document (1), in more (2), or have too many pieces for a shard (3)."""
        return X.answers_to(np.unique(self.seed), replies, np.uint8, buckets)

    def pieces(self, keys: np.ndarray, held: np.ndarray) -> "_Pieces":
        """Pieces with repeated seeds; those of hot seeds are cut into their windows, which go by their own hashes."""
        state = X.look_up(keys, held, self.seed) if len(self.seed) else np.zeros(0, np.uint8)
        cold, hot = np.flatnonzero(state == 2), np.flatnonzero(state == 3)
        n = self.size[hot]
        single = np.repeat(self.start[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = np.concatenate([self.start[cold], single])
        size = np.concatenate([self.size[cold], np.ones(len(single), np.int64)])
        doc = np.concatenate([self.doc[cold], np.repeat(self.doc[hot], n)])
        if not len(start):
            return _Pieces(start, size, doc, np.zeros(0, np.uint64), start, start)
        first, last = self.ends(start, size)
        deal = np.concatenate([self.seed[cold], first[len(cold) :]])
        order = np.lexsort((doc, last, first, size, deal))
        start, size, doc, deal, first, last = (x[order] for x in (start, size, doc, deal, first, last))
        new = np.concatenate([[True], ~np.stack([x[1:] == x[:-1] for x in (deal, size, first, last)]).all(0)])
        return _Pieces(start, size, doc, deal, np.cumsum(new) - 1, np.flatnonzero(new))


@dataclass
class _Pieces:
    """Pieces of a block by (words, document)."""

    start: np.ndarray
    size: np.ndarray
    doc: np.ndarray
    deal: np.ndarray  # names the shard
    which: np.ndarray  # the number of each distinct one
    lead: np.ndarray  # where these begin


def _ask(buckets: int, schema):
    def run(group: pa.Table) -> pa.Table:
        seeds, many = _Block(group).repeated_here()
        return X.table_of(schema, X.send(group["block"][0].as_py(), seeds, many, buckets))

    return run


def _many(hot: int):
    def solve(index: np.ndarray, code: np.ndarray, _: np.ndarray) -> np.ndarray:
        code = code.astype(np.int64) - 1
        docs, pieces = np.bincount(index, 1 + code % 2), np.bincount(index, 2.0 ** (code // 2))
        return np.where(docs < 2, 1, np.where(pieces > hot, 3, 2)).astype(np.uint8)[index]

    return solve


def _send_pieces(buckets: int, shards: int, schema):
    """Rows (block, bucket, pieces): packed size and least key of each distinct piece, and its words as places in the row's vocabulary."""

    def run(group: pa.Table, replies: pa.Table) -> pa.Table:
        out: dict[str, list] = {f.name: [] for f in schema}
        if group.num_rows:
            block = _Block(group)
            found = block.pieces(*block.answers(replies, buckets))
            bucket = X.bucket_of(found.deal[found.lead], shards)
            for b in np.unique(bucket):
                own = found.lead[bucket == b]
                n = found.size[own] + WINDOW - 1
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(found.start[own], n)
                out["block"].append(group["block"][0].as_py())
                out["bucket"].append(int(b))
                out["sizes"].append(found.size[own].astype(np.uint8).tobytes())
                out["docs"].append(found.doc[own].tobytes())
                distinct, place = np.unique(block.hashes[at], return_inverse=True)
                out["vocabulary"].append(distinct.tobytes())
                out["words"].append(place.astype(np.uint16 if len(distinct) <= 2**16 else np.uint32).tobytes())
        return X.table_of(schema, out)

    return run


def _unpacked(vocabulary: bytes, places: bytes) -> np.ndarray:
    distinct = np.frombuffer(vocabulary, np.uint64)
    return distinct[np.frombuffer(places, np.uint16 if len(distinct) <= 2**16 else np.uint32)]


def _least_of_windows(index: FMIndex, text: np.ndarray, begin: np.ndarray, n: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each window of each piece: the least document of a reported interval that holds it, or else the piece's own.

    An interval that reaches back to the piece's start covers all windows before its end, so that piece is done.
    """
    offset = np.cumsum(n - WINDOW + 1) - (n - WINDOW + 1)
    least = np.repeat(owner, n - WINDOW + 1)
    live, end = np.arange(len(n)), n - 1
    while len(live):
        length, found = index.longest_before(text, begin[live] + end[live], end[live] + 1, owner[live])
        far = np.flatnonzero(length >= WINDOW)
        many = length[far] - WINDOW + 1
        inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = np.repeat(offset[live[far]] + end[live[far]] - length[far] + 1, many) + inner
        np.minimum.at(least, at, np.repeat(found[far], many))
        live = live[(length <= end[live]) & (end[live] >= WINDOW)]
        end[live] -= 1
    return least


def _search_shard(schema):
    """Builds the shard's FM-index and answers, for each window of each piece, the least key of a document that has it."""

    def run(group: pa.Table) -> pa.Table:
        sizes = [np.frombuffer(x, np.uint8).astype(np.int64) for x in group["sizes"].to_pylist()]
        size = np.concatenate(sizes)
        doc = np.concatenate([np.frombuffer(x, np.int64) for x in group["docs"].to_pylist()])
        packed = zip(group["vocabulary"].to_pylist(), group["words"].to_pylist(), strict=True)
        words = np.concatenate([_unpacked(v, w) for v, w in packed])
        symbols = np.unique(words, return_inverse=True)[1]
        n = size + WINDOW - 1
        first = np.cumsum(n) - n
        # pieces of other blocks with the same words are one; a piece is named by two hashes of its words
        with np.errstate(over="ignore"):
            place = np.arange(len(words)) - np.repeat(first, n)
            name = np.add.reduceat(W.mix(words + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first)
        order = np.lexsort((doc, name, n))
        new = np.concatenate([[True], (name[order][1:] != name[order][:-1]) | (n[order][1:] != n[order][:-1])])
        lead = order[new]
        which = np.empty(len(n), np.int64)
        which[order] = np.cumsum(new) - 1
        # text: the distinct pieces, each ended by a 0
        ln = n[lead]
        begin = np.cumsum(ln + 1) - (ln + 1)
        text = np.zeros(int((ln + 1).sum()), np.int64)
        inner = np.arange(ln.sum()) - np.repeat(np.cumsum(ln) - ln, ln)
        text[np.repeat(begin, ln) + inner] = symbols[np.repeat(first[lead], ln) + inner] + 1
        documents, owner = np.unique(doc[lead], return_inverse=True)
        index = FMIndex(text, np.repeat(owner.astype(np.int32), ln + 1))
        count = size[lead]
        least = documents[_least_of_windows(index, text, begin, ln, owner.astype(np.int32))]
        # back to all pieces as they came
        from_ = np.cumsum(count) - count
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(from_[which], size)
        answers = np.split(least[at], np.cumsum([s.sum() for s in sizes])[:-1])
        return X.table_of(schema, {"block": group["block"].to_pylist(), "bucket": group["bucket"].to_pylist(), "least": [a.tobytes() for a in answers]})

    return run


def _apply(buckets: int, shards: int, schema):
    def run(group: pa.Table, seeds: pa.Table, found: pa.Table) -> pa.Table:
        block = _Block(group)
        own_pieces = block.pieces(*block.answers(seeds, buckets))
        removed = np.zeros(len(block.hashes), bool)
        if len(own_pieces.lead):
            lead = own_pieces.lead
            bucket, size = X.bucket_of(own_pieces.deal[lead], shards), own_pieces.size[lead]
            least = np.empty(int(size.sum()), np.int64)
            offset = np.cumsum(size) - size
            for b, raw in zip(found["bucket"].to_pylist(), found["least"].to_pylist(), strict=True):
                own = np.flatnonzero(bucket == b)
                at = np.arange(size[own].sum()) - np.repeat(np.cumsum(size[own]) - size[own], size[own]) + np.repeat(offset[own], size[own])
                least[at] = np.frombuffer(raw, np.int64)
            n, doc = own_pieces.size, own_pieces.doc
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hit = least[np.repeat(offset[own_pieces.which], n) + inner] < np.repeat(np.where(doc == _NONE, np.iinfo(np.int64).min, doc), n)
            removed = W.covered(len(removed), (np.repeat(own_pieces.start, n) + inner)[hit], WINDOW)
        out: dict[str, list] = {f.name: [] for f in schema}
        for d, key in enumerate(block.keys):
            a, b = block.found.first[d], block.found.first[d + 1]
            gone = removed[a:b]
            kept = b" ".join(block.raw[d].split()) if not gone.any() else b" ".join(block.found.word(a + i) for i in np.flatnonzero(~gone))
            out["key"].append(key)
            out["n_words"].append(int(b - a))
            out["n_removed"].append(int(gone.sum()))
            out["kept"].append(kept.decode("utf-8", "surrogatepass"))
        return X.table_of(schema, out)

    return run


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, n_words, n_removed, and the kept words joined by single spaces.

    Null and empty texts have no words.  Keys are integers; rows of the same key are not smaller
    than each other, so neither loses words to the other.  A null key is not smaller than any and
    none is smaller than it.  Very long texts are searched whole.  Other columns are dropped.  An empty table gives an empty result.
    """
    blocks, n_blocks = X.in_blocks(docs, key, text)
    buckets = max(1, n_blocks // 4)
    shards = max(1, n_blocks // 2)
    packed = X.struct(X.PACKED)
    asked = blocks.groupBy("block").applyInArrow(_ask(buckets, packed), packed)
    seeds = asked.groupBy("bucket").applyInArrow(X.answer(packed, np.uint8, _many(HOT_PIECES), echo=False), packed)
    told = seeds.select("block", "bucket", "extra")
    sent = X.struct("block long, bucket long, sizes binary, docs binary, vocabulary binary, words binary")
    pieces = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_send_pieces(buckets, shards, sent), sent)
    back = X.struct("block long, bucket long, least binary")
    least = pieces.groupBy("bucket").applyInArrow(_search_shard(back), back)
    # both kinds of answers go back to a block together
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    both = told.withColumn("least", null("binary", "least")).unionByName(least.select("block", "bucket", null("binary", "extra"), "least"))
    final = X.struct("key long, n_words long, n_removed long, kept string")
    work = _apply(buckets, shards, final)

    def apply(group: pa.Table, replies: pa.Table) -> pa.Table:
        if not group.num_rows:
            return X.table_of(final, {f.name: [] for f in final})
        return work(group, replies.filter(replies["extra"].is_valid()), replies.filter(replies["least"].is_valid()))

    out = blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(apply, final)
    return out.withColumnRenamed("key", key)


def brute_force(rows: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[tuple]:
    """The same by a dictionary of all windows, for tests."""
    cut = [W.encode(t).split() for _, t in rows]
    least: dict[tuple, int] = {}
    for (key, _), words in zip(rows, cut, strict=True):
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if key is not None:
                least[w] = min(least.get(w, key), key)
    out = []
    for (key, _), words in zip(rows, cut, strict=True):
        gone = set()
        for i in range(len(words) - window + 1):
            if key is not None and least[tuple(words[i : i + window])] < key:
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((key, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)
