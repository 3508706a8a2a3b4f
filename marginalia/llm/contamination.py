"""Benchmark decontamination with suffix arrays over the training documents.

Each task lays the words of some documents end to end (a shard) and sorts the suffixes into a
suffix array.  Every suffix of a benchmark item that holds a whole window is looked up in it by
binary search, which gives all places of the window and the longest verbatim match from there.
Words are ranked by the benchmark's vocabulary; any other word has rank 0 and ends a match.
Suffixes whose first words begin no benchmark suffix are left out of the array: no search
would reach them.  Nothing is shuffled; only the benchmark travels, in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .columns import add_struct, free_name

WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
HIT_SHARE = 20
#: Text of the benchmark that is broadcast at once; a larger benchmark takes more passes.
BLOCK_BYTES = 4_000_000
#: Text of the documents of one suffix array.
SHARD_BYTES = 1_000_000

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])), False),
        T.StructField("items", T.ArrayType(T.StringType()), False),
        T.StructField("longest", T.LongType(), False),
        T.StructField("longest_at", T.LongType()),
    ]
)


@dataclass
class TestSuffixes:
    """A block of the benchmark: word ranks laid end to end, and the distinct suffixes of its items that hold a window."""

    vocabulary: np.ndarray
    ranks: np.ndarray
    starts: np.ndarray  # of each distinct suffix
    lengths: np.ndarray  # of the window that it begins with
    leads: np.ndarray  # sorted codes of their first words
    group: np.ndarray  # of suffixes that the same items hold
    groups: list[tuple[str, ...]]  # those items
    depth: int  # words in the longest item
    per: int  # ranks that one 64-bit code holds

    @classmethod
    def of(cls, rows: list[tuple[object, str | None]], window: int) -> "TestSuffixes":
        raw = [W.encode(text).lower() for _, text in rows]
        found = W.split_words(raw, W.ALNUM)
        vocabulary, ranks = np.unique(found.hashes(), return_inverse=True)
        padded = _spaced(ranks.astype(np.int64) + 1, found, window)
        suffixes: dict[tuple[int, int], int] = {}
        starts, lengths, items = [], [], []
        for d, (item, _) in enumerate(rows):
            a, b = found.first[d], found.first[d + 1]
            names = _suffix_names(ranks[a:b].tolist())
            for i in range(a, max(a, b - window) + 1 if b > a else a):
                k = suffixes.setdefault((names[i - a], int(b - i)), len(suffixes))
                if k == len(starts):
                    starts.append(i + d)
                    lengths.append(min(i + window, b) - i)
                    items.append(set())
                items[k].add(str(item))
        starts, lengths = np.array(starts, np.int64), np.array(lengths, np.int64)
        per = ranks_per_code(len(vocabulary) + 1)
        leads = np.unique(_lead(padded, starts, lengths, per)) if len(starts) else starts
        groups: dict[tuple[str, ...], int] = {}
        group = np.array([groups.setdefault(tuple(sorted(x)), len(groups)) for x in items], np.int64)
        return cls(vocabulary, padded, starts, lengths, leads, group, list(groups), int(max(found.counts, default=0)), per)


def _suffix_names(ranks: list[int]) -> list[int]:
    """A hash of each suffix of the ranks."""
    out, h = [0] * len(ranks), 0
    for i in range(len(ranks) - 1, -1, -1):
        h = (h * 0x9E3779B97F4A7C15 + ranks[i] + 1) % (2**89 - 1)
        out[i] = h
    return out


def _spaced(ranks: np.ndarray, found: W.Words, window: int) -> np.ndarray:
    """Ranks with a 0 after each text and some more at the end."""
    out = np.zeros(len(ranks) + len(found.first) + window + 3, np.int64)
    out[np.arange(len(ranks)) + found.doc_of()] = ranks
    return out


def ranks_per_code(top: int) -> int:
    """How many ranks up to ``top`` fit into 63 bits; three for all but huge vocabularies."""
    return 3 if top < 2**21 else 2


def _pack(ranks: np.ndarray, at: np.ndarray, per: int) -> np.ndarray:
    at = np.minimum(at, len(ranks) - per)
    code = ranks[at]
    for k in range(1, per):
        code = (code << np.int64(63 // per)) | ranks[at + k]
    return code


def _lead(ranks: np.ndarray, at: np.ndarray, lengths: np.ndarray, per: int) -> np.ndarray:
    """Code of the first ``per`` words; of fewer, if the window has fewer, with the others 0."""
    keep = np.array([0, *[-1 << (63 // per * (per - n)) for n in range(1, per + 1)]], np.int64)[np.minimum(lengths, per)]
    return _pack(ranks, at, per) & keep


def suffix_array(ranks: np.ndarray, at: np.ndarray, depth: int, per: int) -> np.ndarray:
    """``at`` in the order of the suffixes that begin there, as far as ``depth`` words or the first 0."""
    key = _pack(ranks, at, per)
    order = at[np.argsort(key, kind="stable")]
    key = np.sort(key, kind="stable")
    group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).astype(np.int64)])) if len(key) else key
    for done in range(per, depth, per):
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = group[1:] == group[:-1]
        open_ = np.flatnonzero((same[1:] | same[:-1]) & (ranks[np.minimum(order + done - 1, len(ranks) - 1)] > 0))
        if not len(open_):
            break
        key = _pack(ranks, order[open_] + done, per)
        by = np.lexsort((key, group[open_]))
        order[open_] = order[open_][by]
        key, old = key[by], group[open_]
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (old[1:] != old[:-1])])
        group = group * len(order)
        group[open_] += np.cumsum(fresh)
        group = np.unique(group, return_inverse=True)[1]
    return order


def _narrow(column: np.ndarray, low: np.ndarray, high: np.ndarray, value: np.ndarray, right: bool) -> np.ndarray:
    """Binary search for each value in its own sorted run column[low:high]."""
    low, high = low.copy(), high.copy()
    while (todo := low < high).any():
        middle = (low + high) // 2
        seen = column[np.minimum(middle, len(column) - 1)]
        left = todo & ((seen <= value) if right else (seen < value))
        low = np.where(left, middle + 1, low)
        high = np.where(todo & ~left, middle, high)
    return low


class Shard:
    """Suffix array of the words of some documents, for one block of the benchmark."""

    def __init__(self, found: W.Words, hashes: np.ndarray, test: TestSuffixes, window: int) -> None:
        slot = np.minimum(np.searchsorted(test.vocabulary, hashes), max(0, len(test.vocabulary) - 1))
        known = test.vocabulary[slot] == hashes if len(test.vocabulary) else np.zeros(len(hashes), bool)
        self.ranks = _spaced(np.where(known, slot + 1, 0), found, window)
        at = np.flatnonzero(self.ranks)
        reachable = np.zeros(len(at), bool)
        for n in np.unique(np.minimum(test.lengths, test.per)):
            lead = _lead(self.ranks, at, np.full(len(at), n), test.per)
            k = np.minimum(np.searchsorted(test.leads, lead), len(test.leads) - 1)
            reachable |= test.leads[k] == lead
        self.suffixes = suffix_array(self.ranks, at[reachable], test.depth, test.per)

    def search(self, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each window: the run of suffixes that begin with it, and how far the longest match from there goes."""
        sa, m = self.suffixes, len(test.starts)
        low, high = np.zeros(m, np.int64), np.full(m, len(sa), np.int64)
        longest = np.zeros(m, np.int64)
        live = np.arange(m) if len(sa) else np.zeros(0, np.int64)
        for d in range(test.depth):
            value = test.ranks[np.minimum(test.starts[live] + d, len(test.ranks) - 1)]
            live, value = live[value > 0], value[value > 0]  # the item has ended
            if not len(live):
                break
            column = self.ranks[np.minimum(sa + d, len(self.ranks) - 1)]
            a = _narrow(column, low[live], high[live], value, right=False)
            b = _narrow(column, low[live], high[live], value, right=True)
            within = d < test.lengths[live]  # beyond the window only the length of the match counts
            low[live[within]], high[live[within]] = a[within], b[within]
            if not within.all():
                return self._extend(test, low, high, longest, d)
            live = live[a < b]
            longest[live] = d + 1
        return low, high, longest

    def _extend(self, test: TestSuffixes, low: np.ndarray, high: np.ndarray, longest: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All windows of fewer words than d have ended; go on with the others, one word at a time."""
        sa = self.suffixes
        a, b = low.copy(), high.copy()
        live = np.flatnonzero((a < b) & (longest >= np.minimum(d, test.lengths)))
        for d in range(d, test.depth):
            value = test.ranks[np.minimum(test.starts[live] + d, len(test.ranks) - 1)]
            live, value = live[value > 0], value[value > 0]
            if not len(live):
                break
            column = self.ranks[np.minimum(sa + d, len(self.ranks) - 1)]
            x, y = _narrow(column, a[live], b[live], value, right=False), _narrow(column, a[live], b[live], value, right=True)
            inside = d < test.lengths[live]
            low[live[inside]], high[live[inside]] = x[inside], y[inside]
            a[live], b[live] = x, y
            live = live[x < y]
            longest[live] = d + 1
        return low, high, longest


def _occurrences(shard: Shard, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every place where a window begins: the window, the place among the ranks, and the words that agree from there."""
    low, high, longest = shard.search(test)
    k = np.flatnonzero((low < high) & (longest >= test.lengths))
    sizes = high[k] - low[k]
    window = np.repeat(k, sizes)
    places = shard.suffixes[np.arange(len(window)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low[k], sizes)]
    agree = test.lengths[window].copy()
    live = np.flatnonzero(longest[window] > agree)
    while len(live):
        value = test.ranks[np.minimum(test.starts[window[live]] + agree[live], len(test.ranks) - 1)]
        seen = shard.ranks[np.minimum(places[live] + agree[live], len(shard.ranks) - 1)]
        live = live[(value > 0) & (value == seen)]
        agree[live] += 1
    return window, places, agree


def _search_texts(texts: list, before: list, test: TestSuffixes, window: int) -> dict[str, list]:
    out: dict[str, list] = {f.name: [] for f in FOUND}
    for i, j, raw in W.chunks(texts, lower=True, size=SHARD_BYTES):
        found = W.split_words(raw, W.ALNUM)
        items: dict[int, set[str]] = {}
        best: dict[int, tuple[int, int]] = {}
        n_all = len(found.starts)
        starts, sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(test.starts) and n_all:
            shard = Shard(found, found.hashes(), test, window)
            bounds = found.first + np.arange(len(found.first))  # of documents, among the spaced ranks
            which, places, agree = _occurrences(shard, test)
            docs = np.searchsorted(bounds, places, "right") - 1
            starts, sizes = places - docs, test.lengths[which]
            for d, group in np.unique(np.stack([docs, test.group[which]]), axis=1).T:
                items.setdefault(int(d), set()).update(test.groups[group])
            order = np.lexsort((starts, -agree, docs))
            lead = order[np.unique(docs[order], return_index=True)[1]]
            best = {int(docs[x]): (int(agree[x]), int(starts[x] - found.first[docs[x]])) for x in lead}
        old_spans = [(found.first[d] + s["start"], s["end"] - s["start"]) for d in range(j - i) if before[i + d] for s in before[i + d]["spans"]]
        if old_spans:
            starts, sizes = np.concatenate([starts, [x for x, _ in old_spans]]), np.concatenate([sizes, [x for _, x in old_spans]])
        marks = W.covered(n_all, starts, sizes)
        touched = set(np.unique(np.searchsorted(found.first, starts, "right") - 1).tolist())
        for d in range(j - i):
            old, spans = before[i + d], []
            if d in touched:
                own = np.concatenate([[False], marks[found.first[d] : found.first[d + 1]], [False]])
                edge = np.flatnonzero(own[1:] != own[:-1])
                spans = [{"start": int(a), "end": int(b)} for a, b in zip(edge[0::2], edge[1::2], strict=True)]
            most = max(best.get(d, (0, None)), (old["longest"], old["longest_at"]) if old else (0, None), key=lambda x: x[0])
            out["n_words"].append(int(found.first[d + 1] - found.first[d]))
            out["spans"].append(spans)
            out["items"].append(sorted(items.get(d, set()) | set(old["items"] if old else ())))
            out["longest"].append(most[0])
            out["longest_at"].append(most[1])
    return out


def _pieces(text: str | None, window: int, size: int) -> list[str | None]:
    """The text; a longer one than ``size`` bytes in pieces that share ``window`` - 1 words, so that no window is cut."""
    raw = W.encode(text)
    if len(raw) <= size:
        return [text]
    found = W.split_words([raw.lower()], W.ALNUM)
    out, at, n = [], 0, len(found.starts)
    while at < n:
        stop = max(int(np.searchsorted(found.ends, found.starts[at] + size, "right")), min(at + window, n))
        out.append(found.buffer[found.starts[at] : found.ends[stop - 1]].tobytes().decode("utf-8", "surrogatepass"))
        at = max(at + 1, stop - window + 1) if stop < n else n
    return out or [None]


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[TestSuffixes]:
    held, size = [], 0
    for row in benchmark.select(id_col, text_col).toLocalIterator():
        for piece in _pieces(row[1], window, block_bytes):
            more = len(W.encode(piece))
            if held and size + more > block_bytes:
                yield TestSuffixes.of(held, window)
                held, size = [], 0
            held.append((row[0], piece))
            size += more
    yield TestSuffixes.of(held, window)


def annotate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """``docs`` with a struct column of what was found, and that column's name.

    Null and empty texts have no words and no hits.  Rows are treated one by one, so repeated rows
    and repeated or null ids are kept as they are; other columns pass through.  An empty benchmark
    hits nothing.  Items of the same id count once; an item of null id is named 'None'.  An item of more than
    ``block_bytes`` is searched in pieces: its windows are all found, its longest match is taken within a piece.
    """
    name = free_name(docs, "contamination")
    out = docs
    for k, test in enumerate(benchmark_blocks(benchmark, item_col, item_text_col, window, block_bytes)):
        shared = docs.sparkSession.sparkContext.broadcast(test)
        if k == 0:
            make = lambda shared=shared: lambda texts: _search_texts(texts, [None] * len(texts), shared.value, window)
            out = add_struct(out, [text_col], name, FOUND, make)
        else:
            make = lambda shared=shared: lambda texts, old: _search_texts(texts, old, shared.value, window)
            step = add_struct(out, [text_col, name], free_name(out, f"{name}_next"), FOUND, make)
            out = step.drop(name).withColumnRenamed(step.columns[-1], name)
    return out, name


def n_hit(name: str):
    return F.aggregate(f"{name}.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def is_contaminated(name: str, share: int = HIT_SHARE):
    return (n_hit(name) > 0) & (n_hit(name) * share >= F.col(f"{name}.n_words"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose hit words are at least one in HIT_SHARE; same columns."""
    found, name = annotate(docs, benchmark, **options)
    return found.filter(~is_contaminated(name)).select(*[F.col(f"`{c}`") for c in docs.columns])


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[object, str | None]], window: int = WINDOW) -> dict[int, tuple]:
    """The same by plain comparison, for tests: doc_id -> (n_words, n_hit, n_items, digest, contaminated)."""
    cut = lambda t: W.split_words([W.encode(t).lower()], W.ALNUM)
    listed = lambda w: [w.word(i) for i in range(len(w.starts))]
    tests = [(str(i), listed(cut(t))) for i, t in items]
    out = {}
    for doc, text in docs:
        ws = listed(cut(text))
        hit, seen = set(), set()
        for item, ts in tests:
            for a in range(max(0, len(ts) - window) + 1 if ts else 0):
                win = ts[a : a + window]
                for p in range(len(ws) - len(win) + 1):
                    if ws[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        seen.add(item)
        digest = hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest()
        out[doc] = (len(ws), len(hit), len(seen), digest, bool(hit) and HIT_SHARE * len(hit) >= len(ws))
    return out
