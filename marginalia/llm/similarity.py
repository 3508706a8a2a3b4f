"""Near-duplicate documents by an exact Jaccard join of their word shingle sets.

1. Equal sets are one node.  Each node takes the smallest of its shingle hashes, more than a
   partner may lack, and asks which of them other nodes hold as well.  If two sets of n and m shingles
   have a Jaccard similarity of t or more, they share t n of n; so of the (1 - t) n + l smallest
   at least l are shared.  Nodes for which this can't hold have no link.
2. The sets of the others are asked for the frequency of every shingle.  Nodes with less than t n
   shared shingles have no link.  With rare shingles first, linked nodes meet in an index list
   of the first n - t n + 1; the lists join nodes to clusters of candidates.
3. A cluster's sets are dealt to slices of bounded size, each with the cluster's pivot, its least node.  A slice
   compares its sets exactly, and gives every set's distance to the pivot.  Answers are derived from a similar
   set's: if r's distances to all others are known, x at distance e from r can only link with those
   at most 1 - t + e from r.
4. What a slice can't see are links between sets of different slices.  For these the index lists are skipped through:
   a list whose sets are linked already is skipped whole; in others, a posting is skipped if by size, by its
   position (how much of each set is left from there), or by its ring around the pivot no set
   of another class in the list can link with it.  What is left after ROUNDS rounds of this is clustered again and
   compared in pairs of parts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import words as W
from .components import components
from .scratch import settle

SIZE = 5
#: Links need PART * intersection >= WHOLE * union.
PART, WHOLE = 100, 80
#: Bytes of sets, and sets, of a slice of a cluster.
SLICE_BYTES, SLICE_SETS = 8_000_000, 512
#: Rounds of slices with a pivot, before the rest is compared in pairs of parts, and bytes of a part.
ROUNDS, PART_BYTES = 1, 16_000_000


def shingle_sets(texts: list[str | None], size: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; of fewer words, the whole sequence as one."""
    out: list[np.ndarray] = []
    for _, _, raw in W.chunks(texts, lower=True):
        found = W.split_words(raw, W.SPACED)
        hashes = found.hashes()
        grams = W.grams(hashes, size)
        for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
            if b - a >= size:
                g = np.sort(grams[a : b - size + 1])
                out.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
            else:
                out.append(W.grams(hashes[a:b], b - a) + np.uint64(b - a) if b > a else np.zeros(0, np.uint64))
    return out


def needed(n: np.ndarray | int):
    """Shingles of a set of n that a linked set must share."""
    return -(-n * WHOLE // PART)


def digest(s: np.ndarray) -> int:
    """63-bit name of a set."""
    with np.errstate(over="ignore"):
        return int(W.mix(np.array([np.add.reduce(W.mix(s)) * np.uint64(0x9E3779B97F4A7C15) + np.bitwise_xor.reduce(W.mix(s + np.uint64(1))) + np.uint64(len(s))]))[0] >> np.uint64(1))


def _prefix(s: np.ndarray) -> np.ndarray:
    """The smallest hashes that are asked about first: (1 - t) n + l of them, l about n / 8."""
    return s[: len(s) - needed(len(s)) + _extra(len(s))]


def _extra(n: int) -> int:
    return max(1, n // 8)


def _runs(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    sizes = last - first
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)


SETS = "key long, mark long, n long, node long, shingles binary"


def _ask(buckets: int, schema):
    def run(group: pa.Table) -> pa.Table:
        sets = {digest(s): s for s in shingle_sets(group["text"].to_pylist()) if len(s)}
        return _questions(group["block"][0].as_py(), [_prefix(s) for s in sets.values()], buckets, schema)

    return run


def _questions(block: int, sets: list[np.ndarray], buckets: int, schema) -> pa.Table:
    keys, counts = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_counts=True)
    return X.table_of(schema, X.send(block, keys, np.minimum(counts, 255).astype(np.uint8), buckets))


def _total(index: np.ndarray, counts: np.ndarray, _: np.ndarray) -> np.ndarray:
    return np.minimum(np.bincount(index, counts), 255).astype(np.uint8)[index]


def _first_sieve(schema):
    def run(group: pa.Table, replies: pa.Table) -> pa.Table:
        keys, held = X.answers_of(replies, np.uint8)
        out: dict[str, list] = {"key": group["key"].to_pylist(), "mark": group["mark"].to_pylist(), "n": [], "node": [], "shingles": []}
        seen: set[int] = set()
        for s in shingle_sets(group["text"].to_pylist()):
            node = digest(s) if len(s) else None
            # the counts are of nodes within a block; a node in many blocks is counted once for each
            keep = len(s) and node not in seen and np.count_nonzero(X.look_up(keys, held, _prefix(s)) > 1) >= _extra(len(s))
            seen.add(node)
            out["n"].append(len(s))
            out["node"].append(node)
            out["shingles"].append(s.tobytes() if keep else None)
        return X.table_of(schema, out)

    return run


def _second_sieve(schema):
    """Rows (node, n, shingle, position) of the index, and (node, n, null, null, set) for the sets that stay."""

    def run(group: pa.Table, replies: pa.Table) -> pa.Table:
        keys, held = X.answers_of(replies, np.uint8)
        out: dict[str, list] = {"node": [], "n": [], "shingle": [], "position": [], "shingles": []}
        for node, raw in zip(group["node"].to_pylist(), group["shingles"].to_pylist(), strict=True):
            s = np.frombuffer(raw, np.uint64)
            df = X.look_up(keys, held, s)
            if np.count_nonzero(df > 1) < needed(len(s)):
                continue
            first = np.lexsort((s, df))[: len(s) - needed(len(s)) + 1]
            place = np.flatnonzero(df[first] > 1)
            first = first[place]
            out["node"] += [node] * (len(first) + 1)
            out["n"] += [len(s)] * (len(first) + 1)
            out["position"] += [None, *place.tolist()]
            out["shingle"] += [None, *s[first].view(np.int64).tolist()]
            out["shingles"] += [raw, *[None] * len(first)]
        return X.table_of(schema, out)

    return run


class _Groups:
    """Disjoint groups of 0..n-1."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.members = {i: np.array([i]) for i in range(n)}

    def join(self, i: int, others: np.ndarray) -> None:
        for other in np.unique(self.label[others]):
            a, b = int(self.label[i]), int(other)
            if a != b and b in self.members:  # else it was merged just now
                if len(self.members[a]) < len(self.members[b]):
                    a, b = b, a
                self.label[self.members[b]] = a
                self.members[a] = np.concatenate([self.members[a], self.members.pop(b)])


def linked_groups(sets: list[np.ndarray]) -> np.ndarray:
    """A label for each set: equal for sets that links join."""
    n = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(flat, kind="stable")
    values, owners = flat[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    stops = np.append(starts[1:], len(values))
    distinct = values[starts]
    groups = _Groups(len(sets))
    done = np.zeros(len(sets), bool)
    slack = 1 - WHOLE / PART

    def distances(i: int) -> np.ndarray:
        at = np.searchsorted(distinct, sets[i])
        shared = np.bincount(owners[_runs(starts[at], stops[at])], minlength=len(sets))
        return 1 - shared / (n[i] + n - shared)

    def compare(i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that i links with."""
        size = n[others]
        others = others[(PART * np.minimum(size, n[i]) >= WHOLE * np.maximum(size, n[i]))]
        if not len(others):
            return others
        mine = np.concatenate([sets[k] for k in others])
        at = np.minimum(np.searchsorted(sets[i], mine), n[i] - 1)
        hit = np.concatenate([[0], np.cumsum(sets[i][at] == mine)])
        ends = np.cumsum(n[others])
        shared = hit[ends] - hit[ends - n[others]]
        return others[PART * shared >= WHOLE * (n[i] + n[others] - shared)]

    for r in range(len(sets)):
        if done[r]:
            continue
        far = distances(r)
        shared = np.rint((1 - far) * (n[r] + n) / (2 - far)).astype(np.int64)
        near = np.flatnonzero(PART * shared >= WHOLE * (n[r] + n - shared))
        groups.join(r, near)
        done[r] = True
        by_distance = np.argsort(far, kind="stable")
        ordered = far[by_distance]
        for x in near[~done[near]]:
            # only sets in a ring around r can link with x, and those in x's group need no check
            ring = by_distance[np.searchsorted(ordered, slack - far[x] - 1e-9) : np.searchsorted(ordered, slack + far[x] + 1e-9, "right")]
            ring = ring[groups.label[ring] != groups.label[x]]
            if len(ring):
                groups.join(int(x), compare(int(x), ring))
            done[x] = True
    return groups.label


_COMPARED = "a long, b long, component long, far double"


def _compare_slice(schema):
    """Rows (node, least linked node); where the component has several slices, also the distance from its pivot."""

    def run(group: pa.Table) -> pa.Table:
        held = dict(zip(group["node"].to_pylist(), group["shingles"].to_pylist(), strict=True))
        nodes = np.array(list(held), np.int64)
        sets = [np.frombuffer(x, np.uint64) for x in held.values()]
        label = linked_groups(sets)
        least = np.full(len(nodes), np.iinfo(np.int64).max)
        np.minimum.at(least, label, nodes)
        pivot, far = group["component"][0].as_py(), [None] * len(nodes)
        if group["many"][0].as_py():
            middle = np.frombuffer(held[pivot], np.uint64)
            shared = [np.count_nonzero(middle[np.minimum(np.searchsorted(middle, x), len(middle) - 1)] == x) for x in sets]
            far = [1 - k / (len(x) + len(middle) - k) for k, x in zip(shared, sets, strict=True)]
        return X.table_of(schema, {"a": nodes.tolist(), "b": least[label].tolist(), "component": [pivot] * len(nodes), "far": far})

    return run


def _clustered(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """(component, node, shingles): sets that index lists join, directly or not."""
    # written, so that the join with a very frequent shingle or class can be split
    heads = settle(lists.groupBy("shingle").agg(F.min("node").alias("head")), "heads")
    clusters = components(lists.select("shingle", "node").join(heads, "shingle").select("node", "head"), "node", "head")
    return sets.join(clusters, "node").select("component", "node", "shingles")


def _cuts(clustered: DataFrame, bytes_: int, rows: int) -> DataFrame:
    """(component, cut): into how many parts, for components that don't fit into one; a row for each part's worth of sets at most."""
    cut = F.ceil(F.greatest(F.sum(F.octet_length("shingles")) / bytes_, F.count("*") / rows)).cast("int")
    return clustered.groupBy("component").agg(cut.alias("cut")).filter("cut > 1")


def _in_slices(clustered: DataFrame) -> DataFrame:
    """Compared slices: each set is in one, the component's pivot in all of them."""
    cuts = settle(_cuts(clustered, SLICE_BYTES, SLICE_SETS), "cuts")
    dealt = clustered.join(cuts, "component", "left").withColumn("many", F.col("cut").isNotNull())
    own = F.pmod(F.xxhash64(F.lit(3), "node"), F.coalesce("cut", F.lit(1))).cast("int")
    everywhere = F.sequence(F.lit(0), F.coalesce("cut", F.lit(1)) - 1)
    slices = F.when(F.col("node") == F.col("component"), everywhere).otherwise(F.array(own))
    dealt = dealt.select("component", F.explode(slices).alias("slice"), "many", "node", "shingles")
    compared = X.struct(_COMPARED)
    return dealt.groupBy("component", "slice").applyInArrow(_compare_slice(compared), compared)


def _in_pairs_of_parts(clustered: DataFrame) -> DataFrame:
    """Compared pairs of parts: every two sets of a component meet."""
    cuts = settle(_cuts(clustered, PART_BYTES // 2, SLICE_SETS), "cuts")
    dealt = clustered.join(cuts, "component", "left").withColumn("cut", F.coalesce("cut", F.lit(1)))
    part = F.pmod(F.xxhash64(F.lit(3), "node"), F.col("cut")).cast("int")
    dealt = dealt.select("component", "node", "shingles", part.alias("part"), "cut", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)).alias("other"))
    # a part meets each other part in one task; without others, itself
    dealt = dealt.filter("cut = 1 or part <> other").select("component", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), F.lit(False).alias("many"), "node", "shingles")
    compared = X.struct(_COMPARED)
    return dealt.groupBy("component", "i", "j").applyInArrow(_compare_slice(compared), compared)


def _unseen(lists: DataFrame, compared: DataFrame, named: DataFrame) -> DataFrame:
    """Postings that may still link with one of another class; those of pivots are done."""
    told = compared.filter("far is not null").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("pivot"), F.min("far").alias("far"))
    rows = lists.join(told, "node").join(named, "node", "left").withColumn("class", F.coalesce("component", "node")).filter("node <> pivot")
    rows = settle(rows.select("shingle", "node", "n", "position", "far", "class", (F.col("n") - F.col("position")).alias("room")), "postings")
    by_class = rows.groupBy("shingle", "class").agg(F.count("*").alias("many"))
    main = by_class.groupBy("shingle").agg(F.max_by("class", F.struct("many", "class")).alias("main"), F.count("*").alias("classes")).filter("classes > 1").select("shingle", "main")
    # written, as the heads are, so that a join with a very frequent shingle can be split
    mixed = rows.join(settle(main, "lists"), "shingle")
    ends = [f(c).alias(f"{name}_{c}") for c in ("n", "far", "room") for f, name in ((F.min, "least"), (F.max, "most"))]
    others = settle(mixed.filter("class <> main").groupBy("shingle").agg(*ends), "lists")
    slack = 1 - WHOLE / PART + 1e-9
    by_size = (F.col("most_n") * PART >= F.col("n") * WHOLE) & (F.col("n") * PART >= F.col("least_n") * WHOLE)
    by_position = (F.col("most_room") * PART >= F.col("n") * WHOLE) & (F.col("room") * PART >= F.col("least_n") * WHOLE)
    by_ring = F.col("far").between(F.col("least_far") - slack, F.col("most_far") + slack)
    kept = mixed.join(others, "shingle").filter((F.col("class") != F.col("main")) | by_size & by_position & by_ring)
    return settle(kept.select("shingle", "node", "n", "position"), "postings")


def _linked(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, component): sets that links join, directly or not."""
    edges = None
    for last in [False] * ROUNDS + [True]:
        compared = settle((_in_pairs_of_parts if last else _in_slices)(_clustered(lists, sets)), "compared")
        own = compared.select("a", "b").filter("a <> b")
        edges = own if edges is None else edges.unionByName(own)
        named = components(edges)
        if last or compared.filter("far is not null").isEmpty():
            break
        lists = _unseen(lists, compared, named)
        if lists.isEmpty():
            break
    return named


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, n_shingles, component_id (the smallest key linked with it, directly or not).

    Null and empty texts, and texts without words, have no shingles and are linked with nothing.  Repeated
    rows and keys stay; null keys count as linked but never name a component (unless it has no
    other).  Very long texts are compared whole.  Keys are integers.  Other columns are dropped.  An empty table
    gives an empty result.
    """
    own = classes(docs, key=key, text=text)
    least = settle(own.filter("class is not null").groupBy("class").agg(F.min("key").alias("least")), "least")
    final = own.join(least, "class", "left")
    return final.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("key")).otherwise(F.col("least")).alias("component_id"))


def keep_first(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: that of the smallest key, null keys last.

    A document is a row's key and text, so of rows that share a key each goes or stays by its own
    text (of several in one group that of the least text hash stays).  Repeated rows of the document that stays stay; documents
    without words are in no group.  All columns pass through.
    """
    own = classes(docs, key=key, text=text)
    rank = F.struct(F.col("key").isNull().alias("last"), "key", "mark")
    first = settle(own.filter("class is not null").groupBy("class").agg(F.min(rank).alias("first")), "least")
    gone = own.join(first, "class").filter(rank != F.col("first")).select(F.col("key").alias("_gone_key"), F.col("mark").alias("_gone_mark")).distinct()
    same = F.col(f"`{key}`").cast("long").eqNullSafe(F.col("_gone_key")) & (F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))) == F.col("_gone_mark"))
    return docs.join(gone, same, "left_anti")


def classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, mark (a hash of its text), n (its shingles), class (a number that linked documents share; null without words)."""
    blocks, n_blocks = X.in_blocks(docs, key, text)
    blocks = blocks.withColumn("mark", F.xxhash64("text"))
    buckets = max(1, n_blocks // 4)
    packed, kept = X.struct(X.PACKED), X.struct(SETS)
    asked = blocks.groupBy("block").applyInArrow(_ask(buckets, packed), packed)
    told = asked.groupBy("bucket").applyInArrow(X.answer(packed, np.uint8, _total), packed)
    members = settle(blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_first_sieve(kept), kept), "sets")

    # copies may have stayed once for each block
    sets = members.filter("shingles is not null").groupBy("node").agg(F.min("shingles").alias("shingles"))
    held = sets.agg(F.count("*"), F.sum(F.octet_length("shingles"))).first()
    n_parts = max(1, math.ceil((held[1] or 0) / 8 / 500_000))
    sets = sets.select("node", "shingles", F.pmod("node", F.lit(n_parts)).alias("block"))

    def ask_again(group: pa.Table) -> pa.Table:
        return _questions(group["block"][0].as_py(), [np.frombuffer(s, np.uint64) for s in group["shingles"].to_pylist()], n_parts, packed)

    indexed = X.struct("node long, n long, shingle long, position int, shingles binary")
    told = sets.groupBy("block").applyInArrow(ask_again, packed).groupBy("bucket").applyInArrow(X.answer(packed, np.uint8, _total), packed)
    index = settle(sets.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_second_sieve(indexed), indexed), "index")

    named = _linked(index.filter("shingle is not null").drop("shingles"), index.filter("shingles is not null").select("node", "shingles"))
    own = members.select("key", "mark", "n", "node").join(named, "node", "left")
    return own.select("key", "mark", "n", F.coalesce("component", "node").alias("class"))
