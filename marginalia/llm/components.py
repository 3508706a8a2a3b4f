"""Connected components of a graph held as a table, by alternating large stars and contractions of what lies in a task."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import settle

#: Edges that a task contracts at once.
CONTRACTED = 250_000


def _least_linked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges that are linked with a smaller one, and the least node that each is linked with."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(i):
        np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
        while np.any((up := root[root]) != root):
            root = up
        i, j = root[i], root[j]
        i, j = i[i != j], j[i != j]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) that link what the task's own edges link, a star for each group; some hundred thousand edges at a time.

    The last node goes on with the next ones, so that edges in the order of a are linked through every a.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(a) for a, _ in held) > CONTRACTED:
            last = held[-1][0][-1]
            a, b = _least_linked(*map(np.concatenate, zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            held = [(a[a == last], b[a == last])]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _least_linked(*map(np.concatenate, zip(*held, strict=True)))], ["a", "b"])


def _small_stars(edges: DataFrame, turn: int) -> DataFrame:
    """Link what is linked with a node's smaller neighbours to the smallest: they lie together, and then each task contracts what it reads.

    Every turn deals the nodes anew.  A node has a row at most for each contraction before, so that none is too large for a partition.
    """
    dealt = edges.repartition(F.xxhash64(F.lit(turn), "a")).sortWithinPartitions("a")
    return settle(settle(dealt, "edges").mapInArrow(_contract, "a long, b long"), "edges")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of every node to the smallest of all its neighbours and itself.  Edges may come more than once."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and none if it has larger ones: then that neighbour names the component."""
    none = F.lit(None).cast("long")
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), none.alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.min("up").alias("least"), F.max("up").alias("most"), F.max("down").alias("down"))
    return not nodes.agg(F.max((F.col("most") > F.col("least")) | F.col("least").isNotNull() & (F.col("down") > 0))).first()[0]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node of an edge the smallest node it is linked with.

    Loops and repeated edges do no harm; edges with a null end are left out.
    """
    one, two = F.col(a), F.col(b)
    now = _small_stars(edges.filter(one.isNotNull() & two.isNotNull() & (one != two)).select(F.greatest(one, two).cast("long").alias("a"), F.least(one, two).cast("long").alias("b")), turn=0)
    for turn in count(1):
        if _only_stars(now):
            break
        now = _small_stars(_large_star(now), turn)
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # tasks may have the same edge, and a join by node needs no other exchange
    return ends.unionByName(ends.select(F.col("component").alias("node"), "component")).groupBy("node").agg(F.min("component").alias("component"))
