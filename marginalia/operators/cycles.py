"""What of a graph lies on cycles, in a number of jobs that grows with the logarithm of its longest chains.

Nodes that no edge enters, or none leaves, are taken away, and chains of nodes with one edge in and one out become one edge, found by
doubling steps.  Taken in turns, these make short work of long paths and trees.  Whether an edge lies on a cycle, that is,
whether its end leads back to its beginning, is asked of the small graph that is left, and the answers are carried back to the chains.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import walk
from .lineage import settle


def _trimmed(edges: DataFrame) -> DataFrame:
    entered, left = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
    return edges.join(entered, "src", "left_semi").join(left, "dst", "left_semi").select("src", "dst")


def chains(edges: DataFrame) -> DataFrame | None:
    """(id, behind, ahead, ring): nodes with one edge in and one out, and the nearest nodes of other kinds before and after them.

    ``ring``: there are none, all nodes around are of this kind.  None if there are no such nodes.  Each step doubles how far
    a node looks, so chains of n nodes take log n steps.
    """
    after = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.min("dst").alias("ahead")).filter("n = 1")
    before = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.min("src").alias("behind")).filter("n = 1")
    inner = settle(after.select("id", "ahead").join(before.select("id", "behind"), "id").select("id", "behind", "ahead"), "inner")
    many = inner.count()
    if not many:
        return None
    now = inner.select("id", "behind", "ahead", F.lit(True).alias("ring"))
    for _ in range(math.ceil(math.log2(many)) + 1):
        on = now.select(F.col("id").alias("ahead"), F.col("ahead").alias("further"))
        back = now.select(F.col("id").alias("behind"), F.col("behind").alias("earlier"))
        looked = now.join(on, "ahead", "left").join(back, "behind", "left")
        going_on = F.col("further").isNotNull() | F.col("earlier").isNotNull()
        now = settle(looked.select("id", F.coalesce("earlier", "behind").alias("behind"), F.coalesce("further", "ahead").alias("ahead"), going_on.alias("ring")), "chains")
        if now.filter("ring").isEmpty():
            break
    return now


def _on_cycles_of_core(core: DataFrame) -> DataFrame:
    """(src, dst): the edges whose end leads back to their beginning, by walks of 64 origins a row."""
    walked, origins = walk(core)
    reached = walked.join(core, F.col("node") == F.col("src")).select("src", "dst", "block", "bits")
    own = origins.withColumnRenamed("id", "dst")
    return reached.join(own, ["dst", "block"]).filter("bits & shiftleft(1L, bit) <> 0").select("src", "dst").distinct()


def on_cycles(edges: DataFrame) -> DataFrame:
    """(id): nodes that lead back to themselves, by one edge or more.

    Null ends are no nodes; repeated edges count once; a graph without edges has none.
    """
    clean = edges.select("src", "dst").na.drop()
    found = [clean.filter("src = dst").select(F.col("src").alias("id"))]
    now, many = settle(clean.filter("src <> dst").distinct(), "edges"), None
    levels: list[tuple[DataFrame, DataFrame]] = []  # graphs, and their chains
    while many != (left := now.count()) and left:
        many = left
        now = settle(_trimmed(now), "edges")
        inner = chains(now)
        if inner is None:
            continue
        levels.append((now, inner))
        ends = inner.filter("NOT ring").select(F.col("behind").alias("src"), F.col("ahead").alias("dst")).distinct()
        ids = inner.select(F.col("id").alias("src"))
        rest = now.join(ids, "src", "left_anti").join(ids.withColumnRenamed("src", "dst"), "dst", "left_anti").select("src", "dst")
        now = settle(rest.unionByName(ends.filter("src <> dst")).distinct(), "edges")
    closed = _on_cycles_of_core(now) if left else now
    for graph, inner in reversed(levels):
        # a chain lies on a cycle where it is a ring, where it comes back to where it began, or where the edge that stands for it does
        by_edge = inner.join(closed.select(F.col("src").alias("behind"), F.col("dst").alias("ahead")), ["behind", "ahead"], "left_semi")
        on = settle(inner.filter("ring OR behind = ahead").select("id").unionByName(by_edge.select("id")).distinct(), "on")
        beside = on.join(graph, F.col("id") == F.col("src")).select("src", "dst").unionByName(on.join(graph, F.col("id") == F.col("dst")).select("src", "dst"))
        closed = settle(closed.unionByName(beside).distinct(), "closed")
    ends = closed.select(F.col("src").alias("id")).unionByName(closed.select(F.col("dst").alias("id")))
    return ends.unionByName(found[0]).distinct()
