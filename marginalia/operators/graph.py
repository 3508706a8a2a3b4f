"""Inference and walks over graphs of triples, as joins; a job for each step of a walk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import vocabulary as V
from marginalia.sources.triples import RULES
from .lineage import settle
from .ordered import scan
from .rules import derive
from .triples import invert_relation, match, merge, rename_relation


def edges_of(triples: DataFrame, *relations: str) -> DataFrame:
    """(src, dst): distinct edges of relations between resources."""
    return match(triples, p=relations).filter("o_kind = 'iri'").select(F.col("s").alias("src"), F.col("o").alias("dst")).distinct()


def distances(edges: DataFrame, limit: int | None = None, origins: DataFrame | None = None) -> DataFrame:
    """(origin, node, d): the least number of edges from each origin to each other node it reaches.

    ``limit`` bounds d; ``origins`` (id) restricts where walks begin.  Cycles end by themselves: a pair
    is gone on from only when it is first met.  Origins themselves are not listed.  Repeated edges count once.
    A step shuffles the pairs met last by their node and all pairs met so far by (origin, node).
    """
    steps = settle(edges.select("src", "dst").filter("src <> dst").distinct(), "edges")
    begin = steps if origins is None else steps.join(origins.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    front = settle(begin.select(F.col("src").alias("origin"), F.col("dst").alias("node"), F.lit(1).alias("d")), "walk")
    met, d = front, 1
    while (limit is None or d < limit) and not front.isEmpty():
        d += 1
        here = front.select("origin", F.col("node").alias("src"))
        found = here.join(steps, "src").filter("origin <> dst").select("origin", F.col("dst").alias("node")).distinct()
        fresh = found.join(met.select("origin", "node"), ["origin", "node"], "left_anti")
        front = settle(fresh.withColumn("d", F.lit(d)), "walk")
        met = met.unionByName(front)
    return met


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst): pairs joined by more than one edge but not by one; none with itself."""
    return distances(edges).filter("d > 1").select(F.col("origin").alias("src"), F.col("node").alias("dst"))


def infer(explicit: DataFrame) -> DataFrame:
    """All inferred triples: dependencies by citation and proof, their closure, and inverse relations."""
    depends = merge(rename_relation(explicit, "cites", "dependsUpon"), rename_relation(explicit, "provedBy", "dependsUpon"))
    turned = merge(invert_relation(explicit, "hasCorollary", "derivedFrom"), invert_relation(explicit, "hasNote", "explainsElement"))
    far = closure(edges_of(depends, "dependsUpon")).select(F.col("src").alias("s"), F.lit("transitivelyDependsOn").alias("p"), F.col("dst").alias("o"), F.lit("iri").alias("o_kind"))
    return merge(depends, turned, far)


def two_hops(edges: DataFrame) -> DataFrame:
    """(src, dst): ends of paths of two edges, the start itself included where they lead back."""
    a = edges.toDF("src", "mid")
    b = edges.toDF("mid", "dst")
    return a.join(b, "mid").select("src", "dst").distinct()


def apply_rules(explicit: DataFrame, rules: str = ". ".join(RULES)) -> DataFrame:
    """What rules in N3 infer; by default those that travel with a written graph.

    These give what infer() gives, but only dependencies over two steps are added.
    """
    return derive(explicit, rules)


def walk(edges: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Walks from all nodes at once: (block, node, bits, d) and the origins (id, block, bit).

    A row holds which of a block's 64 origins first meet the node after d edges, so that pairs take a bit each
    and not a row.  Neighbours in the order of ids share a block.  A node meets itself at d = 0.
    A step is one join by node and one aggregation by (block, node) over what was met before.
    """
    steps = settle(edges.select("src", "dst").filter("src <> dst").distinct(), "edges")
    ids = steps.select(F.col("src").alias("id")).distinct().repartitionByRange("id").sortWithinPartitions("id")
    numbered = ids.withColumn("k", F.monotonically_increasing_id())
    origins = settle(numbered.select("id", F.shiftright("k", 6).alias("block"), F.col("k").bitwiseAND(F.lit(63)).cast("int").alias("bit")), "origins")
    front = origins.select("block", F.col("id").alias("node"), F.expr("shiftleft(1L, bit)").alias("bits"), F.lit(0).alias("d"))
    met, d = front, 0
    while (limit is None or d < limit) and not front.isEmpty():
        d += 1
        found = front.join(steps, F.col("node") == F.col("src")).select("block", F.col("dst").alias("node"), F.col("bits").alias("new"), F.lit(0).cast("long").alias("old"))
        before = met.select("block", "node", F.lit(0).cast("long").alias("new"), F.col("bits").alias("old"))
        bits = F.bit_or("new").bitwiseAND(F.bitwise_not(F.bit_or("old")))
        fresh = found.unionByName(before).groupBy("block", "node").agg(bits.alias("bits")).filter("bits <> 0")
        front = settle(fresh.withColumn("d", F.lit(d)), "walk")
        met = met.unionByName(front)
    return met, origins


def influence_of(walked: DataFrame, limit: int = 4) -> DataFrame:
    """influence() from walks of ``limit`` edges or more."""
    near = walked.filter(F.col("d").between(1, limit))
    return near.groupBy(F.col("node").alias("id")).agg(F.sum((6 - F.col("d")) * F.bit_count("bits")).cast("double").alias("influence"))


def depth_of(walked: DataFrame, origins: DataFrame) -> DataFrame:
    """dependency_depth() from walks that ended at its limit."""
    by_block = walked.filter("d > 0").groupBy("block", "d").agg(F.bit_or("bits").alias("bits"))
    own = origins.join(by_block, "block").filter("bits & shiftleft(1L, bit) <> 0")
    return own.groupBy("id").agg(F.max("d").alias("depth"))


def influence(edges: DataFrame, limit: int = 4) -> DataFrame:
    """(id, influence): each node within ``limit`` edges that lead to id adds 6 - d."""
    return influence_of(walk(edges, limit)[0], limit)


def dependency_depth(edges: DataFrame, limit: int = 12) -> DataFrame:
    """(id, depth): the largest distance to a node that id leads to, at most ``limit``."""
    return depth_of(*walk(edges, limit))


def citation_steps(triples: DataFrame) -> DataFrame:
    """(src, dst, via): what a passage cites; for passages that cite nothing, what the passages inside them cite."""
    cites = match(triples, p="cites").select(F.col("s").alias("src"), F.col("o").alias("dst"))
    inside = match(triples, p="partOf").select(F.col("o").alias("src"), F.col("s").alias("via"))
    silent = inside.join(cites.select("src").distinct(), "src", "left_anti")
    by_parts = silent.join(cites.toDF("via", "dst"), "via").select("src", "dst", "via")
    return cites.withColumn("via", F.lit(None).cast("string")).unionByName(by_parts)


def trace(triples: DataFrame, limit: int = 3, origins: DataFrame | None = None) -> DataFrame:
    """(origin, node, d): dependencies by levels, each at its least depth."""
    return distances(citation_steps(triples).select("src", "dst"), limit, origins)


def trace_depth_first(triples: DataFrame, origins: DataFrame, limit: int = 3) -> DataFrame:
    """(origin, place, node, depth): the lines of a depth-first trace, siblings in the order of ids.

    A node is entered once, also if that is at the limit and a shorter way comes later.  Origins that lead nowhere
    have their own line; null origins have none.

    Attempts to enter nodes follow each other in the order of their paths of ids, and the first one counts.  So a node's
    path is the least of those that are one step longer than the path of a node entered short of the limit.  Only
    one choice of paths satisfies this.  Rounds lead to it: each works out all paths from those of the round before, for origins
    where something changed.  A round is a join by node and an aggregation by (origin, node), so that neither a hub nor a
    large neighbourhood is one task's work.  It takes ``limit`` + 1 rounds, and more where nodes are met at the limit
    before they are met nearer, as many as there are such nodes in a row that depend on each other.
    """
    steps = settle(citation_steps(triples).select("src", "dst").filter("src <> dst").distinct(), "edges")
    begin = origins.select(F.col("id").alias("origin")).filter("origin IS NOT NULL").distinct()
    entered, done = settle(begin.select("origin", F.col("origin").alias("node"), F.array("origin").alias("path")), "trace"), []
    while not entered.isEmpty():
        attempts = entered.filter(F.size("path") <= limit).join(steps, F.col("node") == F.col("src")).filter("dst <> origin")
        new = attempts.select("origin", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        old = entered.select("origin", "node", F.when(F.col("node") == F.col("origin"), F.col("path")).alias("path"), F.col("path").alias("old"))
        both = new.unionByName(old, allowMissingColumns=True).groupBy("origin", "node")
        found = settle(both.agg(F.min("path").alias("path"), F.min("old").alias("old")), "trace")
        changed = found.filter(~F.col("path").eqNullSafe(F.col("old"))).select("origin").distinct()
        done.append(found.join(changed, "origin", "left_anti").select("origin", "node", "path"))
        entered = settle(found.join(changed, "origin", "left_semi").filter("path IS NOT NULL").select("origin", "node", "path"), "trace")
    lines = scan(reduce(DataFrame.unionByName, done, entered), ["origin"], ["path"], counts={"place": F.lit(True)})
    return lines.select("origin", (F.col("place") - 1).cast("int").alias("place"), "node", (F.size("path") - 1).alias("depth"))


def weighted_edges(triples: DataFrame, weights: dict[str, float] = V.WEIGHTS) -> DataFrame:
    """(src, dst, weight): an edge for each weighted triple."""
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("p")]
    return match(triples, p=list(weights)).select(F.col("s").alias("src"), F.col("o").alias("dst"), weight.alias("weight"))
