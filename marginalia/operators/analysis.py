"""Relations, chains and weights of all passages at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import labels as L
from marginalia.functions import vocabulary as V
from marginalia.functions.roman import lookup

from .graph import depth_of, influence_of, walk, weighted_edges
from .lineage import settle
from .ordered import paged
from .triples import match


def relations(explicit: DataFrame, inferred: DataFrame, id_: object = None) -> DataFrame:
    """(element_id, subject, predicate, object, inferred): what holds of each passage, seen from it.

    A triple tells its subject the relation, and its object the inverse one.  ``id_`` restricts to some passages.
    """
    told = match(explicit, p=V.STATED_RELATIONS).withColumn("inferred", F.lit(False)).select("s", "p", "o", "inferred")
    told = told.unionByName(match(inferred, p=V.INFERRED_RELATIONS).withColumn("inferred", F.lit(True)).select("s", "p", "o", "inferred"))
    out = told.select(F.col("s").alias("element_id"), F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o").alias("object"), "inferred")
    in_ = told.select(F.col("o").alias("element_id"), F.col("s").alias("subject"), L.inverse_name(F.col("p")).alias("predicate"), F.col("o").alias("object"), "inferred")
    if id_ is not None:
        wanted = F.col("element_id").isin(*([id_] if isinstance(id_, str) else id_))
        out, in_ = out.filter(wanted), in_.filter(wanted)
    return out.unionByName(in_).distinct()


def grouped_relations(rows: DataFrame) -> DataFrame:
    """(element_id, predicate, label, rank, relations): relations by predicate, direct ones first.

    All relations of a predicate are one array; relation_pages() has no row that grows with a hub.
    """
    grouped = rows.groupBy("element_id", "predicate").agg(F.sort_array(F.collect_list(F.struct("subject", "object", "inferred"))).alias("relations"))
    return grouped.select("element_id", "predicate", L.relation_label(F.col("predicate")).alias("label"), L.relation_rank(F.col("predicate")).alias("rank"), "relations").orderBy("element_id", "rank", "label")


def relation_pages(rows: DataFrame, size: int = 100) -> DataFrame:
    """(element_id, place, page, rank, label, predicate, subject, object, inferred): the relations of a passage, direct ones first, in pages."""
    labelled = rows.select("element_id", L.relation_rank(F.col("predicate")).alias("rank"), L.relation_label(F.col("predicate")).alias("label"), "predicate", "subject", "object", "inferred")
    found = paged(labelled, ["element_id"], ["rank", "label", "predicate", "subject", "object", "inferred"], size)
    return found.select("element_id", "place", "page", "rank", "label", "predicate", "subject", "object", "inferred")


# Families of chains, the first of which counts where two tell the same.
_FAMILIES = [("transitive_dependency", "transitivelyDependsOn", False), ("dependency", "dependsUpon", False), ("inverse_transitive_dependency", "transitivelyDependsOn", True), ("inverse_dependency", "dependsUpon", True)]


def chains(inferred: DataFrame, limit: int | None = None) -> DataFrame:
    """(element_id, type, start, end, relationship, inferred, path, length): dependencies from and to each passage.

    A path has one step.  With ``limit`` only so many chains of a passage, in the order of the
    families and then of the other end.
    """
    parts = []
    for rank, (kind, relation, inward) in enumerate(_FAMILIES):
        own = F.col("o") if inward else F.col("s")
        parts.append(match(inferred, p=relation).select(own.alias("element_id"), F.lit(rank).alias("rank"), F.lit(kind).alias("type"), F.col("s").alias("start"), F.col("o").alias("end"), F.col("p").alias("relationship")))
    rows = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    first = rows.groupBy("element_id", "start", "relationship", "end").agg(F.min(F.struct("rank", "type")).alias("kind"))
    rows = first.select("element_id", "kind.rank", "kind.type", "start", "end", "relationship")
    if limit is not None:
        order = Window.partitionBy("element_id").orderBy("rank", "start", "end")
        rows = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    step = F.struct(F.col("start").alias("from"), F.col("end").alias("to"), "relationship")
    return rows.select("element_id", "type", "start", "end", "relationship", F.lit(True).alias("inferred"), F.array(step).alias("path"), F.lit(1).alias("length"))


def foundational_score(base, inbound, outbound, reach):
    ratio = F.when(outbound == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.try_divide(inbound, outbound)))
    return F.greatest(F.lit(0.0), base + inbound * 1.5 + reach * 0.2 + ratio * 5)


def weights(explicit: DataFrame, elements: DataFrame) -> DataFrame:
    """One row for each of ``elements`` (id, type): weighted degrees, influence, depth and the score made of them.

    A passage without links has weights of 0 and the score of its type's base plus 5.
    """
    edges = settle(weighted_edges(explicit), "weighted")  # read three times
    walked, origins = walk(edges, 12)
    out = edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("outbound_weight"))
    in_ = edges.groupBy(F.col("dst").alias("id")).agg(F.sum("weight").alias("inbound_weight"))
    joined = elements.select("id", "type").join(in_, "id", "left").join(out, "id", "left").join(influence_of(walked), "id", "left").join(depth_of(walked, origins), "id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    base = F.coalesce(lookup(V.BASE_SCORES, F.col("type")), F.lit(1.0))
    return joined.select(
        F.col("id").alias("element_id"),
        zero("inbound_weight").alias("inbound_weight"),
        zero("outbound_weight").alias("outbound_weight"),
        zero("influence").alias("transitive_influence"),
        foundational_score(base, zero("inbound_weight"), zero("outbound_weight"), zero("influence")).alias("foundational_score"),
        F.create_map().cast("map<string,double>").alias("relationship_breakdown"),
        F.coalesce("depth", F.lit(0)).alias("dependency_depth"),
        F.floor(zero("influence") / 10 + 0.5).cast("int").alias("influence_reach"),
    )
