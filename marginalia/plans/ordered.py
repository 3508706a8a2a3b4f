"""Queries in the order of groups of any size: pages, runs and neighbours in many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import analysis, reader
from marginalia.operators.ordered import scan

from .queries import _inferred
from .tables import passages, table, triples

PAGE = 20


def relation_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Relations of each passage, in pages; nations are hubs."""
    found = analysis.relations(triples(spark, sf, "places", "parents"), _inferred(spark, sf))
    return analysis.relation_pages(found, PAGE).withColumn("rank", F.col("rank").cast("long"))


def child_pages(spark: SparkSession, sf: str) -> DataFrame:
    return reader.child_pages(passages(spark, sf), 2)


def numbered_children(spark: SparkSession, sf: str) -> DataFrame:
    return reader.numbered_children(passages(spark, sf))


def reading_order(spark: SparkSession, sf: str) -> DataFrame:
    """All passages as one reading order."""
    return reader.reading_order(passages(spark, sf))


def section_runs(spark: SparkSession, sf: str) -> DataFrame:
    return reader.section_runs(passages(spark, sf)).select("id", "section_kind", "run")


def line_runs(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as one text, whose lines are counted and whose blocks begin at capitals A to D, with the heading of each block."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    head = F.col("line").rlike("^[A-D]")
    found = scan(lines, [], ["doc_id", "pos"], counts={"nth": F.lit(True), "block": head}, before={"heading": F.when(head, F.md5("line"))})
    found = found.withColumn("heading", F.coalesce(F.when(head, F.md5("line")), "heading"))
    return found.groupBy("block").agg(F.count("*").alias("n"), F.min("nth").alias("first"), F.max("nth").alias("last"), F.min("heading").alias("heading"))


QUERIES = {f.__name__: f for f in [relation_pages, child_pages, numbered_children, reading_order, section_runs, line_runs]}
