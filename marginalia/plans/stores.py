"""Queries over tables laid out for what they are asked: stores of triples, and search indexes."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import search
from marginalia.operators.lineage import shared_folder
from marginalia.sources.store import TripleStore, save_store

from .tables import passages, triples

SEARCHED = ("text", "canonical_label", "id")
WORDS = ["the", " Of ", "x", "onin", "er th", "proposition iv", ".prop.1", "no such thing", "é"]


def _store(spark: SparkSession, sf: str) -> TripleStore:
    name = f"store_{uuid.uuid4().hex}"
    return save_store(triples(spark, sf, "places", "parents", "classes", "orders"), name, f"{shared_folder(spark)}/{name}")


def store_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Triples by subject, by object and by relation, from the copy laid out for each."""
    store = _store(spark, sf)
    asked = {"s": store.match(s="C.7"), "o": store.match(o="N.3"), "po": store.match(p="type", o="Proposition"), "p": store.match(p="partOf")}
    return reduce(DataFrame.unionByName, [rows.select(F.lit(name).alias("asked"), "s", "p", "o", "o_kind") for name, rows in asked.items()])


def store_star(spark: SparkSession, sf: str) -> DataFrame:
    """What passages cite, and what they are part of and their class: a join without an exchange."""
    found = _store(spark, sf).star("cites", "partOf", "type")
    return found.toDF("s", "cites", "inside", "class")


def store_path(spark: SparkSession, sf: str) -> DataFrame:
    """Citations of passages that stand inside others, and inside which."""
    return _store(spark, sf).path("cites", "partOf")


def search_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Passages that contain each of some strings, by an index of trigrams."""
    rows = passages(spark, sf)
    index = search.build_index(rows, f"{shared_folder(spark)}/search-{uuid.uuid4().hex}", SEARCHED)
    return reduce(DataFrame.unionByName, [index.search(rows, w).select(F.lit(w.strip().lower()).alias("query"), "id") for w in WORDS])


QUERIES = {f.__name__: f for f in [store_patterns, store_star, store_path, search_indexed]}
