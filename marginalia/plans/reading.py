"""Whole plans: from files to the graph and analyses of a part, and from a plain text to markup and graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import analysis, corpus, graph, reader
from marginalia.operators.lineage import settle
from marginalia.operators.triples import backfill, entry_triples, merge, passage_triples
from marginalia.sources.n3 import read_n3
from marginalia.sources.passages import entries_of, markup, read_passages
from marginalia.sources.texts import read_parallel
from marginalia.sources.triples import COLUMNS, vocabulary_triples


@dataclass
class Library:
    """Passages with the triples that are stated and inferred about them."""

    passages: DataFrame
    explicit: DataFrame
    inferred: DataFrame

    def relations(self, id_: object = None) -> DataFrame:
        return analysis.relations(self.explicit, self.inferred, id_)

    def chains(self, limit: int | None = None) -> DataFrame:
        return analysis.chains(self.inferred, limit)

    def weights(self) -> DataFrame:
        return analysis.weights(self.explicit, self.passages)


def build_library(passages: DataFrame, *graphs: DataFrame) -> Library:
    """Graphs merged, completed by what the passages tell, and inferred from; both sets of triples are kept as tables."""
    explicit = settle(backfill(merge(*graphs), passage_triples(passages)).select(*COLUMNS), "explicit")
    return Library(passages, explicit, settle(graph.infer(explicit), "inferred"))


def load_library(spark: SparkSession, xml: str | list[str], n3: list[str], parallel: str | None = None, part: int | None = None) -> Library:
    """From files; ``part`` restricts the passages, and what they add to the graph, to one part."""
    passages = read_passages(spark, xml)
    if part is not None:
        passages = passages.filter(F.col("part_number") == part)
    if parallel:
        passages = reader.merge_parallel(passages, read_parallel(spark, parallel))
    return build_library(passages, *[read_n3(spark, x) for x in n3])


def build_corpus(texts: DataFrame, key: str = "path", text: str = "value", end: str | None = None, editorial: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(passages, markup, explicit graph) of plain texts."""
    passages = settle(corpus.as_passages(corpus.passages_of_texts(texts, key, text, end, editorial)), "passages")
    documents = settle(markup(passages), "markup")
    named = documents.select(F.col("part_number").cast("string").alias("path"), F.col("xml").alias("value"))
    return passages, documents, merge(vocabulary_triples(texts.sparkSession), entry_triples(entries_of(named)))
