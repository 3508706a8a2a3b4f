"""Search for any substring by an index of trigrams, kept as a partitioned table.

Each text gives its trigrams, from each character on, filled up at its end so that short texts and last characters have one too.
Postings lie in folders by the trigram's first character, in the order of trigrams within, so that a query opens
the folders of the first characters that it asks for.  A query of three characters or more takes its rarest trigrams and intersects their
postings; a shorter one takes all trigrams that begin with it.  What is left is verified on the texts themselves, so that results
are those of a scan.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .reader import matches

#: Folders of postings, and trigrams of a query whose postings are intersected.
FOLDERS, RAREST = 64, 4
_END = "\0"
_POSTINGS = "gram string, id string, folder int"
_COUNTS = "gram string, n long, folder int"


def _folder(gram: Column) -> Column:
    return F.pmod(F.crc32(F.substring(gram, 1, 1).cast("binary")), F.lit(FOLDERS)).cast("int")


def grams(text: Column) -> Column:
    """The distinct trigrams of a text, in lower case; nulls have none."""
    low = F.lower(text)
    filled = F.concat(low, F.lit(_END * 2))
    return F.array_distinct(F.when(F.length(low) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), lambda k: F.substring(filled, k, F.lit(3)))).otherwise(F.array().cast("array<string>")))


@dataclass
class SearchIndex:
    """``postings`` and ``counts`` in a folder that all executors share, of some columns of rows with an id."""

    spark: SparkSession
    path: str
    key: str
    columns: tuple[str, ...]

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.schema(_POSTINGS).parquet(f"{self.path}/postings")

    @property
    def counts(self) -> DataFrame:
        return self.spark.read.schema(_COUNTS).parquet(f"{self.path}/counts")

    def candidates(self, query: str) -> DataFrame:
        """(id): rows that have all the trigrams asked for; all that match are among them."""
        wanted = query.strip().lower()
        if len(wanted) < 3:
            if not wanted:
                raise ValueError("a blank query matches everything and needs no index")
            lead = self.spark.range(1).select(_folder(F.lit(wanted)).alias("f")).first()["f"]
            return self.postings.filter((F.col("folder") == lead) & F.col("gram").startswith(wanted)).select("id").distinct()
        asked = sorted({wanted[k : k + 3] for k in range(len(wanted) - 2)})
        folders = {r["gram"]: r["f"] for r in self.spark.createDataFrame([(g,) for g in asked], "gram string").select("gram", _folder(F.col("gram")).alias("f")).collect()}
        known = self.counts.filter(F.col("folder").isin(*sorted(set(folders.values()))) & F.col("gram").isin(*asked))
        rare = [r["gram"] for r in known.orderBy("n", "gram").collect()]  # no more than the query is long
        if len(rare) < len(asked):  # some trigram is in no text
            return self.postings.limit(0).select("id")
        rare = rare[:RAREST]
        held = self.postings.filter(F.col("folder").isin(*sorted({folders[g] for g in rare})) & F.col("gram").isin(*rare))
        return held.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(rare)).select("id")

    def search(self, rows: DataFrame, query: str) -> DataFrame:
        """The ``rows`` of which a column contains the query, whatever the case: those that a scan finds.

        A blank query matches every row, as it does without an index.  Only candidates' texts are looked at.
        """
        if not query.strip():
            return rows
        found = rows.join(self.candidates(query).withColumnRenamed("id", self.key), self.key, "left_semi")
        return found.filter(matches(query, *[F.col(c) for c in self.columns]))


def build_index(rows: DataFrame, path: str, columns: Iterable[str], key: str = "id") -> SearchIndex:
    """The index of ``columns`` of ``rows``; rows without a key can't be found.  Repeated keys are found if any of their rows is.

    A trigram that a third of the texts have is many rows, which the range partitioning spreads over files.
    """
    columns = tuple(columns)
    texts = rows.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("own"), F.array(*[F.col(c) for c in columns]).alias("texts"))
    found = texts.select(F.col("own").alias("id"), F.explode(F.array_distinct(F.flatten(F.transform("texts", grams)))).alias("gram"))
    postings = found.withColumn("folder", _folder(F.col("gram"))).distinct()
    postings.repartitionByRange("folder", "gram", "id").sortWithinPartitions("folder", "gram", "id").write.partitionBy("folder").parquet(f"{path}/postings")
    index = SearchIndex(rows.sparkSession, path, key, columns)
    index.postings.groupBy("folder", "gram").agg(F.count("*").alias("n")).repartitionByRange("folder", "gram").sortWithinPartitions("folder", "gram").select("gram", "n", "folder").write.partitionBy("folder").parquet(f"{path}/counts")
    return index


def visible(passages: DataFrame, index: SearchIndex, query: str) -> DataFrame:
    """reader.visible() by the index: top-level passages that match, or of which a passage inside does."""
    top = F.coalesce(F.col("parent_id"), F.lit("")) == ""
    if not query.strip():
        return passages.filter(top)
    hits = index.search(passages, query)
    wanted = hits.filter(top).select("id").unionByName(hits.filter(~top).select(F.col("parent_id").alias("id"))).distinct()
    return passages.filter(top).join(wanted, "id", "left_semi").select(*passages.columns)


def selectable(passages: DataFrame, index: SearchIndex, query: str) -> DataFrame:
    """reader.selectable() by the index: passages that match, or whose parent does."""
    if not query.strip():
        return passages
    hits = index.search(passages, query).select("id").distinct()
    wanted = hits.unionByName(passages.join(hits.withColumnRenamed("id", "parent_id"), "parent_id", "left_semi").select("id")).distinct()
    return passages.join(wanted, "id", "left_semi").select(*passages.columns)
