"""From raw documents to a mixed training set: filter, deduplicate, decontaminate, redact, mix.

Every stage works on all that its predecessor kept; all but the last return the columns of documents.
A stage's result is written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import contamination, mixing, quality, secrets, similarity
from marginalia.llm.labelled import remainder
from marginalia.llm.scratch import settle, table


def _own_columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  It learns from the labelled rows among its input.

    Null and empty texts are judged as texts without words; rows without doc_id are judged, not learned from; repeated rows go or stay
    together; texts are read whole.  Without labels all documents stay.
    """
    usable = F.coalesce(remainder("doc_id", 3) != 1, F.lit(False))
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels"), usable))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays, that of the smallest id (null ids last).

    A document is a row's id and text: rows that share an id go or stay each by its own text.  Documents
    without words are in no group.  Repeated rows of the document that stays stay.
    """
    return similarity.keep_first(docs).select(*_own_columns(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go.

    Null and empty texts are never contaminated, and stay; repeated rows and null ids are judged row by row; texts are searched whole.
    """
    return contamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced; n_chars, a column of documents, follows.

    Null texts stay null and have a null n_chars; no row goes, whatever its id, and very long texts are redacted whole.
    """
    found, spans = secrets.find_secrets(docs)
    clean = found.withColumn("text", secrets.redact(F.col("text"), F.col(spans))).drop(spans)
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.length("text").cast(kind)).select(*_own_columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The draws of the training mix: which document comes where in its source's stream.

    Null sources are a source; null and empty texts have no tokens; equal rows are drawn each; an empty table gives no draws.
    """
    return mixing.mix(docs.select("doc_id", "text", "source"))


STAGES = [
    ("quality", keep_good_quality),
    ("near_duplicates", keep_one_of_each_group),
    ("contamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: Trained classifiers, similarity joins and hash permutations are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, name)
    return docs
