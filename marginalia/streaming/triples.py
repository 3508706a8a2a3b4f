"""Triples from N3 files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from marginalia.sources.n3 import read_n3
from marginalia.sources.triples import COLUMNS, SCHEMA, statements, triples_of


def stream_triples(spark: SparkSession, folder: str, prefixes: dict[str, str]) -> DataFrame:
    """Triples of files that arrive in a folder; a stream can't be searched for its prefixes, so they are given.

    Repeated triples are dropped by state that grows with the set of triples.
    """
    text = spark.readStream.option("lineSep", " .\n").text(folder)
    return triples_of(statements(text), prefixes).dropDuplicates(COLUMNS)


def append_triples(triples: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Writes what has arrived as Parquet and stops; run it again for what has come since."""
    return triples.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_n3(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Reads N3 files that have arrived with all of read_n3's grammar, each with its own prefixes, into a folder a batch of ``table``, and stops.

    A batch that is tried again replaces its folder, so that files count once; no state is kept.  streamed_n3() reads the table.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path")  # the contents aren't read here

    def add(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.collect()]  # the names of one batch's files
        if paths:
            read_n3(spark, paths).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_n3(spark: SparkSession, table: str) -> DataFrame:
    """The set of triples of all batches so far."""
    return spark.read.schema(SCHEMA).parquet(table).select(*COLUMNS).distinct()
