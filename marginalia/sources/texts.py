"""Plain texts, web pages and parallel texts by passage id."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.html import BOILERPLATE, page_paragraphs

PARALLEL = "language string, part int, elements map<string,string>"


def read_raw_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): whole files with \\n as line ends."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.replace("value", F.lit("\r\n"), F.lit("\n")).alias("value"))


def read_pages(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """(path, html) of saved web pages."""
    return decoded(spark.read.format("binaryFile").load(path), encoding)


def decoded(files: DataFrame, encoding: str = "ISO-8859-1") -> DataFrame:
    """(path, html) of (path, content) with the bytes of pages."""
    return files.select("path", F.decode("content", encoding).alias("html"))


def page_lines(pages: DataFrame, key: str, html: str = "html", boilerplate: list[str] = BOILERPLATE) -> DataFrame:
    """(key, pos, paragraph) of pages, one row a paragraph."""
    return pages.select(key, F.posexplode(page_paragraphs(F.col(html), boilerplate)).alias("pos", "paragraph"))


def read_parallel(spark: SparkSession, path: str) -> DataFrame:
    """(id, latin_text) from JSON documents with a map of texts by passage id; none if there is no such file."""
    try:
        found = spark.read.schema(PARALLEL).json(path, multiLine=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "id string, latin_text string")
    return found.select(F.explode("elements").alias("id", "latin_text"))


def parallel_json(texts: DataFrame, language: str = "la") -> DataFrame:
    """(part, value): a JSON document a part from (part, id, text) rows; ids in order."""
    entries = F.sort_array(F.collect_list(F.struct("id", "text")))
    made = texts.groupBy("part").agg(F.map_from_entries(entries).alias("elements"))
    return made.select("part", F.to_json(F.struct(F.lit(language).alias("language"), "part", "elements")).alias("value"))


def write_parallel(texts: DataFrame, path: str, language: str = "la") -> None:
    """One JSON file a part, in folders file=<part>."""
    parallel_json(texts, language).select("value", F.col("part").alias("file")).write.partitionBy("file").text(path)
