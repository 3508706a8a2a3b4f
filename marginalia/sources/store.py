"""A triple store laid out for the patterns it is asked: two copies, in buckets by subject and by object.

Either copy has a folder for each relation, buckets in it, and rows sorted within a bucket; the term that isn't bucketed has a
Bloom filter in each file.  A pattern with a subject or an object reads one bucket of one copy.  Joins of subjects with subjects and of objects with
subjects meet bucket by bucket, without an exchange.  A resource that very many triples have for their object (a class, say) would make one
huge bucket: such objects lie in a third table without buckets, and joins take them separately.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .triples import COLUMNS

#: An object with more rows than so many buckets have in the mean is kept apart.
HOT_BUCKETS = 4


@dataclass
class TripleStore:
    """Three tables of the session's catalog, ``<name>_by_s``, ``<name>_by_o`` and ``<name>_hot``."""

    spark: SparkSession
    name: str

    @property
    def by_subject(self) -> DataFrame:
        return self.spark.table(f"{self.name}_by_s").select(*COLUMNS)

    @property
    def by_object(self) -> DataFrame:
        """Triples whose object isn't hot."""
        return self.spark.table(f"{self.name}_by_o").select(*COLUMNS)

    @property
    def hot(self) -> DataFrame:
        """Triples of the objects that have more than HOT_BUCKETS buckets' share."""
        return self.spark.table(f"{self.name}_hot").select(*COLUMNS)

    def match(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        """Triples that agree with the given terms, from the copy in which they lie together.

        With an object alone, both its bucket and the hot objects' table are looked at; either is sorted by it.
        """
        if s is None and o is not None:
            rows = self.by_object.unionByName(self.hot)
        else:
            rows = self.by_subject
        for name, value in (("s", s), ("p", p), ("o", o)):
            rows = rows if value is None else rows.filter(F.col(name) == value)
        return rows

    def star(self, *relations: str) -> DataFrame:
        """(s, o_1, o_2, ...): subjects with an object in each of the relations, one row for each combination."""
        out = None
        for k, p in enumerate(relations, 1):
            own = self.by_subject.filter(F.col("p") == p).select("s", F.col("o").alias(f"o_{k}"))
            out = own if out is None else out.join(own, "s")
        return out

    def path(self, first: str, second: str) -> DataFrame:
        """(s, via, o): triples of ``first`` whose object is a subject of ``second``."""
        ahead = self.by_subject.filter(F.col("p") == second).select(F.col("s").alias("via"), "o")
        parts = []
        for behind in (self.by_object, self.hot):
            own = behind.filter((F.col("p") == first) & (F.col("o_kind") == "iri")).select("s", F.col("o").alias("via"))
            parts.append(own.join(ahead, "via").select("s", "via", "o"))
        return parts[0].unionByName(parts[1])


def save_store(triples: DataFrame, name: str, path: str, buckets: int = 64) -> TripleStore:
    """The store of a set of triples, in a folder that all executors share; both copies have as many buckets.

    Nulls in a triple are no triple.  Subjects are taken to have no more triples than a bucket holds; objects need not.
    An empty set makes an empty store.
    """
    spark = triples.sparkSession
    rows = triples.select(*COLUMNS).na.drop()
    counted = rows.groupBy("o").agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    # one row on the right, so that this is a broadcast of one number
    hot = counted.join(F.broadcast(total), F.col("n") * buckets > F.col("total") * HOT_BUCKETS).select("o")
    plain, apart = rows.join(hot, "o", "left_anti").select(*COLUMNS), rows.join(hot, "o", "left_semi").select(*COLUMNS)
    for part, key, other in ((rows, "s", "o"), (plain, "o", "s")):
        writer = part.repartition(buckets, key).write.format("parquet").partitionBy("p").bucketBy(buckets, key).sortBy(key)
        writer.option(f"parquet.bloom.filter.enabled#{other}", "true").option("path", f"{path}/by_{key}").saveAsTable(f"{name}_by_{key}")
    apart.repartitionByRange("p", "o", "s").sortWithinPartitions("p", "o", "s").write.format("parquet").partitionBy("p").option("path", f"{path}/hot").saveAsTable(f"{name}_hot")
    return TripleStore(spark, name)


def drop_store(store: TripleStore) -> None:
    """Takes the tables out of the catalog; the files stay where they are."""
    for kind in ("by_s", "by_o", "hot"):
        store.spark.sql(f"DROP TABLE IF EXISTS {store.name}_{kind}")
