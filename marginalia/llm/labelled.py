"""A bounded sample of labelled texts for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import settle

#: Bytes of text that a sample holds at most.
SAMPLE_BYTES = 32_000_000


def remainder(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; null keys have no remainder."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def sampled(docs: DataFrame, labels: DataFrame, label: str, rows: int, usable: Column, key: str = "doc_id", text: str = "text", max_bytes: int = SAMPLE_BYTES) -> DataFrame | None:
    """(key, text, _label): at most ``rows`` labelled documents of ``max_bytes`` together, the same ones on every run; None without any.

    Where a key has several label rows the largest label counts; of several documents of a key,
    the least text.  Texts are taken in the order of a hash of their keys; a text that doesn't fit into what is left
    of the bytes is passed over, so a very long one costs no others.  Null keys and null labels are no examples.
    Only the keys of the sample are broadcast, and only keys and sizes are collected.
    """
    order = F.xxhash64(F.lit(17), F.col(key))
    chosen = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & usable).groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    held = chosen.orderBy(order, key).limit(rows).collect()
    if not held:
        return None
    kind = T.StructType([T.StructField(key, docs.schema[key].dataType)])
    keys = docs.sparkSession.createDataFrame(sorted(map(tuple, held)), T.StructType([*kind.fields, T.StructField("_label", T.IntegerType())]))
    matched = docs.select(key, text).join(F.broadcast(keys), key)
    # at most ``rows`` rows: repeated documents meet in a partial aggregate, in whichever task reads them
    found = settle(matched.groupBy(key).agg(F.min(text).alias("text"), F.first("_label").alias("_label")), "sample")
    sizes = found.select(key, F.coalesce(F.octet_length("text"), F.lit(0)), order).collect()
    fits, left = [], max_bytes
    for k, size, _ in sorted(sizes, key=lambda r: (r[2], r[0])):
        if size <= left:
            fits.append((k,))
            left -= size
    if not fits:
        return None
    return found.join(F.broadcast(docs.sparkSession.createDataFrame(fits, kind)), key).select(key, "text", "_label")


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, usable: Column, key: str = "doc_id", text: str = "text", max_bytes: int = SAMPLE_BYTES) -> list[tuple[str | None, int]]:
    """The texts and labels of ``sampled``, collected in the order of their keys."""
    some = sampled(docs, labels, label, rows, usable, key, text, max_bytes)
    return [(r[1], r[2]) for r in sorted(some.collect(), key=lambda r: r[0])] if some is not None else []
