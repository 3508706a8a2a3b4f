"""Quartile bucket digests of whole texts, and each text held against its successor.

The byte triplets in a sliding window are hashed into buckets; a bucket's two bits say in which
quartile of all bucket counts its count lies.  The digest is the length on a logarithmic scale, the
ratios of the quartiles and those bits, in hex.  The difference of two digests adds up bucket
distances (a distance of three counts double) and header distances, and is bounded.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import words as W
from .scratch import settle

BUCKETS = 256
#: Code points of a text by which rows of one key are dealt to partitions.
RANGED_CHARS = 64
#: Offsets of the bytes of a triplet in the window.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
#: Differences from here on count as no likeness at all.
BOUND = 400
_HEADER = 3


def digests(raw: list[bytes]) -> np.ndarray:
    """One row of codes a text: length, two quartile ratios, then a quartile for each bucket."""
    joined = b"\0\0\0\0".join([*raw, b""])
    buffer = np.frombuffer(joined, np.uint8).astype(np.uint32)
    m = len(buffer) - 3
    hashed = []
    for salt, (x, y, z) in enumerate(TRIPLETS):
        code = buffer[x : x + m] | (buffer[y : y + m] << np.uint32(8)) | (buffer[z : z + m] << np.uint32(16))
        code += np.uint32((salt + 1) << 24)
        code *= np.uint32(0x9E3779B1)
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x85EBCA77)
        hashed.append((code >> np.uint32(24)).astype(np.uint8))
    out = np.zeros((len(raw), _HEADER + BUCKETS), np.uint8)
    counts = np.zeros((len(raw), BUCKETS), np.int64)
    at = 0
    for i, text in enumerate(raw):
        n = len(text)
        for (_, _, z), h in zip(TRIPLETS, hashed, strict=True):
            if n > z:
                counts[i] += np.bincount(h[at : at + n - z], minlength=BUCKETS)
        out[i, 0] = min(255, int(8 * math.log2(n + 1)))
        at += n + 4
    ordered = np.sort(counts, axis=1)
    q = ordered[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    top = np.maximum(1, q[:, 2])
    out[:, 1], out[:, 2] = q[:, 0] * 15 // top, q[:, 1] * 15 // top
    out[:, _HEADER:] = (counts[:, :, None] > q[:, None, :]).sum(2)
    return out


def as_hex(codes: np.ndarray) -> list[str]:
    header = codes[:, 0].astype(np.uint8)[:, None], (codes[:, 1] * 16 + codes[:, 2]).astype(np.uint8)[:, None]
    c = codes[:, _HEADER:].reshape(len(codes), BUCKETS // 4, 4)
    body = c[:, :, 0] * 64 + c[:, :, 1] * 16 + c[:, :, 2] * 4 + c[:, :, 3]
    return [bytes(r).hex() for r in np.concatenate([*header, body.astype(np.uint8)], axis=1)]


def from_hex(texts: list[str]) -> np.ndarray:
    rows = np.array([list(bytes.fromhex(t)) for t in texts], np.uint8).reshape(len(texts), 2 + BUCKETS // 4)
    body = rows[:, 2:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3
    return np.concatenate([rows[:, :1], rows[:, 1:2] >> 4, rows[:, 1:2] & 15, body.reshape(len(texts), -1)], axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests, 0 from a difference of BOUND on."""
    gap = np.abs(a.astype(np.int64) - b.astype(np.int64))
    body = gap[:, _HEADER:]
    far = (body + 3 * (body == 3)).sum(1)
    header = gap[:, :_HEADER]
    far = far + np.where(header[:, 0] <= 2, header[:, 0], 2 * header[:, 0]) + 4 * header[:, 1:].sum(1)
    return 1 - np.minimum(far, BOUND) / BOUND


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the beginning of ``following``."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_ROW = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _fingerprint_pairs(ids: list, texts: list[str], following: list[str]) -> dict[str, list]:
    changed = [W.encode(edited(a, b)) for a, b in zip(texts, following, strict=True)]
    n = len(ids)
    codes = digests([*map(W.encode, texts), *changed, *map(W.encode, following)])
    own, other, after = codes[:n], codes[n : 2 * n], codes[2 * n :]
    return {
        "id": ids,
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(x).hexdigest() for x in changed],
        "fingerprint": as_hex(own),
        "edited_fingerprint": as_hex(other),
        "near_edited": likeness(own, other).tolist(),
        "near_next": likeness(own, after).tolist(),
    }


def _with_following(rows: Iterator[tuple], schema: pa.Schema, ends: bool) -> Iterator[pa.RecordBatch]:
    """Results for each (id, text) that has a successor in ``rows``; with ``ends``, also the first and last row as they are."""

    def batch(made: dict[str, list]) -> pa.RecordBatch:
        n = len(next(iter(made.values()), []))
        return pa.RecordBatch.from_arrays([pa.array(made.get(f.name, [None] * n), f.type) for f in schema], schema=schema)

    ids, texts, following, size = [], [], [], 0
    first = before = None
    for row in rows:
        if before is None:
            first = row
        else:
            ids.append(before[0])
            texts.append(before[1])
            following.append(row[1])
            size += 2 * len(before[1]) + len(row[1])
            if size > W.CHUNK_BYTES:
                yield batch(_fingerprint_pairs(ids, texts, following))
                ids, texts, following, size = [], [], [], 0
        before = row
    if ids:
        yield batch(_fingerprint_pairs(ids, texts, following))
    if ends and first is not None:
        part = TaskContext.get().partitionId()
        yield batch({"id": [first[0], before[0]], "part": [part, part], "text": [first[1], before[1]], "last": [False, True]})


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint every text, its edited text, and its likeness to the next document in ascending ``key``.

    After the last row comes the first.  Null texts are empty; null keys come first; rows of the same
    key are ordered by text.  Other columns are dropped.  An empty table gives an empty result.

    The table is range-partitioned once, by key and the beginning of the text, and each task streams its rows in order; the last
    row of each partition is joined with the first of the next one afterwards, so no task sees more than its part.  A window in one
    task has the numbers of the partitions alone.  Rows that are equal in key and in RANGED_CHARS of text stay in one partition, as a stream.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType
    result = T.StructType([T.StructField("id", kind), *T._parse_datatype_string(_ROW).fields])
    carried = T.StructType([*result.fields, T.StructField("part", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("last", T.BooleanType())])
    arrow_carried, arrow_result = to_arrow_schema(carried), to_arrow_schema(result)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).repartitionByRange(parts, "id", F.substring("text", 1, RANGED_CHARS)).sortWithinPartitions("id", "text")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        return _with_following(rows, arrow_carried, ends=True)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = _fingerprint_pairs(*[b.column(k).to_pylist() for k in range(3)])
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in arrow_result], schema=arrow_result)

    done = settle(ordered.mapInArrow(within, carried), "fingerprints")
    # a partition's last row goes with the first of the next partition that has rows, the very last with the very first
    firsts = done.filter("NOT last").select(F.col("part").alias("after"), F.col("text").alias("following"))
    numbers = firsts.select(F.col("after").alias("part"))
    after = numbers.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy(F.lit(0)))).alias("after"))
    edges = done.filter("last").select("id", "part", "text").join(after, "part").join(firsts, "after").select("id", "text", "following").mapInArrow(across, result)
    return done.filter(F.col("last").isNull()).select(*result.names).unionByName(edges).withColumnRenamed("id", key)
