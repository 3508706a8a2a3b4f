"""Blocks of documents, and packed arrays of hash keys that they send to buckets and get answers for.

A block is some megabytes of whole documents, dealt by hash, so copies and hot sources spread evenly.
A block sends each bucket one row with its own distinct keys in that bucket: a key costs
its eight bytes however often the block holds it, and a very frequent key comes once from a block.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .scratch import text_bytes

BLOCK_BYTES = 4_000_000
#: Keys that one bucket gets, about; it holds them all at once.
BUCKET_KEYS = 1_000_000

PACKED = "block long, bucket long, keys binary, extra binary"


def in_blocks(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """(block, key, text), and the number of blocks.  Null texts are empty."""
    n = max(1, math.ceil(text_bytes(docs, text) / BLOCK_BYTES))
    whole = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    return whole.select(F.pmod(F.xxhash64("key", "text"), F.lit(n)).alias("block"), "key", "text"), n


def table_of(schema: T.StructType, columns: dict[str, list]) -> pa.Table:
    arrow = to_arrow_schema(schema)
    return pa.Table.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)


def struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def send(block: int, keys: np.ndarray, extra: np.ndarray, buckets: int) -> dict[str, list]:
    """Rows of PACKED: the sorted distinct ``keys`` with a fixed-width value each, dealt to buckets."""
    bucket = bucket_of(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    keys, extra, bucket = keys[order], extra[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    parts = [(b[0], k, e) for b, k, e in zip(np.split(bucket, cuts), np.split(keys, cuts), np.split(extra, cuts), strict=True) if len(k)]
    return {"block": [block] * len(parts), "bucket": [int(b) for b, _, _ in parts], "keys": [k.tobytes() for _, k, _ in parts], "extra": [e.tobytes() for _, _, e in parts]}


def answer(schema: T.StructType, width: type, solve: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], echo: bool = True) -> Callable[[pa.Table], pa.Table]:
    """For groups by bucket: ``solve(index, extra, sender)`` gives one value a key sent; index numbers the distinct keys.

    Without ``echo`` the keys don't go back, and answers_to() puts the values to them.
    """

    def run(group: pa.Table) -> pa.Table:
        sent = [np.frombuffer(k, np.uint64) for k in group["keys"].to_pylist()]
        extra = np.concatenate([np.frombuffer(e, width) for e in group["extra"].to_pylist()])
        _, index = np.unique(np.concatenate(sent), return_inverse=True)
        sizes = np.array([len(k) for k in sent])
        values = solve(index, extra, np.repeat(np.arange(len(sent)), sizes))
        cuts = np.cumsum(sizes)[:-1]
        return table_of(schema, {"block": group["block"].to_pylist(), "bucket": group["bucket"].to_pylist(), "keys": group["keys"].to_pylist() if echo else [None] * len(sent), "extra": [v.tobytes() for v in np.split(values, cuts)]})

    return run


def answers_of(replies: pa.Table, width: type) -> tuple[np.ndarray, np.ndarray]:
    """The keys of one block, sorted, and the value that each got."""
    if not replies.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, width)
    keys = np.concatenate([np.frombuffer(k, np.uint64) for k in replies["keys"].to_pylist()])
    values = np.concatenate([np.frombuffer(v, width) for v in replies["extra"].to_pylist()])
    order = np.argsort(keys)
    return keys[order], values[order]


def answers_to(keys: np.ndarray, replies: pa.Table, width: type, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct ``keys`` that a block has sent, and the value that each got in replies without keys."""
    bucket = bucket_of(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, values = bucket[order], np.zeros(len(keys), width)
    for b, raw in zip(replies["bucket"].to_pylist(), replies["extra"].to_pylist(), strict=True):
        got = np.frombuffer(raw, width)
        start = np.searchsorted(bucket, b)
        values[order[start : start + len(got)]] = got
    return keys, values


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of keys that are all there."""
    return values[np.searchsorted(keys, wanted)]
