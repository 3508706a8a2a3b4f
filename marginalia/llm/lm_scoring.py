"""Log probability of whole texts under a language model learned from the corpus, beside a unigram base.

P(word | before) = P(first subword id | first ids before) * (share * count(word) / count(first id)
+ (1 - share) * P(other ids | first id)): the attention model gives both conditional
probabilities, the counts are of all training documents.  Learning takes two jobs:
1. Every task counts the bigrams of subword ids in its training documents, and goes on training
   the model, started on a bounded sample, with every window of them once, some megabytes
   of text at a time.  Counts are summed and weights are averaged over all tasks.
2. Blocks of documents ask for the count of each of their distinct words, and score.
"""

from __future__ import annotations

import copy
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import exchange as X
from . import language_model as L
from . import words as W
from .labelled import remainder
from .scratch import settle

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PARTS, HELD_OUT = 7, 2
SAMPLE_ROWS, SAMPLE_BYTES = 1000, 8_000_000
FIRST_STEPS, FIRST_RATE = 600, 0.01
RATE = 0.002
#: Text of the documents whose windows are shuffled together.
PIECE_BYTES = 4_000_000
SHARE = 0.9
#: Distinct words whose insides a task keeps from block to block.
CACHED_WORDS = 2_000_000


def is_held_out(key: int | None) -> bool:
    return key is not None and zlib.crc32(str(key).encode()) % PARTS == HELD_OUT


class _Streams:
    """Words of some documents, their subword ids, and the streams that the model scores."""

    def __init__(self, raw: list[bytes]) -> None:
        self.found = W.split_words(raw, W.SPACED)
        self.distinct, self.where, self.inverse = W.distinct(self.found.hashes())

    def spell(self, subwords: L.Subwords) -> tuple[tuple, tuple]:
        ids, first = subwords.ids(self.found.lines(self.where)) if len(self.where) else (np.zeros(0, np.int16), np.zeros(1, np.int64))
        outer = L.outer_streams(ids[first[:-1]][self.inverse], self.found.first)
        return outer, L.inside_streams(ids, first)

    def bigrams(self, outer: tuple, inside: tuple) -> np.ndarray:
        """Counts of ids in texts, and of ids in distinct words: insides are asked for where a word is new, and new words are like rare ones."""
        count = lambda s: np.bincount(s[0].astype(np.int64) * L.SIZE + s[1], minlength=L.SIZE**2).reshape(L.SIZE, L.SIZE)
        return np.stack([count(outer), count(inside)])


def first_model(texts: list[str | None], subwords: L.Subwords) -> L.Model:
    """A model from a sample of texts alone."""
    counts, streams = np.zeros((2, L.SIZE, L.SIZE)), []
    for _, _, raw in W.chunks(texts, lower=True, size=PIECE_BYTES):
        s = _Streams(raw)
        outer, inside = s.spell(subwords)
        counts += s.bigrams(outer, inside)
        streams.append((outer, inside))
    model = L.Model.start(counts)
    model.train(streams, FIRST_RATE, steps=FIRST_STEPS)
    return model


def _learn(shared, path: str, schema: pa.Schema):
    """Rows (code, value): bigram counts by code, and behind them the sum of weights and how often they were summed."""

    def rows(codes: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(values, pa.float64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, model = L.Subwords(path), copy.deepcopy(shared.value)
        counts, pieces = np.zeros((2, L.SIZE, L.SIZE)), 0
        for batch in batches:
            for _, _, raw in W.chunks(batch.column(0).to_pylist(), lower=True, size=PIECE_BYTES):
                s = _Streams(raw)
                outer, inside = s.spell(subwords)
                counts += s.bigrams(outer, inside)
                model.train([(outer, inside)], RATE, seed=pieces)
                pieces += 1
        if pieces:
            codes = np.flatnonzero(counts)
            yield rows(codes, counts.ravel()[codes])
            flat = np.concatenate([model.weights[k].ravel() for k in sorted(model.weights)]).astype(np.float64)
            yield rows(counts.size + np.arange(len(flat) + 1), np.append(flat, 1.0) * pieces)

    return run


def first_sample(train: DataFrame, key: str, text: str, rows: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES) -> list[str]:
    """At most ``rows`` texts of ``max_bytes`` together, the same ones on every run; rows that are equal in key and text count once.

    Texts are taken in the order of a hash; one that doesn't fit into what is left of the bytes is passed over.
    Only hashes and sizes are sorted; texts are read again by the hashes that were chosen.
    """
    drawn = train.select(F.xxhash64(F.lit(23), key, text).alias("draw"), F.coalesce(text, F.lit("")).alias("text"))
    # a share of the rows first, so that tasks don't send ``rows`` each
    share = min(1.0, 3 * rows / max(1, train.count()))
    some = drawn.filter(F.pmod("draw", F.lit(2**40)) <= int(share * 2**40))
    sizes = some.groupBy("draw").agg(F.max(F.octet_length("text")).alias("size")).orderBy("draw").limit(rows).collect()
    fits, left = [], max_bytes
    for draw, size in sizes:
        if size <= left:
            fits.append(draw)
            left -= size
    found = some.filter(F.col("draw").isin(fits)).groupBy("draw").agg(F.min("text").alias("text")).collect() if fits else []
    return [r.text for r in sorted(found, key=lambda r: r.draw)]


def learn(train: DataFrame, key: str, text: str, path: str) -> tuple[L.Model, np.ndarray]:
    """The model, and how often each subword id begins a word (or the end) in the training documents."""
    spark = train.sparkSession
    start = first_model(first_sample(train, key, text, SAMPLE_ROWS, SAMPLE_BYTES), L.Subwords(path))
    kind = X.struct("code long, value double")
    told = train.select(text).mapInArrow(_learn(spark.sparkContext.broadcast(start), path, to_arrow_schema(kind)), kind)
    # at most 2 SIZE**2 codes and the weights, whatever the corpus
    summed = told.groupBy("code").agg(F.sum("value").alias("value")).toArrow()
    code, value = summed["code"].to_numpy(), summed["value"].to_numpy()
    size = 2 * L.SIZE**2
    counts = np.zeros(size)
    counts[code[code < size]] = value[code < size]
    counts = counts.reshape(2, L.SIZE, L.SIZE)
    model = L.Model.counted(counts, start.classes, start.weights)
    flat = np.zeros(sum(w.size for w in start.weights.values()) + 1)
    flat[code[code >= size] - size] = value[code >= size]
    if flat[-1]:
        flat, at = flat / flat[-1], 0
        for k in sorted(model.weights):
            n = model.weights[k].size
            model.weights[k] = flat[at : at + n].reshape(model.weights[k].shape).astype(np.float32)
            at += n
    return model, counts[0].sum(0)


class _Insides:
    """First id and inner log probability of words seen before in this worker, for one model."""

    kept: dict[int, "_Insides"] = {}

    def __init__(self) -> None:
        self.hashes, self.first, self.inner = np.zeros(0, np.uint64), np.zeros(0, np.int16), np.zeros(0, np.float32)

    @classmethod
    def of(cls, name: int) -> "_Insides":
        if name not in cls.kept:
            cls.kept = {name: cls()}
        return cls.kept[name]

    def look_up(self, s: _Streams, model: L.Model, subwords: L.Subwords) -> tuple[np.ndarray, np.ndarray]:
        slot = np.minimum(np.searchsorted(self.hashes, s.distinct), max(0, len(self.hashes) - 1))
        new = np.flatnonzero(self.hashes[slot] != s.distinct) if len(self.hashes) else np.arange(len(s.distinct))
        if len(new):
            ids, first = subwords.ids(s.found.lines(s.where[new]))
            inner = np.add.reduceat(model.scores(1, *L.inside_streams(ids, first)), first[:-1])
            hashes = np.concatenate([self.hashes, s.distinct[new]])
            order = np.argsort(hashes, kind="stable")
            self.hashes = hashes[order]
            self.first = np.concatenate([self.first, ids[first[:-1]]])[order]
            self.inner = np.concatenate([self.inner, inner])[order]
        slot = np.searchsorted(self.hashes, s.distinct)
        out = self.first[slot], self.inner[slot]
        if len(self.hashes) > CACHED_WORDS:
            self.__init__()
        return out


def _ask(buckets: int, schema):
    def run(group: pa.Table) -> pa.Table:
        s = _Streams([W.encode(t).lower() for t in group["text"].to_pylist()])
        learned = np.repeat([not is_held_out(k) for k in group["key"].to_pylist()], s.found.counts)
        counts = np.bincount(s.inverse[learned], minlength=len(s.distinct))
        return X.table_of(schema, X.send(group["block"][0].as_py(), s.distinct, counts.astype(np.int64), buckets))

    return run


def _answer(schema):
    """Counts over all blocks; and one row of totals, to the first block that asked, with bucket -1."""
    totals: list[np.ndarray] = []

    def add_up(index: np.ndarray, counts: np.ndarray, _: np.ndarray) -> np.ndarray:
        by_key = np.bincount(index, counts).astype(np.int64)
        totals[:] = [np.array([np.count_nonzero(by_key), by_key.sum()], np.int64)]
        return by_key[index]

    def run(group: pa.Table) -> pa.Table:
        told = X.answer(schema, np.int64, add_up)(group)
        return pa.concat_tables([told, X.table_of(schema, {"block": [group["block"][0].as_py()], "bucket": [-1], "keys": [b""], "extra": [totals[0].tobytes()]})])

    return run


_SCORED = "key long, held_out boolean, n_words long, n_known long, counted double, score double, distinct long, total long"


def _score(shared, heads, path: str, name: int, schema):
    def run(group: pa.Table, replies: pa.Table) -> pa.Table:
        model, often, subwords = shared.value, heads.value, L.Subwords(path)
        bucket = replies["bucket"].to_numpy()
        keys, counts = X.answers_of(replies.filter(pa.array(bucket >= 0)), np.int64)
        s = _Streams([W.encode(t).lower() for t in group["text"].to_pylist()])
        first_id, inner = _Insides.of(name).look_up(s, model, subwords)
        count = X.look_up(keys, counts, s.distinct) if len(s.distinct) else np.zeros(0, np.int64)
        rest = np.log10(SHARE * count / np.maximum(1, often[first_id]) + (1 - SHARE) * np.exp(inner.astype(np.float64)) + 1e-300)
        inputs, targets, begins = L.outer_streams(first_id[s.inverse], s.found.first)
        outer = model.scores(0, inputs, targets, begins).astype(np.float64) / np.log(10)
        by_word = lambda values: np.diff(np.concatenate([[0], np.cumsum(values[s.inverse], dtype=np.float64)])[s.found.first])
        stats = [np.frombuffer(e, np.int64) for e, b in zip(replies["extra"].to_pylist(), bucket, strict=True) if b < 0]
        group_keys, more = group["key"].to_pylist(), len(stats)
        return X.table_of(
            schema,
            {
                "key": group_keys + [None] * more,
                "held_out": [is_held_out(k) for k in group_keys] + [None] * more,
                "n_words": s.found.counts.tolist() + [None] * more,
                "n_known": by_word((count > 0).astype(np.float64)).round().astype(int).tolist() + [None] * more,
                "counted": by_word(np.log10(count + 1.0)).tolist() + [None] * more,
                "score": (np.add.reduceat(outer, begins[:-1]) + by_word(rest)).tolist() + [None] * more,
                "distinct": [None] * len(group_keys) + [int(x[0]) for x in stats],
                "total": [None] * len(group_keys) + [int(x[1]) for x in stats],
            },
        )

    return run


def score_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row a document: key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Null and empty texts are a lone end.  Keys are integers; rows with null keys are learned from.
    Repeated rows are each learned from and scored.  Other columns are dropped.  An empty table gives
    an empty result.  ``vocabulary`` is a file that every executor has.
    """
    spark = docs.sparkSession
    train = docs.filter(F.coalesce(remainder(key, PARTS) != HELD_OUT, F.lit(True))).select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    model, heads = learn(train, "key", "text", vocabulary)
    share = spark.sparkContext.broadcast
    blocks, n_blocks = X.in_blocks(docs, key, text)
    packed, scored = X.struct(X.PACKED), X.struct(_SCORED)
    asked = blocks.groupBy("block").applyInArrow(_ask(max(1, n_blocks // 4), packed), packed)
    told = asked.groupBy("bucket").applyInArrow(_answer(packed), packed)
    name = int.from_bytes(os.urandom(7), "big")
    work = _score(share(model), share(heads), vocabulary, name, scored)
    done = settle(blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(work, scored), "scores")
    total = done.agg(F.sum("distinct"), F.sum("total"), F.count_if(~F.col("held_out"))).first()
    ends = total[2]
    n, v = (total[1] or 0) + ends, (total[0] or 0) + (ends > 0)
    base = F.col("counted") + F.log10(F.lit(float(ends + 1))) - (F.col("n_words") + 1) * F.log10(F.lit(float(n + v + 1)))
    return done.filter("held_out is not null").select(
        F.col("key").alias(key),
        "held_out",
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("n_known") + int(ends > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
    )
