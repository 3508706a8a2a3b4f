"""Supervised subword embeddings: a quality score for every document.

A word is the mean of the learned vectors of its hashed form and its hashed character n-grams; a
document is the mean of its words plus the mean of its word pairs, under a softmax.  A pair of
equal words has one vector of its own, so repetition is seen whatever is repeated.  The vectors are
trained by stochastic gradient descent in numpy on a bounded sample of labelled rows.  As all
layers are linear before the softmax, scoring needs one number a bucket, and each distinct
word of a batch is worked out once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .columns import add_struct, free_name
from .labelled import sampled

SAMPLE_ROWS = 4000
BUCKETS = 1 << 17
SIZES = (3, 4)
DIM = 8
EPOCHS = 8
RATE = 0.5
BATCH = 8
SCORED = T.StructType([T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False)])


@dataclass
class Features:
    """Buckets of a few texts: of each distinct word (ragged), of each pair, and which word is where."""

    found: W.Words
    inverse: np.ndarray
    word_buckets: np.ndarray
    word_first: np.ndarray
    pair_buckets: np.ndarray
    pair_doc: np.ndarray


def _bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (W.mix(hashes + np.uint64(kind)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def features(raw: list[bytes]) -> Features:
    found = W.split_words(raw, W.SPACED)
    hashes = found.hashes()
    distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    starts, lengths = found.starts[where], found.ends[where] - found.starts[where]
    # the distinct words, each between two marks, end to end
    first = np.concatenate([[0], np.cumsum(lengths + 2)])
    buffer = np.full(first[-1], ord(" "), np.uint8)
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    buffer[np.repeat(first[:-1] + 1, lengths) + at] = found.buffer[np.repeat(starts, lengths) + at]
    owner = np.repeat(np.arange(len(distinct)), lengths + 2)
    buckets, owners = [_bucket(distinct, 1)], [np.arange(len(distinct))]
    letters = buffer.astype(np.uint64) + np.uint64(1)
    for n in SIZES:
        m = max(0, len(buffer) - n + 1)
        code = np.zeros(m, np.uint64)
        for k in range(n):
            code = code * np.uint64(257) + letters[k : k + m]
        inside = owner[:m] == owner[n - 1 : n - 1 + m]
        buckets.append(_bucket(code[inside], 2 + n))
        owners.append(owner[:m][inside])
    owners_all = np.concatenate(owners)
    order = np.argsort(owners_all, kind="stable")
    word_first = np.searchsorted(owners_all[order], np.arange(len(distinct) + 1))
    with np.errstate(over="ignore"):
        pair = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]
    pair[hashes[:-1] == hashes[1:]] = 0
    ok = W.inside_documents(found.first, 2, len(hashes))
    return Features(found, inverse, np.concatenate(buckets)[order], word_first, _bucket(pair, 2)[ok], found.doc_of()[:-1][ok] if len(hashes) else np.zeros(0, np.int64))


def _means(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return (total[first[1:]] - total[first[:-1]]) / np.maximum(1, np.diff(first))


def sparse_rows(f: Features) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its buckets and their weights in the document's vector; bucket BUCKETS stands in every text."""
    out = []
    share = 1 / np.diff(f.word_first)
    pair_first = np.searchsorted(f.pair_doc, np.arange(len(f.found.first)))
    for d, (a, b) in enumerate(zip(f.found.first[:-1], f.found.first[1:], strict=True)):
        word, count = np.unique(f.inverse[a:b], return_counts=True)
        sizes = f.word_first[word + 1] - f.word_first[word]
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(f.word_first[word], sizes)
        pairs = f.pair_buckets[pair_first[d] : pair_first[d + 1]]
        ids = np.concatenate([f.word_buckets[at], pairs, [BUCKETS]])
        weights = np.concatenate([np.repeat(count * share[word], sizes) / max(1, b - a), np.full(len(pairs), 1 / max(1, len(pairs))), [1.0]])
        ids, back = np.unique(ids, return_inverse=True)
        out.append((ids.astype(np.int32), np.bincount(back, weights).astype(np.float32)))
    return out


@dataclass
class QualityModel:
    """``margin`` of a bucket: what it adds to the log odds of label 1."""

    margin: np.ndarray

    @classmethod
    def fit(cls, examples: list[tuple[str | None, int]], seed: int = 7) -> "QualityModel":
        rng = np.random.default_rng(seed)
        rows: list[tuple[np.ndarray, np.ndarray]] = []
        for _, _, raw in W.chunks([t for t, _ in examples], lower=False):
            rows += sparse_rows(features(raw))
        labels = np.array([int(y == 1) for _, y in examples])
        vectors = (rng.random((BUCKETS + 1, DIM), np.float32) - 0.5) / DIM
        out = np.zeros((DIM, 2), np.float32)
        steps, total = 0, EPOCHS * len(rows)
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), BATCH):
                batch = order[k : k + BATCH]
                rate = RATE * (1 - steps / total)
                steps += len(batch)
                ids = np.concatenate([rows[i][0] for i in batch])
                weights = np.concatenate([rows[i][1] for i in batch])
                doc = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
                first = np.searchsorted(doc, np.arange(len(batch)))
                hidden = np.add.reduceat(vectors[ids] * weights[:, None], first)
                logits = hidden @ out
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(batch)), labels[batch]] -= 1
                back = np.clip(p @ out.T, -1, 1).astype(np.float32)  # keeps a step from running away
                out -= rate / len(batch) * (hidden.T @ p)
                np.add.at(vectors, ids, -rate * weights[:, None] * back[doc])
        return cls((vectors @ (out[:, 1] - out[:, 0])).astype(np.float64))

    def scores(self, texts: list[str | None]) -> list[float]:
        out: list[float] = []
        for _, _, raw in W.chunks(texts, lower=False):
            f = features(raw)
            word = _means(self.margin[f.word_buckets], f.word_first)
            margin = _means(word[f.inverse], f.found.first)
            pair_first = np.searchsorted(f.pair_doc, np.arange(len(f.found.first)))
            margin += _means(self.margin[f.pair_buckets], pair_first) + self.margin[BUCKETS]
            out += (1 / (1 + np.exp(-np.clip(margin, -30, 30)))).tolist()
        return out


def _fit_group(group: pa.Table) -> pa.Table:
    group = group.sort_by("key")
    model = QualityModel.fit(list(zip(group["text"].to_pylist(), group["_label"].to_pylist(), strict=True)))
    return pa.table({"margin": pa.array([model.margin.tobytes()], pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, usable, *, label: str = "quality", rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text") -> QualityModel:
    """Fit on at most ``rows`` labelled rows for which ``usable`` holds.  Without examples every score is 0.5.

    One task fits the bounded sample; the driver gets the margins alone, and never the texts or their features.
    """
    some = sampled(docs, labels, label, rows, usable, key, text)
    fitted = some.select(F.col(key).alias("key"), "text", "_label").groupBy().applyInArrow(_fit_group, "margin binary").first() if some is not None else None
    return QualityModel(np.frombuffer(fitted.margin).copy() if fitted else np.zeros(BUCKETS + 1))


def annotate(docs: DataFrame, model: QualityModel, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct column (score, predicted), and that column's name.

    Null and empty texts get the score that the model gives to no words.  Rows are scored one by
    one: repeated rows, null ids and other columns stay as they are.
    """
    name = free_name(docs, "quality")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def score(texts: list) -> dict[str, list]:
            scores = shared.value.scores(texts)
            return {"score": scores, "predicted": [int(s >= 0.5) for s in scores]}

        return score

    return add_struct(docs, [text], name, SCORED, make), name


def keep_good(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """The rows that the model accepts, with the columns of ``docs``."""
    scored, name = annotate(docs, model, text)
    return scored.filter(F.col(f"{name}.predicted") == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
