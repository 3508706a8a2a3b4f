"""Severity of toxic language by cumulative-link ordinal regression over sparse word features.

P(grade >= k) = sigmoid(x.w - theta_k): one weight vector for all thresholds, theta rising with k.
x holds, for each word and word beginning of a vocabulary, whether the document has it.  The labels only say whether
a document is toxic; the ordinal targets are made from them and from evidence held apart: grade 0 is not toxic,
and toxic examples get grades 1 to 3 by how much of their text is hostile, which is the share of words that
mark toxic texts among the examples of the other half.  So no example's grade rests on marks found with its help,
and the model, which sees presence alone, predicts a density.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import words as W
from .columns import add_struct, free_name
from .labelled import sample

SAMPLE_ROWS = 8000
GRADES = 4
#: Bytes of the word beginnings that are features beside the words.
PREFIXES = (4, 6, 8)
#: A feature enters the vocabulary if one in so many examples has it, and three at least ...
LEAST_SHARE = 400
#: ... and toxic examples have it more often than by chance, by so many standard deviations.
MARKING = 3.0
#: Text of the examples whose features are counted at once.
COUNTED_BYTES = 4_000_000
SCORED = T.StructType(
    [
        T.StructField("severity", T.DoubleType(), False),
        T.StructField("grade", T.IntegerType(), False),
        T.StructField("at_least", T.ArrayType(T.DoubleType()), False),
    ]
)


def _tokens(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of every feature token: each word, and its first few letters where it has more."""
    found = W.split_words(raw, W.ALNUM)
    doc = found.doc_of()
    docs, hashes = [doc], [found.hashes()]
    for n in PREFIXES:
        long = np.flatnonzero(found.ends - found.starts > n)
        stem = W.Words(found.buffer, found.starts[long], found.starts[long] + n, found.first)
        docs.append(doc[long])
        hashes.append(stem.hashes() ^ np.uint64(n))
    return np.concatenate(docs), np.concatenate(hashes)


def _presence(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs."""
    doc, hashes = _tokens(raw)
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])])[: len(doc)])
    return doc[new], hashes[new]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class SeverityModel:
    vocabulary: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    @classmethod
    def fit(cls, examples: list[tuple[str | None, int]], steps: int = 300, ridge: float = 1e-5) -> "SeverityModel":
        texts, toxic = [t for t, _ in examples], np.array([int(y == 1) for _, y in examples])
        if not len(toxic) or toxic.min() == toxic.max():
            return cls(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES - 1, -30.0 if len(toxic) and toxic[0] else 30.0))
        vocabulary = _marking_features(texts, toxic)
        doc, word = _known_features(texts, vocabulary)
        grade = _grades(texts, toxic)
        n, m = len(toxic), len(vocabulary)
        weights, theta = np.zeros(m), np.linspace(2.0, 4.0, GRADES - 1)
        state = [np.zeros(m), np.zeros(m), np.zeros(GRADES - 1), np.zeros(GRADES - 1)]
        for step in range(1, steps + 1):
            eta = np.bincount(doc, weights[word], n)
            # likelihood of the grade: P(>= g) - P(>= g + 1)
            p = np.column_stack([np.ones(n), _sigmoid(eta[:, None] - theta), np.zeros(n)])
            slope = p * (1 - p)
            at = np.arange(n)
            share = np.maximum(p[at, grade] - p[at, grade + 1], 1e-12)
            d_eta = (slope[at, grade] - slope[at, grade + 1]) / share
            d_theta = np.zeros((n, GRADES + 1))
            d_theta[at, grade] -= slope[at, grade] / share
            d_theta[at, grade + 1] += slope[at, grade + 1] / share
            grads = (-np.bincount(word, d_eta[doc], m) / n + ridge * weights, -d_theta[:, 1:-1].mean(0))
            for k, (value, g) in enumerate(zip((weights, theta), grads, strict=True)):
                state[2 * k] += 0.1 * (g - state[2 * k])
                state[2 * k + 1] += 0.01 * (g * g - state[2 * k + 1])
                value -= 0.1 * (1 - step / (steps + 1)) * (state[2 * k] / (1 - 0.9**step)) / (np.sqrt(state[2 * k + 1] / (1 - 0.99**step)) + 1e-9)
            theta = np.maximum.accumulate(theta + np.arange(GRADES - 1) * 1e-6)
        return cls(vocabulary, weights, theta)

    def score(self, texts: list[str | None]) -> dict[str, list]:
        doc, word = _known_features(texts, self.vocabulary)
        p = _sigmoid(np.bincount(doc, self.weights[word], len(texts))[:, None] - self.thresholds)
        return {"severity": p.sum(1).tolist(), "grade": (p >= 0.5).sum(1).tolist(), "at_least": p.tolist()}


def _marking_features(texts: list[str | None], toxic: np.ndarray) -> np.ndarray:
    """Sorted hashes of the features that mark toxic examples; counts are added up a few texts at a time."""
    vocabulary, df, bad = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    for i, _, raw in W.chunks(texts, lower=True, size=COUNTED_BYTES):
        doc, hashes = _presence(raw)
        vocabulary, at = np.unique(np.concatenate([vocabulary, hashes]), return_inverse=True)
        df = np.bincount(at, np.concatenate([df, np.ones(len(hashes))]), len(vocabulary))
        bad = np.bincount(at, np.concatenate([bad, toxic[i + doc]]), len(vocabulary))
    rate = toxic.mean()
    return vocabulary[(df >= max(3, len(toxic) / LEAST_SHARE)) & (bad - df * rate > MARKING * np.sqrt(df * rate * (1 - rate)))]


def _known_features(texts: list[str | None], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, place in the vocabulary) pairs."""
    docs, words = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, _, raw in W.chunks(texts, lower=True) if len(vocabulary) else ():
        doc, hashes = _tokens(raw)
        slot = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        known = vocabulary[slot] == hashes
        pairs = np.unique(doc[known] * len(vocabulary) + slot[known])
        docs.append(i + pairs // len(vocabulary))
        words.append(pairs % len(vocabulary))
    return np.concatenate(docs), np.concatenate(words)


def _mark_shares(texts: list[str | None], vocabulary: np.ndarray) -> np.ndarray:
    """The share of each text's words that are, or begin like, one of the ``vocabulary``."""
    share = np.zeros(len(texts))
    for i, j, raw in W.chunks(texts, lower=True) if len(vocabulary) else ():
        doc, hashes = _tokens(raw)
        known = vocabulary[np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)] == hashes
        share[i:j] = np.bincount(doc[known], minlength=j - i) / np.maximum(1, np.bincount(doc, minlength=j - i))
    return share


def _grades(texts: list[str | None], toxic: np.ndarray) -> np.ndarray:
    """0 for examples that are not toxic; for the others 1 to GRADES - 1 by their share of marks of the other half.

    The cuts are quantiles of the distinct shares, so that ties leave no grade empty where there are enough of them.
    """
    half, share = np.arange(len(texts)) % 2, np.zeros(len(texts))
    for h in (0, 1):
        own, other = np.flatnonzero(half == h), np.flatnonzero(half != h)
        if len(own) and 0 < toxic[other].sum() < len(other):
            share[own] = _mark_shares([texts[k] for k in own], _marking_features([texts[k] for k in other], toxic[other]))
    grade = np.zeros(len(toxic), int)
    held = share[toxic == 1]
    cuts = np.quantile(np.unique(held), np.arange(1, GRADES - 1) / (GRADES - 1))
    grade[toxic == 1] = 1 + (held[:, None] > cuts).sum(1)
    return grade


def fit(docs: DataFrame, labels: DataFrame, usable, *, label: str = "toxic", rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text") -> SeverityModel:
    """Fit on at most ``rows`` labelled rows for which ``usable`` holds.  Without examples of both kinds the grade is constant."""
    return SeverityModel.fit(sample(docs, labels, label, rows, usable, key, text))


def annotate(docs: DataFrame, model: SeverityModel, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct column: expected grade, likeliest side of each threshold, and P(grade >= k).

    Null and empty texts have no words: only the thresholds count.  Rows are scored one by one, so
    repeated rows get equal scores; very long texts are scored whole, a megabyte of text at a time or the text alone.
    Other columns pass through; the struct's name is free.  An empty table gives an empty result.
    """
    name = free_name(docs, "toxicity")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return add_struct(docs, [text], name, SCORED, lambda: shared.value.score), name
