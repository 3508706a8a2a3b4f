"""A linear-chain conditional random field over words, in numpy: features, training, and exact marginals by forward-backward.

A word's features are its affixes, its character n-grams, itself (all hashed) and the learned lexicons that hold it.
They give a potential for each label; learned transitions link neighbours.  Marginals of many chains are worked out at
once: the chains are laid end to end, with a restart where one begins, and cut into blocks whose matrix products
carry the messages from block to block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import words as W

BUCKETS = 1 << 16
AFFIXES = (1, 2, 3, 4)
GRAMS = (2, 3)
#: Sequences of a training step, words of a sequence, and steps.
BATCH, LENGTH, STEPS = 64, 40, 300
#: Mean number of words after which a training sequence goes on in another document's text.
SEGMENT = 12
RATE, DECAY = 0.3, 1e-4
#: A word is in a lexicon if so many examples of its language have it.
KNOWN_IN = 2
#: Words of a block, about, and numbers that all block products may hold at once.
_BLOCK, _PRODUCTS = 256, 1 << 22
#: Messages are scaled after so many steps; potentials are no smaller than this share of the largest, so that none vanishes between.
_EVERY, _LEAST = 3, 1e-30


def _bucket(codes: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (W.mix(codes * np.uint64(64) + np.uint64(kind)) & np.uint64(BUCKETS - 1)).astype(np.int32)


def word_features(found: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct words, which word is where, buckets of each word end to end, where each word's begin)."""
    distinct, at, inverse = np.unique(found.hashes(), return_index=True, return_inverse=True)
    starts, ends = found.starts[at], found.ends[at]
    size, byte = ends - starts, found.buffer.astype(np.uint64) + np.uint64(1)
    owners, buckets = [np.arange(len(distinct))], [_bucket(distinct, 0)]
    for n in AFFIXES:
        own = np.flatnonzero(size >= n)
        head, tail = np.zeros(len(own), np.uint64), np.zeros(len(own), np.uint64)
        for k in range(n):
            head = head * np.uint64(257) + byte[starts[own] + k]
            tail = tail * np.uint64(257) + byte[ends[own] - n + k]
        owners += [own, own]
        buckets += [_bucket(head, 2 * n), _bucket(tail, 2 * n + 1)]
    for n in GRAMS:
        many = np.maximum(0, size - n + 1)
        own = np.repeat(np.arange(len(distinct)), many)
        place = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + starts[own]
        code = np.zeros(len(own), np.uint64)
        for k in range(n):
            code = code * np.uint64(257) + byte[place + k]
        owners.append(own)
        buckets.append(_bucket(code, 32 + n))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return distinct, inverse, np.concatenate(buckets)[order], np.searchsorted(owner[order], np.arange(len(distinct) + 1))


def _even(x: np.ndarray) -> np.ndarray:
    return x / x.sum(-1, keepdims=True)


def marginals(scores: np.ndarray, begins: np.ndarray, start: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """P(label) of every word, given all words of its chain.

    ``scores`` (words, labels) are the logs of the words' potentials, ``begins`` marks the first word of each chain,
    ``start`` and ``moves`` are the logs of the potentials of first labels and of transitions.
    """
    total, k = scores.shape
    if not total:
        return scores
    n = max(1, min(total // _BLOCK, _PRODUCTS // k**2))
    size = -(-total // n)
    pad = n * size - total  # after the end: chains of one word each
    phi = np.maximum(np.exp(scores - scores.max(1, keepdims=True)), _LEAST)
    phi = np.ascontiguousarray(np.concatenate([phi, np.ones((pad, k))]).reshape(n, size, k).swapaxes(0, 1))
    new = np.concatenate([begins, np.ones(pad, bool)]).reshape(n, size).T
    first, step = np.maximum(np.exp(start - start.max()), _LEAST), np.maximum(np.exp(moves - moves.max()), _LEAST)
    restarts = [np.flatnonzero(x) for x in new]
    product = np.broadcast_to(np.eye(k), (n, k, k))
    for j in range(size):
        moved = (product.reshape(-1, k) @ step).reshape(n, k, k)
        if len(r := restarts[j]):
            moved[r] = product[r].sum(2, keepdims=True) * first
        moved *= phi[j, :, None, :]
        product = moved / moved.max((1, 2), keepdims=True) if j % _EVERY == 0 else moved
    into, out = np.ones((n, k)), np.ones((n, k))
    for b in range(1, n):
        into[b] = _even(into[b - 1] @ product[b - 1])
    for b in range(n - 1, 0, -1):
        out[b - 1] = _even(product[b] @ out[b])
    forward, now = np.empty_like(phi), into
    for j in range(size):
        now = now @ step
        now[restarts[j]] = first
        now *= phi[j]
        forward[j] = now = _even(now) if j % _EVERY == 0 else now
    now, back = out, step.T.copy()
    for j in range(size - 1, -1, -1):
        forward[j] *= now
        now = (phi[j] * now) @ back
        now[restarts[j]] = 1.0
        if j % _EVERY == 0:
            now = _even(now)
    return _even(forward.swapaxes(0, 1).reshape(-1, k)[:total])


@dataclass
class Tagger:
    """``weights`` of the hashed features, ``known`` of the lexicons; ``lexicon`` has sorted hashes and, for each, the labels that know it."""

    labels: list[str]
    weights: np.ndarray
    known: np.ndarray
    start: np.ndarray
    moves: np.ndarray
    lexicon: tuple[np.ndarray, np.ndarray]

    def knows(self, distinct: np.ndarray) -> np.ndarray:
        """(words, labels + 1): which lexicons hold each word; the last column says that none does."""
        words, who = self.lexicon
        out = np.zeros((len(distinct), len(self.labels) + 1))
        if len(words):
            at = np.minimum(np.searchsorted(words, distinct), len(words) - 1)
            held = words[at] == distinct
            out[held, :-1] = who[at[held]]
        out[:, -1] = ~out[:, :-1].any(1)
        return out

    def word_scores(self, distinct: np.ndarray, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not len(distinct):
            return np.zeros((0, len(self.labels)))
        return np.add.reduceat(self.weights[buckets], first[:-1], axis=0) + self.knows(distinct) @ self.known

    def posteriors(self, found: W.Words) -> np.ndarray:
        """P(label) of every word of some texts, each of which is a chain."""
        distinct, inverse, buckets, first = word_features(found)
        begins = np.zeros(len(inverse), bool)
        begins[found.first[:-1][found.counts > 0]] = True
        return marginals(self.word_scores(distinct, buckets, first)[inverse], begins, self.start, self.moves)


def _lexicon(found: W.Words, distinct: np.ndarray, inverse: np.ndarray, of_doc: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    doc = found.doc_of()
    use = wanted[doc]
    pairs = np.unique(np.stack([inverse[use], doc[use]], 1), axis=0)
    many = np.zeros((len(distinct), k), np.int32)
    np.add.at(many, (pairs[:, 0], of_doc[pairs[:, 1]]), 1)
    who = many >= KNOWN_IN
    held = np.flatnonzero(who.any(1))
    return distinct[held], who[held]


def _sequences(rng: np.random.Generator, spans: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Places of words, and their labels: pieces of texts in turn, the label of each drawn anew."""
    at, label = np.zeros((BATCH, LENGTH), np.int64), np.zeros((BATCH, LENGTH), np.int64)
    for row in range(BATCH):
        done = 0
        while done < LENGTH:
            y = int(rng.integers(len(spans)))
            a, b = spans[y][int(rng.integers(len(spans[y])))]
            want = min(LENGTH - done, b - a, 1 + int(rng.geometric(1 / SEGMENT)))
            begin = int(rng.integers(a, b - want + 1))
            at[row, done : done + want], label[row, done : done + want] = np.arange(begin, begin + want), y
            done += want
    return at, label


def _expected(scores: np.ndarray, start: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of words (batch, length, labels) and the expected number of each transition, by forward-backward."""
    phi = np.exp(scores - scores.max(2, keepdims=True))
    first, step = np.exp(start - start.max()), np.exp(moves - moves.max())
    forward, back = np.empty_like(phi), np.ones_like(phi)
    forward[:, 0] = _even(first * phi[:, 0])
    for t in range(1, phi.shape[1]):
        forward[:, t] = _even(forward[:, t - 1] @ step * phi[:, t])
    for t in range(phi.shape[1] - 1, 0, -1):
        back[:, t - 1] = _even((phi[:, t] * back[:, t]) @ step.T)
    pairs = forward[:, :-1, :, None] * step * (phi * back)[:, 1:, None, :]
    return _even(forward * back), (pairs / pairs.sum((2, 3), keepdims=True)).sum((0, 1))


def fit(examples: list[tuple[str, str]], seed: int = 11) -> Tagger:
    """A tagger from (text, label); texts are lower-cased in A-Z.

    Every other example of a label teaches the lexicons alone, and the rest the weights, so that what a
    lexicon is worth is learned on words that it wasn't made of.  Training sequences change between texts, and so between
    labels, which is how transitions are learned from texts that have one label each.
    """
    examples = [(t, y) for t, y in examples if t]
    labels = sorted({y for _, y in examples})
    k, rng = len(labels), np.random.default_rng(seed)
    none = Tagger(labels, np.zeros((BUCKETS, k), np.float32), np.zeros((k + 1, k)), np.zeros(k), np.zeros((k, k)), (np.zeros(0, np.uint64), np.zeros((0, k), bool)))
    of_doc = np.array([labels.index(y) for _, y in examples], np.int64)
    found = W.split_words([W.encode(t).lower() for t, _ in examples], W.LETTERS)
    distinct, inverse, buckets, first = word_features(found)
    turn = np.zeros(len(examples), np.int64)
    for y in range(k):
        own = np.flatnonzero(of_doc == y)
        turn[own] = np.arange(len(own))
    spans = [[(found.first[d], found.first[d + 1]) for d in np.flatnonzero((of_doc == y) & (turn % 2 == 0)) if found.counts[d]] for y in range(k)]
    if k < 2 or not all(spans):  # a single label, or one of which no example has a word
        return none
    none.lexicon = _lexicon(found, distinct, inverse, of_doc, turn % 2 == 1, k)
    model, knows = none, none.knows(distinct)
    sums = [np.full_like(x, 1e-6) for x in (model.weights, model.known, model.start, model.moves)]
    for done in range(STEPS):
        at, label = _sequences(rng, spans)
        word, where = np.unique(inverse[at.ravel()], return_inverse=True)
        sizes = first[word + 1] - first[word]
        own = np.repeat(np.arange(len(word)), sizes)
        bucket = buckets[np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[word], sizes)]
        scores = np.add.reduceat(model.weights[bucket], np.cumsum(sizes) - sizes, axis=0) + knows[word] @ model.known
        gamma, expected = _expected(scores[where].reshape(BATCH, LENGTH, k), model.start, model.moves)
        gap = np.eye(k)[label] - gamma
        by_word = np.zeros((len(word), k))
        np.add.at(by_word, where, gap.reshape(-1, k))
        counted = np.zeros((k, k))
        np.add.at(counted, (label[:, :-1], label[:, 1:]), 1)
        touched, back = np.unique(bucket, return_inverse=True)
        weight_step = np.zeros((len(touched), k), np.float32)
        np.add.at(weight_step, back, by_word[own].astype(np.float32))
        steps = [(model.weights, touched, weight_step), (model.known, slice(None), knows[word].T @ by_word), (model.start, slice(None), gap[:, 0].sum(0)), (model.moves, slice(None), counted - expected)]
        for (x, i, g), total in zip(steps, sums, strict=True):
            g = g / BATCH - DECAY * x[i]
            total[i] += g * g
            x[i] += (RATE * (1 - done / STEPS) * g / np.sqrt(total[i])).astype(x.dtype)
    return model
