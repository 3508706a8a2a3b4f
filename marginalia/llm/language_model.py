"""A small causal self-attention model in numpy over subword ids.

A document is a stream of words and one end.  A word is its subword ids (a public byte-level vocabulary,
cut off after its first merges, spells every text) and a word end.  There are two kinds of positions:
a word's first id attends to the first ids of the words before it, and its other ids attend to those
before them in the word.  So a word's inside is worked out once for all its occurrences in a
block.  The output is factored by classes of ids: the attention's output, on top of counted
bigrams of the corpus, gives the class, and counted bigrams the id within it.  Both kinds of streams are
cut into windows that overlap: the first part of a window is context, and each position is
scored in the one window that has it in its other part.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass
from functools import cache, cached_property
from typing import NamedTuple

import numpy as np

#: Subword ids, then a document's end and a word's end.
RANKS = 1022
END, WORD_END = RANKS, RANKS + 1
SIZE = RANKS + 2
DIM = 16
CLASSES = 64
#: Positions that a window scores, and those before them for context, by kind: first ids of words, ids inside words.
STRIDES = (32, 6)
CONTEXTS = (8, 2)
#: Multiplications that go into one matrix product, at most.  Spark has a worker on each core, and a larger product would start threads of
#: its own, which take more time to wait for each other than they save.
PRODUCT = 2**18
#: What the model's own scores are kept within, either way; counted logarithms are above -28.
BOUND = np.float32(25)
_SCALE = np.float32(DIM**-0.5)
_PLACES = np.arange(SIZE * DIM).reshape(SIZE, DIM)


class Subwords:
    """Ids of words by the first ranks of a public byte-level vocabulary file."""

    def __init__(self, path: str) -> None:
        import tiktoken

        ranks = {}
        with open(path, "rb") as lines:
            for line in lines:
                piece, rank = line.split()
                if int(rank) < RANKS:
                    ranks[base64.b64decode(piece)] = int(rank)
        self.encoding = tiktoken.Encoding("first-ranks", pat_str=r"[^\n]+|\n", mergeable_ranks=ranks, special_tokens={})
        self.line_end = ranks[b"\n"]

    def ids(self, lines: bytes) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words end to end, and where each word's begin.  A line is a word."""
        found = np.array(self.encoding.encode_ordinary(lines.decode("utf-8", "surrogatepass")), np.int16)
        stop = found == self.line_end
        first = np.concatenate([[0], np.flatnonzero(stop) + 1])
        return found[~stop], first - np.arange(len(first))


def windows(first: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """For streams first[k]:first[k+1], the begin of each window's scored part, and how many it scores."""
    sizes = np.diff(first)
    counts = -(-sizes // stride)
    k = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = np.repeat(first[:-1], counts) + k * stride
    return begin, np.minimum(stride, np.repeat(first[1:], counts) - begin)


class Held(NamedTuple):
    """Which slots of some windows are held (None: all of them): the first ``context`` ones lie before what is scored."""

    context: int
    slots: np.ndarray | None


@cache
def _later(context: int, slots: int) -> np.ndarray:
    """What a window's attention is multiplied by: no slot attends to later ones."""
    return (np.arange(slots)[None, :] <= np.arange(context, slots)[:, None]).astype(np.float32)


def _alike(size: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Windows by size and context, those of equal ones in the order they are in: batches of neighbours have next to no empty slots."""
    return np.argsort((before * (max(STRIDES) + 1) + size).astype(np.uint16), kind="stable")


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b for many rows, by as many of them as a product takes."""
    wide, high = b.shape
    rows = PRODUCT // b.size
    if len(a) <= rows:
        return a @ b
    n = len(a) // rows * rows
    out = np.empty((len(a), high), np.float32)
    if n:
        np.matmul(a[:n].reshape(-1, rows, wide), b, out=out[:n].reshape(-1, rows, high))
    if n < len(a):
        np.matmul(a[n:], b, out=out[n:])
    return out


def _sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b for many rows, by as many of them as a product takes."""
    rows = PRODUCT // (a.shape[1] * b.shape[1])
    total = b[:rows].T @ a[:rows]
    for i in range(rows, len(a), rows):
        total += b[i : i + rows].T @ a[i : i + rows]
    return total.T


@cache
def _ones(n: int) -> np.ndarray:
    return np.ones((n, 1), np.float32)


def _totals(x: np.ndarray) -> np.ndarray:
    """Sums along the last axis, which stays: as a product, that is several times as quick as sums of short rows."""
    return (x.reshape(-1, x.shape[-1]) @ _ones(x.shape[-1])).reshape(*x.shape[:-1], 1)


def _exp(x: np.ndarray) -> np.ndarray:
    """In place, of values kept within BOUND, so that no largest one needs to be taken off first."""
    np.clip(x, -BOUND, BOUND, out=x)
    return np.exp(x, out=x)


def id_classes(counts: np.ndarray, classes: int = CLASSES, seed: int = 9) -> np.ndarray:
    """A class for each id, by k-means over what follows it and what it follows."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([counts[0], counts[1], counts[0].T, counts[1].T], axis=1)
    both = np.sqrt(both / np.maximum(1, both.sum(1, keepdims=True)))
    left, strength, _ = np.linalg.svd(both @ both.T)
    points = left[:, :16] * np.sqrt(strength[:16])
    centres = points[rng.choice(len(points), classes, replace=False)]
    for _ in range(20):
        label = ((points[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        for c in np.unique(label):
            centres[c] = points[label == c].mean(0)
    return label


@dataclass
class Model:
    classes: np.ndarray  # of each id
    by_class: np.ndarray  # kind x id x class: log probability of the next id's class, counted in the corpus
    inside: np.ndarray  # kind x id x id: log probability of the next id within its class
    weights: dict[str, np.ndarray]

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 5) -> "Model":
        """``counts``: kind x id x id."""
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(DIM)).astype(np.float32)
        w = {"embed": draw(SIZE, DIM), "place": draw(max(map(sum, zip(STRIDES, CONTEXTS, strict=True))), DIM) * np.float32(0.1), "kind": draw(2, DIM)}
        w |= {k: draw(DIM, DIM) for k in ("query", "key", "value", "mix")} | {"out": np.zeros((DIM, CLASSES), np.float32)}
        return cls.counted(counts, id_classes(counts), w)

    @classmethod
    def counted(cls, counts: np.ndarray, classes: np.ndarray, weights: dict[str, np.ndarray]) -> "Model":
        """Bigram tables from the counts, smoothed with the kind's own frequencies."""
        single = counts.sum(1, keepdims=True) + 0.1
        single /= single.sum(2, keepdims=True)
        table = (counts + 20 * single) / (counts.sum(2, keepdims=True) + 20)
        by_class = table @ np.eye(CLASSES)[classes] + 1e-12
        return cls(classes, np.log(by_class).astype(np.float32), np.log(table / by_class[:, :, classes]).astype(np.float32), dict(weights))

    @cached_property
    def _by_class(self) -> np.ndarray:
        return np.exp(self.by_class)

    def _forward(self, kind: int, ids: np.ndarray, held: Held) -> dict[str, np.ndarray]:
        """ids, held: windows x slots; a slot that isn't held is not attended to.

        Those behind a window's last position are later than all that count; those before the first are masked.
        Queries and keys meet in one small matrix, ``near``, and so do values and the mix, ``mixing``: slots are attended to as they are,
        and only positions are multiplied.  ``a`` are weights whose sums are 1 / ``scale``: dividing what they mix is less work.
        """
        w, c, n = self.weights, held.context, ids.shape[1]
        near, mixing = (w["query"] * _SCALE) @ w["key"].T, w["value"] @ w["mix"]
        x = np.take(w["embed"], ids, axis=0)
        x += w["place"][CONTEXTS[kind] - c :][:n] + w["kind"][kind]
        own = x[:, c:].reshape(-1, DIM)
        q = _times(own, near).reshape(-1, n - c, DIM)
        a = _exp(q @ x.transpose(0, 2, 1))
        a *= _later(c, n)
        if held.slots is not None and not held.slots[:, :c].all():
            a[:, :, :c] *= held.slots[:, None, :c]
        scale = 1 / _totals(a)
        mixed = a @ x
        mixed *= scale
        mixed = mixed.reshape(-1, DIM)
        h = _times(mixed, mixing)
        h += own
        return {"x": x, "own": own, "near": near, "mixing": mixing, "q": q, "a": a, "scale": scale, "mixed": mixed, "h": h}

    def _odds(self, kind: int, h: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Of the next id's classes; a row's divided by their sum are probabilities."""
        odds = _exp(_times(h, self.weights["out"]))
        odds *= np.take(self._by_class[kind], before, axis=0)
        return odds

    def _plan(self, kind: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of the streams, those alike together: begin of the scored part, its size, and the context before it."""
        begin, size = windows(first, STRIDES[kind])
        before = np.minimum(CONTEXTS[kind], begin - first[np.searchsorted(first, begin, "right") - 1])
        order = _alike(size, before)
        return begin[order], size[order], before[order]

    def _batch(self, kind: int, inputs: np.ndarray, plan: tuple, some: slice | np.ndarray) -> tuple[np.ndarray, Held, np.ndarray]:
        begin, size, before = (x[some] for x in plan)
        c = int(before.max())
        slots = np.arange(-c, size.max())
        at = begin[:, None] + slots
        if size.min() == len(slots) - c and before.min() == c:
            return inputs[at], Held(c, None), at[:, c:].ravel()
        held = (slots >= -before[:, None]) & (slots < size[:, None])
        return inputs[np.where(held, at, 0)], Held(c, held), at[:, c:][held[:, c:]]

    def scores(self, kind: int, inputs: np.ndarray, targets: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural log probability of each target; inputs[i] is the id before targets[i]."""
        out = np.empty(len(targets), np.float32)
        plan, batch = self._plan(kind, first), 2048 // STRIDES[kind]
        for i in range(0, len(plan[0]), batch):
            ids, held, at = self._batch(kind, inputs, plan, slice(i, i + batch))
            h = self._forward(kind, ids, held)["h"]
            if held.slots is not None:
                h = h[held.slots[:, held.context :].ravel()]
            before, target = inputs[at], targets[at]
            odds = self._odds(kind, h, before)
            own = np.take(odds, np.arange(0, odds.size, CLASSES) + self.classes[target])
            out[at] = np.log(own / _totals(odds)[:, 0]) + self.inside[kind][before, target]
        return out

    def _gradient(self, kind: int, ids: np.ndarray, held: Held, before: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        w, s, n = self.weights, held.context, ids.shape[1]
        f = self._forward(kind, ids, held)
        full = len(target) == len(f["h"])
        live = None if full else np.flatnonzero(held.slots[:, s:])
        h = f["h"] if full else f["h"][live]
        # probabilities less the targets are odds / totals; the totals divide what is made of the odds, which is less than they are
        odds = self._odds(kind, h, before)
        totals = _totals(odds)
        odds.reshape(-1)[np.arange(0, odds.size, CLASSES) + self.classes[target]] -= totals[:, 0]
        share = 1 / (totals * np.float32(len(target)))
        g = {"out": _sums(h * share, odds)}
        dh = _times(odds, w["out"].T)
        dh *= share
        if not full:
            dh, some = np.zeros_like(f["h"]), dh
            dh[live] = some
        mixing = _sums(f["mixed"], dh)
        dc = _times(dh, f["mixing"].T)
        dc *= f["scale"].reshape(-1, 1)
        # a softmax's gradient takes off the mean of da under a, which is the product of dc and what a has mixed
        mean = _totals(dc * f["mixed"]).reshape(-1, n - s, 1)
        dc = dc.reshape(-1, n - s, DIM)
        da = dc @ f["x"].transpose(0, 2, 1)
        da -= mean
        da *= f["a"]
        dq = (da @ f["x"]).reshape(-1, DIM)
        near = _sums(f["own"], dq)
        g["query"], g["key"] = near @ w["key"] * _SCALE, near.T @ w["query"] * _SCALE
        g["value"], g["mix"] = mixing @ w["mix"].T, w["value"].T @ mixing
        dx = da.transpose(0, 2, 1) @ f["q"]
        dx += f["a"].transpose(0, 2, 1) @ dc
        dh += _times(dq, f["near"].T)
        dx[:, s:] += dh.reshape(-1, n - s, DIM)
        g["embed"] = np.bincount(np.take(_PLACES, ids, axis=0).ravel(), dx.ravel(), SIZE * DIM).astype(np.float32)
        g["place"], g["kind"] = np.zeros_like(w["place"]), np.zeros_like(w["kind"])
        g["place"][CONTEXTS[kind] - s :][:n] = dx.sum(0)
        g["kind"][kind] = g["place"].sum(0)
        return g

    def _shuffled(self, plans: list[tuple], rng: np.random.Generator) -> list[tuple[int, int, np.ndarray]]:
        """Batches (chunk, kind, windows) in any order; each window of each plan is in one of them, with others like it."""
        out = []
        for chunk, pair in enumerate(plans):
            for kind, (begin, size, before) in enumerate(pair):
                if len(begin):
                    batches = -(-len(begin) // (1024 // STRIDES[kind]))
                    drawn = rng.permutation(len(begin))
                    drawn = drawn[_alike(size[drawn], before[drawn])]
                    out += [(chunk, kind, some) for some in np.array_split(drawn, batches)]
        return [out[k] for k in rng.permutation(len(out))]

    def train(self, chunks: list[tuple[tuple, tuple]], rate: float, seed: int = 3, steps: int = 1) -> None:
        """Adam over shuffled batches, in whole passes over all windows: one, or as many as ``steps`` takes.

        A chunk has (inputs, targets, first) for each kind.
        """
        rng = np.random.default_rng(seed)
        plans = [tuple(self._plan(kind, first) for kind, (_, _, first) in enumerate(pair)) for pair in chunks]
        # all weights lie in one array, that a step is a few operations
        names = sorted(self.weights)
        flat = np.concatenate([self.weights[k].ravel() for k in names])
        cuts = np.cumsum([self.weights[k].size for k in names])[:-1]
        self.weights = {k: part.reshape(self.weights[k].shape) for k, part in zip(names, np.split(flat, cuts), strict=True)}
        mean, square, part = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)
        queue = self._shuffled(plans, rng)
        passes = -(-steps // len(queue)) if queue else 0
        total, step = passes * len(queue), 0
        for n in range(passes):
            for chunk, kind, some in queue if n == 0 else self._shuffled(plans, rng):
                step += 1
                inputs, targets, _ = chunks[chunk][kind]
                ids, held, at = self._batch(kind, inputs, plans[chunk][kind], some)
                found = self._gradient(kind, ids, held, inputs[at], targets[at])
                g = np.concatenate([found[k].ravel() for k in names])
                # ten times the mean and a hundred times the square; what they lack goes into the rate
                mean *= np.float32(0.9)
                mean += g
                g *= g
                square *= np.float32(0.99)
                square += g
                root = (0.01 / (1 - 0.99**step)) ** 0.5
                np.sqrt(square, out=part)
                part += np.float32(1e-8 / root)
                np.divide(mean, part, out=part)
                part *= np.float32(rate * (1 - step / (total + 1)) / (1 - 0.9**step) * 0.1 / root)
                flat -= part


def inside_streams(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and begins of the streams inside words: each id is followed by the next, the last by WORD_END."""
    targets = np.empty(len(ids), np.int16)
    targets[:-1] = ids[1:]
    targets[first[1:] - 1] = WORD_END
    return ids, targets, first


def outer_streams(first_ids: np.ndarray, doc_first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for documents: the first ids of the words of each, after and before an END."""
    n = len(doc_first) - 1
    begins = doc_first + np.arange(n + 1)
    targets = np.full(len(first_ids) + n, END, np.int16)
    inner = np.ones(len(targets), bool)
    inner[begins[1:] - 1] = False
    targets[inner] = first_ids
    inputs = np.concatenate([[END], targets[:-1]]).astype(np.int16)
    return inputs, targets, begins
