import math
import random
from collections import Counter

import numpy as np
import pytest

from marginalia.llm import language_model as L
from marginalia.llm import lm_scoring as S

DOCS = "doc_id long, text string, score string"


def corpus(n=300):
    rng = random.Random(2)
    languages = [["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(40)] for parts in (["an", "th", "er", "on"], ["eau", "ille", "ç", "qu"])]
    rows = [(i, " ".join(rng.choice(languages[i % 2]) for _ in range(rng.randint(5, 90)))) for i in range(n)]
    return rows + [(1000, None), (1001, ""), (None, "An th\tTHE"), (5, rows[5][1]), (1002, "x" * 3000), (1003, "\x85 \U0001f642 \x00y")]


def test_base_is_exact_and_the_model_beats_it(spark, monkeypatch):
    monkeypatch.setattr(S.X, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(S, "SAMPLE_ROWS", 50)
    rows = corpus()
    got = S.score_documents(spark.createDataFrame([(*r, "") for r in rows], DOCS)).collect()
    cut = lambda t: [*(t or "").replace("THE", "the").replace("An", "an").replace("\t", " ").split(" "), None] if t else [None]
    counts = Counter(w for k, t in rows if not S.is_held_out(k) for w in cut(t))
    n, v = sum(counts.values()), len(counts)
    want = [(k, S.is_held_out(k), len(cut(t)), sum(counts[w] > 0 for w in cut(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in cut(t)), 6)) for k, t in rows]
    assert sorted(((r[0], r[1], r[2], r[3], r[4], round(r[5], 6)) for r in got), key=str) == sorted(want, key=str)
    held = [r for r in got if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) and all(r.score < 0 for r in got)


def test_words_are_hashed_by_blocks_of_bounded_size(monkeypatch):
    rng = random.Random(4)
    raw = [" ".join(rng.choice(["the", "an", "ille", f"w{rng.randrange(10**6)}", "\u00e7" * 9]) for _ in range(n)).encode() for n in (40_000, 0, 1, 5000)] + [b"x" * 200_000, b" y  z"]
    monkeypatch.setattr(S.W, "_powers", (np.ones(1, np.uint64), np.ones(1, np.uint64)))
    S._Streams(raw[:1] * 5)
    assert len(S.W._powers[0]) <= 70_000  # of a megabyte of text
    s = S._Streams(raw)
    want = np.unique(s.found.hashes(), return_index=True, return_inverse=True)
    assert all(np.array_equal(a, b) for a, b in zip((s.distinct, s.where, s.inverse), want, strict=True))
    words = [w for t in raw for w in t.split()]
    assert len(words) == len(s.inverse) and len(set(words)) == len(s.distinct) and [words[i] for i in s.where] == [s.found.word(i) for i in s.where]
    monkeypatch.setattr(S.W, "HASHED_BYTES", 10**6)
    assert np.array_equal(s.found.hashes(), s.distinct[s.inverse])
    monkeypatch.setattr(S.W, "HASHED_BYTES", 1)
    assert np.array_equal(s.found.hashes(), s.distinct[s.inverse])


def test_empty_table(spark):
    assert S.score_documents(spark.createDataFrame([], DOCS)).count() == 0


@pytest.fixture
def model():
    rng = np.random.default_rng(0)
    m = L.Model.start(rng.integers(0, 3, (2, L.SIZE, L.SIZE)).astype(float))
    m.weights["out"] = rng.standard_normal(m.weights["out"].shape).astype(np.float32)
    return m


def test_next_id_probabilities_add_up_to_one(model):
    rng = np.random.default_rng(1)
    for kind in (0, 1):
        inputs = rng.integers(0, L.SIZE, 45).astype(np.int16)
        total = sum(np.exp(model.scores(kind, inputs, np.append(inputs[1:], k).astype(np.int16), np.array([0, 45]))[-1].astype(float)) for k in range(L.SIZE))
        assert total == pytest.approx(1, abs=1e-3)


def test_no_position_sees_what_follows(model):
    rng = np.random.default_rng(2)
    inputs, targets = (rng.integers(0, L.SIZE, 100).astype(np.int16) for _ in range(2))
    first = np.array([0, 70, 100])
    for kind in (0, 1):
        before = model.scores(kind, inputs, targets, first)
        changed = inputs.copy()
        changed[50:70] = 7
        after = model.scores(kind, changed, targets, first)
        assert np.allclose(before[:50], after[:50], atol=1e-5) and np.allclose(before[70:], after[70:], atol=1e-5)
        assert not np.allclose(before[50:70], after[50:70], atol=1e-5)


def test_gradient(model):
    rng = np.random.default_rng(3)
    for kind in (0, 1):
        inputs, targets = (rng.integers(0, L.SIZE, 60).astype(np.int16) for _ in range(2))
        first = np.array([0, 25, 60])
        ids, held, at = model._batch(kind, inputs, model._plan(kind, first), slice(None))
        grads = model._gradient(kind, ids, held, inputs[at], targets[at])
        for k in ("query", "key", "value", "mix", "out", "kind"):
            weight, step = model.weights[k], 1e-2
            at_ = tuple(rng.integers(n) for n in weight.shape) if k != "kind" else (kind, 3)
            old, losses = weight[at_], []
            for sign in (1, -1):
                weight[at_] = old + sign * step
                classes = model.scores(kind, inputs, targets, first) - model.inside[kind][inputs, targets]
                losses.append(-classes.astype(float).mean())
            weight[at_] = old
            assert (losses[0] - losses[1]) / (2 * step) == pytest.approx(grads[k][at_], abs=2e-3)


def test_every_position_is_trained_on(monkeypatch):
    monkeypatch.setattr(S, "PIECE_BYTES", 3000)
    monkeypatch.setattr(S, "FIRST_STEPS", 1)
    seen = [[], []]
    real = L.Model._gradient

    def watched(self, kind, ids, held, before, target):
        seen[kind] += zip(before.tolist(), target.tolist())
        return real(self, kind, ids, held, before, target)

    monkeypatch.setattr(L.Model, "_gradient", watched)
    texts, subwords = [t for _, t in corpus(60)], L.Subwords(S.VOCABULARY)
    pieces = [S._Streams(raw).spell(subwords)[:2] for _, _, raw in S.W.chunks(texts, lower=True, size=3000)]
    assert len(pieces) > 3
    want = [sorted((a, b) for pair in pieces for a, b in zip(pair[kind][0].tolist(), pair[kind][1].tolist())) for kind in (0, 1)]
    model = S.first_model(texts, subwords)
    assert [sorted(x) for x in seen] == want
    seen[:] = [[], []]
    schema = S.pa.schema([("code", S.pa.int64()), ("value", S.pa.float64())])
    list(S._learn(type("Shared", (), {"value": model}), S.VOCABULARY, schema)(iter([S.pa.RecordBatch.from_pydict({"text": texts})])))
    assert [sorted(x) for x in seen] == want


def test_the_first_sample_is_bounded_in_rows_and_bytes(spark):
    rows = [(k, f"text {k} " + "y" * 50) for k in range(200)] + [(7000, "z" * 100_000)] + [(1, "text 1 " + "y" * 50)] * 400 + [(None, None)]
    sample = lambda df, *bounds: S.first_sample(df, "doc_id", "text", *bounds)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    some = sample(df, 30, 2000)
    assert 20 <= len(some) <= 30 and sum(map(len, some)) <= 2000 and some == sample(df.repartition(7), 30, 2000)
    assert len(sample(df, 10_000, 10_000)) < 202 and sum(map(len, sample(df, 10_000, 10_000))) <= 10_000
    assert sorted(sample(df, 10_000, 10**6)) == sorted({t or "" for _, t in rows})
    assert sample(df.limit(0), 10, 10) == []


def plain_log10(model, kind, inputs, targets):
    """One position after the other: attention over what its window shows before it."""
    w, stride, context, total = model.weights, L.STRIDES[kind], L.CONTEXTS[kind], 0.0
    for i, target in enumerate(targets):
        begin = i // stride * stride
        shown = range(max(0, begin - context), i + 1)
        x = {j: w["embed"][inputs[j]] + w["place"][j - begin + context] + w["kind"][kind] for j in shown}
        weights = np.array([x[i] @ w["query"] @ (x[j] @ w["key"]) / math.sqrt(L.DIM) for j in shown], float)
        weights = np.exp(weights - weights.max())
        mixed = sum(a * (x[j] @ w["value"]) for a, j in zip(weights / weights.sum(), shown, strict=True))
        logits = ((x[i] + mixed @ w["mix"]) @ w["out"] + model.by_class[kind][inputs[i]]).astype(float)
        chosen = logits[model.classes[target]] - logits.max() - math.log(np.exp(logits - logits.max()).sum())
        total += (chosen + model.inside[kind][inputs[i], target]) / math.log(10)
    return total


def test_scores_equal_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(S.X, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(S, "SAMPLE_ROWS", 50)
    rows = corpus(80)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).persist()
    got = {(r.doc_id, r.n_tokens): r.score for r in S.score_documents(docs).collect()}
    train = docs.filter(S.F.coalesce(S.remainder("doc_id", S.PARTS) != S.HELD_OUT, S.F.lit(True))).select("doc_id", S.F.coalesce("text", S.F.lit("")).alias("text"))
    model, often = S.learn(train, "doc_id", "text", S.VOCABULARY)
    subwords = L.Subwords(S.VOCABULARY)
    words = lambda t: [w.encode() for w in (t or "").replace("THE", "the").replace("An", "an").replace("\t", " ").split(" ") if w]
    counts = Counter(w for k, t in rows if not S.is_held_out(k) for w in words(t))
    for key, text in rows:
        spelled = [subwords.ids(w + b"\n")[0].tolist() for w in words(text)]
        firsts = [ids[0] for ids in spelled]
        want = plain_log10(model, 0, [L.END, *firsts], [*firsts, L.END])
        for w, ids in zip(words(text), spelled, strict=True):
            inside = 10 ** plain_log10(model, 1, ids, [*ids[1:], L.WORD_END])
            want += math.log10(S.SHARE * counts[w] / max(1, often[ids[0]]) + (1 - S.SHARE) * inside + 1e-300)
        assert got[key, len(firsts) + 1] == pytest.approx(want, rel=1e-4, abs=1e-2), key
    docs.unpersist()


def test_windows_are_batched_with_others_like_them(model, monkeypatch):
    rng, slots = np.random.default_rng(7), [0, 0]
    real = L.Model._forward
    monkeypatch.setattr(L.Model, "_forward", lambda self, kind, ids, held: slots.__setitem__(kind, slots[kind] + ids.size) or real(self, kind, ids, held))
    pair = []
    for sizes in (rng.integers(1, 150, 400), rng.integers(1, 10, 5000)):
        inputs, targets = (rng.integers(0, L.SIZE, sizes.sum()).astype(np.int16) for _ in range(2))
        pair.append((inputs, targets, np.concatenate([[0], np.cumsum(sizes)])))
    # a slot for each position, and for each one that a window sees before it; hardly any more
    needed = [sum(size + min(context, at) for n in np.diff(first).tolist() for at in range(0, n, stride) for size in [min(stride, n - at)]) for (_, _, first), stride, context in zip(pair, L.STRIDES, L.CONTEXTS)]
    for work in (lambda: [model.scores(kind, *s) for kind, s in enumerate(pair)], lambda: model.train([tuple(pair)], 0.001)):
        slots[:] = [0, 0]
        work()
        assert all(n <= got <= 1.15 * n for got, n in zip(slots, needed)), (slots, needed)


def test_only_scored_positions_are_multiplied(model, monkeypatch):
    rng, rows, done = np.random.default_rng(8), [], []
    times, sums = L._times, L._sums
    monkeypatch.setattr(L, "_times", lambda a, b: rows.append(len(a)) or done.append(len(a) * b.size) or times(a, b))
    monkeypatch.setattr(L, "_sums", lambda a, b: rows.append(len(a)) or done.append(len(a) * a.shape[1] * b.shape[1]) or sums(a, b))
    for kind in (0, 1):
        n = 20 * L.STRIDES[kind]
        inputs, targets = (rng.integers(0, L.SIZE, n).astype(np.int16) for _ in range(2))
        plan = model._plan(kind, np.array([0, n]))
        ids, held, at = model._batch(kind, inputs, plan, slice(1, None))
        assert held.context and ids.size > len(at) == n - L.STRIDES[kind]
        small, large = L.DIM**2, L.DIM * L.CLASSES
        # queries, what is mixed, and classes; then their gradients, each by what went in and by the weights
        for work, most in ((lambda: model._forward(kind, ids, held), 2 * small), (lambda: model._gradient(kind, ids, held, inputs[at], targets[at]), 3 * (2 * small + large))):
            rows[:], done[:] = [], []
            work()
            assert set(rows) == {len(at)} and sum(done) <= most * len(at)


def test_products_of_many_rows():
    rng = np.random.default_rng(9)
    for wide, high in ((16, 16), (16, 64), (64, 16)):
        for n in (0, 1, L.PRODUCT // (wide * high), 3 * L.PRODUCT // (wide * high) + 5):
            a, b, c = (rng.standard_normal(s).astype(np.float32) for s in ((n, wide), (wide, high), (n, high)))
            assert np.allclose(L._times(a, b), a.astype(float) @ b, atol=1e-4)
            assert np.allclose(L._sums(a, c), a.T.astype(float) @ c, atol=1e-2)
    x = rng.standard_normal((5, 6, 7)).astype(np.float32)
    assert np.allclose(L._totals(x), x.sum(-1, keepdims=True), atol=1e-5)
