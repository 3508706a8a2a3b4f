import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import crf, language_id
from marginalia.llm.labelled import remainder

DOCS = "doc_id long, text string, lang string, language string, letters string"
SYLLABLES = {"xa": ["an", "th", "er", "on", "re", "sti"], "xb": ["eau", "oué", "la", "ent", "ier", "çon"], "xc": ["schu", "ein", "ung", "tz", "über", "ge"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(n=400):
    rng = random.Random(4)
    return [(i, sentence(rng, y, rng.randint(3, 60)) + ".", y, "x", "y") for i, y in ((i, rng.choice(["xa", "xa", "xa", "xb", "xc"])) for i in range(n))]


@pytest.fixture(scope="module")
def model():
    return crf.fit([(t, y) for _, t, y, *_ in corpus(200)])


@pytest.mark.parametrize("block", [1, 2, 3, 256])
def test_marginals_against_all_labellings(block, monkeypatch):
    monkeypatch.setattr(crf, "_BLOCK", block)
    rng, k, lengths = np.random.default_rng(1), 3, [1, 4, 1, 6, 2]
    scores, start, moves = rng.normal(size=(sum(lengths), k)) * 3, rng.normal(size=k), rng.normal(size=(k, k))
    begins, want, at = np.zeros(sum(lengths), bool), [], 0
    for n in lengths:
        begins[at] = True
        total = np.zeros((n, k))
        for y in product(range(k), repeat=n):
            weight = np.exp(start[y[0]] + sum(scores[at + i, y[i]] for i in range(n)) + sum(moves[a, b] for a, b in zip(y, y[1:], strict=False)))
            total[range(n), y] += weight
        want.append(total / total.sum(1, keepdims=True))
        at += n
    assert np.allclose(crf.marginals(scores, begins, start, moves), np.concatenate(want), atol=1e-12)


def test_training_goes_along_the_gradient():
    """The expected counts are the derivative of the log of the sum over all labellings."""
    rng, k, n = np.random.default_rng(2), 2, 4
    scores, start, moves = rng.normal(size=(1, n, k)), rng.normal(size=k), rng.normal(size=(k, k))

    def log_sum(s, m):
        return np.log(sum(np.exp(start[y[0]] + sum(s[0, i, y[i]] for i in range(n)) + sum(m[a, b] for a, b in zip(y, y[1:], strict=False))) for y in product(range(k), repeat=n)))

    gamma, expected = crf._expected(scores, start, moves)
    for i, y in product(range(n), range(k)):
        step = np.zeros_like(scores)
        step[0, i, y] = 1e-5
        assert abs((log_sum(scores + step, moves) - log_sum(scores - step, moves)) / 2e-5 - gamma[0, i, y]) < 1e-6
    for a, b in product(range(k), repeat=2):
        step = np.zeros_like(moves)
        step[a, b] = 1e-5
        assert abs((log_sum(scores, moves + step) - log_sum(scores, moves - step)) / 2e-5 - expected[a, b]) < 1e-6


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(corpus(), DOCS)
    train = remainder("doc_id", 4) != 2
    named, c = language_id.annotate(docs, language_id.fit(docs, train))
    rows = named.filter(~train).select("lang", f"{c}.lang", f"{c}.score").collect()
    assert len(rows) > 50 and np.mean([r[0] == r[1] for r in rows]) > 0.98 and all(0 <= r[2] <= 1 for r in rows)
    assert named.columns[: len(docs.columns)] == docs.columns


def test_words_of_a_text_that_switches(spark, model):
    rng, rows, truth = random.Random(9), [], {}
    for i in range(60):
        parts = [(y, sentence(rng, y, rng.randint(4, 12))) for y in rng.sample(sorted(SYLLABLES), 2)]
        text = "¡1, " + " 22 ".join(t for _, t in parts) + " — "
        rows.append((i, text, None, None, None))
        truth[i] = [y for y, t in parts for _ in t.split()]
    named, c = language_id.annotate(spark.createDataFrame(rows, DOCS), model, spans=True)
    right = total = 0
    for i, text, spans in named.select("doc_id", "text", f"{c}.spans").collect():
        got = [s["lang"] for s in spans for w in text[s["start"] : s["end"]].split() if w.isalpha()]
        assert all(a["end"] <= b["start"] for a, b in zip(spans, spans[1:], strict=False))
        total += len(truth[i])
        right += sum(a == b for a, b in zip(got[-len(truth[i]) :], truth[i], strict=False))
    assert right / total > 0.95


def test_edges(spark, model, monkeypatch):
    rng = random.Random(8)
    long = sentence(rng, "xb", 20_000)
    rows = [(None, None, None, None, None), (1, "", "xa", "a", "b"), (1, "", "xa", "a", "b"), (2, "12 -- !?", None, "a", "b"), (3, long, "xb", "a", "b"), (4, "日本", None, "a", "b"), (5, "x" * 100_000, None, "a", "b")]
    docs = spark.createDataFrame(rows, DOCS)
    named, c = language_id.annotate(docs, model)
    got = named.select("doc_id", f"{c}.lang", f"{c}.score").collect()
    assert [r[1] for r in got[:4]] == ["und"] * 4 and all(r[2] == 0 for r in got[:4])
    assert got[4][1] == "xb" and got[5][1] in SYLLABLES and got[6][1] in SYLLABLES
    assert language_id.annotate(docs.limit(0), model)[0].count() == 0
    unlabelled, c = language_id.annotate(docs, language_id.fit(docs, F.lit(False)))
    assert {r[0] for r in unlabelled.select(f"{c}.lang").collect()} == {"und"}
    monkeypatch.setattr(language_id, "PIECE_BYTES", 1000)  # many chains, which count together
    pieces = language_id._pieces(long.encode())
    assert b"".join(pieces) == long.encode() and max(map(len, pieces)) <= 1000
    owners = [o for o, _, _ in language_id._labelled(model, [long, "a"])]
    assert {int(x) for o in owners for x in o} == {0, 1} and len(owners) > 100


def test_sample_is_bounded_balanced_and_repeatable(spark):
    docs = spark.createDataFrame(corpus(), DOCS)
    one = language_id.sample(docs, F.lit(True), rows=60)
    assert len(one) <= 60 and one == language_id.sample(docs.repartition(5), F.lit(True), rows=60)
    assert all(sum(y == lang for _, y in one) > 8 for lang in SYLLABLES)
    assert sum(len(t.encode()) for t, _ in language_id.sample(docs, F.lit(True), max_bytes=900)) <= 900
