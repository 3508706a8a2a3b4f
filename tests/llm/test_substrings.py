import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from marginalia.llm import substrings as R
from marginalia.llm.fm_index import FMIndex

DOCS = "doc_id long, text string, kept string"


def corpus(seed=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "A", "a"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([12, 13, 14, 60]))] for _ in range(10)]
    rows = []
    for i in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 5, 13, 40, 150]))]
        for _ in range(rng.choice([0, 1, 3])):
            k = rng.randrange(len(words) + 1)
            words[k:k] = rng.choice(passages)
        rows.append((rng.randrange(400), rng.choice([" ", "\n", " \t"]).join(words)))
    rows += rows[:4] + [(None, rows[5][1]), (None, None), (7, ""), (8, "a " * 3000), (9, "a " * 40), (3, "\x1c x " * 14), (4, "\x1c x " * 14)]
    return rows


@pytest.mark.parametrize("size", [4_000_000, 4000])
def test_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(R.X, "BLOCK_BYTES", size)
    rows = corpus()
    got = R.remove_repeats(spark.createDataFrame([(*r, "?") for r in rows], DOCS)).collect()
    assert sorted(((r[0], r[1], r[2], hashlib.sha256(r[3].encode()).hexdigest()) for r in got), key=str) == R.brute_force(rows)


def shared_passage(n=400):
    """Documents that share one passage, each between words of its own."""
    passage = " ".join(f"p{k}" for k in range(30))
    return [(i, " ".join(f"a{i}x{k}" for k in range(20)) + f" {passage} " + " ".join(f"b{i}x{k}" for k in range(20))) for i in range(n)]


@pytest.mark.parametrize("hot", [0, 3])
def test_hot_seeds_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(R.X, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(R, "HOT_PIECES", hot, raising=False)
    rows = corpus() + [(1000 + k, t) for k, t in shared_passage(40)]
    got = R.remove_repeats(spark.createDataFrame([(*r, "?") for r in rows], DOCS)).collect()
    assert sorted(((r[0], r[1], r[2], hashlib.sha256(r[3].encode()).hexdigest()) for r in got), key=str) == R.brute_force(rows)


def test_no_shard_gets_all_neighbours_of_a_shared_passage():
    keys, texts = zip(*shared_passage())
    group = pa.table({"block": [0] * len(keys), "key": keys, "text": texts})
    packed, sent = R.X.struct(R.X.PACKED), R.X.struct("block long, bucket long, sizes binary, docs binary, vocabulary binary, words binary")
    many = R._many(50) if hasattr(R, "HOT_PIECES") else R._many
    told = R.X.answer(packed, np.uint8, many, echo=False)(R._ask(1, packed)(group))
    shards = [len(x) for x in R._send_pieces(1, 50, sent)(group, told)["docs"].to_pylist()]
    assert max(shards) < sum(shards) / 10


def test_empty_table(spark):
    assert R.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_fm_index_counts_occurrences():
    rng = np.random.default_rng(1)
    text = np.concatenate([np.append(rng.integers(1, 4, rng.integers(1, 30)), 0) for _ in range(40)])
    index = FMIndex(text)
    at = np.array([p for p in range(len(text) - 5) if (text[p : p + 5] > 0).all()])
    low, high, matched = index.search(at, text, 5)
    assert (matched == 5).all()
    for p, a, b in zip(at, low, high):
        assert sorted(index.suffixes[a:b]) == [q for q in range(len(text) - 4) if (text[q : q + 5] == text[p : p + 5]).all()]


def test_matching_statistics_of_any_length():
    rng = np.random.default_rng(5)
    parts = [np.append(rng.integers(1, 4, rng.integers(1, 40)), 0) for _ in range(50)]
    text, owner = np.concatenate(parts), np.repeat(rng.integers(0, 20, 50), [len(p) for p in parts]).astype(np.int32)
    index = FMIndex(text, owner)
    starts = np.repeat(np.cumsum([0, *map(len, parts)])[:-1], [len(p) for p in parts])
    end = np.flatnonzero(text > 0)
    length, least = index.longest_before(text, end, end - starts[end] + 1, owner[end])
    words = [(o, "".join(map(str, p[:-1]))) for o, p in zip(owner[np.unique(starts)], parts)]
    for e, n, doc in zip(end.tolist(), length.tolist(), least.tolist()):
        before = "".join(map(str, text[starts[e] : e + 1]))
        held = lambda k: [o for o, w in words if o < owner[e] and before[len(before) - k :] in w]
        assert n == max((k for k in range(1, len(before) + 1) if held(k)), default=0)
        assert doc == (min(held(n)) if n else owner[e])


def test_sampled_positions_and_wide_symbols(monkeypatch):
    from marginalia.llm import fm_index

    text = np.concatenate([np.append(np.random.default_rng(2).integers(1, 3, 50), 0) for _ in range(8)])
    order = fm_index.suffix_order(text)
    assert (FMIndex(text).suffixes == order).all() and len(FMIndex(text).positions) < len(text) / 8
    monkeypatch.setattr(fm_index, "symbols_per_key", lambda top: 2)
    assert (fm_index.suffix_order(text) == order).all()
