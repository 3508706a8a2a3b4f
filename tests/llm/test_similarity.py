import random

import numpy as np
import pytest

from marginalia.llm import similarity as S
from marginalia.llm import components as C
from marginalia.llm.components import components

DOCS = "doc_id long, text string, node string"


def brute(rows):
    sets = []
    for _, text in rows:
        words = [w for w in (text or "").translate({i: i + 32 for i in range(65, 91)}).replace("\x0b", " ").replace("\t", " ").replace("\n", " ").split(" ") if w]
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    out = []
    for i, (key, _) in enumerate(rows):
        same = [k for (k, _), lb in zip(rows, label) if lb == label[i] and k is not None] if sets[i] else [key]
        out.append((key, len(sets[i]), min(same, default=None)))
    return sorted(out, key=str)


def corpus(n=60, seed=8):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)] + ["Été", "THE", "the"]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 20, 80, 200]))]
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.choice([1, 1, 2, 5])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
                k = rng.randrange(len(text))
                text[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [text[k], "x"]])
            rows.append((rng.randrange(10**9), rng.choice([" ", "\n", "  "]).join(text)))
    return rows + [(5, None), (6, ""), (7, " \n"), (None, rows[0][1]), (None, None), rows[1], rows[1], (8, "a b c d"), (9, "A b\tc D"), (10, "a b c")]


@pytest.mark.parametrize("small", [False, True])
def test_against_all_pairs(spark, monkeypatch, small):
    if small:  # many blocks, and clusters cut into parts
        monkeypatch.setattr(S.X, "BLOCK_BYTES", 3000)
        monkeypatch.setattr(S, "PART_BYTES", 4000)
    rows = corpus()
    df = spark.createDataFrame([(*r, "?") for r in rows], DOCS)
    assert sorted((tuple(r) for r in S.near_duplicates(df).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_clusters_of_many_slices(spark, monkeypatch, rounds):
    monkeypatch.setattr(S, "SLICE_SETS", 6)
    monkeypatch.setattr(S, "ROUNDS", rounds)
    rng = random.Random(2)
    base = [f"b{i}" for i in range(120)]
    rows, text = [], list(base)
    for i in range(70):  # a chain: neighbours are linked, far ones are not
        text = list(text)
        for _ in range(2):
            text[rng.randrange(len(text))] = f"x{i}{rng.randrange(9)}"
        rows.append((i * 3 + 1, " ".join(text if i % 9 else base + [f"y{i}"] * (i // 4))))
    got = S.near_duplicates(spark.createDataFrame([(*r, "?") for r in rows], DOCS)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_chain_of_near_copies():
    base = np.arange(1000, dtype=np.uint64)
    chain = [base[i * 15 : i * 15 + 200] for i in range(50)]
    assert len(set(S.linked_groups(chain))) == 1
    far = [base[i * 60 : i * 60 + 200] for i in range(12)]
    assert len(set(S.linked_groups(far))) == 12


def test_groups_of_all_sizes_merge():
    rng = np.random.default_rng(3)
    for _ in range(200):
        groups, naive = S._Groups(12), list(range(12))
        for _ in range(8):
            i, others = int(rng.integers(12)), rng.integers(0, 12, 3)
            groups.join(i, others)
            old = {naive[i], *(naive[k] for k in others)}
            naive = [naive[i] if x in old else x for x in naive]
        assert all((groups.label[a] == groups.label[b]) == (naive[a] == naive[b]) for a in range(12) for b in range(12))


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 90), (90, 95), (7, 7), (None, 4)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(31)} | {(90, 90), (95, 90), (100, 90)}


def test_components_of_stars_and_random_graphs(spark):
    rng = np.random.default_rng(3)
    graphs = [[], [(5, 1), (4, 1), (9, 7)], [(3, 1), (3, 2)], [(2, 1), (3, 2)]]
    graphs += [[tuple(int(v) for v in e) for e in rng.integers(0, 60, (n, 2))] for n in (25, 45)]
    for edges in graphs:
        least = {v: v for e in edges if e[0] != e[1] for v in e}
        for _ in least:
            for a, b in edges:
                if a != b:
                    least[a] = least[b] = min(least[a], least[b])
        got = sorted(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
        assert got == sorted(least.items())


def test_components_of_a_large_group_take_few_rounds(spark, monkeypatch):
    checks, real = [], C._only_stars
    monkeypatch.setattr(C, "_only_stars", lambda edges: checks.append(edges) or real(edges))
    rng = np.random.default_rng(6)
    chain = [(i, i + 1) for i in range(10, 3000)]
    dense = [(int(a), int(b)) for a, b in rng.integers(5000, 6000, (9000, 2))]
    for edges, most in ((chain, 2), (dense, 2)):
        checks.clear()
        got = components(spark.createDataFrame(edges, "a long, b long").repartition(12)).collect()
        assert len(got) == len({v for e in edges if e[0] != e[1] for v in e}) and {r.component for r in got} == {min(map(min, edges))}
        assert len(checks) <= most


@pytest.mark.parametrize("at_once", [1, 7, 10**6])
def test_contraction_keeps_what_is_linked(spark, monkeypatch, at_once):
    monkeypatch.setattr(C, "CONTRACTED", at_once)
    rng = np.random.default_rng(at_once)
    for n in (1, 30, 90):
        edges = [(int(max(e)), int(min(e))) for e in rng.integers(-50, 50, (n, 2)) if e[0] != e[1]]
        batches = [S.pa.RecordBatch.from_pydict({"a": [a for a, _ in part], "b": [b for _, b in part]}, S.pa.schema([("a", S.pa.int64()), ("b", S.pa.int64())])) for part in (edges[:20], [], edges[20:])]
        got = [tuple(r.values()) for batch in C._contract(iter(batches)) for r in batch.to_pylist()]
        assert all(a > b for a, b in got)
        for some in (got, edges):
            label = {v: v for e in edges for v in e}
            for _ in label:
                for a, b in some:
                    label[a] = label[b] = min(label[a], label[b])
            want = label if some is got else want
        assert label == want
