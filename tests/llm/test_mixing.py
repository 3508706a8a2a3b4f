import random
from collections import defaultdict

import pytest

from marginalia.llm import mixing as M

DOCS = "doc_id long, text string, source string, epoch string"


def corpus():
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(1, 40), rng.choice("aaaaaaaabbc"), "") for i in range(900)]
    return rows + [(None, "x y", None, ""), (5, None, "empty", ""), (6, "z z z", "a", ""), (6, "z z z", "a", "")]


def test_draws_meet_the_budgets(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_TOKENS", 500)
    rows = corpus()
    tokens = defaultdict(int)
    for _, t, s, _ in rows:
        tokens[s] += len((t or "").split())
    for options in ({}, {"max_repeats": 4.0, "target_entropy": 1.0}, {"budget": 6000, "max_repeats": 3.0}):
        _, draw = M.budgets(dict(tokens), **options)
        got = defaultdict(list)
        for r in M.mix(spark.createDataFrame(rows, DOCS), **options).collect():
            got[r["source"]].append((r["start_token"], r["epoch"], r["doc_id"], r["n_tokens"]))
        for s, n in tokens.items():
            drawn = sorted(got[s], key=lambda x: x[:2])
            if not n:
                assert len(drawn) == sum(x[2] == s for x in rows)
                continue
            # the stream has no gaps, and ends with the first document that reaches the budget
            assert drawn[0][0] == 0 and all(a[0] + a[3] == b[0] for a, b in zip(drawn, drawn[1:]))
            assert drawn[-1][0] < draw[s] <= drawn[-1][0] + drawn[-1][3]
            held = sorted(((x[0] is None, x[0] or 0) for x in rows if x[2] == s))
            for epoch in range(draw[s] // n):
                assert sorted((x[2] is None, x[2] or 0) for x in drawn if x[1] == epoch) == held


def test_power():
    tokens = {"a": 9000, "b": 900, "c": 100}
    power, draw = M.budgets(tokens, max_repeats=5.0)
    assert max(draw[s] / tokens[s] for s in tokens) == pytest.approx(5.0, abs=0.01) and min(draw[s] / tokens[s] for s in tokens) == pytest.approx(1.0, abs=0.01)
    wanted, _ = M.budgets(tokens, max_repeats=1e9, target_entropy=0.8)
    assert M.entropy(M.weights(tokens, wanted)) == pytest.approx(0.8, abs=1e-6)
    assert M.budgets({"a": 0}) == (1.0, {"a": 0})


def test_empty_table(spark):
    assert M.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_many_sources_and_equal_budgets_by_table_and_dict(spark):
    rows = [(i, "w " * (i % 9 + 1), f"s{i // 3}", "") for i in range(3000)] + [(-1, "w " * 900, "big", "")]
    tokens = defaultdict(int)
    for _, t, s, _ in rows:
        tokens[s] += len(t.split())
    totals = spark.createDataFrame([(s, n, 3) for s, n in tokens.items()], "source string, total long, rows long")
    for options in ((2.0, None, None), (50.0, 4.0, None), (3.0, 6.5, 30_000)):
        _, draw = M.budgets(dict(tokens), *options)
        got = {r["source"]: r["drawn"] for r in M.planned(totals, *options).collect()}
        assert max(abs(got[s] - draw[s]) for s in tokens) <= 1
    drawn = M.mix(spark.createDataFrame(rows, DOCS)).select("source").distinct().count()
    assert drawn == len(tokens)


def test_rows_without_tokens_are_spread_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ROWS", 10)
    rows = [(i, None, "empty", "") for i in range(200)] + [(900, "w " * 300_000, "long", "")]
    got = M.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 201 and len({r["block"] for r in got if r["source"] == "empty"}) > 5


def test_a_budget_beyond_the_repeats_is_an_error():
    with pytest.raises(ValueError, match="passes"):
        M.budgets({"a": 100, "b": 10}, max_repeats=2.0, budget=1000)
    power, draw = M.budgets({"a": 100, "b": 10}, max_repeats=2.0, budget=220)
    assert draw == {"a": 200, "b": 20} and power == pytest.approx(1.0, abs=1e-6)


def test_equal_rows_are_spread_over_blocks(spark, monkeypatch):
    """Half of all rows are equal: they are in as many blocks as the others, also where they are made in runs."""
    monkeypatch.setattr(M, "BLOCK_TOKENS", 100)
    monkeypatch.setattr(M, "COPIES", 70)
    rows = [(7, "the same text", "a", "")] * 1000 + [(i, "w " * 3, "a", "") for i in range(1000, 2000)] + [(None, "x", "b", "")] * 150
    got = M.mix(spark.createDataFrame(rows, DOCS), budget=6150, max_repeats=1.0).collect()
    assert len(got) == 2150 and sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows)
    held = defaultdict(int)
    for r in got:
        held[r["source"], r["block"]] += 1
    own = sorted(n for (s, _), n in held.items() if s == "a")
    assert len(own) == 60 and own[-1] <= 2 * own[len(own) // 2]
    streams = sorted((r["start_token"], r["n_tokens"]) for r in got if r["source"] == "a")
    assert all(a + n == b for (a, n), (b, _) in zip(streams, streams[1:]))
