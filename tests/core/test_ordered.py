import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions import labels as L
from marginalia.operators import analysis, ordered, reader


@pytest.fixture
def many_ranges(spark):
    """Small ranges stay apart, as large ones would."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def some_rows(n=600):
    draw = random.Random(5)
    # a hub has two thirds of all rows; nulls are a group of their own
    return [(draw.choice(["hub"] * 8 + ["a", "b", None, None]), k, draw.choice([None, "x", "y"]), draw.random() < 0.1) for k in range(n)]


def expected(rows):
    out = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        for i, (_, k, value, flag) in enumerate(own):
            before = [v for _, _, v, _ in own[:i] if v is not None]
            after = [v for _, _, v, _ in own[i + 1 :] if v is not None]
            out[k] = (g, i + 1, sum(bool(r[3]) for r in own[: i + 1]), before[-1] if before else None, after[0] if after else None)
    return out


def test_scans_over_many_ranges(spark, many_ranges):
    rows = some_rows()
    df = spark.createDataFrame(rows, "g string, k int, v string, flag boolean").repartition(5)
    found = ordered.scan(df, ["g"], ["k"], counts={"nth": F.lit(True), "n_flags": F.col("flag")}, before={"earlier": F.col("v")}, after={"later": F.col("v")})
    assert found.columns == ["g", "k", "v", "flag", "nth", "n_flags", "earlier", "later"]
    assert {r.k: (r.g, r.nth, r.n_flags, r.earlier, r.later) for r in found.collect()} == expected(rows)


def test_scans_in_one_group(spark, many_ranges):
    rows = [("all", *r[1:]) for r in some_rows()]
    df = spark.createDataFrame(rows, "g string, k int, v string, flag boolean")
    found = ordered.scan(df.drop("g"), [], ["k"], counts={"nth": F.lit(True)}, before={"earlier": F.col("v")}, after={"later": F.col("v")})
    assert {r.k: (r.nth, r.earlier, r.later) for r in found.collect()} == {k: (x[1], x[3], x[4]) for k, x in expected(rows).items()}


def test_a_hub_lies_in_many_ranges(spark, many_ranges, monkeypatch):
    seen = []
    monkeypatch.setattr(ordered, "settle", lambda df, name: seen.append(df.persist()) or df)
    df = spark.range(4000).select(F.when(F.col("id") < 3000, "hub").otherwise(F.col("id").cast("string")).alias("g"), "id")
    assert ordered.paged(df, ["g"], ["id"], 100).filter("g = 'hub'").agg(F.max("page")).first()[0] == 29
    of_hub = [r["count"] for r in seen[0].filter("g = 'hub'").groupBy("_scan_range").count().collect()]
    assert len(of_hub) >= 5 and max(of_hub) < 1000
    seen[0].unpersist()


def test_scans_of_no_rows_and_of_ties(spark, many_ranges):
    empty = spark.createDataFrame([], "g string, `a b` int")
    assert ordered.scan(empty, ["g"], ["a b"], counts={"n": F.lit(True)}, after={"z": F.col("g")}).collect() == []
    ties = spark.createDataFrame([("g", 1)] * 50 + [("g", None)] * 3, "g string, `a b` int")
    assert sorted(r.n for r in ordered.scan(ties, ["g"], ["a b"], counts={"n": F.lit(True)}).collect()) == list(range(1, 54))


def test_pages_by_key(spark, many_ranges):
    rows = [(None, 2), (None, 1), (0, None), (0, 1), (1, None), (1, 5), (2, 0)]
    df = spark.createDataFrame(rows, "a int, b int")
    want = sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r))
    got, last = [], None
    while page := [tuple(r) for r in ordered.next_page(df, ["a", "b"], 2, last).collect()]:
        got, last = got + page, page[-1]
    assert got == want


def test_runs_and_neighbours_of_a_book(spark, many_ranges):
    kinds = [k for k in ("axioms", None, "lemmas", "axioms") for _ in range(40)]
    rows = [(f"p{n}", n, kind, None) for n, kind in enumerate(kinds)]
    book = spark.createDataFrame(rows, "id string, sort_index int, section_kind string, parent_id string")
    assert [r.run for r in reader.section_runs(book).orderBy("sort_index").collect()] == [n // 40 + 1 for n in range(160)]
    beside = {r.id: (r.previous_id, r.next_id) for r in reader.reading_order(book).collect()}
    assert beside == {f"p{n}": (f"p{n - 1}" if n else None, f"p{n + 1}" if n < 159 else None) for n in range(160)}


def test_children_and_relations_in_pages(spark, many_ranges):
    inside = spark.createDataFrame([(f"n{k:03}", k, "note", "top") for k in range(250)] + [("top", -1, "proof", None)], "id string, sort_index int, type string, parent_id string")
    pages = reader.child_pages(inside, 100).groupBy("page").count().collect()
    assert sorted(map(tuple, pages)) == [(0, 100), (1, 100), (2, 50)]
    names = {r.id: r.numbered_id for r in reader.numbered_children(inside).collect()}
    assert names["n000"] == "top.note" and names["n249"] == "top.note250" and len(names) == 250
    told = spark.createDataFrame([("hub", f"s{k:03}", "cites" if k % 2 else "transitivelyDependsOn", "hub", False) for k in range(10)], "element_id string, subject string, predicate string, object string, inferred boolean")
    found = analysis.relation_pages(told, 4).orderBy("place").collect()
    assert [r.page for r in found] == [0] * 4 + [1] * 4 + [2] * 2
    assert [r.subject for r in found] == [f"s{k:03}" for k in (1, 3, 5, 7, 9, 0, 2, 4, 6, 8)]


def test_decimals_are_rounded_by_their_exact_value(spark):
    from decimal import ROUND_HALF_UP, Decimal

    draw = random.Random(3)
    values = [0.0, 0.05, 0.15, 0.25, 0.35, 0.45, 1.005, 8.345, 0.95, 9.95, 99.95, -0.04, -0.25, -2.35, 1e13 + 0.25] + [draw.randrange(100000) / 20 for _ in range(3000)] + [draw.uniform(-50, 50) for _ in range(500)]
    shown = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(L.one_decimal(F.col("v"))).collect()]
    assert shown == [str(Decimal(v).quantize(Decimal("0.1"), ROUND_HALF_UP)) for v in values]
