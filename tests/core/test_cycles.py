import random

import pytest

from marginalia.operators import cycles


def brute(edges):
    out = set()
    for start in {a for a, _ in edges}:
        seen, todo = set(), [start]
        while todo:
            here = todo.pop()
            for a, b in edges:
                if a == here and b not in seen:
                    seen.add(b)
                    todo.append(b)
        if start in seen:
            out.add(start)
    return out


def found(spark, edges):
    rows = [r["id"] for r in cycles.on_cycles(spark.createDataFrame(sorted(edges) + [(None, "x"), ("x", None)], "src string, dst string")).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def path(name, n, first=None, last=None):
    nodes = [first or f"{name}0", *[f"{name}{k}" for k in range(1, n)], last or f"{name}{n}"]
    return set(zip(nodes, nodes[1:], strict=False))


CASES = {
    "loops, a ring and a chain between rings": {("a", "a")} | path("r", 5, "r0", "r0") | path("c", 4, "r2", "s0") | path("s", 3, "s0", "s0") | path("t", 6, "s1"),
    "two ways between the same ends, one leads back": path("u", 3, "p", "q") | path("v", 4, "p", "q") | path("w", 2, "q", "p") | path("x", 3, "q", "z"),
    "a pure ring beside a tree": path("r", 9, "r0", "r0") | {(f"t{k}", f"t{(k - 1) // 2}") for k in range(1, 15)},
    "chains of chains": path("a", 3, "h", "i") | path("b", 2, "i", "h") | path("c", 2, "h", "k") | path("d", 2, "k", "l") | path("e", 2, "l", "k") | {("k", "m"), ("m", "n")},
    "nothing": set(),
}


@pytest.mark.parametrize("name", list(CASES))
def test_against_brute_force(spark, name):
    assert found(spark, CASES[name]) == brute(CASES[name])


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = [14, 30, 40][seed]
    edges = {(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range([30, 34, 44][seed])}
    for a, b in [e for e in sorted(edges) if rng.random() < 0.3]:
        edges = edges - {(a, b)} | path(f"{a}.{b}.", rng.randint(2, 4), a, b)
    assert found(spark, edges) == brute(edges)


def test_jobs_grow_with_the_logarithm(spark):
    """A path of a thousand edges into a ring of as many: fewer jobs than a fortieth of its length."""
    edges = path("p", 1000, last="r0") | path("r", 1000, "r0", "r0")
    spark.sparkContext.setJobGroup("cycles", "cycles")
    try:
        assert found(spark, edges) == {b for a, b in edges if a.startswith("r")}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("cycles"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 150, jobs
