import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import analysis, cycles, graph
from marginalia.operators import triples as T
from marginalia.sources import triples as S
from marginalia.streaming.triples import append_triples, stream_triples

N3 = """# made by hand
@prefix e: <http://example.org/e#> .
@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .

e:Axiom a rdf:Class .
e:I.def.1 a e:Definition ;
    e:partNumber 1 ;
    e:number 1  .

e:I.prop.1 a e:Proposition ;
    e:cites e:I.def.1, e:I.ax.1 ;
    e:title "a \\"b\\" ; c ."  .
<http://example.org/e#I.prop.1> e:cites e:I.def.1 .
{ ?x e:cites ?y } => { ?x e:dependsUpon ?y } .
{ ?x e:cites ?y . ?y e:cites ?z }
  => { ?x e:far ?z } .
"""
WANTED = {
    ("Axiom", "type", "Class", "iri"),
    ("I.def.1", "type", "Definition", "iri"),
    ("I.def.1", "partNumber", "1", "literal"),
    ("I.def.1", "number", "1", "literal"),
    ("I.prop.1", "type", "Proposition", "iri"),
    ("I.prop.1", "cites", "I.def.1", "iri"),
    ("I.prop.1", "cites", "I.ax.1", "iri"),
    ("I.prop.1", "title", 'a "b" ; c .', "literal"),
}


def rows(df):
    return {tuple(r) for r in df.collect()}


def store(spark, *found):
    return spark.createDataFrame([(s, p, o, "iri") for s, p, o in found], S.SCHEMA)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_read_write(spark, tmp_path, end):
    (tmp_path / "a.n3").write_text(N3.replace("\n", end), newline="")
    found = S.read_triples(spark, str(tmp_path / "a.n3"))
    assert sorted(map(tuple, found.collect())) == sorted(WANTED)
    S.write_triples(found, str(tmp_path / "out"), rules=True)
    assert rows(S.read_triples(spark, str(tmp_path / "out"))) == WANTED


def test_stream_gives_each_triple_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.n3").write_text(N3)
        found = stream_triples(spark, str(tmp_path / "in"), {"e": "http://example.org/e#", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#"})
        append_triples(found, str(tmp_path / "table"), str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "table")).collect())) == sorted(WANTED)


@pytest.mark.parametrize("text", ["e:a e:b .\n", "x:a x:b x:c .\n", "e:a e:b e:c e:d .\n"])
def test_bad_statements_are_errors(spark, tmp_path, text):
    (tmp_path / "a.n3").write_text("@prefix e: <e#> .\n" + text)
    with pytest.raises(Exception, match="USER_RAISED"):
        S.read_triples(spark, str(tmp_path / "a.n3")).collect()


def test_table_by_relation(spark, tmp_path):
    given = store(spark, ("a", "cites", "b"), ("a", "1", "b"), ("c", "partOf", "a"))
    S.save_triples(given, str(tmp_path / "t"))
    found = S.load_triples(spark, str(tmp_path / "t"))
    assert rows(found) == rows(given)
    plan = T.cited_by(found, "a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in plan and "PushedFilters: [IsNotNull(s), EqualTo(s,a)]" in plan and "o_kind" not in plan.split("ReadSchema")[1]


def test_inference(spark):
    given = store(spark, ("p1", "cites", "d1"), ("p2", "provedBy", "p2.proof"), ("p2.proof", "cites", "p1"), ("p3", "hasCorollary", "c"), ("p4", "hasNote", "n"))
    literal = spark.createDataFrame([("p5", "hasNote", "7", "literal")], S.SCHEMA)
    found = {r[:3] for r in rows(graph.infer(given.unionByName(literal)))}
    assert found == {("p1", "dependsUpon", "d1"), ("p2", "dependsUpon", "p2.proof"), ("p2.proof", "dependsUpon", "p1"), ("p2", "transitivelyDependsOn", "p1"), ("p2", "transitivelyDependsOn", "d1"), ("p2.proof", "transitivelyDependsOn", "d1"), ("c", "derivedFrom", "p3"), ("n", "explainsElement", "p4")}


def test_cycle(spark):
    e = graph.edges_of(store(spark, ("1", "x", "2"), ("2", "x", "3"), ("3", "x", "1"), ("4", "x", "4")), "x")
    assert rows(graph.closure(e)) == {("1", "3"), ("2", "1"), ("3", "2")}
    assert rows(cycles.on_cycles(e)) == {("1",), ("2",), ("3",), ("4",)}
    assert ("1", "1") not in rows(graph.two_hops(e)) and ("4", "4") in rows(graph.two_hops(e))


def brute_distances(edges, limit):
    out = {}
    for origin in {a for a, _ in edges}:
        level, seen = {origin}, {origin}
        for d in range(1, limit + 1):
            level = {b for a, b in edges if a in level} - seen
            seen |= level
            out |= {(origin, x): d for x in level}
    return out


@pytest.mark.parametrize("n, m, seed", [(150, 320, 1), (90, 90, 2), (5, 0, 3)])
def test_walks_by_bits(spark, n, m, seed):
    """More nodes than a block holds, cycles, loops, repeated edges and null ends; and no edges at all."""
    r = random.Random(seed)
    pairs = [(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(m)]
    given = pairs + pairs[:5] + [(None, "n1"), ("n1", None)] if m else []
    e = spark.createDataFrame(given, "src string, dst string")
    plain = {(a, b) for a, b in pairs if a != b}
    far = brute_distances(plain, n)
    depth: dict[str, int] = {}
    influence: dict[str, int] = {}
    for (a, b), d in far.items():
        if d <= 3:
            depth[a] = max(depth.get(a, 0), d)
            influence[b] = influence.get(b, 0) + 6 - d
    assert rows(graph.dependency_depth(e, 3)) == set(depth.items())
    assert rows(graph.influence(e, 3)) == set(influence.items())
    around = {(a,) for a, b in plain if (b, a) in far} | {(a,) for a, b in pairs if a == b}
    assert rows(cycles.on_cycles(e)) == around

def brute_trace(cites, part_of, start, limit):
    out, seen = [], set()

    def go(node, depth):
        if depth > limit or node in seen:
            return
        seen.add(node)
        out.append((node, depth))
        own = sorted({b for a, b in cites if a == node})
        inner = sorted({b for s, o in part_of if o == node for a, b in cites if a == s})
        for x in own or inner:
            go(x, depth + 1)

    go(start, 0)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_walks_against_plain_loops(spark, seed):
    rng = random.Random(seed)
    cites = {(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(26)}
    part_of = {(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(8)}
    t = store(spark, *[(a, "cites", b) for a, b in cites], *[(a, "partOf", b) for a, b in part_of])
    edges = graph.edges_of(t, "cites")
    walked = {(r["origin"], r["node"]): r["d"] for r in graph.distances(edges, 4).collect()}
    assert walked == brute_distances({(a, b) for a, b in cites if a != b}, 4)
    reach = {r["id"]: r["influence"] for r in graph.influence(edges).collect()}
    back = brute_distances({(b, a) for a, b in cites if a != b}, 4)
    assert reach == {k: float(sum(6 - d for (o, _), d in back.items() if o == k)) for k in {o for o, _ in back}}
    starts = spark.createDataFrame([("n1",), ("n5",), ("gone",)], "id string")
    lines = graph.trace_depth_first(t, starts, 2).orderBy("origin", "place").collect()
    for start in ("n1", "n5", "gone"):
        assert [(r["node"], r["depth"]) for r in lines if r["origin"] == start] == brute_trace(cites, part_of, start, 2)


@pytest.mark.parametrize("limit", [0, 1, 3, 4])
def test_depth_first_lines_where_nodes_meet_at_the_limit(spark, limit):
    rng = random.Random(limit)
    # many short cycles, so that nodes are often met at the limit before they are met nearer
    cites = {(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(22)} | {(f"c{k}", f"c{k + 1}") for k in range(6)} | {("hub", f"c{k}") for k in range(7)}
    part_of = {(f"n{rng.randrange(9)}", f"m{rng.randrange(3)}") for _ in range(8)}
    t = store(spark, *[(a, "cites", b) for a, b in cites], *[(a, "partOf", b) for a, b in part_of])
    names = [f"n{k}" for k in range(9)] + ["m0", "m1", "m2", "hub", "gone"]
    lines = graph.trace_depth_first(t, spark.createDataFrame([(n,) for n in names * 2] + [(None,)], "id string"), limit).collect()
    assert {r["origin"] for r in lines} == set(names)
    for start in names:
        own = sorted((r for r in lines if r["origin"] == start), key=lambda r: r["place"])
        assert [r["place"] for r in own] == list(range(len(own)))
        assert [(r["node"], r["depth"]) for r in own] == brute_trace(cites, part_of, start, limit), start
    assert graph.trace_depth_first(t, spark.createDataFrame([], "id string"), limit).count() == 0


def test_depth_first_lines_of_a_hub(spark):
    ids = spark.range(100_000).select(F.lit("hub").alias("s"), F.lit("cites").alias("p"), F.format_string("k%06d", "id").alias("o"), F.lit("iri").alias("o_kind"))
    t = ids.unionByName(store(spark, ("a", "cites", "hub"), ("a", "cites", "k000007"), ("k000003", "cites", "k000001"), ("k000005", "cites", "z")).select(ids.columns))
    lines = graph.trace_depth_first(t, spark.createDataFrame([("a",), ("k000003",)], "id string"), 2)
    assert "InPandas" not in lines._jdf.queryExecution().toString()
    own = lines.persist()
    assert own.filter("origin = 'a'").count() == 100_002 and own.filter("depth = 2").count() == 100_000
    near = {(r["origin"], r["place"]): (r["node"], r["depth"]) for r in own.filter("place < 3 OR place > 100000").collect()}
    assert near == {("a", 0): ("a", 0), ("a", 1): ("hub", 1), ("a", 2): ("k000000", 2), ("a", 100_001): ("k099999", 2), ("k000003", 0): ("k000003", 0), ("k000003", 1): ("k000001", 1)}
    own.unpersist()


def test_weights(spark):
    t = store(spark, ("a", "cites", "b"), ("c", "provedBy", "b"), ("b", "groundedIn", "d"), ("x", "mentions", "b"))
    e = spark.createDataFrame([("b", "proposition"), ("d", "definition"), ("lone", "lemma")], "id string, type string")
    found = {r["element_id"]: r for r in analysis.weights(t, e).collect()}
    b = found["b"]
    assert (b["inbound_weight"], b["outbound_weight"], b["transitive_influence"], b["dependency_depth"], b["influence_reach"]) == (3.0, 2.0, 10.0, 1, 1)
    assert b["foundational_score"] == pytest.approx(3 + 4.5 + 2 + 5)
    assert found["d"]["foundational_score"] == pytest.approx(10 + 3 + 0.2 * 13 + 5) and found["lone"]["foundational_score"] == 6.0
    assert found["lone"]["relationship_breakdown"] == {}


def test_relations_and_chains(spark):
    stated = store(spark, ("a", "cites", "b"), ("a", "type", "Axiom"), ("a", "unknown", "b"))
    inferred = store(spark, ("a", "dependsUpon", "b"), ("a", "transitivelyDependsOn", "c"))
    found = {tuple(r) for r in analysis.relations(stated, inferred, "b").collect()}
    assert found == {("b", "a", "citedBy", "b", False), ("b", "a", "inverse_dependsUpon", "b", True)}
    chains = analysis.chains(inferred).collect()
    assert {(r["element_id"], r["type"], r["start"], r["end"]) for r in chains} == {("a", "dependency", "a", "b"), ("b", "inverse_dependency", "a", "b"), ("a", "transitive_dependency", "a", "c"), ("c", "inverse_transitive_dependency", "a", "c")}
    assert chains[0]["path"][0]["from"] == chains[0]["start"] and chains[0]["length"] == 1


def test_backfill(spark):
    a, b = store(spark, ("x", "p", "y")), store(spark, ("x", "p", "y"), ("x", "p", "z"), ("x", "p", "z"))
    assert rows(T.backfill(a, b)) == {("x", "p", "y", "iri", "canonical"), ("x", "p", "z", "iri", "backfill")}
    assert T.merge(a, b, b).count() == 2
