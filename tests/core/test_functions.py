from pyspark.sql import functions as F

from marginalia.functions import html as H
from marginalia.functions import labels as L
from marginalia.functions.citations import references
from marginalia.functions.roman import from_roman, to_roman
from marginalia.operators import triples as T


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def found(spark, text, own, build=False):
    return value(spark, references(F.lit(text), F.lit(own), build))


def test_roman_round_trip(spark):
    n = spark.range(1, 4000).select("id", to_roman(F.col("id")).alias("r")).select("id", "r", from_roman(F.lower("r")).alias("back"))
    assert n.filter("id <> back").count() == 0
    assert [r["r"] for r in n.filter("id in (4, 1999, 3888)").orderBy("id").collect()] == ["IV", "MCMXCIX", "MMMDCCCLXXXVIII"]
    odd = {"IIX": 8, "MIX": 1009, "DID": 999, "": 0, "ABC": None}
    assert {k: value(spark, from_roman(F.lit(k))) for k in odd} == odd
    assert value(spark, to_roman(F.lit(None).cast("int"))) == "" and value(spark, to_roman(F.lit(-2))) == ""


def test_references(spark):
    assert found(spark, "Walls fall (III. xii.) where roots are (III. xii. Coroll. iii).", "III.prop.40") == ["III.prop.12", "III.prop.12.corollary3"]
    assert found(spark, "Rain comes first, Part iv, Prop. xx, Coroll. ii", "III.prop.40") == ["IV.prop.20.corollary2", "III.prop.20.corollary2"]
    assert found(spark, "Post. vi; Lemma ix; Ax. iii and iv; Deff. x, xi", "V.prop.7.note") == ["V.def.10", "V.def.11", "V.ax.3", "V.ax.4", "V.lemma.9", "V.post.6"]
    assert found(spark, "(Prop. v, Coroll. ii)", "III.prop.9") == ["III.prop.5.corollary2"]
    assert found(spark, "(Prop. v)", "III.prop.5") == [] and found(spark, None, "III.prop.5") == []


def test_references_at_the_beginning_and_after_rare_spaces(spark):
    texts = {"iv. Ax. ii": "IV.ax.2", "iv. xi": "IV.prop.11", "Prop. ix": "II.prop.9", "Def. ix": "II.def.9", "Ax. ix": "II.ax.9", "Lemma ix": "II.lemma.9", "Post. ix": "II.post.9", "Pt. iv, Lemma ix": "IV.lemma.9"}
    before = {"": True, " ": True, ", ": True, "so\u00a0": True, "so\u2029": True, "so\u3000": True, "so\x0b(": True, "so\u2030": False, "so\u200b": False}
    rows = spark.createDataFrame([(b + t, wanted, there or t.startswith("Pt.")) for t, wanted in texts.items() for b, there in before.items()], "text string, wanted string, there boolean")
    has = [F.array_contains(references(F.col("text"), F.lit("II.prop.1"), build), F.col("wanted")) for build in (False, True)]
    assert [r["text"] for r in rows.filter((has[0] != F.col("there")) | (has[1] != F.col("there"))).collect()] == []


def test_squeeze(spark):
    spaces = " \t\n\x0b\f\r\u00a0\u1680\u2000\u2005\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
    texts = [f"{a}x{b}y{c}" for a in ("", " ", "\n ") for b in [*spaces, *(" " + s for s in spaces), *(s + " " for s in spaces), spaces] for c in ("", " ", "\u3000")]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(L.squeeze(F.col("t")).alias("x"))
    assert {r["x"] for r in rows.collect()} == {"x y"}
    assert value(spark, L.squeeze(F.lit("a\u0085b\u200bc\u1681d"))) == "a\u0085b\u200bc\u1681d" and value(spark, L.squeeze(F.lit(None).cast("string"))) is None


def test_reference_patterns_without_right_boundary(spark):
    assert found(spark, "a definite thing", "I.prop.2") == ["I.def.1"]
    assert found(spark, "Part iv", "I.prop.2") == ["I.prop.5"]
    assert "III.prop.50" in found(spark, "so III. Lemma x", "I.prop.2")
    assert found(spark, "Pt. iiii, Prop. ii", "I.prop.2") != found(spark, "Pt. iiii, Prop. ii", "I.prop.2", build=True)


def test_passage_triples(spark):
    inside = [(f"I.lemma.6.{kind}", kind, "Trees age.", "I.lemma.6") for kind in ("proof", "note", "corollary")]
    p = spark.createDataFrame([("I.lemma.6", "lemma", "Roots hold (Def. iv), not Lemma xxx.", None), ("I.def.4", "definition", "Part iii, Prop. ii is elsewhere.", None), *inside], "id string, type string, text string, parent_id string")
    got = {tuple(r)[:3] for r in T.passage_triples(p).collect()}
    assert {x for x in got if x[1] == "cites"} == {("I.lemma.6", "cites", "I.def.4")}  # of what it refers to, what is there
    relation = {"proof": "provedBy", "note": "hasNote", "corollary": "hasCorollary"}
    assert {(i, "partOf", parent) for i, _, _, parent in inside} | {(parent, relation[kind], i) for i, kind, _, parent in inside} <= got
    assert ("I.def.4", "type", "Definition") in got


def labels():
    return [
        (L.humanised(F.lit("some_tokenName-x..y")), "Some TokenName X Y"),
        (L.section_label(F.lit("lemmas")), "Lemmas"),
        (L.section_label(F.lit("odd_kind")), "Odd Kind"),
        (L.passage_label(F.lit("I.prop.11.corollary2"), F.lit("corollary"), F.lit(None), F.lit(None)), "Corollary"),
        (L.passage_label(F.lit("I.def.6"), F.lit("definition"), F.lit(None), F.lit(None)), "Definition VI"),
        (L.passage_label(F.lit("I.def.6.extra"), F.lit("definition"), F.lit("4"), F.lit(None)), "Definition IV Extra"),
        (L.passage_label(F.lit("I.x"), F.lit("axiom"), F.lit("n"), F.lit("")), "Axiom"),
        (L.variant_of(F.lit("I.prop.1.proof2"), F.lit("proof")), "proof2"),
        (L.variant_of(F.lit("I.prop.1.proof"), F.lit("proof")), None),
        (L.variant_label(F.lit("proof12")), "Proof 12"),
        (L.inverse_name(F.lit("contradicts")), "contradictedBy"),
        (L.inverse_name(F.lit("dependsUpon")), "inverse_dependsUpon"),
        (L.relation_label(F.lit("transitivelyDependsOn")), "Transitively Depends On"),
        (L.relation_label(F.lit("inverse_dependsUpon")), "Is Depended On By"),
        (L.relation_phrase(F.lit("dependsUpon")), "depends upon"),
        (L.relation_rank(F.lit("inverse_transitivelyDependsOn")), 2),
        (L.reference_text(F.lit("II.prop.1"), F.lit(5)), "prop.1"),
        (L.reference_text(F.lit("II.prop.1"), F.lit(1)), "II.prop.1"),
        (L.truncated(F.lit("abc d"), 4, trimmed=True), "abc…"),
        (L.truncated(F.lit("abc"), 3), "abc"),
        (L.part_of_id(F.lit("IV.prop.1")), 4),
        (L.local_name(F.lit("http://e#a#b")), "a"),
        (L.escaped(F.lit('<a b="&">')), "&lt;a b=&quot;&amp;&quot;&gt;"),
        (L.from_url_component(L.url_component(F.lit("a b+(c)*é'"))), "a b+(c)*é'"),
        (L.url_component(F.lit("a b(!)")), "a%20b(!)"),
        (L.one_decimal(F.lit(12.25)), "12.3"),
        (L.heading_key(F.lit("Axioms.:")), "AXIOMS"),
        (L.squeeze(F.lit("  a \n b ")), "a b"),
        (H.decode_entities(F.lit("&amp;quot;&AElig;&#198;&nbsp;x")), '"aeAe x'),
    ]


def test_labels(spark):
    for k, (column, wanted) in enumerate(labels()):
        assert value(spark, column) == wanted, k
