import json

import pytest
from pyspark.sql import functions as F

from marginalia.operators import reader
from marginalia.operators import triples as T
from marginalia.sources import passages as P
from marginalia.sources import texts as X

BOOK = """<part id="V" number="5" title="Of gardens">
  <section type="definitions" id="V.definitions">
    <def id="V.def.1" number="1"><text>A hedge is a   wall that grows.</text>
      <explanation id="V.def.1.explanation"><text>Stone does not grow.</text><continuation><text>Nor do fences.</text></continuation></explanation></def>
    <def number="2"><text>This one has no id.</text></def>
    <section type="postulates" id="V.postulates">
      <postulate id="V.post.1" number="1"><text>Rain falls.</text><footnote id="V.post.1.note" number="7" editorial="true"><text>Salt &amp; sand stay dry.</text></footnote></postulate>
    </section>
    <def id="V.def.3" number="3"><text> </text><note id="V.def.3.note"><text>A path is left out.</text></note></def>
  </section>
  <section type="propositions" id="V.propositions">
    <note id="V.propositions.note"><text>What grows is counted here.</text></note>
    <prop id="V.prop.4" number="4"><text>Hedges need water.</text><enumeration><item number="1"><text>rain</text></item><item><text>dew</text></item></enumeration>
      <corollary id="V.prop.4.corollary2"><text>Drought ends them.</text></corollary></prop>
  </section>
  <section type="preface" id="V.preface"><text>Of what</text><text>grows   slowly.</text></section>
</part>"""
ORDER = ["V.def.1", "V.def.1.explanation", "V.post.1", "V.post.1.note", "V.def.3.note", "V.propositions.note", "V.prop.4", "V.prop.4.corollary2", "V.preface"]
APPENDIX = """<part id="IV"><section type="appendix" id="IV.appendix">
<introduction id="x"><text>Opening.</text></introduction>
<section type="chapter" id="IV.appendix.chapter.1" topic="i"><text>Chapter.</text></section>
<section topic="abstract_notions"><text>Argument.</text></section>
<section><text>Nameless.</text></section></section>
<section><def id="IV.def.1"><text>old</text></def><def id="IV.def.1"><text>new</text></def></section></part>"""


def docs(spark, *texts):
    return spark.createDataFrame([(f"f{k}", t) for k, t in enumerate(texts)], "path string, value string")


def by_id(df):
    return {r["id"]: r for r in df.collect()}


def test_reading_order_and_derived_columns(spark):
    found = P.passages_of(docs(spark, BOOK)).orderBy("sort_index").collect()
    assert [r["id"] for r in found] == ORDER and [r["sort_index"] for r in found] == list(range(1, 10))
    rows = {r["id"]: r for r in found}
    assert rows["V.def.1"]["text"] == "A hedge is a wall that grows." and rows["V.preface"]["text"] == "Of what\n\ngrows slowly."
    assert rows["V.prop.4"]["text"] == "Hedges need water.\n\n1. rain\n\ndew"
    assert rows["V.def.1.explanation"]["text"] == "Stone does not grow.\n\nNor do fences."
    note = rows["V.post.1.note"]
    assert [note[c] for c in ("is_editorial", "editorial_kind", "source_authority", "number", "section_kind", "parent_id")] == [True, "english_only_addition", "english_structural", "7", "postulates", "V.post.1"]
    assert (rows["V.prop.4.corollary2"]["variant_label"], rows["V.prop.4"]["canonical_label"], rows["V.def.1"]["canonical_label"]) == ("corollary2", "Proposition IV", "Definition I")
    assert {(r["part_number"], r["part_numeral"]) for r in found} == {(5, "V")}


def test_appendix_headings_and_repeated_ids(spark):
    rows = by_id(P.passages_of(docs(spark, APPENDIX, "<other/>")))
    assert rows["IV.appendix.introduction"]["editorial_kind"] == "synthetic_heading" and not rows["IV.appendix.introduction"]["is_editorial"]
    assert rows["IV.appendix.chapter.1"]["canonical_label"] == "Caput I" and rows["IV.appendix.chapter.1"]["source_authority"] == "latin_governed"
    assert rows["IV.appendix.argument.2"]["heading"] == "On Common Abstract Notions"
    assert (rows["IV.appendix.argument.3"]["heading"], rows["IV.appendix.argument.3"]["editorial_kind"]) == ("Appendix Section", "synthetic_heading")
    assert rows["IV.def.1"]["text"] == "new"


def test_markup_reads_back(spark):
    found = P.passages_of(docs(spark, BOOK, APPENDIX))
    again = P.passages_of(P.markup(found).select(F.col("part_number").cast("string").alias("path"), F.col("xml").alias("value")))
    kept = [c for c in found.columns if c not in ("sort_index", "text")]
    key = lambda df: sorted(map(str, df.select(*kept, F.regexp_replace("text", r"\s+", " ").alias("text")).collect()))
    assert key(found) == key(again)
    order = lambda df: [r["id"] for r in df.orderBy("part_number", "sort_index").collect()]
    assert order(found) == order(again)


def test_entries_hold_all_inner_text(spark):
    rows = by_id(P.entries_of(docs(spark, BOOK)))
    assert rows["V.prop.4"]["text"] == "Hedges need water. rain dew Drought ends them."
    assert rows["V.def.1.explanation"]["parent_id"] == "V.def.1" and "V.preface" not in rows and rows["V.def.3"]["part_number"] == 5


def test_a_graph_walks_its_documents_once(spark):
    citing = """<part id="V" number="5"><section type="notes"><note id="V.note.1"><text>Def. i, by (Prop. iv); Def. i. Ax. ii</text></note></section></part>"""
    graph = T.entry_triples(P.entries_of(docs(spark, BOOK, citing)))
    assert "MapIn" not in graph._jdf.queryExecution().executedPlan().toString()  # a walk for each kind of triple before
    rows = [tuple(r)[:3] for r in graph.collect()]
    assert len(rows) == len(set(rows)) and {r for r in rows if r[1] == "cites"} == {("V.note.1", "cites", "V.def.1"), ("V.note.1", "cites", "V.prop.4")}
    assert {r for r in rows if "V.prop.4" in r} == {("V.prop.4", "type", "Proposition"), ("V.prop.4", "partNumber", "5"), ("V.prop.4", "number", "4"), ("V.prop.4.corollary2", "partOf", "V.prop.4"), ("V.prop.4", "hasCorollary", "V.prop.4.corollary2"), ("V.note.1", "cites", "V.prop.4")}


def test_bundles_hold_many_documents_a_file(spark, tmp_path):
    kinds = "id string, type string, text string, number string, parent_id string, sort_index long, section_kind string, part_number int, part_numeral string, heading string, is_editorial boolean"
    rows = [(f"I.prop.{k}", "proposition", f"A <line\n {k}\u2029 & more", str(k), None, k, "propositions", k // 3 + 1, str(k // 3 + 1), None, False) for k in range(60)]
    P.write_bundles(spark.createDataFrame(rows, kinds), str(tmp_path / "few"))
    P.write_markup(spark.createDataFrame(rows, kinds), str(tmp_path / "many"))
    few, many = P.bundled_documents(spark, str(tmp_path / "few")), P.xml_documents(spark, str(tmp_path / "many"))
    assert few.select("path").distinct().count() == many.count() == 20 and len(list((tmp_path / "few").glob("*.txt"))) <= 4
    assert {r["value"].strip() for r in few.collect()} == {r["value"].strip() for r in many.collect()}
    entries = lambda d: sorted(map(str, P.entries_of(d).collect()))
    assert entries(few) == entries(many) and len(entries(few)) == 60


def test_outline(spark):
    ids = {r["id"] for r in P.outline(P.passages_of(docs(spark, BOOK))).collect()}
    assert "V.prop.4.corollary2" in ids and "V.post.1.note" not in ids and "V.preface" not in ids


def test_files(spark, tmp_path):
    (tmp_path / "p.xml").write_text(BOOK)
    found = P.read_passages(spark, str(tmp_path / "p.xml"))
    assert found.count() == 9
    P.write_markup(found, str(tmp_path / "out"))
    assert P.read_passages(spark, str(tmp_path / "out" / "part_number=5")).count() == 9
    (tmp_path / "la.json").write_text(json.dumps({"language": "la", "part": 5, "elements": {"V.prop.4": " Aquam. ", "V.def.1": "  "}}, indent=1))
    merged = by_id(reader.merge_parallel(found, X.read_parallel(spark, str(tmp_path / "la.json"))))
    assert merged["V.prop.4"]["latin_text"] == "Aquam." and merged["V.def.1"]["latin_text"] is None and len(merged) == 9
    assert X.read_parallel(spark, str(tmp_path / "none.json")).count() == 0
    X.write_parallel(spark.createDataFrame([(2, "b", "B"), (2, "a", "A")], "part int, id string, text string"), str(tmp_path / "la"))
    assert {tuple(r) for r in X.read_parallel(spark, str(tmp_path / "la")).collect()} == {("a", "A"), ("b", "B")}
    (tmp_path / "page.html").write_bytes("<p>Æther &aelig;t&amp;quot;</p><script>x</script><br>AXIOMATA I. Quod est.\r\n\r\nNeo-Latin".encode("latin-1"))
    lines = X.page_lines(X.read_pages(spark, str(tmp_path / "page.html")), "path").orderBy("pos").collect()
    assert [r["paragraph"] for r in lines] == ['Æther aet"', "AXIOMATA", "I. Quod est."]


def test_search_and_neighbours(spark):
    found = P.passages_of(docs(spark, BOOK))
    ids = lambda df: {r["id"] for r in df.collect()}
    assert ids(reader.visible(found, " DROUGHT ")) == {"V.prop.4"} and ids(reader.visible(found, "%")) == set()
    assert ids(reader.visible(found, "  ")) == {"V.def.1", "V.post.1", "V.propositions.note", "V.prop.4", "V.preface"}
    assert ids(reader.selectable(found, "need WATER")) == {"V.prop.4", "V.prop.4.corollary2"}
    assert ids(reader.children_shown(found, "fences")) == {"V.def.1.explanation"}
    near = by_id(reader.neighbours(found))
    assert [near[i]["previous_id"] for i in ORDER] == [None, *ORDER[:-1]] and [near[i]["next_id"] for i in ORDER] == [*ORDER[1:], None]
    assert [tuple(r)[:3] for r in reader.section_summary(found).collect()] == [("definitions", "Definitions", 1), ("postulates", "Postulates", 1), ("propositions", "Propositions", 2), ("preface", "Preface", 1)]
    assert [r["shows_heading"] for r in reader.section_starts(found).orderBy("sort_index").collect()] == [True, True, True, False, True]
    assert [c["id"] for c in reader.children_by_parent(found).filter("parent_id = 'V.prop.4'").first()["children"]] == ["V.prop.4.corollary2"]


@pytest.mark.parametrize("text", ["", "no markup"])
def test_broken_documents_are_errors(spark, text):
    with pytest.raises(Exception, match="ParseError"):
        P.passages_of(docs(spark, text)).collect()
