"""Queries over files: tables written out as N3, XML, JSON and pages in the shared folder, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import labels as L
from marginalia.functions.roman import to_roman
from marginalia.operators import alignment, graph, reader
from marginalia.operators import triples as T
from marginalia.operators.lineage import shared_folder
from marginalia.sources import passages as P
from marginalia.sources import texts as X
from marginalia.sources.n3 import read_n3
from marginalia.sources.triples import NAMESPACE, read_triples, write_triples

from .reading import load_library
from .tables import citing_sentence, passages, ranged_parts, table, triples

#: Rows of a table that make a file.
FILE_ROWS = 500


def _new(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def n3_written(spark: SparkSession, sf: str) -> DataFrame:
    """A graph written as N3 with its inference rules, and read again without them."""
    path = _new(spark, "n3")
    write_triples(triples(spark, sf, "parents", "classes", "places"), path, rules=True)
    return read_triples(spark, path)


def n3_abbreviated(spark: SparkSession, sf: str) -> DataFrame:
    """N3 as people write it: prefixes, lists with ';' and ',', quoted and plain literals, rules over two lines, comments."""
    p = table(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    quoted = F.concat(F.lit('"'), F.regexp_replace("p_name", " ", r' \\"'), F.lit('"'))
    body = F.concat(F.lit(":P."), key, F.lit(" a :Proposition ;\n  :label "), quoted, F.lit(" ;\n  :cites <http://example.org/other#B."), F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""), F.lit("> , o:S."), F.col("p_size").cast("string"), F.lit(" ;\n  :number "), F.col("p_size").cast("string"), F.lit(" .\n# about "), key, F.lit("\n{ ?x :cites ?y }\n=> { ?x :dependsUpon ?y } ."))
    head = spark.createDataFrame([("@prefix : <http://example.org/one#> .\n@prefix o: <http://example.org/two#> .",)], "value string")
    path = _new(spark, "n3")
    head.unionByName(p.select(body.alias("value"))).write.text(path)
    return read_triples(spark, path)


def n3_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as N3 of all kinds: prefixes that mean something else in every other file, several statements a line, long
    strings with anything in them, blank nodes with and without names, and rules over several lines."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source", F.floor(F.col("doc_id") / FILE_ROWS).cast("int").alias("file"))
    key = F.col("doc_id").cast("string")
    escaped = F.replace(F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\r"), F.lit("\\r"))
    item = F.concat(
        *[F.lit(":D."), key, F.lit(' a :Passage ; :text """'), escaped, F.lit('"""@x-any . [ :of :D.'), key, F.lit(' ; :lang "'), "lang", F.lit('"^^:code ] . _:d'), key, F.lit(" :in :S."), "source"],
        F.lit(" .\n{ ?x :of ?y . # a rule, not a fact .\n  ?y :text ?z .\n}\n=> { ?x :has ?z } ."),
    )
    head = F.when(F.col("file") % 2 == 0, "@prefix : <http://example.org/even#> .").otherwise("@prefix : <http://example.org/odd#odd.> .")
    files = d.select("file", "doc_id", item.alias("item")).groupBy("file").agg(F.concat(F.first(head), F.lit("\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "item"))), lambda x: x["item"]), "\n")).alias("value"))
    path = _new(spark, "n3")
    files.select("value", "file").write.partitionBy("file").text(path)
    blank = F.when(F.col("s").startswith("_:"), "[]").otherwise(F.col("s"))
    return read_n3(spark, path).groupBy(blank.alias("s"), "p", F.md5("o").alias("digest"), "o_kind").agg(F.count("*").alias("n"))


def iri_names(spark: SparkSession, sf: str) -> DataFrame:
    t = triples(spark, sf, "parents")
    full = L.iri(F.col("s"), NAMESPACE)
    return t.select("s", full.alias("iri"), L.local_name(full).alias("name"), L.local_name(F.col("o")).alias("o"))


def _written_passages(spark: SparkSession, sf: str) -> DataFrame:
    path = _new(spark, "xml")
    P.write_markup(ranged_parts(passages(spark, sf)), path)
    return P.xml_documents(spark, path)


def ordered_xml(spark: SparkSession, sf: str) -> DataFrame:
    """Passages written as XML files of a fixed size, and read in document order."""
    read = P.passages_of(_written_passages(spark, sf))
    return read.select("id", "type", F.md5("text").alias("digest"), F.col("sort_index").cast("long").alias("sort_index"), "section_kind", "parent_id", F.col("part_number").cast("long").alias("part_number"), "is_editorial", "source_authority", "variant_label")


def explorer_outline(spark: SparkSession, sf: str) -> DataFrame:
    """The short view of an explorer, from XML files."""
    return P.outline(P.passages_of(_written_passages(spark, sf))).select("id", "type", F.md5("text").alias("digest"), "parent_id")


def marked_appendix(spark: SparkSession, sf: str) -> DataFrame:
    """XML with definitions that hold lists, and an appendix whose sections have no ids."""
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", F.floor(F.col("p_partkey") / FILE_ROWS).cast("int").alias("file"))
    name, brand, kind = (L.escaped(F.col(c)) for c in ("p_name", "p_brand", "p_type"))
    key = F.col("p_partkey").cast("string")
    item = F.concat(F.lit('<def id="I.def.'), key, F.lit('" number="'), key, F.lit('"><text> '), name, F.lit("\n <i>"), kind, F.lit('</i></text><enumeration><item number="1">'), brand, F.lit("</item><item>"), kind, F.lit("</item></enumeration></def>"))
    chapter = F.concat(F.lit("<section"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(' topic="'), to_roman(F.col("p_partkey").cast("int") + 1), F.lit('"'))).otherwise(F.lit("")), F.lit("><p>"), name, F.lit("</p></section>"))
    gather = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", c.alias("xml")))), lambda x: x["xml"]), "\n")
    files = p.groupBy("file").agg(gather(item).alias("items"), gather(chapter).alias("chapters"))
    xml = F.concat(F.lit('<part id="I"><section type="definitions">'), "items", F.lit('</section><section type="appendix" id="I.appendix"><introduction>To begin with</introduction>'), "chapters", F.lit("</section></part>"))
    path = _new(spark, "xml")
    files.select(xml.alias("value"), "file").write.partitionBy("file").text(path)
    # an id may come again in another file, so that the file is part of the answer
    documents = P.xml_documents(spark, path).withColumn("path", F.regexp_extract("path", r"file=(\d+)", 1))
    rows = P.passages_of(documents)
    return rows.groupBy("id").agg(F.count("*").alias("n"), F.min("type").alias("type"), F.min("sort_index").cast("long").alias("first_index"), F.min("heading").alias("heading"), F.min("editorial_kind").alias("editorial_kind"), F.md5(F.array_join(F.sort_array(F.collect_list("text")), "|")).alias("digest"))


def order_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as propositions with a proof each, which cites others; parts of a fixed number of orders."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    part = F.upper(F.element_at(F.array(*map(F.lit, ("I", "II", "III", "IV", "V"))), (F.col("o_orderkey") % 5 + 1).cast("int")))
    top = F.concat(part, F.lit(".prop."), F.col("o_orderkey").cast("string"))
    rows = [
        o.select(top.alias("id"), F.lit("proposition").alias("type"), F.col("o_orderpriority").alias("text"), F.col("o_orderkey").cast("string").alias("number"), F.lit(None).cast("string").alias("parent_id"), "o_orderkey", F.lit(0).alias("nth")),
        o.select(F.concat(top, F.lit(".proof")).alias("id"), F.lit("proof").alias("type"), citing_sentence().alias("text"), F.lit(None).cast("string").alias("number"), top.alias("parent_id"), "o_orderkey", F.lit(1).alias("nth")),
    ]
    both = rows[0].unionByName(rows[1])
    number = F.floor(F.col("o_orderkey") / FILE_ROWS).cast("int") + 1
    return both.select("id", "type", "text", "number", "parent_id", (F.col("o_orderkey") * 2 + F.col("nth")).alias("sort_index"), F.lit("propositions").alias("section_kind"), number.alias("part_number"), number.cast("string").alias("part_numeral"), F.lit(None).cast("string").alias("heading"), F.lit(False).alias("is_editorial"))


def explicit_graph(spark: SparkSession, sf: str) -> DataFrame:
    """The explicit graph of marked-up files: entries of every element, with their citations."""
    path = _new(spark, "xml")
    P.write_bundles(order_passages(spark, sf), path)
    found = T.entry_triples(P.entries_of(P.bundled_documents(spark, path)))
    return found.groupBy("p", "o_kind", "o").agg(F.count("*").alias("n"), F.min("s").alias("first"))


def supplemental_graph(spark: SparkSession, sf: str) -> DataFrame:
    """What passages themselves tell: class, parent, relation to the parent, citations of passages that are there."""
    found = T.passage_triples(order_passages(spark, sf))
    return found.groupBy("p", "o").agg(F.count("*").alias("n"), F.min("s").alias("first"))


def inferred_graph(spark: SparkSession, sf: str) -> DataFrame:
    found = graph.infer(triples(spark, sf, "places", "brands", "notes"))
    return found.groupBy("p", "o").agg(F.count("*").alias("n"), F.min("s").alias("first"))


def parallel_json(spark: SparkSession, sf: str) -> DataFrame:
    """Texts written as JSON maps by id, and read again."""
    d = table(spark, sf, "documents").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    path = _new(spark, "json")
    X.write_parallel(d.select(F.floor(F.col("doc_id") / FILE_ROWS).cast("int").alias("part"), F.col("doc_id").cast("string").alias("id"), "text"), path)
    return X.read_parallel(spark, path).select("id", F.md5("latin_text").alias("digest"))


def latin1_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as bytes in a one-byte encoding ('?' for what it lacks), decoded and cut into paragraphs."""
    narrow = F.regexp_replace("html", r"[^\x00-\xFF]", "?")
    files = table(spark, sf, "pages").select(F.col("page_id").alias("path"), F.encode(narrow, "ISO-8859-1").alias("content"))
    lines = X.page_lines(X.decoded(files), "path")
    return lines.select(F.col("path").alias("page_id"), F.col("pos").cast("long").alias("pos"), F.md5("paragraph").alias("digest"))


def library_store(spark: SparkSession, sf: str) -> DataFrame:
    """A library loaded from XML, N3 and JSON files: its graph, completed by the passages and inferred from."""
    xml, n3, parallel = (_new(spark, x) for x in ("xml", "n3", "json"))
    own = ranged_parts(passages(spark, sf))
    P.write_markup(own, xml)
    write_triples(triples(spark, sf, "places", "classes"), n3, rules=True)
    X.write_parallel(own.filter("type = 'proof'").select(F.col("part_number").alias("part"), "id", F.concat(F.lit("la "), "id").alias("text")), parallel)
    library = load_library(spark, xml, [n3], parallel)
    told = library.explicit.select("s", "p").unionByName(library.inferred.select("s", "p")).groupBy("p").agg(F.count("*").alias("n"), F.countDistinct("s").alias("subjects"))
    latin = library.passages.filter("latin_text IS NOT NULL").agg(F.lit("latin texts").alias("p"), F.count("*").alias("n"), F.countDistinct("latin_text").alias("subjects"))
    return told.unionByName(latin)


def children_shown(spark: SparkSession, sf: str) -> DataFrame:
    return reader.children_shown(passages(spark, sf), "the").select("id", "parent_id")


def fixed_decimals(spark: SparkSession, sf: str) -> DataFrame:
    quantity = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("n"))
    return quantity.select("l_partkey", L.one_decimal(F.col("n") + F.lit(0.25)).alias("shown"))


def decimals_rounded(spark: SparkSession, sf: str) -> DataFrame:
    """Prices, many of which lie next to a tie, and sixteenths, many of which are ties."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("price"))
    return rows.select("l_orderkey", "l_linenumber", L.one_decimal(F.col("price")).alias("price"), L.one_decimal(F.lit(-1) * F.col("l_orderkey") / 16).alias("sixteenths"))


def humanised_headings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", L.heading_key(F.concat("p_type", F.lit(".:"))).alias("key"), L.humanised_heading(F.concat_ws("-", "p_type", "p_name")).alias("title"))


def public_paths(spark: SparkSession, sf: str) -> DataFrame:
    url = F.concat(F.lit("/"), F.regexp_replace("url", "^[a-z]+:/+", ""))
    return table(spark, sf, "pages").select("page_id", L.public_path("/reader/", url).alias("path"))


def aligned_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Passages aligned with a parallel text that has them all: each gets its own, and none is missing."""
    p = ranged_parts(passages(spark, sf)).withColumn("number", F.when(F.col("type") == "proposition", F.regexp_extract("id", r"(\d+)$", 1)))
    label = F.when(F.col("type") == "proposition", F.concat(F.lit("PROPOSITIO "), to_roman(F.col("number").cast("int")), F.lit(": "))).when(F.col("type") == "proof", "DEMONSTRATIO: ").otherwise(F.lit("SCHOLIUM: "))
    paras = p.filter(~F.coalesce("is_editorial", F.lit(False))).select("part_number", F.col("sort_index").cast("int").alias("pos"), F.concat(label, F.lit("lege "), L.squeeze(F.col("text"))).alias("paragraph"))
    found = alignment.align(p, paras)
    return alignment.complete(p, found).select("id", F.md5("text").alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        [n3_written, n3_abbreviated, n3_whole, iri_names, ordered_xml, explorer_outline, marked_appendix, explicit_graph, supplemental_graph, inferred_graph, parallel_json, latin1_pages, library_store]
        + [children_shown, fixed_decimals, decimals_rounded, humanised_headings, public_paths, aligned_in_order]
    )
}
