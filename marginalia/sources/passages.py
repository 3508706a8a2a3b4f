"""Passages in XML markup: one row a passage, in reading order, and the markup made from such rows.

The document order of different elements matters, which Spark's XML source does not keep; so a
small function walks each document and gives flat rows, and everything else is Columns.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import labels as L
from marginalia.functions import vocabulary as V
from marginalia.functions.roman import from_roman, lookup

_FLAT = "path string, pos int, part string, id string, type string, tag string, section_kind string, number string, parent_id string, topic string, editorial boolean, segments array<array<string>>"
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<array<string>>": pa.list_(pa.list_(pa.string()))}
#: Stands between documents in a file: a character that no XML document can hold.
_BETWEEN = "\x1e"
_TEXTS = ("text", "continuation", "item")


def _texts(node: ET.Element) -> list[str]:
    return [t for t in (x.strip() for x in node.itertext()) if t]


def _body(node: ET.Element) -> list[list[str]]:
    """Segments of a passage's own text, each with its pieces of text; items of a list begin with their number."""
    out = []
    for child in node:
        if child.tag in _TEXTS:
            out.append(_texts(child))
        elif child.tag == "enumeration":
            for item in child.findall("item"):
                number, texts = item.get("number"), _texts(item)
                out.append([f"{number}. {texts[0] if texts else ''}", *texts[1:]] if number else texts)
    return out


def _walk(document: str) -> Iterator[dict]:
    """Flat rows of a document for readers: sections of <part>, their passages and one level of passages inside these."""
    root = ET.fromstring(document.strip().encode())
    if root.tag != "part":
        return
    part, arguments = root.get("id", "I"), 0

    def row(node: ET.Element, kind: str, segments: list[list[str]], **more: object) -> dict:
        return {"part": part, "id": node.get("id"), "type": kind, "tag": node.tag, "editorial": node.get("editorial") == "true", "segments": segments} | more

    def section(node: ET.Element) -> Iterator[dict]:
        nonlocal arguments
        kind = node.get("type", "section")
        id_ = node.get("id", f"{part}.{kind}")
        if kind == "preface":
            yield row(node, "preface", [[t] for t in _texts(node)], id=id_, section_kind=kind, editorial=False)
            return
        for child in node:
            if kind == "appendix":
                if child.tag == "introduction":
                    yield row(child, "appendix", [[t] for t in _texts(child)], id=f"{id_}.introduction", section_kind=kind, editorial=False)
                elif child.tag == "section":
                    arguments += 1
                    yield row(child, "appendix", [[t] for t in _texts(child)], id=child.get("id", f"{id_}.argument.{arguments}"), section_kind=kind, topic=child.get("topic"), editorial=False)
            elif child.tag == "section":
                yield from section(child)
            elif child.tag == "note":
                yield row(child, "note", _body(child), section_kind=kind)
            elif child.tag in V.TAG_TYPES:
                yield row(child, V.TAG_TYPES[child.tag], _body(child), section_kind=kind, number=child.get("number"))
                for inner in child if child.get("id") else ():
                    if inner.tag in V.CHILD_TAGS:
                        yield row(inner, V.CHILD_TAGS[inner.tag], _body(inner), section_kind=kind, parent_id=child.get("id"), number=inner.get("number") if V.CHILD_TAGS[inner.tag] == "note" else None)

    for node in root.findall("section"):
        yield from section(node)


_ENTRY_TAGS = (*V.TAG_TYPES, "proof", "corollary", "note", "explanation", "introduction")


def _walk_entries(document: str) -> Iterator[dict]:
    """Flat rows of a document for the graph builder: every marked passage with the text of all that is inside it.

    An id may come twice; the first counts.
    """
    root = ET.fromstring(document.strip().encode())
    if root.tag != "part":
        return
    met = {None, ""}

    def rows(node: ET.Element, kind: str, parent: str | None, number: str | None) -> Iterator[dict]:
        if node.get("id") in met:
            return
        met.add(node.get("id"))
        yield {"part": root.get("number") or root.get("id"), "id": node.get("id"), "tag": node.tag, "section_kind": kind, "parent_id": parent, "number": number, "segments": [_texts(node)], "editorial": node.get("editorial") == "true"}

    def walk(node: ET.Element, kind: str) -> Iterator[dict]:
        for child in node:
            if child.tag == "section":
                yield from walk(child, child.get("type", kind))
            elif child.tag in _ENTRY_TAGS:
                yield from rows(child, kind, None, child.get("number"))
                for inner in child:
                    if inner.tag in ("proof", "corollary", "note", "explanation"):
                        yield from rows(inner, kind, child.get("id"), None)
                yield from walk(child, kind)

    yield from walk(root, "")


def _flat(documents: DataFrame, walk) -> DataFrame:
    schema = pa.schema([(n, _ARROW[t]) for n, t in (f.split() for f in _FLAT.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch["path"], batch["value"], strict=True):
                path, rows = path.as_py(), list(walk(text.as_py()))
                columns = {n: [r.get(n) for r in rows] for n in schema.names} | {"path": [path] * len(rows), "pos": range(len(rows))}
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    return documents.mapInArrow(run, _FLAT)


def xml_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, value): whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def passages_of(documents: DataFrame) -> DataFrame:
    """Passages of (path, value) documents; see read_passages."""
    flat = _flat(documents, _walk)
    squeezed = F.transform("segments", L.join_paragraphs)
    text = F.when(F.col("type").isin("preface", "appendix"), F.array_join(F.filter(squeezed, lambda x: x != ""), "\n\n")).otherwise(L.join_paragraphs(squeezed))
    rows = flat.withColumn("text", text).filter((F.coalesce("id", F.lit("")) != "") & (F.col("text") != ""))
    # ids that come again: the later row counts, with its later place
    last = Window.partitionBy("path", "id").orderBy(F.desc("pos"))
    order = Window.partitionBy("path").orderBy("pos")
    rows = rows.withColumn("sort_index", F.row_number().over(order)).withColumn("_last", F.row_number().over(last)).filter("_last = 1")
    made_up = (F.col("type") == "appendix") & ((F.col("tag") == "introduction") | (F.coalesce("topic", F.lit("")) == ""))
    heading = F.when(F.col("type") == "preface", F.lit("Preface")).when(F.col("tag") == "introduction", F.lit("Appendix Introduction")).when(F.col("type") == "appendix", L.topic_label(F.col("topic")))
    rows = rows.withColumn("heading", heading)
    numbers = {numeral: n for n, numeral in V.PART_NUMERALS.items()}
    return rows.select(
        "id",
        "type",
        "text",
        F.lit(None).cast("string").alias("latin_text"),
        "sort_index",
        "section_kind",
        "number",
        "parent_id",
        "heading",
        F.coalesce(lookup(numbers, F.col("part")), F.when(F.col("part") == F.upper("part"), from_roman(F.col("part")))).alias("part_number"),
        F.col("part").alias("part_numeral"),
        L.passage_label(F.col("id"), F.col("type"), F.col("number"), F.col("heading")).alias("canonical_label"),
        F.col("editorial").alias("is_editorial"),
        F.when(made_up, F.lit("synthetic_heading")).otherwise(L.editorial_kind(F.col("editorial"))).alias("editorial_kind"),
        L.source_authority(F.col("editorial")).alias("source_authority"),
        L.variant_of(F.col("id"), F.col("type")).alias("variant_label"),
    )


def read_passages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Passages of XML files, one part a file, with all derived columns.

    Rows without an id or with blank text are left out and take no place in the order; of rows of one
    id in a file the last stays.  Files without a <part> give nothing.
    """
    return passages_of(xml_documents(spark, path))


def entries_of(documents: DataFrame) -> DataFrame:
    """(id, tag, part_number, number, section_kind, parent_id, text, editorial): what the graph builder reads.

    Of rows of one id the first counts.  Prefaces and appendix chapters have no entries.
    """
    flat = _flat(documents, _walk_entries).filter(F.coalesce("id", F.lit("")) != "")
    first = Window.partitionBy("id").orderBy("path", "pos")
    rows = flat.withColumn("_first", F.row_number().over(first)).filter("_first = 1")
    part = F.coalesce(F.col("part").try_cast("int"), L.part_of_id(F.col("part")))
    text = L.squeeze(F.array_join(F.flatten("segments"), " "))
    return rows.select("id", "tag", part.alias("part_number"), "number", "section_kind", "parent_id", text.alias("text"), "editorial")


def outline(passages: DataFrame) -> DataFrame:
    """Definitions, axioms, propositions and what is inside propositions: the short view of an explorer."""
    inside = F.col("parent_id").isNotNull() & F.col("type").isin("proof", "corollary", "note") & F.col("parent_id").contains(".prop.")
    return passages.filter(F.col("type").isin("definition", "axiom", "proposition") | inside).select("id", "type", "text", "parent_id", "part_number")


def markup(passages: DataFrame, title: str | None = None) -> DataFrame:
    """(part_number, xml): the documents that passages_of reads back to the same rows.

    A run of passages of one section kind becomes a section.  Passages inside one that has no text of
    its own, and so no row, get an empty one around them.
    """

    def element(tag, id_, attributes, body, indent):
        pad = " " * indent
        return F.concat(F.lit(pad + "<"), tag, F.lit(' id="'), L.escaped(id_), F.lit('"'), attributes, F.lit(">\n"), body, F.lit("\n" + pad + "</"), tag, F.lit(">"))

    def attribute(name, value):
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f' {name}="'), L.escaped(value), F.lit('"'))).otherwise(F.lit(""))

    def text_lines(indent):
        return F.concat(F.lit(" " * indent + "<text>"), L.escaped(F.col("text")), F.lit("</text>"))

    editorial = F.when(F.col("is_editorial"), F.lit(' editorial="true"')).otherwise(F.lit(""))
    number = attribute("number", F.col("number"))
    tops = passages.filter("parent_id IS NULL")
    orphans = passages.filter("parent_id IS NOT NULL").join(tops.select(F.col("id").alias("parent_id")), "parent_id", "left_anti")
    kinds = {"def": "definition", "affect": "definition", "ax": "axiom", "phys_ax": "axiom", "lemma": "lemma", "post": "postulate"}
    empty = orphans.groupBy("parent_id").agg(*[F.min_by(c, "sort_index").alias(c) for c in ("section_kind", "part_number", "part_numeral")], F.min("sort_index").alias("sort_index"))
    kind = F.coalesce(lookup(kinds, F.get(F.split("parent_id", r"\."), F.lit(1))), F.lit("proposition"))
    empty = empty.select(F.col("parent_id").alias("id"), kind.alias("type"), F.lit("").alias("text"), "sort_index", "section_kind", "part_number", "part_numeral", F.lit(False).alias("is_editorial"))
    inner = passages.filter("parent_id IS NOT NULL").withColumn("xml", element(F.col("type"), F.col("id"), F.concat(number, editorial), text_lines(8), 6))
    inner = inner.groupBy(F.col("parent_id").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sort_index", "xml"))), lambda x: x["xml"]), "\n").alias("inside"))
    own = {t: tag for tag, t in V.TAG_TYPES.items()} | {"note": "note"}
    top = tops.unionByName(empty, allowMissingColumns=True).join(inner, "id", "left")
    intro = F.col("id").endswith(".introduction")
    caput = F.regexp_extract("heading", "^Caput ([IVXLCDM]+)$", 1)
    topic = F.when(caput != "", caput).when(F.col("heading") != "Appendix Section", F.col("heading"))
    body = F.concat(text_lines(6), F.when(F.col("inside").isNotNull(), F.concat(F.lit("\n"), "inside")).otherwise(F.lit("")))
    xml = (
        F.when(F.col("type") == "preface", text_lines(4))
        .when((F.col("type") == "appendix") & intro, element(F.lit("introduction"), F.col("id"), F.lit(""), text_lines(6), 4))
        .when(F.col("type") == "appendix", element(F.lit("section"), F.col("id"), F.concat(F.lit(' type="chapter"'), attribute("topic", topic)), text_lines(6), 4))
        .otherwise(element(lookup(own, F.col("type")), F.col("id"), F.concat(number, editorial), body, 4))
    )
    order = Window.partitionBy("part_number").orderBy("sort_index")
    fresh = ~F.coalesce(F.lag("section_kind").over(order).eqNullSafe(F.col("section_kind")), F.lit(False))
    top = top.withColumn("xml", xml).withColumn("_new", fresh.cast("int")).withColumn("_run", F.sum("_new").over(order))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sort_index", "xml"))), lambda x: x["xml"]), "\n")
    sections = top.groupBy("part_number", "part_numeral", "_run", "section_kind").agg(joined.alias("xml"), F.min_by("id", "sort_index").alias("_id"))
    id_ = F.when(F.col("section_kind") == "preface", F.col("_id")).otherwise(F.concat_ws(".", "part_numeral", "section_kind"))
    section = F.concat(F.lit('  <section type="'), "section_kind", F.lit('" id="'), L.escaped(id_), F.lit('">\n'), "xml", F.lit("\n  </section>"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_run", section.alias("xml")))), lambda x: x["xml"]), "\n")
    named = F.lit(title) if title is not None else F.coalesce(lookup(V.PART_TITLES, F.col("part_number")), F.lit(""))
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<part id="'), "part_numeral", F.lit('" number="'), F.col("part_number").cast("string"), F.lit('" title="'), L.escaped(named), F.lit('">\n'))
    return sections.groupBy("part_number", "part_numeral").agg(whole.alias("body")).select("part_number", F.concat(head, "body", F.lit("\n</part>\n")).alias("xml"))


def write_markup(passages: DataFrame, path: str) -> None:
    """One text file a part, in folders part_number=<n>."""
    markup(passages).write.partitionBy("part_number").option("lineSep", "\n").text(path)


def write_bundles(passages: DataFrame, path: str) -> None:
    """The documents of many parts in each text file, for books of very many parts: a folder and a file take longer than a small part's text."""
    markup(passages).select("xml").write.option("lineSep", _BETWEEN).text(path)


def bundled_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, value): the documents in files of ``write_bundles``; a document's path is its file's and the digest of its text."""
    found = spark.read.option("lineSep", _BETWEEN).text(path)
    return found.select(F.concat("_metadata.file_path", F.lit("#"), F.md5("value")).alias("path"), "value")
