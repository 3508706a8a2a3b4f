"""From a book's plain text to passages: parts, sections, numbered items and what belongs to them.

Each level is a running count of the lines or paragraphs that begin something, so that the whole
is windows over (document, position) and aggregates; a document's lines stay in one partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import labels as L
from marginalia.functions import vocabulary as V
from marginalia.functions.roman import from_roman, lookup

# Headings of sections, and the section kinds they stand for.
HEADINGS = {
    "PREFACE": "preface",
    "DEFINITIONS": "definitions",
    "AXIOMS": "axioms",
    "AXIOM": "axioms",
    "PROPOSITIONS": "propositions",
    "POSTULATES": "postulates",
    "APPENDIX": "appendix",
    "DEFINITIONS OF THE EMOTIONS": "definitions_of_emotions",
    "GENERAL DEFINITION OF THE EMOTIONS": "general_definition",
}
# What begins a part, a proposition, an axiom or lemma among propositions, a numbered item.
PART = r"^PART\s+(I|II|III|IV|V)[.:](?:\s+(.*))?$"
PROPOSITION = r"^PROP\.\s+([IVXLCDM]+)\.\s*(.*)$"
PHYSICAL_AXIOM = r"^AXIOM\s+([IVXLCDM]+)\.\s*(.*)$"
LEMMA = r"^LEMMA\s+([IVXLCDM]+)\.\s*(.*)$"
NUMBERED = r"(?i)^([IVXLCDM]+)\.\s*(.*)$"
NUMBERED_DEFINITION = r"(?i)^(?:DEFINITION\s+)?([IVXLCDM]+)\.\s*(.*)$"
# What begins a passage inside another: pattern, group of the numeral (0: none), group of the text.
INNER = {
    "proof": (r"(?i)^(?:Proof|Another proof)\.(?:—|-)?\s*(.*)$", 0, 1),
    "corollary": (r"(?i)^Corollary(?:\s+([IVXLCDM]+))?\.(?:—|-)?\s*(.*)$", 1, 2),
    "note": (r"(?i)^(?:Note(?:\s+([IVXLCDM]+))?\.(?:—|-)?|N\.B\.)\s*(.*)$", 1, 2),
    "explanation": (r"(?i)^Explanation(?:\.(?:—|-)?|(?:—|-))\s*(.*)$", 0, 1),
}
# Id token and passage type of the items of a section.
ITEMS = {"definitions": ("def", "definition"), "definitions_of_emotions": ("affect", "definition"), "axioms": ("ax", "axiom"), "postulates": ("post", "postulate"), "appendix": ("appendix.chapter", "appendix"), "propositions": ("prop", "proposition"), "physical_axioms": ("phys_ax", "axiom"), "lemmas": ("lemma", "lemma")}


def running(flag: Column, window) -> Column:
    """How many rows up to this one have the flag."""
    return F.sum(flag.cast("int")).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def islands(rows: DataFrame, begins: Column, group: list[str], order: str, name: str) -> DataFrame:
    """Rows with a number that grows where a new run begins; rows before the first run have 0."""
    return rows.withColumn(name, running(F.coalesce(begins, F.lit(False)), Window.partitionBy(*group).orderBy(order)))


def _joined(column: str, order: str, between: str) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, column))), lambda x: x[column]), between)


def part_lines(texts: DataFrame, key: str = "path", text: str = "value", end: str | None = None) -> DataFrame:
    """(key, part, pos, line): lines of each part, after its heading and title.

    A part runs to the next heading of a part; the last one to the line that contains ``end``.
    """
    lines = texts.select(F.col(key).alias("key"), F.posexplode(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n")).alias("pos", "line")).withColumn("line", F.rtrim("line"))
    if end:
        lines = islands(lines, F.col("line").contains(end), ["key"], "pos", "_end").filter("_end = 0")
    lines = islands(lines, F.col("line").rlike(PART), ["key"], "pos", "part_no").filter("part_no > 0")
    own = ["key", "part_no"]
    heading = F.first(F.when(F.col("line").rlike(PART), F.col("line")), ignorenulls=True).over(Window.partitionBy(*own).orderBy("pos"))
    lines = lines.withColumn("_heading", heading).filter(~F.col("line").rlike(PART))
    lines = lines.withColumn("part", F.regexp_extract("_heading", PART, 1)).withColumn("_inline", F.trim(F.regexp_extract("_heading", PART, 2)))
    # the first line with text is the title, unless one stands in the heading or it begins something else
    order = Window.partitionBy(*own).orderBy("pos")
    lines = lines.withColumn("_text", F.trim("line")).withColumn("_nth", running(F.trim("line") != "", order))
    begins = _is_heading(F.col("line")) | F.col("line").rlike(PROPOSITION)
    lines = lines.withColumn("_title", (F.col("_nth") == 1) & (F.col("_text") != "") & (F.col("_inline") == "") & ~begins)
    named = F.coalesce(L.blank_to_null(F.col("_inline")), F.first(F.when(F.col("_title"), F.col("_text")), ignorenulls=True).over(order))
    # part II may say its title twice
    again = (F.col("part") == "II") & (F.col("_text") == named) & (F.col("_nth") == F.when(F.col("_inline") == "", 2).otherwise(1))
    lines = lines.withColumn("_again", F.coalesce(again, F.lit(False)))
    return lines.filter("NOT _title AND NOT _again").select("key", "part", "pos", "line")


def _is_heading(line: Column) -> Column:
    return L.heading_key(line).isin(*HEADINGS)


def section_paragraphs(lines: DataFrame) -> DataFrame:
    """(key, part, section_no, section_kind, pos, paragraph): lines joined to paragraphs, within sections.

    A heading begins a section; so does a proposition outside propositions.  Part II begins with its
    preface, with or without a heading; in part III all before the definitions is preface.
    """
    own = ["key", "part"]
    order = Window.partitionBy(*own).orderBy("pos")
    line, kind = F.trim("line"), lookup(HEADINGS, L.heading_key(F.col("line")))
    rows = lines.withColumn("_kind", kind)
    before_definitions = running(F.coalesce(F.col("_kind") == "definitions", F.lit(False)), order) == 0
    rows = rows.withColumn("_kind", F.when((F.col("part") == "III") & before_definitions, F.lit(None)).otherwise(F.col("_kind")))
    rows = islands(rows, F.col("_kind").isNotNull(), own, "pos", "_heads")
    under = Window.partitionBy(*own, "_heads").orderBy("pos")
    rows = rows.withColumn("_head_kind", F.first("_kind").over(under)).withColumn("_prop", line.rlike(PROPOSITION))
    implicit = F.col("_prop") & (running(F.col("_prop"), under) == 1) & ~F.col("_head_kind").eqNullSafe("propositions") & ~((F.col("part") == "III") & (F.col("_heads") == 0))
    rows = rows.withColumn("_implicit", implicit)
    rows = islands(rows, F.col("_kind").isNotNull() | F.col("_implicit"), own, "pos", "section_no")
    starts = Window.partitionBy(*own, "section_no").orderBy("pos")
    section = F.first(F.when(F.col("_implicit"), F.lit("propositions")).otherwise(F.col("_kind"))).over(starts)
    opening = F.when((F.col("section_no") == 0) & F.col("part").isin("II", "III"), F.lit("preface"))
    rows = rows.withColumn("section_kind", F.coalesce(section, opening)).filter("section_kind IS NOT NULL AND _kind IS NULL")
    within = ["key", "part", "section_no"]
    blank = F.trim("line") == ""
    rows = islands(rows, blank, within, "pos", "_para").filter(~blank)
    found = rows.groupBy(*within, "section_kind", "_para").agg(_joined("line", "pos", " ").alias("paragraph"), F.min("pos").alias("pos"))
    return found.select(*within, "section_kind", "pos", L.squeeze(F.col("paragraph")).alias("paragraph"))


def items(paragraphs: DataFrame) -> DataFrame:
    """(key, part, section_kind, item_no, pos, kind, numeral, paragraph): paragraphs of numbered items.

    ``kind`` is the section kind that the item belongs to: axioms and lemmas among propositions have
    sections of their own.  An axiom among propositions is one paragraph; one within lemmas is part
    of the lemma before.  ``paragraph`` is without the mark that begins the item.
    """
    own = ["key", "part", "section_no"]
    order = Window.partitionBy(*own).orderBy("pos")
    p, section = F.col("paragraph"), F.col("section_kind")
    among = section == "propositions"
    rows = paragraphs.filter(section.isin(*ITEMS))
    strong = F.when(among & p.rlike(PROPOSITION), "propositions").when(among & p.rlike(LEMMA), "lemmas")
    rows = rows.withColumn("_strong", strong)
    last = F.last("_strong", ignorenulls=True).over(order)
    rows = rows.withColumn("_mark", F.when(F.col("_strong").isNotNull(), F.col("_strong")).when(among & p.rlike(PHYSICAL_AXIOM) & ~last.eqNullSafe("lemmas"), "physical_axioms").when(among & p.rlike("(?i)^POSTULATES?$") & ~last.eqNullSafe("lemmas"), "none"))
    pattern = {"propositions": PROPOSITION, "lemmas": LEMMA, "physical_axioms": PHYSICAL_AXIOM}
    number = {k: F.regexp_extract(p, x, 1) for k, x in pattern.items()}
    rest = {k: F.regexp_extract(p, x, 2) for k, x in pattern.items()}
    defs = section.isin("definitions", "definitions_of_emotions")
    begins = F.when(among, F.col("_mark").isNotNull()).when(defs, p.rlike(NUMBERED_DEFINITION)).otherwise(p.rlike(NUMBERED))

    def pick(of: dict, group: int) -> Column:
        out = F.when(defs, F.regexp_extract(p, NUMBERED_DEFINITION, group)).when(~among, F.regexp_extract(p, NUMBERED, group))
        for k, x in of.items():
            out = out.when(F.col("_mark") == k, x)
        return out

    rows = rows.withColumn("_begins", begins).withColumn("_numeral", F.when(begins, pick(number, 1))).withColumn("_rest", F.when(begins, F.trim(pick(rest, 2))))
    rows = islands(rows, F.col("_begins"), own, "pos", "item_no")
    item = Window.partitionBy(*own, "item_no").orderBy("pos")
    rows = rows.withColumn("kind", F.when(among, F.first("_mark").over(item)).otherwise(section)).withColumn("numeral", F.first("_numeral").over(item))
    keep = ~among | (F.col("item_no") > 0) & (F.col("kind") != "none") & ((F.col("kind") != "physical_axioms") | F.col("_begins"))
    return rows.filter(keep).select(*own, "section_kind", "item_no", "pos", "kind", "numeral", F.coalesce("_rest", F.trim("paragraph")).alias("paragraph"))


def _inner(rows: DataFrame) -> DataFrame:
    """Paragraphs of items, numbered by the passage inside the item that they belong to (0: the item itself)."""
    p = F.col("paragraph")
    allowed = F.col("kind").isin("definitions", "definitions_of_emotions")
    childless = F.col("kind").isin("appendix", "physical_axioms")
    mark = F.when(childless, F.lit(None))
    for name, (pattern, _, _) in INNER.items():
        mark = mark.when(p.rlike(pattern) & (allowed if name == "explanation" else F.lit(True)), F.lit(name))
    rows = rows.withColumn("_inner", mark)
    own = ["key", "part", "section_no", "item_no"]
    rows = islands(rows, F.col("_inner").isNotNull(), own, "pos", "inner_no")
    numeral, text = F.lit(""), p
    for name, (pattern, n, t) in INNER.items():
        text = F.when(F.col("_inner") == name, F.regexp_extract(p, pattern, t)).otherwise(text)
        if n:
            numeral = F.when(F.col("_inner") == name, F.regexp_extract(p, pattern, n)).otherwise(numeral)
    # the second of a kind, and later ones, are told apart by their count unless they have a numeral
    nth = F.row_number().over(Window.partitionBy(*own, "_inner").orderBy("pos"))
    suffix = F.when(numeral != "", from_roman(numeral)).when(nth > 1, nth)
    token = F.when(F.col("_inner").isNotNull(), F.concat("_inner", F.coalesce(suffix.cast("string"), F.lit(""))))
    return rows.withColumn("paragraph", F.trim(text)).withColumn("token", token)


def passages_of_texts(texts: DataFrame, key: str = "path", text: str = "value", end: str | None = None, editorial: tuple[str, ...] = ()) -> DataFrame:
    """(key, part, id, type, section_kind, number, parent_id, heading, is_editorial, text, pos) of books' plain texts.

    ``editorial``: ids that the edition has added.  ``pos`` is the place in the book.
    """
    paragraphs = section_paragraphs(part_lines(texts, key, text, end))
    own = ["key", "part", "section_no"]
    whole = paragraphs.filter(F.col("section_kind").isin("preface", "general_definition")).groupBy(*own, "section_kind").agg(_joined("paragraph", "pos", "\n\n").alias("text"), F.min("pos").alias("pos"))
    general = F.col("section_kind") == "general_definition"
    whole = whole.select(
        "key",
        "part",
        F.when(general, F.concat("part", F.lit(".general_definition.note"))).otherwise(F.concat("part", F.lit(".preface"))).alias("id"),
        F.when(general, "note").otherwise(F.lit("preface")).alias("type"),
        "section_kind",
        F.lit(None).cast("string").alias("number"),
        F.lit(None).cast("string").alias("parent_id"),
        F.when(general, F.lit(None)).otherwise(F.lit("Preface")).alias("heading"),
        "text",
        "pos",
    )
    rows = _inner(items(paragraphs))
    inner = [*own, "section_kind", "kind", "item_no", "inner_no"]
    found = rows.groupBy(*inner).agg(F.trim(_joined("paragraph", "pos", "\n\n")).alias("text"), F.min("pos").alias("pos"), F.first("numeral", ignorenulls=True).alias("numeral"), F.max("token").alias("token"))
    # unnumbered items count from the section's first item
    place = F.dense_rank().over(Window.partitionBy(*own, "kind").orderBy("item_no"))
    found = found.withColumn("number", F.coalesce(from_roman(L.blank_to_null(F.col("numeral"))), place).cast("string"))
    ids = {k: t for k, (t, _) in ITEMS.items()}
    types = {k: t for k, (_, t) in ITEMS.items()}
    intro = (F.col("kind") == "appendix") & F.col("numeral").isNull()
    item = F.when(intro, F.concat("part", F.lit(".appendix.introduction"))).otherwise(F.concat_ws(".", "part", lookup(ids, F.col("kind")), "number"))
    child = F.col("token").isNotNull()
    listed = found.select(
        "key",
        "part",
        F.when(child, F.concat_ws(".", item, "token")).otherwise(item).alias("id"),
        F.when(child, F.regexp_extract("token", "^[a-z]+", 0)).otherwise(lookup(types, F.col("kind"))).alias("type"),
        F.col("kind").alias("section_kind"),
        F.when(~child & (F.col("kind") != "appendix"), F.col("number")).alias("number"),
        F.when(child, item).alias("parent_id"),
        F.when(intro, F.lit("Appendix Introduction")).when(F.col("kind") == "appendix", F.concat(F.lit("Caput "), F.upper("numeral"))).alias("heading"),
        "text",
        "pos",
    )
    out = whole.unionByName(listed)
    return out.withColumn("is_editorial", F.col("id").isin(*editorial) if editorial else F.lit(False))


def as_passages(found: DataFrame) -> DataFrame:
    """The passage model of what passages_of_texts() finds; blank texts and repeated ids (but the last) go."""
    rows = found.filter("text <> ''")
    last = Window.partitionBy("key", "id").orderBy(F.desc("pos"))
    rows = rows.withColumn("_last", F.row_number().over(last)).filter("_last = 1")
    order = Window.partitionBy("key", "part").orderBy("pos", F.col("parent_id").isNotNull(), "id")
    numbers = {numeral: n for n, numeral in V.PART_NUMERALS.items()}
    made_up = F.col("heading") == "Appendix Introduction"
    return rows.select(
        "id",
        "type",
        "text",
        F.lit(None).cast("string").alias("latin_text"),
        F.row_number().over(order).alias("sort_index"),
        "section_kind",
        "number",
        "parent_id",
        "heading",
        lookup(numbers, F.col("part")).alias("part_number"),
        F.col("part").alias("part_numeral"),
        L.passage_label(F.col("id"), F.col("type"), F.col("number"), F.col("heading")).alias("canonical_label"),
        "is_editorial",
        F.when(made_up, F.lit("synthetic_heading")).otherwise(L.editorial_kind(F.col("is_editorial"))).alias("editorial_kind"),
        L.source_authority(F.col("is_editorial")).alias("source_authority"),
        L.variant_of(F.col("id"), F.col("type")).alias("variant_label"),
    )
