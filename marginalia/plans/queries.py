"""One query for each operator, over the star-schema tables; plans/oracle.py has the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import html as H
from marginalia.functions import labels as L
from marginalia.functions.citations import references
from marginalia.functions.roman import from_roman, to_roman
from marginalia.operators import alignment, analysis, corpus, cycles, graph, reader
from marginalia.operators import triples as T
from marginalia.operators.corpus import islands
from marginalia.operators.lineage import shared_folder
from marginalia.sources.passages import markup
from marginalia.sources.texts import read_raw_text
from marginalia.sources.triples import classes_of, statement_text

from .tables import PART_CONVERSATIONS, citing_texts, passages, ranged_parts, table, triples

WORD = "the"


def top_cited(spark: SparkSession, sf: str) -> DataFrame:
    return T.top_cited(triples(spark, sf, "orders", "places")).select(F.col("rank").cast("long").alias("rank"), "id", "n")


def outward_citations(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "customer").select(F.concat(F.lit("C."), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("text"))
    return T.with_preview(T.cited_by(triples(spark, sf, "orders", "places")), texts, 12)


def inward_citations(spark: SparkSession, sf: str) -> DataFrame:
    counted = T.citing(triples(spark, sf, "orders", "places")).groupBy("id").agg(F.count("*").alias("n"), F.min("other").alias("first"))
    return counted


def consequences(spark: SparkSession, sf: str) -> DataFrame:
    return T.consequences(triples(spark, sf, "events"))


def reductio_subjects(spark: SparkSession, sf: str) -> DataFrame:
    return T.refuted_by_absurdity(triples(spark, sf, "events")).orderBy("id")


def elements_of_class(spark: SparkSession, sf: str) -> DataFrame:
    return T.of_class(triples(spark, sf, "classes"), "Axiom", "Definition").orderBy("id")


def graph_counts(spark: SparkSession, sf: str) -> DataFrame:
    return T.graph_counts(triples(spark, sf, "classes", "supply", "brands"))


def several_proofs(spark: SparkSession, sf: str) -> DataFrame:
    proofs = T.match(triples(spark, sf, "supply")).select(F.concat("s", F.lit("/"), "o").alias("s"), F.lit("type").alias("p"), F.lit("Proof").alias("o"), "o_kind")
    return T.several_proofs(proofs, r"^(P\.\d+)")


def relation_counts(spark: SparkSession, sf: str) -> DataFrame:
    return T.relation_counts(triples(spark, sf, "events", "supply", "orders"))


def merge_stores(spark: SparkSession, sf: str) -> DataFrame:
    merged = T.merge(triples(spark, sf, "places", "parents"), triples(spark, sf, "parents", "brands"))
    return merged.groupBy("p", "o_kind").agg(F.count("*").alias("n"))


def backfill(spark: SparkSession, sf: str) -> DataFrame:
    return T.backfill(triples(spark, sf, "places", "classes"), triples(spark, sf, "parents", "classes", "brands"))


def project_invert(spark: SparkSession, sf: str) -> DataFrame:
    t = triples(spark, sf, "places", "brands", "classes", "supply")
    return T.merge(T.rename_relation(t, "provedBy", "dependsUpon"), T.invert_relation(t, "hasCorollary", "derivedFrom"), T.invert_relation(t, "number", "numbers"))


def _places(spark: SparkSession, sf: str) -> DataFrame:
    return graph.edges_of(triples(spark, sf, "places"), "cites")


def transitive_closure(spark: SparkSession, sf: str) -> DataFrame:
    return graph.closure(_places(spark, sf))


def rules_two_hops(spark: SparkSession, sf: str) -> DataFrame:
    return graph.two_hops(_places(spark, sf))


def apply_rules(spark: SparkSession, sf: str) -> DataFrame:
    return graph.apply_rules(triples(spark, sf, "places", "brands")).groupBy("p").agg(F.count("*").alias("n"), F.countDistinct("s").alias("subjects"))


def influence(spark: SparkSession, sf: str) -> DataFrame:
    return graph.influence(_places(spark, sf)).select("id", F.col("influence").cast("long").alias("influence"))


def dependency_depth(spark: SparkSession, sf: str) -> DataFrame:
    return graph.dependency_depth(_places(spark, sf)).select("id", F.col("depth").cast("long").alias("depth"))


def element_weights(spark: SparkSession, sf: str) -> DataFrame:
    explicit = triples(spark, sf, "places", "supply")
    found = analysis.weights(explicit, classes_of(triples(spark, sf, "classes")))
    return found.select("element_id", "inbound_weight", "outbound_weight", "transitive_influence", F.round("foundational_score", 6).alias("foundational_score"), F.col("dependency_depth").cast("long").alias("dependency_depth"), F.col("influence_reach").cast("long").alias("influence_reach"))


def _inferred(spark: SparkSession, sf: str) -> DataFrame:
    return T.merge(T.rename_relation(triples(spark, sf, "places"), "cites", "dependsUpon"), T.invert_relation(triples(spark, sf, "brands"), "hasCorollary", "derivedFrom"))


def relations_all(spark: SparkSession, sf: str) -> DataFrame:
    found = analysis.relations(triples(spark, sf, "places", "parents", "classes"), _inferred(spark, sf))
    return found.select("element_id", "subject", "predicate", "object", "inferred")


def relation_groups(spark: SparkSession, sf: str) -> DataFrame:
    found = analysis.relations(triples(spark, sf, "places", "parents"), _inferred(spark, sf))
    grouped = analysis.grouped_relations(found)
    return grouped.select("element_id", "predicate", "label", F.col("rank").cast("long").alias("rank"), F.size("relations").cast("long").alias("n"))


def chains_first(spark: SparkSession, sf: str) -> DataFrame:
    inferred = _inferred(spark, sf)
    far = graph.two_hops(_places(spark, sf)).select(F.col("src").alias("s"), F.lit("transitivelyDependsOn").alias("p"), F.col("dst").alias("o"), F.lit("iri").alias("o_kind"))
    found = analysis.chains(T.merge(inferred, far), limit=12)
    return found.select("element_id", "type", "start", "end", "relationship", F.col("length").cast("long").alias("length"), F.col("path")[0]["to"].alias("path_to"))


def trace_levels(spark: SparkSession, sf: str) -> DataFrame:
    t = triples(spark, sf, "places", "parents")
    return graph.trace(t, 3).select("origin", "node", F.col("d").cast("long").alias("d"))


def trace_depth_first(spark: SparkSession, sf: str) -> DataFrame:
    t = triples(spark, sf, "places")
    found = graph.trace_depth_first(t, t.select(F.col("s").alias("id")).distinct(), 2)
    return found.select("origin", F.col("place").cast("long").alias("place"), "node", F.col("depth").cast("long").alias("depth"))


def trace_fallback(spark: SparkSession, sf: str) -> DataFrame:
    t = triples(spark, sf, "places", "parents")
    found = graph.trace_depth_first(t, t.select(F.explode(F.array("s", "o")).alias("id")), 3)
    return found.select("origin", F.col("place").cast("long").alias("place"), "node", F.col("depth").cast("long").alias("depth"))


def cyclic_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return cycles.on_cycles(_places(spark, sf))


def roman_numerals(spark: SparkSession, sf: str) -> DataFrame:
    n = (F.col("o_orderkey") % 3999 + 1).cast("int")
    rows = table(spark, sf, "orders").select("o_orderkey", to_roman(n).alias("roman"))
    return rows.select("o_orderkey", "roman", from_roman(F.lower("roman")).cast("long").alias("value"))


def relation_labels(spark: SparkSession, sf: str) -> DataFrame:
    e = triples(spark, sf, "events", "places", "parents", "supply", "brands").select("p").distinct()
    both = e.select("p", F.explode(F.array(F.col("p"), L.inverse_name(F.col("p")), F.concat(F.lit("inverse_"), "p"))).alias("name"))
    return both.select("p", "name", L.relation_label(F.col("name")).alias("label"), L.relation_phrase(F.col("name")).alias("phrase"), L.relation_rank(F.col("name")).cast("long").alias("rank"))


def passage_labels(spark: SparkSession, sf: str) -> DataFrame:
    p = passages(spark, sf)
    chips = L.chips(F.col("variant_label"), F.col("is_editorial"), F.col("editorial_kind"), F.col("source_authority"))
    return p.select("id", "canonical_label", "variant_label", L.variant_label(F.col("variant_label")).alias("spoken"), L.section_label(F.col("section_kind")).alias("section"), L.part_of_id(F.col("id")).cast("long").alias("part"), L.reference_text(F.col("id"), F.col("part_number")).alias("reference"), F.array_join(F.transform(chips, lambda c: F.concat_ws("/", c["label"], c["tone"])), ";").alias("chips"))


def humanised_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", L.humanised(F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("-")), F.lower("p_type"))).alias("name"))


def previews(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", L.truncated(t, 140).alias("short"), L.truncated(t, 220).alias("card"), L.truncated(t, 200, "...").alias("hint"))


def search_visible(spark: SparkSession, sf: str) -> DataFrame:
    return reader.visible(passages(spark, sf), WORD).select("id", "sort_index")


def search_selectable(spark: SparkSession, sf: str) -> DataFrame:
    return reader.selectable(passages(spark, sf), WORD).select("id", "sort_index")


def search_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return reader.neighbours(reader.selectable(ranged_parts(passages(spark, sf)), WORD)).select("id", "previous_id", "next_id")


def section_summary(spark: SparkSession, sf: str) -> DataFrame:
    return reader.section_summary(passages(spark, sf))


def section_starts(spark: SparkSession, sf: str) -> DataFrame:
    return reader.section_starts(ranged_parts(passages(spark, sf))).select("id", "shows_heading")


def children_by_parent(spark: SparkSession, sf: str) -> DataFrame:
    found = reader.children_by_parent(passages(spark, sf))
    return found.select("parent_id", F.array_join(F.transform("children", lambda c: c["id"]), ",").alias("ids"), F.size("children").cast("long").alias("n"))


def parallel_texts(spark: SparkSession, sf: str) -> DataFrame:
    docs, marks = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("text"), F.lit(None).cast("string").alias("latin_text"))
    other = marks.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("  "), F.repeat(F.lit("q"), F.col("quality")), F.lit("\n")).alias("latin_text"))
    merged = reader.merge_parallel(rows, other)
    shown = [L.shown_text(m, F.col("text"), F.col("latin_text"), "(none)").alias(m) for m in ("english", "latin", "both")]
    return merged.select("id", "latin_text", *shown)


def citations_found(spark: SparkSession, sf: str) -> DataFrame:
    found = citing_texts(spark, sf).select("id", "text", F.posexplode(references(F.col("text"), F.col("id"))).alias("pos", "reference"))
    return found.groupBy("reference").agg(F.count("*").alias("n"), F.countDistinct("id").alias("passages"), F.max("pos").cast("long").alias("last"))


def citations_known(spark: SparkSession, sf: str) -> DataFrame:
    found = T.known_citations(citing_texts(spark, sf), build=True)
    return found.groupBy(F.col("o").alias("id")).agg(F.countDistinct("s").alias("n"))


def page_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", F.posexplode(H.page_paragraphs(F.col("html"))).alias("pos", "paragraph"))
    return pages.select("page_id", F.col("pos").cast("long").alias("pos"), F.md5("paragraph").alias("digest"))


def url_components(spark: SparkSession, sf: str) -> DataFrame:
    coded = table(spark, sf, "pages").select("page_id", "url", L.url_component(F.concat("url", F.lit(" (a+b)*"))).alias("coded"))
    return coded.select("page_id", "coded", L.from_url_component(F.col("coded")).alias("back"))


def text_blocks(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    blocks = islands(lines, F.col("line").rlike("^[A-D]"), ["doc_id"], "pos", "block")
    return blocks.groupBy("doc_id", "block").agg(F.count("*").alias("n"), F.min("pos").cast("long").alias("first"), F.sum(F.length("line")).cast("long").alias("chars"))


def child_counters(spark: SparkSession, sf: str) -> DataFrame:
    inner = passages(spark, sf).filter("parent_id IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy("parent_id", "type").orderBy("sort_index"))
    return inner.select("id", F.concat("parent_id", F.lit("."), "type", F.when(nth > 1, nth.cast("string")).otherwise("")).alias("numbered_id"))


def first_of_text(spark: SparkSession, sf: str) -> DataFrame:
    first = Window.partitionBy(F.sha2("text", 256)).orderBy("doc_id")
    return table(spark, sf, "documents").withColumn("nth", F.row_number().over(first)).filter("nth = 1").select("doc_id")


def paragraph_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return reader.paragraphs(rows).select("id", F.col("pos").cast("long").alias("pos"), "language", F.md5("paragraph").alias("digest"))


def escaped_markup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.md5(L.escaped(F.col("html"))).alias("digest"))


def passage_markup(spark: SparkSession, sf: str) -> DataFrame:
    return markup(ranged_parts(passages(spark, sf))).select("part_number", F.length("xml").cast("long").alias("chars"), F.md5("xml").alias("digest"))


def triple_statements(spark: SparkSession, sf: str) -> DataFrame:
    return statement_text(triples(spark, sf, "parents", "classes", "brands"))


def corpus_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations laid out as plain texts of books, written, read and segmented again.

    A book has PART_CONVERSATIONS conversations: of each three, one is a definition and one an axiom of part I,
    and one a proposition of part IV.  Rows without conv_id or turn have no place in a book.
    """
    c = table(spark, sf, "conversations").filter("turn IS NOT NULL AND conv_id IS NOT NULL")
    numeral = to_roman(F.col("conv_id").cast("int") + 1)
    said = L.squeeze(F.regexp_replace(F.coalesce("text", F.lit("")), r"[.:]+", " "))
    section = (F.col("conv_id") % 3).cast("int")
    opening = F.concat(F.when(section == 2, "PROP. ").otherwise(F.lit("")), numeral, F.lit(". "))
    lead = F.when(F.col("turn") == 0, opening).when(F.col("role") == "assistant", "Proof.—").otherwise(F.lit("Note.—"))
    rows = c.select(F.floor(F.col("conv_id") / PART_CONVERSATIONS).alias("book"), section.alias("section"), "conv_id", "turn", F.concat(lead, said).alias("line"))
    bodies = rows.groupBy("book").agg(*[F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("section") == k, F.struct("conv_id", "turn", "line")))), lambda x: x["line"]), "\n\n").alias(f"body{k}") for k in range(3)])
    book = F.concat(F.lit("PART I.\n\nA TITLE\n\nDEFINITIONS\n\n"), "body0", F.lit("\n\nAXIOMS.\r\n\n"), "body1", F.lit("\n\nPART IV. Another title\n\nPROPOSITIONS\n\n"), "body2", F.lit("\n\nThe end.\n"))
    path = f"{shared_folder(spark)}/books-{uuid.uuid4().hex}"
    bodies.select("book", book.alias("value")).write.partitionBy("book").text(path)
    texts = read_raw_text(spark, path).withColumn("path", F.regexp_extract("path", r"book=(\d+)", 1))
    found = corpus.passages_of_texts(texts, end="The end.")
    return found.select("key", "id", "type", "number", "parent_id", F.md5("text").alias("digest"))


def aligned_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Passages aligned with paragraphs in which some of their labels are missing (the gaps are the made-up text's)."""
    p = ranged_parts(passages(spark, sf)).withColumn("number", F.when(F.col("type") == "proposition", F.regexp_extract("id", r"(\d+)$", 1)))
    label = F.when(F.col("type") == "proposition", F.concat(F.lit("PROPOSITIO "), to_roman(F.col("number").cast("int")), F.lit(": "))).when(F.col("type") == "proof", "DEMONSTRATIO: ").otherwise(F.lit("SCHOLIUM: "))
    kept = p.filter("sort_index % 11 <> 3").withColumn("pos", (F.row_number().over(Window.partitionBy("part_number").orderBy("sort_index"))).cast("int"))
    paras = kept.select("part_number", "pos", F.concat(label, L.squeeze(F.col("text"))).alias("paragraph"))
    return alignment.align(p, paras).select("id", F.md5("text").alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        [top_cited, outward_citations, inward_citations, consequences, reductio_subjects, elements_of_class, graph_counts, several_proofs, relation_counts, merge_stores, backfill, project_invert]
        + [transitive_closure, rules_two_hops, apply_rules, influence, dependency_depth, element_weights, relations_all, relation_groups, chains_first, trace_levels, trace_depth_first, trace_fallback, cyclic_nodes]
        + [roman_numerals, relation_labels, passage_labels, humanised_tokens, previews, search_visible, search_selectable, search_neighbours, section_summary, section_starts, children_by_parent]
        + [parallel_texts, citations_found, citations_known, page_paragraphs, url_components, text_blocks, child_counters, first_of_text, paragraph_rows, escaped_markup, passage_markup, triple_statements]
        + [corpus_passages, aligned_passages]
    )
}
