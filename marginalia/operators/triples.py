"""Sets of triples: patterns, counts, unions and differences, and explicit graphs made from passages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import labels as L
from marginalia.functions import vocabulary as V
from marginalia.functions.citations import ids_of_mark, marks, part_of
from marginalia.functions.roman import lookup
from marginalia.sources.triples import COLUMNS, TYPE

from .lineage import settle


def match(triples: DataFrame, s: object = None, p: object = None, o: object = None) -> DataFrame:
    """Triples that agree with the given terms; None stands for any, a list for any of its members."""
    out = triples
    for name, wanted in (("s", s), ("p", p), ("o", o)):
        if wanted is not None:
            out = out.filter(F.col(name).isin(*wanted) if isinstance(wanted, list | tuple | set) else F.col(name) == wanted)
    return out


def cited_by(triples: DataFrame, id_: object = None) -> DataFrame:
    """(id, other): what passages cite."""
    return match(triples, s=id_, p="cites").select(F.col("s").alias("id"), F.col("o").alias("other"))


def citing(triples: DataFrame, id_: object = None) -> DataFrame:
    """(id, other): by what passages are cited."""
    return match(triples, p="cites", o=id_).select(F.col("o").alias("id"), F.col("s").alias("other"))


def consequences(triples: DataFrame, id_: object = None) -> DataFrame:
    """(id, other): what follows by necessity from passages."""
    return match(triples, p="necessarilyFollows", o=id_).select(F.col("o").alias("id"), F.col("s").alias("other"))


def with_preview(links: DataFrame, passages: DataFrame, limit: int = 200, ending: str = "...") -> DataFrame:
    """Links with the beginning of the other passage's text; null where there is no such passage."""
    texts = passages.select(F.col("id").alias("other"), L.truncated(F.col("text"), limit, ending).alias("preview"))
    return links.join(texts, "other", "left").select(*links.columns, "preview")


def refuted_by_absurdity(triples: DataFrame) -> DataFrame:
    """(id): distinct subjects of arguments by reduction to absurdity."""
    return match(triples, p="refutedByAbsurdity").select(F.col("s").alias("id")).distinct()


def of_class(triples: DataFrame, *classes: str) -> DataFrame:
    """(id, class): members of classes; of all classes if none is named."""
    return match(triples, p=TYPE, o=classes or None).select(F.col("s").alias("id"), F.col("o").alias("class"))


def graph_counts(triples: DataFrame) -> DataFrame:
    """(name, n): triples, and members of each class."""
    total = triples.agg(F.count("*").alias("n")).select(F.lit("triples").alias("name"), "n")
    return total.unionByName(of_class(triples).groupBy(F.col("class").alias("name")).agg(F.count("*").alias("n")))


def top_cited(triples: DataFrame, limit: int = 10) -> DataFrame:
    """(rank, id, n): the most cited passages; ties in the order of ids."""
    counted = match(triples, p="cites").groupBy(F.col("o").alias("id")).agg(F.count("*").alias("n"))
    few = counted.orderBy(F.desc("n"), "id").limit(limit)
    return few.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "id"))).select("rank", "id", "n")


def several_proofs(triples: DataFrame, pattern: str = r"^(I\.prop\.\d+)") -> DataFrame:
    """(id, n): propositions with more than one proof, most proofs first, by what ``pattern`` takes from the proofs' ids."""
    proofs = match(triples, p=TYPE, o="Proof").select(F.regexp_extract("s", pattern, 1).alias("id")).filter("id <> ''")
    return proofs.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "id")


def relation_counts(triples: DataFrame, relations: list[str] = V.ARGUMENT_RELATIONS) -> DataFrame:
    """(relation, n): how often relations occur; those that never do are left out."""
    return match(triples, p=relations).groupBy(F.col("p").alias("relation")).agg(F.count("*").alias("n"))


def merge(*stores: DataFrame) -> DataFrame:
    """Union of sets of triples."""
    return reduce(DataFrame.unionByName, [s.select(*COLUMNS) for s in stores]).distinct()


def backfill(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Triples of ``primary``, and those of ``fallback`` that it lacks; ``origin`` tells them apart."""
    own = primary.select(*COLUMNS).distinct()
    lacking = fallback.select(*COLUMNS).distinct().join(own, COLUMNS, "left_anti")
    return own.withColumn("origin", F.lit("canonical")).unionByName(lacking.withColumn("origin", F.lit("backfill")))


def rename_relation(triples: DataFrame, old: str, new: str) -> DataFrame:
    return match(triples, p=old).withColumn("p", F.lit(new)).select(*COLUMNS)


def invert_relation(triples: DataFrame, old: str, new: str) -> DataFrame:
    """The relation seen from its objects; literals have no such view."""
    turned = match(triples, p=old).filter("o_kind = 'iri'")
    return turned.select(F.col("o").alias("s"), F.lit(new).alias("p"), F.col("s").alias("o"), F.lit("iri").alias("o_kind"))


def _links(subject: Column, relation: Column | str, object_: Column) -> list[Column]:
    relation = F.lit(relation) if isinstance(relation, str) else relation
    return [subject.alias("s"), relation.alias("p"), object_.alias("o"), F.lit("iri").alias("o_kind")]


def known_citations(rows: DataFrame, build: bool) -> DataFrame:
    """The set of citations in texts of (id, text), only of ids that are there."""
    return _known_citations(settle(rows.select("id", marks(F.col("text"), build).alias("marks")), "marks"), build)


def _known_citations(marked: DataFrame, build: bool) -> DataFrame:
    """From a table of (id, marks).  Books cite in the same words over and over: each distinct mark is read once."""
    key = ["part", "family", "mark"]
    each = marked.select("id", part_of(F.col("id")).alias("part"), F.posexplode("marks").alias("family", "found")).select("id", "part", "family", F.explode("found").alias("mark"))
    other = ids_of_mark(F.col("family"), F.col("mark"), F.col("part"), build)
    # written, so that their size is known before the passages and the texts' marks are joined with them
    read = settle(each.select(*key).distinct().select(*key, F.explode(other).alias("other")).filter("other IS NOT NULL"), "citations")
    there = marked.select(F.col("id").alias("other")).join(read, "other", "left_semi")
    return each.join(read.join(there, "other", "left_semi"), key).filter("other <> id").select(*_links(F.col("id"), "cites", F.col("other"))).distinct()


def passage_triples(passages: DataFrame) -> DataFrame:
    """The set of triples that passages themselves tell: class, parent, relation to the parent, citations."""
    typed = passages.select(*_links(F.col("id"), TYPE, lookup(V.TYPE_CLASSES, F.col("type")))).filter("o is not null")
    inside = passages.filter(F.coalesce("parent_id", F.lit("")) != "")
    part_of = inside.select(*_links(F.col("id"), "partOf", F.col("parent_id")))
    related = inside.select(*_links(F.col("parent_id"), lookup(V.CHILD_RELATIONS, F.col("type")), F.col("id"))).filter("p is not null")
    return merge(typed, part_of, related, known_citations(passages, build=False))


def entry_triples(entries: DataFrame) -> DataFrame:
    """The explicit graph of the graph builder's entries: class, part, number, parent, citations, relation to the parent.

    Of each id there is one entry, as ``entries_of`` gives them, so that no triple comes twice.  They are read once and kept
    without their texts.
    """
    entries = settle(entries.select("id", "tag", "part_number", "number", "parent_id", marks(F.col("text"), build=True).alias("marks")), "entries")
    tag_class = {"def": "Definition", "axiom": "Axiom", "postulate": "Axiom", "prop": "Proposition", "lemma": "Proposition", "proof": "Proof", "corollary": "Corollary", "explanation": "Explanation"}
    literal = lambda p, value: [F.col("id").alias("s"), F.lit(p).alias("p"), F.col(value).cast("string").alias("o"), F.lit("literal").alias("o_kind")]
    typed = entries.select(*_links(F.col("id"), TYPE, F.coalesce(lookup(tag_class, F.col("tag")), F.lit("Note"))))
    part = entries.select(*literal("partNumber", "part_number")).filter("o is not null")
    number = entries.select(*literal("number", "number")).filter("o <> ''")
    inside = entries.filter(F.coalesce("parent_id", F.lit("")) != "")
    part_of = inside.select(*_links(F.col("id"), "partOf", F.col("parent_id")))
    related = inside.select(*_links(F.col("parent_id"), lookup(V.CHILD_RELATIONS, F.col("tag")), F.col("id"))).filter("p is not null")
    return reduce(DataFrame.unionByName, [typed, part, number, part_of, related, _known_citations(entries, build=True)])
