"""The star-schema tables seen as triples and passages, for the registered queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import labels as L
from marginalia.functions.roman import to_roman

#: Conversations that make a part of a written text.
PART_CONVERSATIONS = 500
EVENTS = {"click": "necessarilyFollows", "error": "refutedByAbsurdity", "purchase": "buildsUpon", "signup": "groundedIn", "view": "clearlyfollowsFrom"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(kind: str, key: str | Column) -> Column:
    return F.concat(F.lit(f"{kind}."), (F.col(key) if isinstance(key, str) else key).cast("string"))


def triples(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """The set of triples of the named groups."""
    t = lambda name: table(spark, sf_dir, name)

    def rows(df: DataFrame, s: Column, p: str | Column, o: Column, kind: str = "iri") -> DataFrame:
        return df.select(s.alias("s"), (F.lit(p) if isinstance(p, str) else p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))

    nation_ring = lambda a, b: rows(t("nation"), _node("N", "n_nationkey"), "cites", _node("N", (F.col("n_nationkey") * a + b) % 25))
    groups = {
        "orders": lambda: [rows(t("orders"), _node("O", "o_orderkey"), "cites", _node("C", "o_custkey"))],
        "places": lambda: [
            rows(t("customer"), _node("C", "c_custkey"), "cites", _node("N", "c_nationkey")),
            rows(t("supplier"), _node("S", "s_suppkey"), "cites", _node("N", "s_nationkey")),
            nation_ring(3, 1),
            nation_ring(7, 2),
        ],
        "parents": lambda: [
            rows(t("customer"), _node("C", "c_custkey"), "partOf", _node("N", "c_nationkey")),
            rows(t("nation"), _node("N", "n_nationkey"), "partOf", _node("R", "n_regionkey")),
        ],
        "supply": lambda: [rows(t("lineitem"), _node("P", "l_partkey"), "provedBy", _node("S", "l_suppkey"))],
        "notes": lambda: [rows(t("lineitem"), _node("O", "l_orderkey"), "hasNote", _node("P", "l_partkey"))],
        "brands": lambda: [rows(t("part"), _node("P", "p_partkey"), "hasCorollary", _node("B", "p_brand"))],
        "events": lambda: [rows(t("events"), _node("U", "user_id"), F.create_map(*[F.lit(x) for kv in EVENTS.items() for x in kv])[F.col("event_type")], _node("V", F.col("event_id") % 50))],
        "classes": lambda: [
            rows(t("part"), _node("P", "p_partkey"), "type", F.lit("Proposition")),
            rows(t("customer"), _node("C", "c_custkey"), "type", F.lit("Definition")),
            rows(t("supplier"), _node("S", "s_suppkey"), "type", F.lit("Proof")),
            rows(t("nation"), _node("N", "n_nationkey"), "type", F.lit("Axiom")),
            rows(t("nation"), _node("N", "n_nationkey"), "number", F.col("n_nationkey").cast("string"), "literal"),
        ],
    }
    return reduce(DataFrame.unionByName, [x for n in names for x in groups[n]()]).distinct()


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as passages: the first turn is a proposition, the others stand inside it.

    A passage's id and place are made of conv_id and turn, so rows without one of these are no passages.
    """
    c = table(spark, sf_dir, "conversations").filter("turn IS NOT NULL AND conv_id IS NOT NULL")
    top = F.col("turn") == 0
    kind = F.when(top, "proposition").when(F.col("role") == "assistant", "proof").otherwise(F.lit("note"))
    numeral = F.element_at(F.array(*map(F.lit, ("I", "II", "III", "IV", "V"))), (F.col("conv_id") % 5 + 1).cast("int"))
    parent = F.concat(numeral, F.lit(".prop."), (F.col("conv_id") + 1).cast("string"))
    rows = c.select(
        F.when(top, parent).otherwise(F.concat(parent, F.lit("."), kind, F.col("turn").cast("string"))).alias("id"),
        kind.alias("type"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("latin_text"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("sort_index"),
        F.element_at(F.array(F.lit("propositions"), F.lit("lemmas"), F.lit("physical_axioms")), ((F.col("conv_id") / 7).cast("long") % 3 + 1).cast("int")).alias("section_kind"),
        F.lit(None).cast("string").alias("number"),
        F.when(~top, parent).alias("parent_id"),
        F.lit(None).cast("string").alias("heading"),
        (F.col("conv_id") % 5 + 1).cast("int").alias("part_number"),
        numeral.alias("part_numeral"),
        (F.col("role") == "system").alias("is_editorial"),
    )
    return rows.withColumns(
        {
            "canonical_label": L.passage_label(F.col("id"), F.col("type"), F.col("number"), F.col("heading")),
            "editorial_kind": L.editorial_kind(F.col("is_editorial")),
            "source_authority": L.source_authority(F.col("is_editorial")),
            "variant_label": L.variant_of(F.col("id"), F.col("type")),
        }
    )


def ranged_parts(rows: DataFrame, size: int = PART_CONVERSATIONS) -> DataFrame:
    """Passages in parts of a fixed number of conversations, so that the number of parts grows with the table."""
    part = F.floor(F.col("sort_index") / (size * 1000)).cast("int") + 1
    return rows.withColumn("part_number", part).withColumn("part_numeral", to_roman(part))


def citing_sentence() -> Column:
    """A sentence with references of all kinds, made from the keys of an order."""
    a, b, part = to_roman(F.col("o_custkey") % 60 + 1), F.lower(to_roman(F.col("o_orderkey") % 40 + 1)), _citing_part()
    return F.concat(
        *[F.lit("By Pt. "), part, F.lit("., Prop. "), a, F.lit(", Coroll. "), b, F.lit("; (Pt. "), part, F.lit(" Def. "), b, F.lit("), ("), F.lower(part), F.lit(". "), b, F.lit(". Coroll.), "), F.lower(part), F.lit(". Ax. "), b],
        *[F.lit(", Prop. "), a, F.lit(", Def. "), b, F.lit(" and "), F.lower(a), F.lit(", Ax. i, Lemma "), b, F.lit(" and Post. "), b, F.lit(".")],
    )


def _citing_part() -> Column:
    return F.element_at(F.array(*map(F.lit, ("i", "II", "iii", "IV", "v"))), (F.col("o_orderkey") % 5 + 1).cast("int"))


def citing_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): sentences with references of all kinds, made from orders."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return o.select(F.concat(F.upper(_citing_part()), F.lit(".prop."), (F.col("o_orderkey") % 97 + 1).cast("string")).alias("id"), citing_sentence().alias("text")).distinct()
