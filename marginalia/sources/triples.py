"""Triples in N3 text: read as statements by Spark's text source, taken apart by Column expressions, written back.

A triple is (s, p, o, o_kind): local names of resources, the text of literals; o_kind is iri or literal.
A set of triples has no repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import vocabulary as V
from marginalia.functions.labels import local_name
from marginalia.functions.roman import lookup

COLUMNS = ["s", "p", "o", "o_kind"]
SCHEMA = "s string, p string, o string, o_kind string"
TYPE = "type"
#: Resources get this namespace when they are written, unless the caller names another.
NAMESPACE = "http://example.org/passages#"
_END = " .\n"
_TOKEN = r'<[^>]*>|"(?:[^"\\]|\\.)*"(?:@[A-Za-z-]+|\^\^[^\s;,]+)?|[;,]|[^\s;,<"]+'
_PREFIX = r"(?s)^\s*@prefix\s+([^\s:]*):\s*<([^>]*)>\s*$"

# The inference rules that travel with a written graph.
RULES = [
    "{ ?x :cites ?y } => { ?x :dependsUpon ?y }",
    "{ ?x :provedBy ?y } => { ?x :dependsUpon ?y }",
    "{ ?x :hasCorollary ?y } => { ?y :derivedFrom ?x }",
    "{ ?x :hasNote ?y } => { ?y :explainsElement ?x }",
    "{ ?x :dependsUpon ?y . ?y :dependsUpon ?z } => { ?x :transitivelyDependsOn ?z }",
    "{ ?x :cites ?y . ?y :cites ?z } => { ?x :transitivelyDependsOn ?z }",
]


def without_rules(text: Column) -> Column:
    """Text without lines that begin a rule or its conclusion."""
    kept = F.filter(F.split(text, "\n"), lambda line: ~line.rlike(r"^\s*(?:\{|=>)"))
    return F.array_join(kept, "\n")


def statements(text: DataFrame) -> DataFrame:
    """(statement) from rows of text, each of which ends where a statement ends."""
    clean = F.regexp_replace(without_rules(F.col("value")), r"(?m)^\s*#.*$", "")
    pieces = F.explode(F.split(clean, r"\s\.[ \t\r]*(?:\n|$)"))
    return text.select(pieces.alias("statement")).filter(F.trim(F.regexp_replace("statement", r"\s+", " ")) != "")


def _taken_apart(statement: Column) -> Column:
    """Array of (s, p, o) terms: ';' goes on with the same subject, ',' with the same predicate too."""
    none = F.lit(None).cast("string")
    start = F.struct(none.alias("s"), none.alias("p"), F.lit(0).alias("due"), F.array().cast("array<struct<s:string,p:string,o:string>>").alias("out"))

    def step(state: Column, token: Column) -> Column:
        is_object = (state["due"] == 2) & ~token.isin(";", ",")
        found = F.array(F.struct(state["s"].alias("s"), state["p"].alias("p"), token.alias("o")))
        due = F.when(token == ";", 1).when(token == ",", 2).when(state["due"] < 3, state["due"] + 1).otherwise(F.lit(4))
        return F.struct(
            F.when(state["due"] == 0, token).otherwise(state["s"]).alias("s"),
            F.when((state["due"] == 1) & (token != ";"), token).otherwise(state["p"]).alias("p"),
            F.when(state["due"] == 4, F.lit(4)).otherwise(due).alias("due"),
            F.when(is_object, F.concat(state["out"], found)).otherwise(state["out"]).alias("out"),
        )

    whole = F.aggregate(F.regexp_extract_all(statement, F.lit(_TOKEN), F.lit(0)), start, step)
    return F.when((whole["due"] == 4) | (F.size(whole["out"]) == 0), F.raise_error(F.concat(F.lit("not a statement: "), statement))).otherwise(whole["out"])


def _resolved(term: Column, prefixes: dict[str, str]) -> Column:
    """Local name of a resource; the text of a literal."""
    known = prefixes or {"": ""}
    prefix = F.regexp_extract(term, "^([^:]*):", 1)
    full = F.concat(F.coalesce(lookup(known, prefix), F.raise_error(F.concat(F.lit("unknown prefix in "), term))), F.regexp_extract(term, "(?s)^[^:]*:(.*)$", 1))
    quoted = F.regexp_replace(F.regexp_extract(term, r'(?s)^"(.*)"', 1), r'\\(["\\])', "$1")
    return (
        F.when(term == "a", F.lit(TYPE))
        .when(term.startswith("<"), local_name(F.regexp_replace(term, "^<|>$", "")))
        .when(term.startswith('"'), quoted)
        .when(_is_plain_literal(term), term)
        .otherwise(local_name(full))
    )


def _is_plain_literal(term: Column) -> Column:
    return term.rlike(r"^[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$|^true$|^false$")


def triples_of(found: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """Triples, not yet distinct, of (statement) rows."""
    terms = found.filter(~F.col("statement").rlike(_PREFIX)).select(F.inline(_taken_apart(F.col("statement"))))
    kind = F.when(F.col("o").startswith('"') | _is_plain_literal(F.col("o")), "literal").otherwise("iri")
    return terms.select(*[_resolved(F.col(c), prefixes).alias(c) for c in "spo"], kind.alias("o_kind"))


def prefixes_of(found: DataFrame) -> dict[str, str]:
    """Namespaces by prefix, over all files; a prefix must mean the same in each."""
    declared = found.filter(F.col("statement").rlike(_PREFIX)).select(*[F.regexp_extract("statement", _PREFIX, k).alias(n) for k, n in ((1, "prefix"), (2, "namespace"))])
    out: dict[str, str] = {}
    for row in declared.distinct().collect():  # as many rows as the files declare different prefixes
        if out.setdefault(row["prefix"], row["namespace"]) != row["namespace"]:
            raise ValueError(f"prefix {row['prefix']}: stands for two namespaces")
    return out


def read_triples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The set of triples in N3 files; rules in them are left out.

    Understands @prefix, 'a', ';' and ',' lists, <IRIs>, quoted and plain literals.  A statement ends
    with ' .' at a line's end, which is also where large files are split among tasks.  Any other
    text, and prefixes that no file declares, raise an error when the triples are used.
    """
    found = statements(spark.read.option("lineSep", _END).text(path))
    return triples_of(found, prefixes_of(found)).distinct()


def vocabulary_triples(spark: SparkSession) -> DataFrame:
    """Declarations of the properties and classes of explicit graphs."""
    properties = ["cites", "dependsUpon", "transitivelyDependsOn", "provedBy", "hasCorollary", "hasNote", "partOf", "derivedFrom", "explainsElement", "partNumber", "number"]
    classes = ["Definition", "Axiom", "Proposition", "Proof", "Corollary", "Note", "Explanation"]
    rows = [(x, TYPE, "Property", "iri") for x in properties] + [(x, TYPE, "Class", "iri") for x in classes]
    return spark.createDataFrame(rows, SCHEMA)


def statement_text(triples: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """(s, statement): one N3 statement for each subject, with whole IRIs, so that any part of the text can be read alone."""

    def resource(name: Column) -> Column:
        return F.concat(F.lit("<"), F.when(name.rlike("^[a-z]+://"), name).otherwise(F.concat(F.lit(namespace), name)), F.lit(">"))

    plain = F.col("o").rlike(r"^[+-]?\d+(?:\.\d+)?$")
    text = F.concat(F.lit('"'), F.regexp_replace("o", r'(["\\])', r"\\$1"), F.lit('"'))
    o = F.when(F.col("o_kind") == "iri", resource(F.col("o"))).when(plain, F.col("o")).otherwise(text)
    p = F.when(F.col("p") == TYPE, F.lit("a")).otherwise(resource(F.col("p")))
    objects = triples.select("s", p.alias("p"), o.alias("o")).distinct().groupBy("s", "p").agg(F.array_join(F.sort_array(F.collect_list("o")), ", ").alias("o"))
    # 'a' sorts after '<', so that it is put first by a key of its own
    lines = F.sort_array(F.collect_list(F.struct((F.col("p") != "a").alias("rest"), "p", "o")))
    body = F.array_join(F.transform(lines, lambda x: F.concat(x["p"], F.lit(" "), x["o"])), " ;\n    ")
    return objects.groupBy("s").agg(F.concat(resource(F.first("s")), F.lit(" "), body).alias("statement"))


def write_triples(triples: DataFrame, path: str, namespace: str = NAMESPACE, rules: bool = False) -> None:
    """N3 text files; with ``rules`` the inference rules follow the statements."""
    out = statement_text(triples, namespace).select(F.concat("statement", F.lit(" .")).alias("value"))
    if rules:
        text = "\n".join([f"@prefix : <{namespace}> .", *[f"{r} ." for r in RULES]])
        out = out.unionByName(triples.sparkSession.createDataFrame([(text,)], "value string"))
    out.write.text(path)


def save_triples(triples: DataFrame, path: str) -> None:
    """A Parquet table in a folder for each relation, by subject within: a pattern reads its relation's files only.

    The range partitioning spreads a relation that most triples have over many files.
    """
    triples.select(*COLUMNS).repartitionByRange("p", "s").sortWithinPartitions("p", "s").write.partitionBy("p").parquet(path)


def load_triples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path).select(*COLUMNS)


def classes_of(triples: DataFrame) -> DataFrame:
    """(id, type): the passage type that stands for a node's class; the least name where there are several."""
    typed = triples.filter((F.col("p") == TYPE) & F.col("o").isin(*V.CLASS_TYPES))
    return typed.groupBy(F.col("s").alias("id")).agg(F.min(lookup(V.CLASS_TYPES, F.col("o"))).alias("type"))
