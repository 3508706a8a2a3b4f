"""Secret scanning over a trigram inverted index, in Spark expressions alone.

For each rule the trigrams that any match must hold are derived from its regex as a Boolean query,
here a set of alternatives that each ask for all of their trigrams.  The index has a posting
(trigram, document) for each trigram of the queries; intersecting postings gives the candidates,
whose texts the regex then verifies.  Rules without mandatory trigrams scan all texts.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import free_name


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping, whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
MORE = (
    Rule("block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE + MORE


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives, each a set of lower-case trigrams that a match must hold; [] if some match needs none."""

    def runs(tree) -> list[list[str]]:
        """Ways to match, each as the literal strings that then must occur."""
        ways: list[list[str]] = [[""]]
        for op, arg in tree:
            if op is sre.LITERAL:
                ways = [[*w[:-1], w[-1] + chr(arg).lower()] for w in ways]
            elif op is sre.SUBPATTERN:
                ways = [[*w, *x, ""] for w in ways for x in runs(arg[3])]
            elif op is sre.BRANCH:
                ways = [[*w, *x, ""] for w in ways for branch in arg[1] for x in runs(branch)]
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                ways = [[*w, *x, ""] for w in ways for x in runs(arg[2])]
            else:
                ways = [[*w, ""] for w in ways]
        return ways

    found = [frozenset(s[i : i + 3] for s in way for i in range(len(s) - 2)) for way in runs(sre_parser.parse(pattern))]
    return sorted(set(found), key=sorted) if all(found) else []


def postings(docs: DataFrame, key: Column, text: str, trigrams: list[str]) -> DataFrame:
    """The inverted index for these trigrams: rows (trigram, key)."""
    low = F.lower(F.col(text))
    held = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(low, t))
    return docs.select(key.alias("key"), F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Rows (key, kinds): the rules for which a document has all trigrams of some alternative."""
    asked = [(r.kind, k, t, len(way)) for r in rules for k, way in enumerate(trigram_query(r.pattern)) for t in sorted(way)]
    query = index.sparkSession.createDataFrame(asked, "kind string, way int, trigram string, needed int")
    met = index.join(F.broadcast(query), "trigram").groupBy("key", "kind", "way", "needed").agg(F.count_distinct("trigram").alias("n"))
    return met.filter("n = needed").groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def sieve(rule: Rule) -> str:
    """A regex that every text with a long enough match of ``rule`` matches; the rule's own where no sharper one is known.

    It is sharper for patterns of single characters that end in one that repeats without limit, like ``AB[0-9]+``: a match of
    ``least`` characters has at least ``least`` less the others in that last run.
    """
    single = (sre.LITERAL, sre.NOT_LITERAL, sre.IN, sre.ANY)
    tree = list(sre_parser.parse(rule.pattern))
    if rule.group or not tree or not rule.pattern.endswith("+"):
        return rule.pattern
    op, arg = tree[-1]
    plain = all(o in single for o, _ in tree[:-1]) and op is sre.MAX_REPEAT and arg[:2] == (1, sre.MAXREPEAT) and [o for o, _ in arg[2]][:1] in [[o] for o in single] and len(arg[2]) == 1
    return f"{rule.pattern[:-1]}{{{max(1, rule.least - len(tree) + 1)},}}" if plain else rule.pattern


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, kind, end) in code points, by cutting the text at the matches and adding up lengths."""
    pattern = F.lit(rule.pattern)
    parts = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value"),
    )
    none = F.expr("cast(array() as array<struct<start:bigint,rank:int,kind:string,end:bigint>>)")

    def step(held: Column, p: Column) -> Column:
        start = held["at"] + F.length(p["gap"])
        end = start + F.coalesce(F.length(p["whole"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(order).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        good = F.coalesce(F.length(p["value"]) >= rule.least, F.lit(False))
        return F.struct(end.alias("at"), F.when(good, F.array_append(held["spans"], span)).otherwise(held["spans"]).alias("spans"))

    found = F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), step)["spans"]
    # only texts that may have a long enough match are cut up
    return F.when(F.rlike(text, F.lit(sieve(rule))), found).otherwise(none)


def find_secrets(docs: DataFrame, *, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, str]:
    """``docs`` with an array column of spans (start, rank, kind, end) by start and rule, and that column's name.

    Null and empty texts have no spans.  Postings go by a hash of key and text, so null keys and
    repeated keys or rows need no care: rows of one hash share candidates, and every candidate is
    verified on its own text.  Very long texts are searched whole, without being cut.  Other columns
    pass through.  An empty table gives an empty result.
    """
    name, joint = free_name(docs, "spans"), free_name(docs, "posting_key")
    hashed = F.xxhash64(F.col(key), F.col(text))
    indexed = tuple(r for r in rules if trigram_query(r.pattern))
    trigrams = sorted({t for r in indexed for way in trigram_query(r.pattern) for t in way})
    kinds = free_name(docs, "kinds")
    found = candidates(postings(docs, hashed, text, trigrams), indexed).select(F.col("key").alias(joint), F.col("kinds").alias(kinds))
    joined = docs.withColumn(joint, hashed).join(found, joint, "left")
    none = F.expr("cast(array() as array<struct<start:bigint,rank:int,kind:string,end:bigint>>)")
    lists = []
    for i, r in enumerate(rules):
        spans = rule_spans(F.coalesce(F.col(text), F.lit("")), r, i)
        lists.append(F.when(F.array_contains(kinds, r.kind), spans).otherwise(none) if r in indexed else spans)
    return joined.withColumn(name, F.array_sort(F.concat(*lists))).drop(joint, kinds), name


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span, or run of overlapping spans, replaced by [SECRET]."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(held: Column, s: Column) -> Column:
        fresh = s["start"] >= held["at"]
        gap = F.substring(text, held["at"].cast("int") + 1, (s["start"] - held["at"]).cast("int"))
        out = F.when(fresh, F.concat(held["out"], gap, F.lit("[SECRET]"))).otherwise(held["out"])
        return F.struct(F.greatest(held["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(spans, start, step, lambda h: F.concat(h["out"], F.substring(text, h["at"].cast("int") + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
