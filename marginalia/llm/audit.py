"""How the filters of a corpus interact: what each removes, repeats or spares in every order they can be applied.

Expressions give each document a mask of the filters it fails; only the filter for repeated texts needs the rest of
the table, and gets the smallest id of each text from a grouping by the text's SHA-256.  Rows become counts by
text and part before they are joined with it, so that a text which a third of the table repeats is a few
rows.  A part then has at most 32 cells (one a mask), and every order of the filters is worked out from those.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import settle

_SPACE = r"[\x20\x09-\x0D]+"


def _short(text: Column, words: Column) -> Column:
    return F.size(words) < 50


def _repetitive(text: Column, words: Column) -> Column:
    return 100 * F.size(F.array_distinct(words)) < 65 * F.size(words)


def _capitals(text: Column, words: Column) -> Column:
    letters = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return 100 * letters > 5 * F.length(text)


def _symbols(text: Column, words: Column) -> Column:
    return text.rlike("[#$%&*|]")


#: Filters by the bit they have in a mask: what fails it, from the text and its words.  The last one, repeated texts, has no expression.
FILTERS = {"A": _short, "B": _repetitive, "C": _capitals, "D": _symbols, "E": None}
REPEATED = 1 << (len(FILTERS) - 1)
_ORDERS = factorial(len(FILTERS))


def own_failures(text: Column) -> Column:
    """The mask of the filters that a text fails by itself."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    bits = [F.when(fails(text, words), 1 << k).otherwise(0) for k, fails in enumerate(FILTERS.values()) if fails]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out.cast("int")


def histogram(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and by the filters that they fail, at most 32 rows a part.

    A text is repeated if a smaller key has it too, anywhere in the table: rows that share their key and text don't
    repeat each other, and rows without a key neither repeat nor are repeated.  Null texts are empty, null parts the
    empty string.  A document is good or toxic if any label row of its key says 1.  Other columns are not looked at.
    """
    marked = labels.select(F.col(key).alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    marked = marked.groupBy("id").agg(F.coalesce(F.max("good"), F.lit(False)).alias("good"), F.coalesce(F.max("toxic"), F.lit(False)).alias("toxic"))
    whole = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(text, F.lit("")).alias("text"))
    rows = whole.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), own_failures(F.col("text")).alias("mask"))
    known = rows.join(marked, "id", "left").na.fill(False, ["good", "toxic"])
    alike = ["digest", "part", "mask", "good", "toxic"]
    by_id = known.groupBy("id", *alike).agg(F.count("*").alias("n"))  # one row a document, unless rows are repeated
    kept = by_id.groupBy(*alike).agg(F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("n_least"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("n_null"))
    cells = settle(kept, "texts")
    first = cells.groupBy("digest").agg(F.min("least").alias("first"))
    held = cells.join(first, "digest")
    spared = F.col("n_null") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    both = F.array(F.struct("mask", spared.alias("n")), F.struct(F.col("mask").bitwiseOR(REPEATED).alias("mask"), (F.col("n") - spared).alias("n")))
    split = held.select("part", "good", "toxic", F.inline(both)).filter("n > 0")
    total = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0)).alias(flag)
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), total("good"), total("toxic"))


def _steps() -> Column:
    """Every order of the filters, step by step, as an array: its filter's bit and those of the filters before it."""
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    rows = [{"filter_order": "".join(o), "step": k + 1, "bit": bit[o[k]], "prior": sum(bit[f] for f in o[:k])} for o in permutations(FILTERS) for k in range(len(o))]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order:string,step:int,bit:int,prior:int>>")


def audit(cells: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from histogram().

    ``shapley`` is what the step's filter removes, summed over all orders: of the filters that a document fails,
    each comes first in the same number of orders.  Counts are 0 where no document is concerned; a
    table without documents has no parts and so no rows.
    """
    entry = F.struct("mask", "n", "good", "toxic")
    parts = cells.groupBy("part").agg(F.collect_list(entry).alias("cells"))  # at most 32
    steps = parts.select("part", "cells", F.inline(_steps()))
    bit, prior = F.col("bit"), F.col("prior")

    def total(test, value=lambda c: c["n"]) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda sum_, c: sum_ + F.when(test(c["mask"]), value(c)).otherwise(F.lit(0).cast("long")))

    fails = lambda m: m.bitwiseAND(bit) != 0
    left = lambda m: m.bitwiseAND(prior) == 0
    share = lambda c: (c["n"] * (F.lit(_ORDERS) / F.bit_count(c["mask"])).cast("long")).cast("long")
    return steps.select(
        *["part", "filter_order", "step"],
        total(lambda m: ~fails(m) & left(m)).alias("kept"),
        total(lambda m: fails(m) & left(m)).alias("removed"),
        total(lambda m: fails(m) & ~left(m)).alias("redundant"),
        total(lambda m: m == bit).alias("unique_fails"),
        total(lambda m: fails(m) & left(m), lambda c: c["good"]).alias("good_lost"),
        total(lambda m: fails(m) & left(m), lambda c: c["toxic"]).alias("toxic_lost"),
        total(fails, share).alias("shapley"),
    )
