"""Spelling variants: words at one error from each other, and the form that each word is a variant of.

Of two words at one error the error is in the first or in the second half of the longer one, so the other half is
exact.  A word goes to where its exact half is looked up: under its beginning for errors behind it, and, read backward, under its
end for errors before it; once as the longer word of a pair and once as one that lacks a letter.  There a minimal automaton, forward or
backward, follows a query's exact half and completes it with one error.  A half that very many words
share is made longer: what is left is cut in two, and again one of the two halves is exact (the word is then read
in turns from both ends).  Where one letter is left, no more words than letters can meet.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automaton import MARK, Automaton
from .exchange import struct, table_of
from .scratch import settle

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Entries that may share one exact part, and those that one task looks at, about.
SHARED, BUCKET = 2000, 50_000

_KEY = ["backward", "exact", "longer"]


def _without(word: Column, place: Column) -> Column:
    return F.concat(F.substring(word, F.lit(1), place.cast("int")), F.substring(word, (place + 2).cast("int"), F.length(word)))


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", slips: int | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): how often words of ``least_length`` letters or more occur, if ``least_count`` times or more.

    Words are runs of letters up to U+00FF; only A-Z are lower-cased.  With ``slips``, a run whose crc32 with its document's key
    is divisible by that number loses a letter, the crc32 modulo its length.  Null texts have no words; a null key
    counts as the empty string there.  Repeated rows count each.
    """
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("run"))
    lower = runs.select("key", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("word"))
    if slips:
        h = F.crc32(F.concat("key", F.lit(":"), "word").cast("binary"))
        lower = lower.withColumn("h", h).select(F.when(F.col("h") % slips == 0, _without(F.col("word"), F.col("h") % F.length("word"))).otherwise(F.col("word")).alias("word"))
    return lower.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _halves(exact: Column, rest: Column, left: Column) -> Column:
    """What is left of the longer word (``left`` letters) cut in two: the first half exact, or the second, read from its end."""
    head, size = F.floor(left / 2).cast("int"), F.length(rest)
    tail = (left - head).cast("int")
    first = F.struct(F.concat(exact, F.substring(rest, F.lit(1), head)).alias("exact"), F.substring(rest, head + 1, size).alias("rest"), tail.alias("left"))
    last = F.struct(F.concat(exact, F.lit(MARK), F.reverse(F.substring(rest, size - tail + 1, tail))).alias("exact"), F.reverse(F.substring(rest, F.lit(1), size - tail)).alias("rest"), head.alias("left"))
    return F.array(first, last)


def _entries(words: DataFrame) -> DataFrame:
    """(word, n, backward, longer, asks, exact, rest, left): each word under both its halves, as the longer word (asks) and as one that lacks a letter."""
    size = F.length("word")
    as_ = words.select("word", "n", F.inline(F.array(*[F.struct((size + k).cast("int").alias("longer"), F.lit(k == 0).alias("asks")) for k in (0, 1)])))
    head, tail = F.floor(F.col("longer") / 2).cast("int"), F.ceil(F.col("longer") / 2).cast("int")
    forward = F.struct(F.lit(False).alias("backward"), F.substring("word", F.lit(1), head).alias("exact"), F.substring(F.col("word"), head + 1, size).alias("rest"), tail.alias("left"))
    backward = F.struct(F.lit(True).alias("backward"), F.reverse(F.substring(F.col("word"), size - tail + 1, tail)).alias("exact"), F.reverse(F.substring(F.col("word"), F.lit(1), size - tail)).alias("rest"), head.alias("left"))
    return as_.select("word", "n", "longer", "asks", F.inline(F.array(forward, backward)))


def _spread(words: DataFrame) -> DataFrame:
    """_entries(), with exact parts that are shared by SHARED entries at most, or leave one letter."""
    now, done = settle(_entries(words), "halves"), []
    while True:
        crowded = settle(now.filter("left > 1").groupBy(*_KEY).agg(F.count("*").alias("many")).filter(F.col("many") > SHARED).drop("many"), "crowded")
        if crowded.isEmpty():
            return _all([*done, now])
        done.append(now.join(crowded, _KEY, "left_anti"))
        cut = now.join(crowded, _KEY, "left_semi").select("word", "n", "backward", "longer", "asks", F.inline(_halves(F.col("exact"), F.col("rest"), F.col("left"))))
        now = settle(cut, "halves")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


PAIRS = "word string, near string, near_n long"


def _look_up(schema):
    def run(group: pa.Table) -> pa.Table:
        out: dict[str, list] = {"word": [], "near": [], "near_n": []}
        for way in (False, True):
            rows = group.filter(pa.compute.equal(group["backward"], way))
            word, n, exact, rest, asks = (rows[c].to_pylist() for c in ("word", "n", "exact", "rest", "asks"))
            turned = [a + b for a, b in zip(exact, rest, strict=True)]
            automaton = Automaton(turned)
            kept = [0] * len(automaton)
            for k, t in enumerate(turned):
                kept[automaton.number(t)] = k
            for k, ask in enumerate(asks):
                for number in automaton.one_error(exact[k], rest[k]) if ask else ():
                    j = kept[number]
                    out["word"] += [word[k], word[j]]
                    out["near"] += [word[j], word[k]]
                    out["near_n"] += [n[j], n[k]]
        return table_of(schema, out)

    return run


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n): all ordered pairs of ``words`` (word, n; distinct) at exactly one inserted, deleted or replaced code point.

    No letter but those that occur is tried, so a word has no more pairs than its length times twice the letters, whatever
    the size of the set.  Words are letters without U+0000.  No words, no pairs.
    """
    spread = settle(_spread(words), "shared")
    buckets = max(1, math.ceil(spread.count() / BUCKET))
    dealt = spread.withColumn("bucket", F.pmod(F.xxhash64("backward", "exact"), F.lit(buckets)))
    found = dealt.groupBy("bucket").applyInArrow(_look_up(struct(PAIRS)), PAIRS)
    return found.dropDuplicates(["word", "near"])  # an error in the middle, or one of equal letters, is found both ways


def variants(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for ``words`` (word, n; distinct).

    ``form`` is the near word that occurs most often (ties: the least), if at least twice as often as the word; else
    null.  ``root`` is where forms lead at last, the word itself if nowhere.  As n doubles with each form, ways to a root are short; they are
    followed by doubling, a join each time.
    """
    words = settle(words.select("word", "n"), "words")
    best = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = words.join(best, "word", "left")
    is_form = F.col("best.less") <= -2 * F.col("n")
    told = settle(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    ways = told.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = ways.join(on, "root", "left")
        ways = settle(longer.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if ways.filter("moved").isEmpty():
            break
        ways = ways.drop("moved")
    return told.join(ways.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))
