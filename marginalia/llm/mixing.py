"""Mixing sources by temperature, realised as budgeted permutations of blocks.

A source's weight is its share of the tokens to a power between 0 and 1, normalised.  The power is
found by bisection: as small as the repetition limit allows, or where the weights have the
entropy that is asked for.  A source's weight of the token budget is then drawn in passes; each pass
goes through the source's blocks in an order of its own, and through a block's documents likewise,
and the last pass stops where the budget ends.  The number of sources is free: their totals stay a table,
and a step of the bisection is one aggregate over it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import words as W
from .columns import add_struct
from .scratch import settle

BLOCK_TOKENS = 1_000_000
MAX_BLOCKS = 65_536
#: Rows without tokens, or with few, share blocks of so many.
BLOCK_ROWS = 250_000
MAX_REPEATS = 2.0
#: Powers that one aggregate over the sources tries.
TRIED = 32
#: Equal rows that one task makes from their number.
COPIES = 10_000


def weights(tokens: dict, power: float) -> dict:
    total = sum(tokens.values())
    raw = {s: (n / total) ** power if n else 0.0 for s, n in tokens.items()}
    scale = sum(raw.values())
    return {s: x / scale for s, x in raw.items()}


def entropy(shares: dict) -> float:
    return -sum(x * math.log(x) for x in shares.values() if x)


def _least_power(good: Callable[[list[float]], list[bool]]) -> float:
    """The smallest power between 0 and 1 for which ``good`` holds; it holds from some power on.  Tries some powers at once."""
    low, high = 0.0, 1.0
    if good([low])[0]:
        return low
    while high - low > 1e-16:
        tried = [low + (high - low) * k / (TRIED + 1) for k in range(1, TRIED + 1)]
        held = [*good(tried), True]
        first = held.index(True)
        ends = [low, *tried, high]
        if (ends[first], ends[first + 1]) == (low, high):
            break
        low, high = ends[first], ends[first + 1]
    return high


def chosen_power(least: int, most: int, sums: Callable[[list[float]], list[tuple[float, float]]], max_repeats: float, target_entropy: float | None, budget: int | None) -> tuple[float, float]:
    """The power, and what n ** power is multiplied with to give the tokens to draw from a source of n.

    ``least`` and ``most`` are the tokens of the smallest and the largest source; ``sums`` gives for each power
    the sums of n ** power and of n ** power * ln n over the sources.  The smallest source repeats most.
    """

    def factors(powers: list[float]) -> list[float]:
        if budget is None:  # every token is drawn once at least: the largest source just once
            return [most ** (1 - p) for p in powers]
        return [budget / z for z, _ in sums(powers)]

    def in_limit(powers: list[float]) -> list[bool]:
        return [f * least**p <= least * max_repeats * (1 + 1e-12) for p, f in zip(powers, factors(powers), strict=True)]

    def even_enough(powers: list[float]) -> list[bool]:
        return [math.log(z) - p * s / z <= target_entropy for p, (z, s) in zip(powers, sums(powers), strict=True)]

    if not in_limit([1.0])[0]:  # at a power of 1 all sources repeat alike, and less is not to be had
        raise ValueError(f"{budget} tokens are more than {max_repeats:g} passes over all sources")
    power = max(_least_power(in_limit), 0.0 if target_entropy is None else _least_power(even_enough))
    return power, factors([power])[0]


def budgets(tokens: dict, max_repeats: float = MAX_REPEATS, target_entropy: float | None = None, budget: int | None = None) -> tuple[float, dict]:
    """The power, and the tokens to draw from each source, of sources that are given as a dict.

    Without a budget, the smallest one that draws every token at least once is taken.
    """
    held = [n for n in tokens.values() if n]
    if not held:
        return 1.0, dict.fromkeys(tokens, 0)
    sums = lambda powers: [(sum(n**p for n in held), sum(n**p * math.log(n) for n in held)) for p in powers]
    power, factor = chosen_power(min(held), max(held), sums, max_repeats, target_entropy, budget)
    return power, {s: round(n**power * factor) if n else 0 for s, n in tokens.items()}


def planned(totals: DataFrame, max_repeats: float, target_entropy: float | None, budget: int | None) -> DataFrame:
    """``totals`` (source, total, rows) with the tokens to draw, the passes, and the number of blocks of each source."""
    with_tokens = totals.filter("total > 0").select(F.col("total").cast("double").alias("n"))

    def sums(powers: list[float]) -> list[tuple[float, float]]:
        raised = [F.pow("n", F.lit(p)) for p in powers]
        got = with_tokens.agg(*[F.sum(x).alias(f"z{k}") for k, x in enumerate(raised)], *[F.sum(x * F.log("n")).alias(f"s{k}") for k, x in enumerate(raised)]).first()
        return list(zip(got[: len(powers)], got[len(powers) :], strict=True))

    ends = with_tokens.agg(F.min("n"), F.max("n")).first()
    power, factor = chosen_power(ends[0], ends[1], sums, max_repeats, target_entropy, budget) if ends[0] else (1.0, 0.0)
    drawn = F.when(F.col("total") > 0, F.bround(F.pow(F.col("total").cast("double"), F.lit(power)) * F.lit(factor), 0)).otherwise(0).cast("long")
    blocks = F.least(F.lit(MAX_BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("total") / BLOCK_TOKENS), F.ceil(F.col("rows") / BLOCK_ROWS))).cast("int")
    passes = F.when(F.col("total") > 0, F.greatest(F.lit(1), F.ceil(F.col("drawn") / F.col("total")))).otherwise(1).cast("int")
    return totals.withColumn("drawn", drawn).select("source", "total", "drawn", passes.alias("passes"), blocks.alias("blocks"))


def _count_words(texts: list) -> dict[str, list]:
    counts: list[int] = []
    for _, _, raw in W.chunks(texts, lower=False):
        counts += W.split_words(raw, W.SPACED).counts.tolist()
    return {"n": counts}


def _each_copy(slim: DataFrame) -> DataFrame:
    """A row for each of the ``copies`` of a row, numbered; very many copies are made in many tasks."""
    runs = F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES).cast("int")))
    many = slim.filter(F.col("copies") > COPIES).withColumn("run", runs).repartition("key", "source", "mark", "run")
    some = slim.filter(F.col("copies") <= COPIES).withColumn("run", F.lit(0))
    first = F.col("run").cast("long") * COPIES
    each = F.explode(F.sequence(first, F.least(first + COPIES, F.col("copies")) - 1))
    return some.unionByName(many).select("key", "source", "mark", "n_tokens", each.alias("copy"))


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", max_repeats: float = MAX_REPEATS, target_entropy: float | None = None, budget: int | None = None, seed: int = 11) -> DataFrame:
    """One row a draw: the columns key and source, n_tokens, epoch, block and start_token (in the source's stream).

    Null sources are a source of their own; null texts have no tokens.  A source without any tokens
    is drawn once.  Rows are drawn one by one, so repeated rows stay, each in a block of its own choice, and null keys are drawn too.
    A budget of more than ``max_repeats`` passes over everything raises ValueError; an entropy below that of the sources' own shares isn't reached.  A very
    long text is drawn whole and counts with all its tokens.  Only sums over all sources reach the driver.  Blocks are by
    hash, their number follows the source's tokens and rows up to MAX_BLOCKS, so running sums over blocks stay
    bounded.  Other columns are dropped.  An empty table gives an empty result.
    """
    counted = add_struct(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text")), ["text"], "words", T.StructType([T.StructField("n", T.LongType())]), lambda: _count_words)
    # rows that are equal in key and source are told apart by their text; rows that are equal in all are one row with their number
    told = counted.select("key", "source", F.xxhash64("text").alias("mark"), F.col("words.n").alias("n_tokens"))
    slim = settle(told.groupBy("key", "source", "mark", "n_tokens").agg(F.count("*").alias("copies")), "mixing")
    totals = settle(slim.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("total"), F.sum("copies").alias("rows")), "totals")
    # settled: its size is known, so Spark broadcasts it only if it is small
    plan_table = settle(planned(totals, max_repeats, target_entropy, budget), "plan").withColumnRenamed("source", "plan_source")

    placed = _each_copy(slim).join(plan_table, F.col("source").eqNullSafe(F.col("plan_source")))
    placed = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "key", "mark", "copy"), F.col("blocks")).cast("int"))
    sums = placed.groupBy("source", "epoch", "block").agg(F.sum("n_tokens").alias("held"))
    over = Window.partitionBy("source", "epoch").orderBy(F.xxhash64(F.lit(seed), "block", "epoch"), "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("block").alias("b"), F.coalesce(F.sum("held").over(over), F.lit(0)).alias("block_start"))
    found = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("block") == F.col("b")))
    inside = Window.partitionBy("source", "epoch", "block").orderBy(F.xxhash64(F.lit(seed + 1), "key", "mark", "epoch", "copy"), "key", "mark", "copy").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("start", F.col("block_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)) + F.col("epoch") * F.col("total"))
    # a text without tokens is drawn too where it stands at the very end of what is drawn
    drawn = (F.col("start") < F.col("drawn")) | (F.col("n_tokens") == 0) & (F.col("start") <= F.col("drawn"))
    return found.filter(drawn).select(
        F.col("key").alias(key), F.col("source").alias(source), "n_tokens", F.col("epoch"), "block", F.col("start").alias("start_token")
    )
