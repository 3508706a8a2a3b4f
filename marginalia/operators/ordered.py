"""Ranks, running counts and neighbours in order, of groups of any size.

A window over a group is one task's work, however large the group.  Here rows are dealt out by ranges of (group, order),
so that a large group lies in many ranges one after the other.  What the ranges before and behind hand on to a range
is a row for each range and group; it joins the range's own rows as their first or last row, and one window
over (range, group) does the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settle

Named = dict[str, Column]


def scan(rows: DataFrame, by: Sequence[str], order: Sequence[str], counts: Named | None = None, before: Named | None = None, after: Named | None = None) -> DataFrame:
    """``rows`` with new columns: what stands before and behind each row of its group, in order.

    ``counts``: how many rows up to this one meet the condition (null: it doesn't).  ``before``: the last value that isn't null
    in the rows before this one; ``after``: the first one in the rows behind it; null where there is none.
    Without ``by`` all rows are one group.  Nulls come first and are a group of their own.  ``order`` should tell the rows of a
    group apart: rows that are equal in it stay in one range, in no certain order.  Names that begin with ``_scan`` are taken.
    """
    counts, before, after = counts or {}, before or {}, after or {}
    ticks = {f"_scan_n_{name}": F.coalesce(c, F.lit(False)).cast("long") for name, c in counts.items()}
    behind = {f"_scan_b_{name}": c for name, c in before.items()}
    ahead = {f"_scan_a_{name}": c for name, c in after.items()}
    valued = rows.withColumns(ticks | behind | ahead).repartitionByRange(*by, *order)
    cut = settle(valued.withColumn("_scan_range", F.spark_partition_id()), "ranges")  # ranges are drawn once: a second draw may cut elsewhere

    place = F.struct(*order)
    told = cut.groupBy("_scan_range", *by).agg(
        F.count("*").alias("_scan_rows"),
        *[F.sum(c).alias(c) for c in ticks],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in behind],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in ahead],
    )
    ranges = Window.partitionBy(*by).orderBy("_scan_range")  # a row for each range that the group lies in
    earlier, later = ranges.rowsBetween(Window.unboundedPreceding, -1), ranges.rowsBetween(1, Window.unboundedFollowing)
    first = told.select("_scan_range", *by, F.lit(0).alias("_scan_at"), *[F.sum(c).over(earlier).alias(c) for c in ticks], *[F.last(c, ignorenulls=True).over(earlier).alias(c) for c in behind])
    whole = cut.withColumn("_scan_at", F.lit(1)).unionByName(first, allowMissingColumns=True)
    if ahead:
        last = told.select("_scan_range", *by, F.lit(2).alias("_scan_at"), *[F.first(c, ignorenulls=True).over(later).alias(c) for c in ahead])
        whole = whole.unionByName(last, allowMissingColumns=True)

    here = Window.partitionBy("_scan_range", *by).orderBy("_scan_at", *order)
    up, over, under = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(Window.unboundedPreceding, -1), here.rowsBetween(1, Window.unboundedFollowing)
    found = whole.withColumns(
        {name: F.sum(f"_scan_n_{name}").over(up) for name in counts}
        | {name: F.last(f"_scan_b_{name}", ignorenulls=True).over(over) for name in before}
        | {name: F.first(f"_scan_a_{name}", ignorenulls=True).over(under) for name in after}
    )
    return found.filter("_scan_at = 1").select(*[f"`{c}`" for c in dict.fromkeys([*rows.columns, *counts, *before, *after])])


def paged(rows: DataFrame, by: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """``rows`` with ``place`` (from 0, in its group) and ``page`` of ``size`` rows, so that no row grows with a group."""
    placed = scan(rows, by, order, counts={"place": F.lit(True)}).withColumn("place", F.col("place") - 1)
    return placed.withColumn("page", F.floor(F.col("place") / size))


def next_page(rows: DataFrame, order: Sequence[str], size: int, last: Sequence | None = None) -> DataFrame:
    """The ``size`` rows that follow the row with the values ``last`` of ``order`` (the first ones without it).

    A page is found by its predecessor's last row and not by its number: a filter and a top-k, without a sort of all rows.
    """
    if last is not None:
        beyond, same = F.lit(False), F.lit(True)
        for c, value in zip(order, last, strict=True):
            bigger = F.col(c).isNotNull() if value is None else F.col(c) > F.lit(value)  # nulls come first
            beyond, same = beyond | (same & F.coalesce(bigger, F.lit(False))), same & F.col(c).eqNullSafe(F.lit(value))
        rows = rows.filter(beyond)
    return rows.orderBy(*order).limit(size)


def runs(rows: DataFrame, kind: Column, by: Sequence[str], order: Sequence[str], name: str = "run") -> DataFrame:
    """``rows`` with the number (from 1) of the run of equal ``kind`` they lie in, in the order of their group."""
    marked = scan(rows.withColumn("_kind", F.struct(kind.alias("kind"))), by, order, before={"_earlier": F.col("_kind")})
    begins = F.col("_earlier").isNull() | ~F.col("_earlier.kind").eqNullSafe(F.col("_kind.kind"))
    return scan(marked.withColumn("_begins", begins), by, order, counts={name: F.col("_begins")}).drop("_kind", "_earlier", "_begins")
