"""What a reader asks of passages: search, sections, neighbours in reading order, parallel texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import labels as L

from .ordered import paged, runs, scan

_SEARCHED = ("text", "latin_text", "canonical_label", "heading", "id")


def matches(query: str, *columns: Column) -> Column:
    """Does any column contain the query, whatever the case?  A blank query matches everything; nulls match nothing."""
    wanted = query.strip().lower()
    if not wanted:
        return F.lit(True)
    found = [F.coalesce(F.lower(c).contains(wanted), F.lit(False)) for c in columns]
    out = found[0]
    for x in found[1:]:
        out = out | x
    return out


def _matching(passages: DataFrame, query: str) -> Column:
    return matches(query, *[F.col(c) for c in _SEARCHED if c in passages.columns])


def is_top_level() -> Column:
    return F.coalesce(F.col("parent_id"), F.lit("")) == ""


def merge_parallel(passages: DataFrame, parallel: DataFrame) -> DataFrame:
    """Passages with the text of the same id; blank texts are null."""
    texts = parallel.select("id", L.blank_to_null(L.trim(F.col("latin_text"))).alias("latin_text"))
    return passages.drop("latin_text").join(texts, "id", "left").select(*passages.columns)


def visible(passages: DataFrame, query: str) -> DataFrame:
    """Top-level passages that match, or of which a passage inside does."""
    if not query.strip():
        return passages.filter(is_top_level())
    hit = passages.withColumn("_hit", _matching(passages, query))
    inside = hit.filter(~is_top_level() & F.col("_hit")).select(F.col("parent_id").alias("id")).distinct().withColumn("_inside", F.lit(True))
    return hit.filter(is_top_level()).join(inside, "id", "left").filter(F.col("_hit") | F.col("_inside")).select(*passages.columns)


def selectable(passages: DataFrame, query: str) -> DataFrame:
    """Passages that match, or whose parent does: what a search lets one step through."""
    if not query.strip():
        return passages
    hit = passages.withColumn("_hit", _matching(passages, query))
    parents = hit.filter("_hit").select(F.col("id").alias("parent_id")).distinct().withColumn("_parent", F.lit(True))
    return hit.join(parents, "parent_id", "left").filter(F.col("_hit") | F.col("_parent")).select(*passages.columns)


def children_shown(passages: DataFrame, query: str) -> DataFrame:
    """Passages inside others that a search shows: all those of a matching parent, else those that match."""
    return selectable(passages, query).filter(~is_top_level())


def section_summary(passages: DataFrame) -> DataFrame:
    """(kind, label, count, first_index): top-level passages by section, in the order of first appearance."""
    top = passages.filter(is_top_level())
    counted = top.groupBy(F.col("section_kind").alias("kind")).agg(F.count("*").alias("count"), F.min("sort_index").alias("first_index"))
    return counted.select("kind", L.section_label(F.col("kind")).alias("label"), "count", "first_index").orderBy("first_index")


def children_by_parent(passages: DataFrame) -> DataFrame:
    """(parent_id, children): arrays in reading order; child_pages() has no row that grows with a parent."""
    kept = F.struct("sort_index", "id", "type", "text")
    return passages.filter(~is_top_level()).groupBy("parent_id").agg(F.sort_array(F.collect_list(kept)).alias("children"))


def child_pages(passages: DataFrame, size: int = 100) -> DataFrame:
    """(parent_id, place, page, id, type, sort_index): passages inside others in reading order, in pages."""
    inner = passages.filter(~is_top_level()).select("parent_id", "sort_index", "id", "type")
    return paged(inner, ["parent_id"], ["sort_index", "id"], size).select("parent_id", "place", "page", "id", "type", "sort_index")


def numbered_children(passages: DataFrame) -> DataFrame:
    """(id, numbered_id): passages inside others, named by parent and type, and from the second of a type on by its count."""
    inner = passages.filter(~is_top_level()).select("parent_id", "type", "sort_index", "id")
    nth = scan(inner, ["parent_id", "type"], ["sort_index", "id"], counts={"nth": F.lit(True)})
    return nth.select("id", F.concat("parent_id", F.lit("."), "type", F.when(F.col("nth") > 1, F.col("nth").cast("string")).otherwise("")).alias("numbered_id"))


def reading_order(passages: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """(within, id, previous_id, next_id) of a reading order of any length: neighbours() in many tasks."""
    rows = passages.select(*within, "sort_index", "id")
    found = scan(rows, within, ["sort_index", "id"], before={"previous_id": F.col("id")}, after={"next_id": F.col("id")})
    return found.select(*within, "id", "previous_id", "next_id")


def section_runs(passages: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Top-level passages with ``run``: the number of the section they lie in, in a reading order of any length."""
    return runs(passages.filter(is_top_level()), F.col("section_kind"), within, ["sort_index", "id"])


def neighbours(passages: DataFrame, within: tuple[str, ...] = ("part_number",)) -> DataFrame:
    """(id, previous_id, next_id) in reading order within a part."""
    order = Window.partitionBy(*within).orderBy("sort_index", "id")
    return passages.select(*within, "id", F.lag("id").over(order).alias("previous_id"), F.lead("id").over(order).alias("next_id"))


def section_starts(passages: DataFrame, within: tuple[str, ...] = ("part_number",)) -> DataFrame:
    """Top-level passages with ``shows_heading``: is its section another than that of the one before?"""
    order = Window.partitionBy(*within).orderBy("sort_index", "id")
    before = F.lag(F.struct("section_kind")).over(order)
    top = passages.filter(is_top_level())
    return top.withColumn("shows_heading", before.isNull() | ~before["section_kind"].eqNullSafe(F.col("section_kind")))


def paragraphs(passages: DataFrame, column: str = "text", language: str = "en") -> DataFrame:
    """(id, pos, language, paragraph): texts cut at empty lines."""
    parts = F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), r"\n{2,}"), L.trim), lambda p: p != "")
    return passages.select("id", F.posexplode(parts).alias("pos", "paragraph")).select("id", "pos", F.lit(language).alias("language"), "paragraph")
