"""Web pages to paragraphs, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import trim

# Markup and what replaces it, in this order.
MARKUP = [
    (r"<script[\s\S]*?</script>", ""),
    (r"<style[\s\S]*?</style>", ""),
    (r"<br\s*/?>", "\n"),
    (r"</?p\b[^>]*>", "\n\n"),
    (r"</?center\b[^>]*>", "\n\n"),
    (r"</?div\b[^>]*>", "\n\n"),
    (r"</?font\b[^>]*>", ""),
    (r"</?i\b[^>]*>", ""),
    (r"</?table\b[^>]*>", "\n\n"),
    (r"</?tr\b[^>]*>", "\n"),
    (r"</?td\b[^>]*>", " "),
    (r"</?hr\b[^>]*>", "\n\n"),
    (r"<[^>]+>", ""),
]
# Entities and what replaces them, in this order (an escaped entity is decoded twice).
ENTITIES = [("&amp;", "&"), ("&quot;", '"'), ("&nbsp;", " "), ("&rsquo;", "'"), ("&#176;", "°"), ("&#160;", " "), ("&#198;", "Ae"), ("&#230;", "ae")]
# Paragraphs that belong to the site, not to the text; title lines of a work are for the caller to add.
BOILERPLATE = [r"^ORDINE GEOMETRICO DEMONSTRATA$", r"^ET IN QUINQUE PARTES DISTINCTA$", r"^Neo-Latin$", r"^The Latin Library$", r"^The Classics Homepage$", r"^Finis "]
# Headings that run into their first item.
MERGED_HEADING = r"(?i)^(DEFINITIONES(?: AFFECTUUM)?|AXIOMATA|POSTULATA|PR(?:AE|Æ|E)FATIO)\s+([IVXLCDM]+)\.\s+([\s\S]+)$"
MERGED_REVERSED = r"(?i)^AFFECTUUM DEFINITIONES\s+([IVXLCDM]+)\.\s+([\s\S]+)$"


def decode_entities(text: Column) -> Column:
    out = F.regexp_replace(text, "(?i)&aelig;", "ae")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def strip_markup(html: Column) -> Column:
    out = html
    for pattern, by in MARKUP:
        out = F.regexp_replace(out, f"(?i){pattern}", by)
    return out


def paragraphs(text: Column) -> Column:
    """Array of paragraphs: parts between empty lines, on one line each, blank ones left out."""
    parts = F.split(F.replace(text, F.lit("\r"), F.lit("")), r"\n\s*\n+")
    flat = F.transform(parts, lambda p: trim(F.regexp_replace(F.regexp_replace(p, "[ \t]+", " "), "\n+", " ")))
    return F.filter(flat, lambda p: p != "")


def without_boilerplate(parts: Column, patterns: list[str] = BOILERPLATE) -> Column:
    pattern = "(?i)" + "|".join(f"(?:{p})" for p in patterns)
    return F.filter(parts, lambda p: ~p.rlike(pattern))


def split_merged_headings(parts: Column) -> Column:
    def pieces(p: Column) -> Column:
        cut = lambda pattern, k: F.regexp_extract(p, pattern, k)
        first = F.array(F.upper(cut(MERGED_HEADING, 1)), F.concat(cut(MERGED_HEADING, 2), F.lit(". "), cut(MERGED_HEADING, 3)))
        second = F.array(F.lit("DEFINITIONES AFFECTUUM"), F.concat(cut(MERGED_REVERSED, 1), F.lit(". "), cut(MERGED_REVERSED, 2)))
        return F.when(p.rlike(MERGED_HEADING), first).when(p.rlike(MERGED_REVERSED), second).otherwise(F.array(p))

    return F.flatten(F.transform(parts, pieces))


def page_paragraphs(html: Column, boilerplate: list[str] = BOILERPLATE) -> Column:
    """Paragraphs of a page; null page: an empty array."""
    parts = paragraphs(decode_entities(strip_markup(F.coalesce(html, F.lit("")))))
    return split_merged_headings(without_boilerplate(parts, boilerplate))

