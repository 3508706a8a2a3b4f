"""Names, labels and short texts of passages and relations, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .roman import lookup, to_roman

#: White space and line breaks of every script but the common space, for use inside a bracket.  Those past Latin-1 stand behind
#: one comparison, as a regex asks every member of a bracket about every character.
_RARE_SPACES = r"\t\n\x0B\f\r\x{00A0}[\x{1680}-\x{FEFF}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]]"
SPACES = f" {_RARE_SPACES}"


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACES}]+|[{SPACES}]+$", "")


def squeeze(text: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{_RARE_SPACES}][{SPACES}]*| [{SPACES}]+", " "))


def join_paragraphs(parts: Column) -> Column:
    """Squeezed parts of an array, blank ones left out, with an empty line between."""
    return F.array_join(F.filter(F.transform(parts, squeeze), lambda x: x != ""), "\n\n")


def capitalised(text: Column) -> Column:
    """First letter in upper case; the others stay (initcap would lower them)."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 2**31 - 1))


def humanised(token: Column) -> Column:
    words = F.filter(F.split(token, r"[_\-.]+"), lambda x: x != "")
    return F.array_join(F.transform(words, capitalised), " ")


def section_label(kind: Column) -> Column:
    return F.coalesce(lookup(V.SECTION_LABELS, kind), humanised(kind))


def topic_label(topic: Column) -> Column:
    """Heading of an appendix section; null topic: a made-up heading."""
    named = F.coalesce(lookup(V.TOPIC_LABELS, topic), humanised(topic))
    return F.when(F.coalesce(topic, F.lit("")) == "", F.lit("Appendix Section")).when(topic.rlike("(?i)^[IVXLCDM]+$"), F.concat(F.lit("Caput "), F.upper(topic))).otherwise(named)


def passage_label(id_: Column, kind: Column, number: Column, heading: Column) -> Column:
    """Heading if there is one, else the type and number; a passage inside another adds the last token of its id."""
    tokens = F.split(id_, r"\.")
    token = F.coalesce(number, F.get(tokens, F.lit(2)))
    roman = to_roman(F.regexp_extract(token, r"^\s*\+?(\d{1,9})", 1).try_cast("int"))
    numbered = F.concat(capitalised(kind), F.lit(" "), roman)
    plain = kind.isin("proof", "corollary", "note", "explanation")
    base = F.when(kind.isin(*V.TAG_TYPES.values()), F.trim(numbered)).when(plain, capitalised(kind)).otherwise(humanised(kind))
    inner = blank_to_null(F.get(tokens, F.lit(3)))
    spoken = F.when(plain | inner.isNull(), base).otherwise(F.trim(F.concat(F.when(kind.isin(*V.TAG_TYPES.values()), numbered).otherwise(base), F.lit(" "), humanised(inner))))
    return F.coalesce(blank_to_null(heading), F.when(kind == "preface", F.lit("Preface")).when(kind == "appendix", F.lit("Appendix")).otherwise(spoken))


def variant_of(id_: Column, kind: Column) -> Column:
    """proof2 for the second proof, and so on; null for a first one."""
    number = F.regexp_extract(id_, r"\.(proof|corollary|note|explanation)(\d+)$", 2)
    return F.when((F.regexp_extract(id_, r"\.(proof|corollary|note|explanation)(\d+)$", 1) == kind) & (number != ""), F.concat(kind, number))


def variant_label(variant: Column) -> Column:
    kind, number = (F.regexp_extract(variant, r"(?i)^([a-z]+)(\d+)$", k) for k in (1, 2))
    return F.when(kind == "", variant).otherwise(F.concat(capitalised(kind), F.lit(" "), number))


def inverse_name(predicate: Column) -> Column:
    return F.coalesce(lookup(V.INVERSE_NAMES, predicate), F.concat(F.lit("inverse_"), predicate))


def _split_capitals(name: Column) -> Column:
    return F.regexp_replace(name, "([A-Z])", " $1")


def relation_label(predicate: Column) -> Column:
    return F.coalesce(lookup(V.INVERSE_LABELS, predicate), F.trim(capitalised(_split_capitals(predicate))))


def relation_phrase(predicate: Column) -> Column:
    return F.lower(_split_capitals(predicate))


def relation_rank(predicate: Column) -> Column:
    """1 for direct relations, 2 for those over several steps."""
    return F.when(F.regexp_replace(predicate, "^inverse_", "").contains("transitively"), 2).otherwise(1)


def reference_text(id_: Column, part: Column) -> Column:
    """An id without its part where that is the part being read; parts other than the first compare with II."""
    own = id_.startswith(F.when(part == 1, "I.").otherwise("II."))
    return F.when(own, F.regexp_replace(id_, r"^[IVX]+\.", "")).otherwise(id_)


def truncated(text: Column, limit: int, ending: str = "…", trimmed: bool = False) -> Column:
    """At most ``limit`` characters, then ``ending``; ``trimmed`` takes white space off before it."""
    head = F.substring(text, 1, limit)
    return F.when(F.length(text) > limit, F.concat(trim(head) if trimmed else head, F.lit(ending))).otherwise(text)


def part_of_id(id_: Column) -> Column:
    """Number of the part that the first token of an id names; null for others."""
    return lookup({v: k for k, v in V.PART_NUMERALS.items()}, F.get(F.split(id_, r"\."), F.lit(0)))


def local_name(iri: Column) -> Column:
    return F.when(iri.contains("#"), F.get(F.split(iri, "#"), F.lit(1))).otherwise(iri)


def iri(name: Column, namespace: str) -> Column:
    return F.concat(F.lit(namespace), name)


def editorial_kind(editorial: Column) -> Column:
    return F.when(editorial, F.lit("english_only_addition"))


def source_authority(editorial: Column) -> Column:
    return F.when(editorial, F.lit("english_structural")).otherwise(F.lit("latin_governed"))


def chips(variant: Column, editorial: Column, kind: Column, authority: Column) -> Column:
    """Array of (label, tone, description): what a reader is told about a passage."""

    def chip(name: str, label: Column | None = None) -> Column:
        text, tone, description = V.CHIPS[name]
        return F.struct((label if label is not None else F.lit(text)).alias("label"), F.lit(tone).alias("tone"), F.lit(description).alias("description"))

    marked = F.coalesce(editorial, F.lit(False))
    rules = [
        F.when(F.coalesce(variant, F.lit("")) != "", chip("variant", variant_label(variant))),
        F.when(marked, chip("editorial")).when(kind == "synthetic_heading", chip("heading")),
        F.when(authority == "latin_governed", chip("latin_governed")),
        F.when(authority == "english_structural", chip("english_structural")),
    ]
    return F.filter(F.array(*rules), lambda c: c.isNotNull())


def shown_text(mode: str, text: Column, other: Column, missing: str = "") -> Column:
    """The text of a reading mode: english, latin (with a stand-in where there is none) or both."""
    latin = F.coalesce(blank_to_null(trim(other)), F.lit(missing))
    return {"english": text, "latin": latin, "both": F.concat_ws("\n\n", text, blank_to_null(trim(other)))}[mode]


def url_component(text: Column) -> Column:
    """Percent-encoding that leaves ! ' ( ) * as they are and writes a space as %20."""
    out = F.url_encode(text)
    for code, char in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def from_url_component(text: Column) -> Column:
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def escaped(text: Column) -> Column:
    """Markup characters as entities."""
    out = text
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def one_decimal(value: Column) -> Column:
    """A number with one decimal, rounded by its exact binary value; exact ties go away from zero.  (Java's formatter rounds
    the shortest decimal that prints as the number, so that 0.15, which lies below a tie, would become 0.2.)

    The double next to a tie m/20 is compared with it by differences that are exact, as both sides are within a factor of two.
    """
    v = value.cast("double")
    size = F.abs(v)
    m = F.floor(size * 10).cast("double") * 2 + 1
    tie = m / 20
    above = (size > tie) | ((size == tie) & ((tie * 16 - m) + tie * 4 >= 0))
    tenths = F.floor(size * 10) + above.cast("long")
    sign = F.when(v < 0, "-").otherwise(F.lit(""))
    shown = F.concat(sign, F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"))
    return F.when(size < 1e14, shown).otherwise(F.format_string("%.1f", v))


def heading_key(line: Column) -> Column:
    """A heading without its closing stops, in upper case."""
    return F.upper(trim(F.regexp_replace(line, "[.:]+$", "")))


def humanised_heading(heading: Column) -> Column:
    """A heading in lower case with a capital letter at the start of each word."""
    pieces = F.regexp_extract_all(F.lower(heading), F.lit(r"\w+|\W+"), F.lit(0))
    return F.array_join(F.transform(pieces, capitalised), "")


def public_path(base: str, path: Column) -> Column:
    """Where a file of the site is: the base and the path, with one slash between."""
    return F.concat(F.lit(base), F.regexp_replace(path, "^/", ""))
