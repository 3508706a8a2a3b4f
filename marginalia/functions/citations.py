"""References to passages in running text, as Column expressions that give arrays of ids.

Eight families of references are looked for one after another; within a family from left to right.
The patterns have no right word boundary, so that 'definite' refers to definition 1: that is how
such texts have always been read, and what results are compared with.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .labels import SPACES
from .roman import from_roman, lookup

# The patterns of the families, in the order in which they are looked for.
_KIND = r"(Prop(?:osition)?|Def(?:inition)?s?|Deff\.?|Ax(?:iom)?|Lemma|Post(?:ulate)?)"
_FROM = r"(?:^|[\s,(;])"
EXPLICIT = r"\b(?:Pt\.?|Part)\s*([ivx]+)\.?,?\s*(?:" + _KIND + r"\.?\s*)?([ivxlcdm]+)(?:,?\s*Coroll?(?:ary)?\.?\s*([ivxlcdm]+)?)?"
QUALIFIED = _FROM + r"((?:i{1,3}|iv|v))\.\s*" + _KIND + r"\.?\s*([ivxlcdm]+)(?:\.\s*Coroll?(?:ary)?\.?\s*([ivxlcdm]+)?)?"
PART_AND_NUMBER = _FROM + r"([ivx]+)\.\s*([ivxlcdm]+)(?:\.\s*Coroll?\.?\s*([ivxlcdm]+)?)?"
PART_AND_NUMBER_BUILD = _FROM + r"((?:i{1,3}|iv|v))\.\s*([ivxlcdm]+)(?:\.\s*Coroll?(?:ary)?\.?\s*([ivxlcdm]+)?)?"
PROPOSITION = _FROM + r"(?:Prop(?:osition)?\.?)\s*([ivxlcdm]+)(?:,?\s*Coroll?(?:ary)?\.?\s*([ivxlcdm]+)?)?"
DEFINITION = _FROM + r"(?:Def(?:inition)?s?|Deff\.?)\.?\s*([ivxlcdm]+)(?:\s*(?:and|,)\s*([ivxlcdm]+))?"
AXIOM = _FROM + r"(?:Ax(?:iom)?)\.?\s*([ivxlcdm]+)(?:\s*(?:and|,)\s*([ivxlcdm]+))?"
LEMMA = _FROM + r"Lemma\s+([ivxlcdm]+)"
POSTULATE = _FROM + r"(?:Post(?:ulate)?)\.?\s*([ivxlcdm]+)"


@dataclass(frozen=True)
class Family:
    """Groups of a pattern: of the part (0: the passage's own), of the kind (or a fixed kind), of numbers, of a corollary."""

    pattern: str
    kind: int | str
    numbers: tuple[int, ...]
    part: int = 0
    corollary: int = 0


def families(build: bool) -> list[Family]:
    """``build``: as the graph builder reads texts; otherwise as the reader does.

    The builder takes any spelling of the numbers one to five for a part (iiii), the reader I to V only.
    """
    return [
        Family(EXPLICIT, 2, (3,), part=1, corollary=4),
        Family(QUALIFIED, 2, (3,), part=1, corollary=4),
        Family(PART_AND_NUMBER_BUILD if build else PART_AND_NUMBER, "prop", (2,), part=1, corollary=3),
        Family(PROPOSITION, "prop", (1,), corollary=2),
        Family(DEFINITION, "def", (1, 2)),
        Family(AXIOM, "ax", (1, 2)),
        Family(LEMMA, "lemma", (1,)),
        Family(POSTULATE, "post", (1,)),
    ]


def java_pattern(pattern: str) -> str:
    """The pattern as Java reads it, where \\s stands for ASCII white space only."""
    return "(?i)" + re.sub(r"(\[?)\\s", lambda m: f"[{SPACES}" if m[1] else f"[{SPACES}]", pattern)


def kind_of_token(token: Column) -> Column:
    """def, ax, lemma, post, or else prop."""
    low = F.lower(token)
    return F.when(low.startswith("def"), "def").when(low.startswith("ax"), "ax").when(low.startswith("lemma"), "lemma").when(low.startswith("post"), "post").otherwise("prop")


def reference_id(part: Column, kind: Column, number: Column, suffix: Column | None = None) -> Column:
    """part.kind.number[.suffix]; null where the part or the number is missing or 0."""
    parts = [part, kind, number.cast("string")] + ([suffix] if suffix is not None else [])
    return F.when(part.isNotNull() & (number != 0), F.concat_ws(".", *parts))


def _found(text: Column, family: Family) -> Column:
    """Array of the places in ``text`` that a family's pattern matches.

    A space is put before the text, so that a reference at its beginning has one to start with, as all others have: with '^' as
    another way to start, a search takes twice its time.
    """
    pattern = java_pattern(family.pattern)
    if family.pattern.startswith(_FROM):
        text, pattern = F.concat(F.lit(" "), text), java_pattern(family.pattern.replace(_FROM, "", 1))
        pattern = f"[{SPACES},(;]{pattern}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _ids_of(matches: Column, own_part: Column, family: Family, build: bool) -> Column:
    """Array of ids.  Groups, numbers and ids are made one after another, so that each is worked out once for a match."""
    pattern = java_pattern(family.pattern)

    def groups(found: Column) -> Column:
        group = lambda k: F.regexp_extract(found, pattern, k)
        part = group(family.part) if family.part else F.lit("")
        kind = kind_of_token(group(family.kind)) if isinstance(family.kind, int) else F.lit(family.kind)
        corollary = group(family.corollary) if family.corollary else F.lit("")
        return F.struct(part.alias("part"), kind.alias("kind"), F.array(*[group(k) for k in family.numbers]).alias("numbers"), corollary.alias("corollary"))

    def numbers(g: Column) -> Column:
        part = (from_roman(g["part"]) if build else g["part"]) if family.part else F.lit("")
        return F.struct(part.alias("part"), g["kind"].alias("kind"), F.transform(g["numbers"], from_roman).alias("numbers"), from_roman(g["corollary"]).alias("corollary"))

    def ids(g: Column) -> Column:
        part = own_part
        if family.part:
            part = lookup(V.PART_NUMERALS, g["part"]) if build else F.when(F.upper(g["part"]).isin(*V.PART_NUMERALS.values()), F.upper(g["part"]))
        suffix = F.when((g["corollary"] != 0) & (g["kind"] == "prop"), F.concat(F.lit("corollary"), g["corollary"].cast("string"))) if family.corollary else None
        return F.transform(g["numbers"], lambda n: reference_id(part, g["kind"], n, suffix))

    return F.flatten(F.transform(F.transform(F.transform(matches, groups), numbers), ids))


def part_of(own_id: Column) -> Column:
    """The part that references without one are to."""
    return F.get(F.split(own_id, r"\."), F.lit(0))


def marks(text: Column, build: bool = False) -> Column:
    """For each family, an array of the places in ``text`` that it matches.  Null text: none."""
    return F.array(*[_found(F.coalesce(text, F.lit("")), f) for f in families(build)])


def ids_of_mark(family: Column, mark: Column, own_part: Column, build: bool = False) -> Column:
    """Array of the ids (or nulls) that a place found by ``marks`` refers to; ``family`` is its number there."""
    out = F.lit(None).cast("array<string>")
    for k, f in enumerate(families(build)):
        out = F.when(family == k, _ids_of(F.array(mark), own_part, f, build)).otherwise(out)
    return out


def references(text: Column, own_id: Column, build: bool = False) -> Column:
    """Distinct ids that ``text`` refers to, without the passage's own, in the order of the families.

    Null text: an empty array.
    """
    text = F.coalesce(text, F.lit(""))
    found = F.concat(*[_ids_of(_found(text, f), part_of(own_id), f, build) for f in families(build)])
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull() & (x != own_id)))
