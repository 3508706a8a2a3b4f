"""Roman numerals as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of one decimal place, and the numerals' values.
_PLACES = [
    (100, ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"]),
    (10, ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]),
    (1, ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]),
]
_VALUES = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def lookup(values: dict, key: Column) -> Column:
    """The value of a constant table; null for other keys."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def to_roman(n: Column) -> Column:
    """Numeral of a whole number; '' for 0, negative and null numbers."""
    whole = F.greatest(F.coalesce(n.cast("int"), F.lit(0)), F.lit(0))
    digits = [F.element_at(F.array(*map(F.lit, names)), F.pmod((whole / place).cast("int"), F.lit(10)) + 1) for place, names in _PLACES]
    return F.concat(F.repeat(F.lit("M"), (whole / 1000).cast("int")), *digits)


def from_roman(text: Column) -> Column:
    """Value of a numeral in either case, read from the right: a smaller digit before a larger one is subtracted.

    No numeral is checked for its canonical form (IIX is 8).  Null for other characters; '' is 0.
    """
    values = F.create_map(*[F.lit(x) for pair in _VALUES.items() for x in pair])

    def step(state: Column, letter: Column) -> Column:
        value = values[letter]
        down = value < state["last"]
        return F.struct((state["total"] + F.when(down, -value).otherwise(value)).alias("total"), F.when(down, state["last"]).otherwise(value).alias("last"))

    letters = F.reverse(F.split(F.upper(text), ""))
    value = F.aggregate(letters, F.struct(F.lit(0).alias("total"), F.lit(0).alias("last")), step, lambda s: s["total"])
    return F.when(text == "", 0).otherwise(value)
