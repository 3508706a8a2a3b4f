"""N3 text as people and tools write it, read in parallel from files that may be cut anywhere.

Spark's text source deals out the lines.  Where a split of a file begins, it may be inside a long string or inside the braces
of a rule; nothing else goes on over lines that changes what ends a statement.  So a first pass works out, from the few lines
that hold such marks, what each split does to that state; the states are put together file by file (a row a split).  A second pass
cuts each split into statements, the pieces at its edges are joined to those of its neighbours, and the statements are parsed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import urljoin
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.operators.lineage import settle

from .triples import COLUMNS, SCHEMA, TYPE

#: What a lexer is in: statements, or a long string in double or in single quotes.
CODE, DOUBLE, SINGLE = 0, 1, 2
_CLOSE = {DOUBLE: re.compile(r'(?s)(?:[^"\\]|\\.|"(?!""))*"""'), SINGLE: re.compile(r"(?s)(?:[^'\\]|\\.|'(?!''))*'''")}
#: Tokens that may hold a dot or a brace which means nothing there, then those that mean something.
_PASSED = r"""\"\"\"|'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|<[^<>"{}|^`\\\s]*>|\#[^\n]*"""
_MARKS = re.compile(rf"({_PASSED})|([{{}}])")
_ENDS = re.compile(rf"({_PASSED})|([{{}}])|(\.)(?=[\s\#<\[\]_@{{(]|$|\Z)|[^\s\"'<>\#{{}};,.\[\]()]+(?:\.[^\s\"'<>\#{{}};,.\[\]()]+)*")

_BLOCK = ["file", "block"]
_PIECES = "file string, block long, place long, ends boolean, text string"


def _after(line: str, mode: int, depth: int) -> tuple[int, int]:
    """The state at a line's end."""
    at = 0
    while True:
        if mode != CODE:
            end = _CLOSE[mode].match(line, at)
            if not end:
                return mode, depth
            at, mode = end.end(), CODE
        m = _MARKS.search(line, at)
        if not m:
            return mode, depth
        at = m.end()
        if m[2]:
            depth += 1 if m[2] == "{" else -1
        elif m[1] in ('"""', "'''"):
            mode = DOUBLE if m[1] == '"""' else SINGLE


def cut(text: str, mode: int = CODE, depth: int = 0) -> list[tuple[str, bool]]:
    """Pieces of a text that begins in a state: each with whether a statement ends there.  Ends are left out, comments are not."""
    out, begin, at = [], 0, 0
    while True:
        if mode != CODE:
            end = _CLOSE[mode].match(text, at)
            if not end:
                break
            at, mode = end.end(), CODE
        m = _ENDS.search(text, at)
        if not m:
            break
        at = m.end()
        if m[2]:
            depth += 1 if m[2] == "{" else -1
        elif m[1] in ('"""', "'''"):
            mode = DOUBLE if m[1] == '"""' else SINGLE
        elif m[3] and depth == 0:
            out.append((text[begin : m.start()], True))
            begin = at
    return [*out, (text[begin:], False)]


def _splits(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """The lines of each split, in order: rows of one split come together and in the order of the file."""
    now, lines = None, []
    for batch in batches:
        for file, block, value in zip(batch["file"], batch["block"], batch["value"], strict=True):
            if (file, block) != now:
                if now:
                    yield now, lines
                now, lines = (file, block), []
            lines.append(value)
    if now:
        yield now, lines


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _starts(lines: DataFrame) -> dict[tuple[str, int], tuple[int, int]]:
    """The states of the splits that don't begin between or inside plain statements: at most one a split, and mostly none."""
    marked = lines.filter(F.col("value").rlike("[{}]|\"\"\"|'''"))

    def effect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (file, block), held in _splits(batches):
            row: list = [file, block]
            for mode in (CODE, DOUBLE, SINGLE):
                depth = 0
                for line in held:
                    mode, depth = _after(line, mode, depth)
                row += [mode, depth]
            yield pd.DataFrame([row], columns=["file", "block", "m0", "d0", "m1", "d1", "m2", "d2"])

    def states(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        mode = depth = 0
        out = []
        for r in rows.sort_values("block").itertuples():
            out.append((key[0], r.block, mode, depth))
            if r.m0 is not None and not pd.isna(r.m0):
                mode, depth = (int(r.m0), depth + int(r.d0)) if mode == CODE else (int(r.m1), depth + int(r.d1)) if mode == DOUBLE else (int(r.m2), depth + int(r.d2))
        return pd.DataFrame(out, columns=["file", "block", "mode", "depth"])

    kind = "file string, block long, m0 int, d0 int, m1 int, d1 int, m2 int, d2 int"
    splits = lines.select(*_BLOCK).distinct()
    effects = splits.join(marked.mapInPandas(effect, kind), _BLOCK, "left")
    found = effects.groupBy("file").applyInPandas(states, "file string, block long, mode int, depth int").filter("mode <> 0 OR depth <> 0")
    return {(r["file"], r["block"]): (r["mode"], r["depth"]) for r in found.collect()}


def statements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, at, statement): the statements of N3 files and their places in them, from 1; rules among them."""
    lines = _lines(spark, path)
    begin = spark.sparkContext.broadcast(_starts(lines))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (file, block), held in _splits(batches):
            parts = cut("\n".join(held), *begin.value.get((file, block), (CODE, 0)))
            yield pd.DataFrame([(file, block, k, ends, text) for k, (text, ends) in enumerate(parts)], columns=["file", "block", "place", "ends", "text"])

    found = settle(lines.mapInPandas(pieces, _PIECES), "statements")
    in_file = Window.partitionBy("file").orderBy("block", "place")  # of a row or two a split
    before = found.groupBy(*_BLOCK).agg(F.sum(F.col("ends").cast("long")).alias("many"))
    before = before.select(*_BLOCK, (F.sum("many").over(Window.partitionBy("file").orderBy("block")) - F.col("many")).alias("before"))
    numbered = found.join(before, _BLOCK)
    whole = numbered.filter("place > 0 AND ends").select("file", (F.col("before") + F.col("place") + 1).alias("at"), F.col("text").alias("statement"))
    edges = found.filter("place = 0 OR NOT ends").withColumn("nth", F.sum(F.col("ends").cast("long")).over(in_file) - F.col("ends").cast("long"))
    # a statement's end is the first piece of a split; its place is what ended before that split, and one
    ended = numbered.filter("place = 0 AND ends").select("file", "block", (F.col("before") + 1).alias("at"))
    joined = edges.groupBy("file", "nth").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "place", "text"))), lambda x: x["text"]), "\n").alias("statement"), F.max(F.when(F.col("ends"), F.col("block"))).alias("block")
    )
    edge = joined.join(ended, _BLOCK, "left").select("file", F.coalesce("at", F.lit(-1)).alias("at"), "statement")
    return whole.unionByName(edge).filter(F.regexp_replace("statement", r"(?m)^\s*#.*$|\s+", "") != "")


_TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')
    |(?P<short>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<tag>@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^)
    |<(?P<iri>[^<>"{}|^`\\\s]*)>
    |(?P<mark>[;,\[\]()])
    |(?P<name>[^\s"'<>\#{};,.\[\]()^@]+(?:\.[^\s"'<>\#{};,.\[\]()^@]+)*|\.\d+(?:[eE][+-]?\d+)?)""",
    re.X | re.S,
)
_NUMBER = re.compile(r"[+-]?(?:\d+(?:\.\d+)?|\.\d+)(?:[eE][+-]?\d+)?|true|false")
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_PLAIN = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


def _unescaped(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _PLAIN.get(m[3], m[3]), text) if "\\" in text else text


class _Statement:
    """One statement taken apart; terms are (text, kind)."""

    def __init__(self, text: str, scope: str, at: int, spaces: dict[str, str]):
        self.text, self.scope, self.at, self.spaces = text, scope, at, spaces
        self.tokens: list[tuple[str, str]] = []
        place = 0
        while place < len(text):
            m = _TOKEN.match(text, place)
            if not m:
                raise ValueError(f"not a statement: {text!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[m.lastgroup]))
            place = m.end()
        self.k, self.blanks = 0, 0
        self.found: list[tuple[str, str, str, str]] = []

    def _next(self, *marks: str) -> bool:
        """Takes the next token if it is one of these marks."""
        if self.k < len(self.tokens) and self.tokens[self.k][0] == "mark" and self.tokens[self.k][1] in marks:
            self.k += 1
            return True
        return False

    def _blank(self) -> tuple[str, str]:
        self.blanks += 1
        return f"_:{self.scope}.{self.at}.{self.blanks}", "iri"

    def _full(self, iri: str) -> str:
        iri = urljoin(self.spaces["@base"], iri) if self.spaces.get("@base") else iri
        return iri.split("#")[1] if "#" in iri else iri

    def _term(self) -> tuple[str, str]:
        if self._next("["):
            node = self._blank()
            if not self._next("]"):
                self._predicates(node)
                self._expect("]")
            return node
        if self._next("("):
            items = []
            while not self._next(")"):
                items.append(self._term())
            nodes = [self._blank() for _ in items]
            for node, item, rest in zip(nodes, items, [*nodes[1:], ("nil", "iri")], strict=True):
                self.found += [(node[0], "first", *item), (node[0], "rest", *rest)]
            return nodes[0] if nodes else ("nil", "iri")
        if self.k >= len(self.tokens):
            raise ValueError(f"not a statement: {self.text!r}")
        kind, value = self.tokens[self.k]
        self.k += 1
        if kind in ("long", "short"):
            if self.k < len(self.tokens) and self.tokens[self.k][0] == "tag":  # a language, or a type and its name
                self.k += 2 if self.tokens[self.k][1] == "^^" else 1
            return _unescaped(value[3:-3] if kind == "long" else value[1:-1]), "literal"
        if kind == "iri":
            return self._full(_unescaped(value)), "iri"
        if kind == "name":
            if value == "a":
                return TYPE, "iri"
            if _NUMBER.fullmatch(value):
                return value, "literal"
            prefix, colon, local = value.partition(":")
            if prefix == "_" and colon:
                return f"_:{self.scope}.{local}", "iri"
            if colon and prefix in self.spaces:
                return self._full(self.spaces[prefix] + local.replace("\\", "")), "iri"
            if colon:
                raise ValueError(f"unknown prefix in {value}")
        raise ValueError(f"not a statement: {self.text!r}")

    def _expect(self, mark: str) -> None:
        if not self._next(mark):
            raise ValueError(f"not a statement: {self.text!r}")

    def _predicates(self, subject: tuple[str, str]) -> None:
        while True:
            predicate = self._term()
            while True:
                self.found.append((subject[0], predicate[0], *self._term()))
                if predicate[1] != "iri":
                    raise ValueError(f"a literal can't be a predicate: {self.text!r}")
                if not self._next(","):
                    break
            if not self._next(";"):
                return
            while self._next(";"):
                pass
            if self.k >= len(self.tokens) or self.tokens[self.k] == ("mark", "]"):
                return

    def triples(self) -> list[tuple[str, str, str, str]]:
        alone = self.tokens[:1] == [("mark", "[")]
        subject = self._term()
        if subject[1] != "iri":
            raise ValueError(f"a literal can't be a subject: {self.text!r}")
        if not (alone and self.k == len(self.tokens)):  # [ ... ] may stand for itself
            self._predicates(subject)
        if self.k != len(self.tokens):
            raise ValueError(f"not a statement: {self.text!r}")
        return self.found


_DIRECTIVE = r"(?is)^\s*(?:#[^\n]*\n\s*)*@?(prefix|base)\b\s*([^\s:<]*)\s*:?\s*<([^>]*)>\s*$"
_RULE = r"(?s)^\s*(?:#[^\n]*\n\s*)*\{"


def _namespaces(found: DataFrame) -> dict[str, dict[str, tuple[list[int], list[str]]]]:
    """By file and prefix: from where on it stands for what.  As many as the files declare."""
    group = lambda k: F.regexp_extract("statement", _DIRECTIVE, k)
    rows = found.filter(F.col("statement").rlike(_DIRECTIVE)).select("file", "at", F.lower(group(1)).alias("kind"), group(2).alias("prefix"), group(3).alias("space")).collect()
    out: dict[str, dict[str, tuple[list[int], list[str]]]] = {}
    for r in sorted(rows, key=lambda r: r["at"]):
        ats, spaces = out.setdefault(r["file"], {}).setdefault("@base" if r["kind"] == "base" else r["prefix"], ([], []))
        ats.append(r["at"])
        spaces.append(r["space"])
    return out


def read_n3(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The set of triples in N3 files; rules are left out (rules_in() has them).

    Understands @prefix and @base (of the file, from their place on), 'a', ';' and ',' lists, several statements a line, IRIs, names,
    blank nodes (_:b, [ ... ], which are resources named by file and place), ( ... ) collections, numbers, truth values, and strings of all four kinds of
    quotes with their escapes; a string's language and type are read over.  A last statement needs no dot if nothing
    follows.  Empty files have no triples.  Anything else, and prefixes that a file doesn't declare, are errors when the triples are used.
    However Spark cuts the files, the triples are the same.
    """
    found = settle(statements(spark, path), "statements")
    spaces = spark.sparkContext.broadcast(_namespaces(found))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple[str, str, str, str]] = []
            for file, at, statement in zip(batch["file"], batch["at"], batch["statement"], strict=True):
                now = {}
                for prefix, (ats, names) in spaces.value.get(file, {}).items():
                    k = bisect_left(ats, at if at > 0 else 1 << 62)
                    if k:
                        now[prefix] = names[k - 1]
                rows += _Statement(statement, f"{crc32(file.encode()):08x}", at, now).triples()
            yield pd.DataFrame(rows, columns=COLUMNS)

    plain = found.filter(~F.col("statement").rlike(_DIRECTIVE) & ~F.col("statement").rlike(_RULE))
    return plain.mapInPandas(parse, SCHEMA).distinct()


def rules_in(spark: SparkSession, path: str | list[str]) -> str:
    """The text of the rules in N3 files, for operators.rules: as much of it as there are rules."""
    found = statements(spark, path).filter(F.col("statement").rlike(_RULE))
    return " .\n".join(r["statement"] for r in found.orderBy("file", "at").collect())
