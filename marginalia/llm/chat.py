"""Chat formatting in Spark expressions alone.

The turns of a conversation are collected and sorted as structs; adjacent turns of one role form a
block, inside which a separator keeps the turns apart, so that the format can be read back.
Texts and roles are escaped: backslashes are doubled and every control string gets a
backslash behind its first character; dropping single backslashes undoes it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: role -> (before a block, after it)
BLOCKS = {"system": ("<<SYS>> ", " <</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>\n")}
OTHER = ("<|", "|> ", " <|end|>\n")
BETWEEN = "<|turn|>"
CONTROL = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<|", "|>")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _opening(role: Column) -> Column:
    out = F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1]))
    for name, (before, _) in BLOCKS.items():
        out = F.when(role == name, F.lit(before)).otherwise(out)
    return out


def _closing(role: Column) -> Column:
    out = F.lit(OTHER[2])
    for name, (_, after) in BLOCKS.items():
        out = F.when(role == name, F.lit(after)).otherwise(out)
    return out


def format_chats(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row a conversation: its formatted text and the spans (start, length in code points) under the loss mask.

    Null texts and roles are empty; null conversation ids form one conversation; turns of the same
    number are ordered by role and text, repeated rows stay, null numbers come first.  Other columns
    are dropped.  An empty table gives an empty result.  A conversation is one string, so its turns
    meet in one task; nothing else is gathered.
    """
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    told = turns.groupBy(F.col(conv).alias("conv")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    changes = lambda i, j: F.coalesce(F.get("turns", i)["role"] != F.get("turns", j)["role"], F.lit(True))
    pieces = F.transform(
        "turns",
        lambda t, i: F.struct(
            F.when(changes(i, i - 1), _opening(t["role"])).otherwise(F.lit(BETWEEN)).alias("before"),
            escape(t["text"]).alias("text"),
            F.when(changes(i, i + 1), _closing(t["role"])).otherwise(F.lit("")).alias("after"),
            (t["role"] == learn).alias("learn"),
        ),
    )
    told = told.select("conv", pieces.alias("pieces"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("spans"))

    def step(held: Column, p: Column) -> Column:
        begin, size = held["at"] + F.length(p["before"]), F.length(p["text"]).cast("long")
        span = F.struct(begin.alias("start"), size.alias("length"))
        return F.struct((begin + size + F.length(p["after"])).alias("at"), F.when(p["learn"], F.array_append(held["spans"], span)).otherwise(held["spans"]).alias("spans"))

    joined = F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"], p["after"])), "")
    return told.select(F.col("conv").alias(conv), joined.alias("formatted"), F.aggregate("pieces", start, step)["spans"].alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) for each turn, in order: the inverse of the format."""
    quote = lambda s: re.sub(r"([\[\]|<>/])", r"\\\1", s)
    kinds = [f"{quote(a)}.*?{quote(b)}" for a, b in BLOCKS.values()] + [f"{quote(OTHER[0])}.*?{quote(OTHER[1])}.*?{quote(OTHER[2])}"]
    blocks = F.regexp_extract_all(formatted, F.lit("(?s)(" + "|".join(kinds) + ")"), F.lit(1))

    def read(block: Column) -> Column:
        name = F.substring_index(F.substring_index(block, OTHER[1], 1), OTHER[0], -1)
        role, body = unescape(name), F.substring(block, F.length(name) + len(OTHER[0] + OTHER[1]) + 1, F.length(block) - F.length(name) - len("".join(OTHER)))
        for known, (a, b) in BLOCKS.items():
            here = F.startswith(block, F.lit(a))
            role = F.when(here, F.lit(known)).otherwise(role)
            body = F.when(here, F.substring(block, F.lit(len(a) + 1), F.length(block) - len(a + b))).otherwise(body)
        return F.transform(F.split(body, quote(BETWEEN), -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, read))


def loss_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")
