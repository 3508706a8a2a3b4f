"""Alignment of passages with the paragraphs of a parallel text, both in order.

Spark classifies the paragraphs by their marks and puts the texts together; in between, a small
loop over a part's passages and marks decides which run of paragraphs each passage takes.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import labels as L
from marginalia.functions.roman import lookup, to_roman

# What a paragraph's beginning tells.
MARKS = {
    "boundary": r"(?i)^(DEFINITIONES(?: AFFECTUUM)?|AFFECTUUM DEFINITIONES|AXIOMATA|AXIOMA(?:\s+[IVXLCDM]+)?|POSTULATA|PROPOSITIO\s+[IVXLCDM]+|LEMMA\s+[IVXLCDM]+|DEMONSTRATIO|ALITER|COROLLARIUM(?:\s+[IVXLCDM]+)?|SCHOLIUM(?:\s+[IVXLCDM]+)?|EXPLICATIO|APPENDIX|CAPUT\s+[IVXLCDM]+|AFFECTUUM GENERALIS DEFINITIO|[IVXLCDM]+\.)",
    "boundary_but_aliter": r"(?i)^(DEFINITIONES(?: AFFECTUUM)?|AFFECTUUM DEFINITIONES|AXIOMATA|AXIOMA(?:\s+[IVXLCDM]+)?|POSTULATA|PROPOSITIO\s+[IVXLCDM]+|LEMMA\s+[IVXLCDM]+|DEMONSTRATIO|COROLLARIUM(?:\s+[IVXLCDM]+)?|SCHOLIUM(?:\s+[IVXLCDM]+)?|EXPLICATIO|APPENDIX|CAPUT\s+[IVXLCDM]+|AFFECTUUM GENERALIS DEFINITIO|[IVXLCDM]+\.)",
    "structure": r"(?i)^(DEFINITIONES(?: AFFECTUUM)?|AFFECTUUM DEFINITIONES|AXIOMATA|AXIOMA(?:\s+[IVXLCDM]+)?|POSTULATA|PROPOSITIO\s+[IVXLCDM]+|LEMMA\s+[IVXLCDM]+|APPENDIX|AFFECTUUM GENERALIS DEFINITIO)(?:\b|:)",
    "caput": r"(?i)^CAPUT\s+[IVXLCDM]+\s*:?\s*",
    "heading preface": r"(?i)^PR(?:AE|Æ|E)FATIO$",
    "heading definitions": r"(?i)^DEFINITIONES$",
    "heading definitions_of_emotions": r"(?i)^DEFINITIONES AFFECTUUM$",
    "heading axioms": r"(?i)^AXIOMATA$",
    "heading physical_axioms": r"(?i)^AXIOMATA$",
    "heading postulates": r"(?i)^POSTULATA$",
    "inner proof": r"(?i)^(DEMONSTRATIO|ALITER)\b",
    "inner corollary": r"(?i)^COROLLARIUM(?:\s+[IVXLCDM]+)?\b",
    "inner note": r"(?i)^SCHOLIUM(?:\s+[IVXLCDM]+)?\b",
    "inner explanation": r"(?i)^EXPLICATIO\b",
    "other axiom": r"(?i)^AXIOMA\s+[IVXLCDM]+\b",
    "other definition": r"(?i)^DEFINITIO\b",
    "part": r"(?i)^PARS\b",
    "capitals": r"^[A-ZÆŒ\s.;:'-]+$",
    "known": r"(?i)^(DEFINITIONES(?: AFFECTUUM)?|AFFECTUUM DEFINITIONES|AXIOMATA|AXIOMA|POSTULATA|PR(?:AE|Æ|E)FATIO|PROPOSITIO|LEMMA|DEMONSTRATIO|ALITER|COROLLARIUM|SCHOLIUM|EXPLICATIO|APPENDIX|AFFECTUUM GENERALIS DEFINITIO)\b",
}
# What begins a passage; the last group is its text.
LABELS = {
    "preface": r"(?i)^PR(?:AE|Æ|E)FATIO\s*:?\s*(.*)$",
    "appendix": r"(?i)^APPENDIX\s*:?\s*(.*)$",
    "general": r"(?i)^AFFECTUUM GENERALIS DEFINITIO\s*:?\s*(.*)$",
    "axiom": r"(?i)^AXIOMA\s*:?\s*(.*)$",
    "numbered": r"(?i)^(?:[IVXLCDM]+)\.\s*(.*)$",
    "proposition": r"(?i)^PROPOSITIO\s+[IVXLCDM]+\s*:?\s*(.*)$",
    "lemma": r"(?i)^LEMMA\s+[IVXLCDM]+\s*:?\s*(.*)$",
    "proof": r"(?i)^(?:DEMONSTRATIO|ALITER)\s*:?\s*(.*)$",
    "corollary": r"(?i)^COROLLARIUM(?:\s+[IVXLCDM]+)?\s*:?\s*(.*)$",
    "note": r"(?i)^SCHOLIUM(?:\s+[IVXLCDM]+)?\s*:?\s*(.*)$",
    "explanation": r"(?i)^EXPLICATIO\s*:?\s*(.*)$",
}


def marks(paragraph: Column) -> Column:
    """Array of the names of the marks and labels that a paragraph begins with."""
    named = [F.when(paragraph.rlike(p), F.lit(n)) for n, p in MARKS.items()] + [F.when(paragraph.rlike(p), F.lit(f"is {n}")) for n, p in LABELS.items()]
    return F.filter(F.array(*named), lambda x: x.isNotNull())


def _steps(elements: pd.DataFrame, paras: pd.DataFrame) -> list[tuple]:
    """(id, first, last, label) for the passages of one part that take paragraphs first to last."""
    seen: list[set[str]] = [set(m) for m in paras["marks"]]
    numeral, caput = paras["numeral"].tolist(), paras["caput"].tolist()
    end, at, out = len(seen), 0, []

    def until(start: int, stop: Callable[[set[str]], bool]) -> int:
        while start < end and not stop(seen[start]):
            start += 1
        return start

    def is_(*names: str) -> Callable[[set[str]], bool]:
        return lambda m: any(n in m for n in names)

    at = until(0, lambda m: not ("part" in m or ("capitals" in m and "known" not in m)))
    for e in elements.itertuples():
        headings = {f"heading {e.section_kind}"} - {"heading preface"} | ({"heading preface"} if e.type == "preface" else set())
        at = until(at, lambda m, h=headings: not m & h)
        for kinds in ("inner", "other"):
            while at < end and any(m.startswith(kinds) and m != f"{kinds} {e.type}" for m in seen[at]):
                at = until(at + 1, is_("boundary"))
        here = seen[at] if at < end else set()
        label, first, stop = e.type, at + 1, is_("boundary")
        found = f"is {e.type}" in here
        if e.type == "preface":
            stop, label, first = is_("structure"), label if found else None, at + 1 if found else at
            found = True
        elif e.type == "appendix" and e.id.endswith(".introduction"):
            stop = is_("caput")
        elif e.type == "appendix" and ".appendix.chapter." in e.id:
            label, found = "caput", at < end and bool(caput[at]) and caput[at].startswith(e.roman or "?")
        elif e.type == "appendix":
            stop = lambda m: False
        elif e.id.endswith(".general_definition.note"):
            inline = "is general" in here
            bare = inline and paras["bare"].iloc[at]
            label, first = ("general", at + 1) if inline else (None, at)
            stop, found = is_("structure") if bare or not inline else (lambda m: True), True
        elif e.type in ("definition", "postulate") or (e.type == "axiom" and not found):
            label, found = "numbered", "is numbered" in here and (not e.number or numeral[at] == e.roman)
        elif e.type == "corollary":
            stop = is_("boundary_but_aliter")
        if found and (label is None or at < end):
            begin, at = at, until(first, stop)
            if at > begin:
                out.append((e.id, begin, at - 1, label))
    return out


def align(passages: DataFrame, paragraphs: DataFrame, part: str = "part_number") -> DataFrame:
    """(part, id, text): the parallel text of passages that have one.

    ``passages`` need part, id, type, section_kind, number, sort_index, is_editorial; editorial ones have no
    counterpart.  ``paragraphs`` need part, pos, paragraph.  Passages and paragraphs are gone through in order; blocks
    that no passage waits for are left out, and a passage whose block isn't next gets none.  A part
    goes to one task, without its texts.
    """
    roman = F.when(F.col("id").rlike(r"\.appendix\.chapter\.\d+$"), to_roman(F.regexp_extract("id", r"(\d+)$", 1).try_cast("int"))).otherwise(to_roman(F.col("number").try_cast("int")))
    wanted = passages.filter(~F.coalesce("is_editorial", F.lit(False))).select(F.col(part).alias("part"), "id", "type", "section_kind", F.coalesce("number", F.lit("")).alias("number"), roman.alias("roman"), "sort_index")
    text = F.col("paragraph")
    seen = paragraphs.select(
        F.col(part).alias("part"),
        "pos",
        marks(text).alias("marks"),
        F.upper(F.regexp_extract(text, r"(?i)^([IVXLCDM]+)\.", 1)).alias("numeral"),
        F.upper(F.regexp_extract(text, r"(?i)^CAPUT\s+([IVXLCDM]+)", 1)).alias("caput"),
        text.rlike("(?i)^AFFECTUUM GENERALIS DEFINITIO$").alias("bare"),
    )

    def run(key: tuple, elements: pd.DataFrame, paras: pd.DataFrame) -> pd.DataFrame:
        paras = paras.sort_values("pos")
        pos = paras["pos"].tolist()
        steps = _steps(elements.sort_values("sort_index"), paras)
        return pd.DataFrame([(key[0], i, pos[a], pos[b], n) for i, a, b, n in steps], columns=["part", "id", "first", "last", "label"])

    kind = passages.schema[part].dataType.simpleString()
    taken = wanted.groupBy("part").cogroup(seen.groupBy("part")).applyInPandas(run, f"part {kind}, id string, first int, last int, label string")
    rows = taken.withColumn("pos", F.explode(F.sequence("first", "last"))).join(wanted.select("part", "id", "roman"), ["part", "id"])
    rows = rows.join(paragraphs.select(F.col(part).alias("part"), "pos", "paragraph"), ["part", "pos"])
    pattern = F.when(F.col("label") == "caput", F.concat(F.lit(r"(?i)^CAPUT\s+"), "roman", F.lit(r"\s*:?\s*(.*)$"))).otherwise(lookup(LABELS, F.col("label")))
    piece = F.when((F.col("pos") == F.col("first")) & F.col("label").isNotNull(), F.call_function("regexp_extract", F.col("paragraph"), pattern, F.lit(1))).otherwise(F.col("paragraph"))
    pieces = F.sort_array(F.collect_list(F.struct("pos", L.trim(piece).alias("text"))))
    joined = F.array_join(F.filter(F.transform(pieces, lambda x: x["text"]), lambda t: t != ""), "\n\n")
    return rows.groupBy("part", "id").agg(joined.alias("text")).filter("text <> ''")


def unaligned(passages: DataFrame, aligned: DataFrame) -> DataFrame:
    """(id): passages without parallel text that should have one."""
    return passages.filter(~F.coalesce("is_editorial", F.lit(False))).select("id").join(aligned.select("id"), "id", "left_anti")


def complete(passages: DataFrame, aligned: DataFrame) -> DataFrame:
    """``aligned``; using it raises an error that names the least passage without parallel text, if one should have it."""
    missing = unaligned(passages.filter("text <> ''"), aligned).agg(F.min("id").alias("_missing"), F.count("*").alias("_n"))
    problem = F.concat(F.lit("no parallel text for "), F.col("_n").cast("string"), F.lit(" passages, the first of which is "), "_missing")
    fields = [F.raise_error(problem).cast(f.dataType).alias(f.name) for f in aligned.schema]
    return aligned.unionByName(missing.filter("_n > 0").select(*fields))
