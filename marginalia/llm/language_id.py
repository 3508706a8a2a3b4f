"""The language of every text, and of every word of texts that switch between languages, by a conditional random field.

The field (crf.py) is fitted in the driver on a bounded sample and labels the words of whole texts in Arrow
batches.  A text's language is the one with the largest mean probability over its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import crf
from . import words as W
from .columns import add_struct, free_name
from .scratch import settle

SAMPLE_ROWS = 2400
#: Bytes of text that the sample holds at most.
SAMPLE_BYTES = 16_000_000
#: Bytes of a text that are one chain; a longer text is several, which count together.
PIECE_BYTES = 4_000_000
UNKNOWN = "und"

_SPAN = T.StructType([T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False), T.StructField("lang", T.StringType(), False)])


def sample(docs: DataFrame, usable: Column, rows: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES, key: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """About equally many texts of each language with their languages: at most ``rows`` of ``max_bytes`` together, the same ones on every run.

    Which keys are taken depends on a hash of the key alone.  Null keys, texts and languages are no examples; of several
    documents with one key and language the least text counts.  A text that doesn't fit into what is left of the bytes is
    passed over.  Languages are counted in Spark; their number, which the model holds as well, is what the driver gets.
    """
    order = F.xxhash64(F.lit(29), F.col("key"))
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"), usable.alias("usable"))
    own = own.filter("usable AND key IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").drop("usable")
    many = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not many:
        return []
    share = {y: min(1.0, rows / len(many) / n) for y, n in many.items()}
    shares = docs.sparkSession.createDataFrame(list(share.items()), "lang string, share double")
    drawn = own.join(F.broadcast(shares), "lang").filter(F.pmod(order, F.lit(1 << 30)) < F.col("share") * (1 << 30))
    found = settle(drawn.groupBy("key", "lang").agg(F.min("text").alias("text")).orderBy(order, "lang").limit(rows), "languages")
    sizes = found.select("key", "lang", F.octet_length("text").alias("size"), order.alias("order")).collect()
    fits, left = [], max_bytes
    for r in sorted(sizes, key=lambda r: (r["order"], r["lang"])):
        if r["size"] <= left:
            fits.append((r["key"], r["lang"]))
            left -= r["size"]
    wanted = docs.sparkSession.createDataFrame(fits, found.select("key", "lang").schema)
    return [(r["text"], r["lang"]) for r in sorted(found.join(F.broadcast(wanted), ["key", "lang"]).collect(), key=lambda r: (r["lang"], r["key"]))]


def fit(docs: DataFrame, usable: Column, rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text", lang: str = "lang") -> crf.Tagger:
    """Fit on the texts and languages of at most ``rows`` documents for which ``usable`` holds.  Without any, no language is known."""
    return crf.fit(sample(docs, usable, rows, key=key, text=text, lang=lang))


def _pieces(raw: bytes) -> list[bytes]:
    """Pieces of at most PIECE_BYTES, cut after a byte that is no letter where there is one."""
    out = []
    while len(raw) > PIECE_BYTES:
        ends = np.flatnonzero(~W.LETTERS[np.frombuffer(raw[:PIECE_BYTES], np.uint8)])
        cut = int(ends[-1]) + 1 if len(ends) else PIECE_BYTES
        out.append(raw[:cut])
        raw = raw[cut:]
    return [*out, raw]


def _labelled(model: crf.Tagger, texts: list[str | None]) -> Iterator[tuple[np.ndarray, W.Words, np.ndarray]]:
    """For some texts at a time: which text each piece is of, the words of the pieces, and P(label) of every word."""
    for i, j, raw in W.chunks(texts, lower=True):
        whole = sum(map(len, raw)) <= PIECE_BYTES
        for owner, held in [(np.arange(i, j), raw)] if whole else [(np.array([d]), [p]) for d, r in enumerate(raw, i) for p in _pieces(r)]:
            found = W.split_words(held, W.LETTERS)
            yield owner, found, model.posteriors(found)


def _spans(found: W.Words, p: np.ndarray, labels: list[str], piece: int, base: int) -> list[dict]:
    """Runs of words of one language in one piece, in code points from ``base``."""
    a, b = found.first[piece], found.first[piece + 1]
    if a == b:
        return []
    best = p[a:b].argmax(1)
    cuts = np.flatnonzero(np.diff(best)) + 1
    heads, tails = np.concatenate([[0], cuts]) + a, np.concatenate([cuts, [b - a]]) + a - 1
    return [(base + int(found.starts[h]), base + int(found.ends[t]), labels[best[h - a]]) for h, t in zip(heads, tails, strict=True)]


def annotate(docs: DataFrame, model: crf.Tagger, text: str = "text", spans: bool = False) -> tuple[DataFrame, str]:
    """``docs`` with a struct column (lang, score), and that column's name.

    ``score`` is the mean probability of ``lang`` over the words.  Where a text is null or has no letter, or the model
    knows no language, ``lang`` is ``und`` and ``score`` 0.  With ``spans`` a third field has the runs of words of one
    language: (start, end, lang), code points, end exclusive.  Texts are read whole; one of more than PIECE_BYTES is several chains.  Rows
    are labelled one by one: repeated rows, null ids and other columns stay as they are.
    """
    name, letters = free_name(docs, "language"), free_name(docs, "letters")
    fields = [T.StructField("lang", T.StringType(), False), T.StructField("score", T.DoubleType(), False)]
    kind = T.StructType(fields + [T.StructField("spans", T.ArrayType(_SPAN), False)] * spans)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        tagger = shared.value
        k = len(tagger.labels)

        def label(texts: list, has_letter: list) -> dict[str, list]:
            ok = np.array([bool(x) for x in has_letter]) & (k > 0)
            sums, many = np.zeros((len(texts), max(1, k))), np.zeros(len(texts), np.int64)
            runs: list[list] = [[] for _ in texts]
            done = [0] * len(texts)  # bytes of a text in earlier pieces
            for owner, found, p in _labelled(tagger, [t if x else None for t, x in zip(texts, ok, strict=True)]) if k else ():
                np.add.at(sums, owner[found.doc_of()], p)
                np.add.at(many, owner, found.counts)
                if spans:
                    begin = 1
                    for piece, d in enumerate(owner):
                        size = len(found.buffer) - 2 if len(owner) == 1 else len(W.encode(texts[d]) if ok[d] else b"")
                        runs[d] += _spans(found, p, tagger.labels, piece, done[d] - begin)
                        done[d] += size
                        begin += size + 1
            best = sums.argmax(1)
            score = sums[np.arange(len(texts)), best] / np.maximum(1, many)
            out = {"lang": [tagger.labels[b] if x else UNKNOWN for b, x in zip(best, ok, strict=True)], "score": np.where(ok, np.minimum(1.0, score), 0.0).tolist()}
            if spans:
                out["spans"] = [_in_code_points(W.encode(t), r) for t, r in zip(texts, runs, strict=True)]
            return out

        return label

    marked = docs.withColumn(letters, F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False)))
    return add_struct(marked, [text, letters], name, kind, make).drop(letters), name


def _in_code_points(raw: bytes, runs: list[tuple[int, int, str]]) -> list[dict]:
    if not runs:
        return []
    before = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [{"start": int(before[a]), "end": int(before[b]), "lang": y} for a, b, y in runs]
