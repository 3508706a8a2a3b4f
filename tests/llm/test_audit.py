import random
import re
from itertools import permutations

import duckdb
import pandas as pd

from marginalia.llm import audit
from marginalia.llm.oracle import FILTER_AUDIT

DOCS = "doc_id long, text string, source string, part string, n long, mask string"
LABELS = "doc_id long, quality int, toxic int"


def tables():
    rng = random.Random(5)
    words = ["one", "Two", "THREE", "four#", "fünf", "six|", "seven", "EIGHT", "nine", "ten"]
    texts = [None, "", " \t\n", "x " * 30_000, "Ab" * 40_000] + [" ".join(rng.choice(words[: rng.randint(2, 10)]) + str(rng.randint(0, 9)) * (k % 2) for _ in range(rng.choice([3, 49, 50, 51, 80]))) for k in range(60)]
    docs = [(k, rng.choice(texts[:20] if k % 3 else texts), rng.choice([None, "", "a", "b", "hot", "hot", "hot"]), "p", 1, "m") for k in range(300)]
    docs += [(None, texts[7], "a", "p", 1, "m"), (None, texts[7], "b", "p", 1, "m"), (-5, texts[7], "hot", "p", 1, "m"), (-5, texts[7], "hot", "p", 1, "m"), (12, texts[8], "a", "p", 1, "m"), (12, texts[8], "a", "p", 1, "m")]
    docs += [(1000 + k, texts[9], "hot", "p", 1, "m") for k in range(150)]  # a third of the rows have one text
    labels = [(rng.randrange(320), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(200)] + [(None, 1, 1)]
    return docs, labels


def expected(docs, labels):
    first = {}
    for i, text, *_ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good, toxic = ({i for i, *marks in labels if marks[k] == 1 and i is not None} for k in (0, 1))
    rows = []
    for i, text, source, *_ in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        rows.append((source or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out = {}
    for order in permutations("ABCDE"):
        for k, f in enumerate(order):
            for part in {r[0] for r in rows}:
                own = [r for r in rows if r[0] == part]
                here = [r for r in own if f in r[1] and not r[1] & set(order[:k])]
                out[part, "".join(order), k + 1] = [sum(not r[1] & set(order[: k + 1]) for r in own), len(here), sum(f in r[1] for r in own) - len(here), sum(r[1] == {f} for r in own), sum(r[2] for r in here), sum(r[3] for r in here)]
    by_filter = {}
    for (part, order, step), row in out.items():
        by_filter[part, order[step - 1]] = by_filter.get((part, order[step - 1]), 0) + row[1]
    return {k: tuple(row + [by_filter[k[0], k[1][k[2] - 1]]]) for k, row in out.items()}


def test_audit_against_brute_force_and_sql(spark):
    docs, labels = tables()
    d, lb = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    got = {(r[0], r[1], r[2]): tuple(r)[3:] for r in audit.audit(audit.histogram(d, lb)).collect()}
    want = expected(docs, labels)
    assert got == want and len(got) == 4 * 600
    db = duckdb.connect()
    db.register("documents", pd.DataFrame(docs, columns=["doc_id", "text", "source", "part", "n", "mask"]).astype({"doc_id": "Int64"}))
    db.register("labels", pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).astype("Int64"))
    assert {(r[0], r[1], r[2]): r[3:] for r in db.sql(FILTER_AUDIT).fetchall()} == want


def test_empty_tables(spark):
    docs, labels = tables()
    d, lb = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    assert audit.audit(audit.histogram(d.limit(0), lb)).count() == 0
    rows = audit.histogram(d, lb.limit(0)).collect()
    assert sum(r["n"] for r in rows) == len(docs) and not any(r["good"] or r["toxic"] for r in rows)
