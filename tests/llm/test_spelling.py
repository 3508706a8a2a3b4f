import random
import re
from collections import Counter
from zlib import crc32

import pytest

from marginalia.llm import spelling
from marginalia.llm.automaton import Automaton

DOCS = "doc_id long, text string, word string, n long, h string"


def counted(docs, slips=97):
    many = Counter()
    for i, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if i is None else i}:{low}".encode())
            if h % slips == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            many[low] += 1
    return {w: n for w, n in many.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def expected(words):
    rows = {}
    for w, n in words.items():
        close = sorted((-words[x], x) for x in words if near(w, x))
        form = close[0][1] if close and -close[0][0] >= 2 * n else None
        rows[w] = [n, len(close), form, words[form] if form else None]
    for w, row in rows.items():
        root = w
        while rows[root][2]:
            root = rows[root][2]
        row.append(root)
    return rows


def corpus():
    rng = random.Random(6)
    stems = ["".join(rng.choice(["an", "th", "é", "ss", "À", "oo", "Ÿ", "r", "ß", "ÿ"]) for _ in range(rng.randint(2, 6))) for _ in range(60)]
    stems += ["abbey" + "xyzuv"[k % 5] * (k % 3) + "qrstw"[k % 4] for k in range(40)] + ["aaaaa", "aaaaaa", "aaaaaaa", "aabaa"]
    docs = []
    for i in range(250):
        words = []
        for _ in range(40):
            w = rng.choice(stems[: rng.randint(1, len(stems))])
            if rng.random() < 0.2:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("anthe") + w[k:], w[:k] + "x" + w[k + 1 :], w.upper()])
            words.append(w)
        docs.append((i, ", ".join(words), "a", 1, "b"))
    return docs + [(None, docs[3][1], None, None, None), (None, None, None, None, None), (7, "", "", 1, ""), (3, docs[3][1], "", 1, ""), (9, "tiger, " * 20_000 + "tigers " * 90 + "tigerss tigersst " * 9, "", 1, "")]


@pytest.mark.parametrize("shared", [2000, 6])
def test_variants_against_brute_force(spark, shared, monkeypatch):
    monkeypatch.setattr(spelling, "SHARED", shared)
    monkeypatch.setattr(spelling, "BUCKET", 300)
    docs = corpus()
    words = spelling.word_counts(spark.createDataFrame(docs, DOCS), slips=97)
    want = expected(counted(docs))
    assert {r["word"]: r["n"] for r in words.collect()} == {w: row[0] for w, row in want.items()}
    got = {r["word"]: [r["n"], r["n_near"], r["form"], r["form_n"], r["root"]] for r in spelling.variants(words).collect()}
    assert got == want
    assert sum(row[1] > 0 for row in want.values()) > 100 and any(row[4] not in (w, row[2]) for w, row in want.items())


def test_crowded_halves_are_cut_until_one_letter_is_left(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SHARED", 3)
    rng = random.Random(2)
    words = {"prefix" + "".join(rng.choice("abc") for _ in range(5)) for _ in range(150)} | {"p" + "".join(rng.choice("ab") for _ in range(5)) + "suffix" for _ in range(30)}
    table = spark.createDataFrame([(w, 5) for w in sorted(words)], "word string, n long")
    spread = spelling._spread(table)
    crowds = spread.filter("left > 1").groupBy("backward", "exact", "longer").count().agg({"count": "max"}).first()[0]
    assert crowds <= 3
    got = {(r["word"], r["near"]) for r in spelling.near_pairs(table).collect()}
    assert got == {(a, b) for a in words for b in words if near(a, b)}


def test_automaton_is_minimal_and_numbers_its_words():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(300)})
    automaton = Automaton(words)
    assert [automaton.number(w) for w in words] == list(range(len(words))) and len(automaton) == len(words)
    assert all(automaton.number(w + "c") is None for w in words if w + "c" not in words)
    ends = {w[:k]: frozenset(x[k:] for x in words if x.startswith(w[:k])) for w in words for k in range(len(w) + 1)}
    assert len(automaton.steps) == len(set(ends.values()))  # as many states as there are different sets of endings
    for q in words[:80]:
        for k in range(len(q) + 1):
            found = [words[n] for n in automaton.one_error(q[:k], q[k:])]
            assert set(found) == {w for w in words if w[:k] == q[:k] and len(w) <= len(q) and near(q, w) and near(q[k:], w[k:])}


def test_empty_tables(spark):
    docs = spark.createDataFrame(corpus(), DOCS)
    assert spelling.variants(spelling.word_counts(docs.limit(0), slips=97)).count() == 0
    one = spelling.variants(spark.createDataFrame([("alone", 3)], "word string, n long")).collect()
    assert [tuple(one[0][c] for c in ("word", "n", "n_near", "form", "form_n", "root"))] == [("alone", 3, 0, None, None, "alone")]
