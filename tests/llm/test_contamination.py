import hashlib
import random

from marginalia.llm import contamination as C

DOCS = "doc_id long, text string, n_words string"
ITEMS = "item_id long, text string"


def rows(found, c):
    from pyspark.sql import functions as F

    r = found.select("doc_id", f"{c}.n_words", C.n_hit(c).alias("n_hit"), f"{c}.items", C.is_contaminated(c).alias("bad"), f"{c}.longest").collect()
    return {x[0]: (x[1], x[2], len(x[3]), hashlib.sha256(",".join(x[3]).encode()).hexdigest(), x[4]) for x in r}


def fixture():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["été", "x1", "the"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(rng.choice([1, 2, 3, 12, 13, 14, 30, 60]))) for i in range(30)] + [(90, None), (91, ""), (92, "Only, w1"), (3, prose(20))]
    docs = []
    for i in range(120):
        text = prose(rng.choice([0, 3, 40, 200]))
        if rng.random() < 0.6:
            item = (rng.choice(items)[1] or "").split()
            a = rng.randrange(max(1, len(item) - 13))
            text += ", " + "! ".join(item[a : a + rng.choice([12, 13, 20, 99])]).upper() + "\n" + prose(20)
        docs.append((i, text, "x"))
    docs += [(200, None, None), (201, "", ""), (202, "w1 " * 3000, "")]
    return docs, items


def test_matches_brute_force(spark):
    docs, items = fixture()
    found, c = C.annotate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert rows(found, c) == C.brute_force([d[:2] for d in docs], items)


def test_benchmark_in_many_blocks(spark):
    docs, items = fixture()
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS).coalesce(1)
    one, c = C.annotate(d, b)
    many, m = C.annotate(d, b, block_bytes=900)
    assert rows(many, m) == rows(one, c)


def test_empty_tables_and_repeated_rows(spark):
    items = spark.createDataFrame([], ITEMS)
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, None)], DOCS)
    found, c = C.annotate(docs, items)
    assert found.count() == 3 and found.filter(C.is_contaminated(c)).count() == 0
    found, _ = C.annotate(docs.limit(0), spark.createDataFrame([(1, "a")], ITEMS))
    assert found.count() == 0
    assert C.remove_contaminated(docs, spark.createDataFrame([(1, "A, B")], ITEMS)).columns == docs.columns


def test_longest_match(spark):
    item = " ".join(f"v{i}" for i in range(40))
    docs = [(1, "x y " + " ".join(f"v{i}" for i in range(5, 30)) + " z", ""), (2, item, "")]
    found, c = C.annotate(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(7, item)], ITEMS))
    got = {r[0]: (r[1], r[2]) for r in found.select("doc_id", f"{c}.longest", f"{c}.longest_at").collect()}
    assert got == {1: (25, 2), 2: (40, 0)}


def test_longest_match_where_items_share_windows(spark):
    shared = " ".join(f"v{i}" for i in range(22))
    long = shared + " " + " ".join(f"b{i}" for i in range(30))
    items = [(1, shared + " a1 a2 a3"), (2, long), (3, long)]
    found, c = C.annotate(spark.createDataFrame([(1, "x " + long, "")], DOCS), spark.createDataFrame(items, ITEMS))
    row = found.select(f"{c}.longest", f"{c}.longest_at", f"{c}.items").first()
    assert tuple(row) == (52, 1, ["1", "2", "3"])


def test_items_longer_than_a_block(spark):
    rng = random.Random(4)
    words = [rng.choice([f"w{i}" for i in range(60)]) for _ in range(700)]
    items = [(1, " ".join(words)), (2, "x " + " ".join(words[300:330])), (3, " ".join(words[:5]) + "  , ")]
    docs = [(i, " ".join(["q"] * i + words[a : a + n]), "") for i, (a, n) in enumerate([(0, 13), (90, 40), (400, 12), (687, 13), (0, 700), (120, 14), (121, 13)])]
    found, c = C.annotate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), block_bytes=400)
    assert rows(found, c) == C.brute_force([d[:2] for d in docs], items)


def test_codes_of_many_ranks(monkeypatch):
    docs, items = fixture()
    monkeypatch.setattr(C, "ranks_per_code", lambda top: 2)
    test = C.TestSuffixes.of(items, C.WINDOW)
    assert test.per == 2
    for _, text, _ in docs[:60]:
        got = C._search_texts([text], [None], test, C.WINDOW)
        want = C.brute_force([(0, text)], items)[0]
        assert (got["n_words"][0], sum(s["end"] - s["start"] for s in got["spans"][0]), len(got["items"][0])) == want[:3]
