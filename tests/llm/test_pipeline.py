import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from marginalia.llm import contamination, mixing, quality
from marginalia.llm.labelled import remainder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice(["an", "th", "er", "on", "re", "sti", "lo"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [" ".join(prose(30)) for _ in range(5)]
    docs, labels = [], []
    for i in range(400):
        words, good = prose(rng.randint(30, 90)), rng.random() < 0.8
        if not good:
            words = [w for w in words[:5] for _ in range(10)]
        elif rng.random() < 0.1:
            words[4:4] = rng.choice(items).split()
        elif rng.random() < 0.1:
            words[4:4] = ["password:", "Abcdef123456789x"]
        text = " ".join(words)
        docs.append((i, text, "en", rng.choice("aaab"), len(text)))
        labels.append((i, int(good), 0))
    copies = [(400 + k, docs[k][1] + (" more" if k % 2 else ""), "en", "b", 1) for k in range(40)]
    docs += copies + [(None, None, None, None, None), (500, "", "en", "a", 0)]
    top = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}
    # quality: by the same classifier on one text at a time
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"), remainder("doc_id", 3) != 1)
    good = P.keep_good_quality(spark, docs, folder)
    kept = {r["doc_id"] for r in good.collect()}
    assert good.columns == columns and kept == {k for k, r in rows.items() if model.scores([r["text"]])[0] >= 0.5}
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert sum((k in kept) == (labels[k] == 1) for k in labels) / len(labels) > 0.97
    # near-duplicates: all pairs
    one = P.keep_one_of_each_group(spark, good, folder)
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k in kept if (w := (rows[k]["text"] or "").split())}
    gone = {k for k in sets for j in sets if j < k and len(sets[k] & sets[j]) * 100 >= 80 * len(sets[k] | sets[j])}
    left = {r["doc_id"] for r in one.collect()}
    assert one.columns == columns and left == kept - gone and gone
    # contamination
    clean = P.drop_contaminated(spark, one, folder)
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    found = contamination.brute_force([(k, rows[k]["text"]) for k in left], items)
    held = {r["doc_id"] for r in clean.collect()}
    assert clean.columns == columns and held == {k for k in left if not found[k][4]} and held != left
    # secrets
    safe = P.redact_secrets(spark, clean, folder)
    texts = {r["doc_id"]: r["text"] for r in safe.collect()}
    assert safe.columns == columns and set(texts) == held and not any("Abcdef123456789x" in (t or "") for t in texts.values())
    assert all(texts[k] == rows[k]["text"] for k in held if "password" not in (rows[k]["text"] or ""))
    # mixing: every document is drawn, and the budgets are met
    mixed = P.mix_sources(spark, safe, folder).collect()
    tokens: dict = {}
    for r in safe.collect():
        tokens[r["source"]] = tokens.get(r["source"], 0) + len((r["text"] or "").split())
    _, draw = mixing.budgets(tokens)
    assert {r["doc_id"] for r in mixed} == held
    for s, n in tokens.items():
        if n:
            assert draw[s] <= sum(r["n_tokens"] for r in mixed if r["source"] == s) < draw[s] + 200
    # the whole run does the same
    again = {tuple(r) for r in P.run(spark, folder).collect()}
    assert again == {tuple(r) for r in mixed}


def test_stages_take_empty_tables_nulls_and_repeated_rows(spark, folder):
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", None, None, None), (3, "so far so good\n" * 3000, "en", "a", 45_000), (3, "so far so good\n" * 3000, "en", "a", 45_000), (None, "one two", "en", None, 7)]
    docs = spark.createDataFrame(rows, DOCS)
    for _, stage in P.STAGES[1:]:  # what the classifier thinks of these is its own affair
        got = stage(spark, docs, folder)
        assert {r["doc_id"] for r in got.collect()} == {None, 1, 2, 3}
    for k, (_, stage) in enumerate(P.STAGES):
        got = stage(spark, docs.limit(0), folder)
        assert got.count() == 0 and (k == len(P.STAGES) - 1 or got.columns == docs.columns)
    assert P.keep_good_quality(spark, docs, folder).columns == docs.columns


def test_stages_keep_extra_columns_with_clashing_names(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(30).withColumns({n: F.lit("mine") for n in ("quality", "contamination", "spans", "kinds", "posting_key", "component_id", "n_shingles")})
    for _, stage in P.STAGES[:-1]:
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns and {tuple(r)[-7:] for r in got.collect()} <= {("mine",) * 7}


def test_rows_that_share_an_id_go_by_their_own_text(spark, folder):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(3, a), (5, a), (5, b), (6, a + " x"), (7, None), (7, ""), (None, b), (None, "c d e f g h"), (8, "c d e f g h"), (3, a)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], DOCS)
    got = P.keep_one_of_each_group(spark, docs, folder)
    assert sorted(((r[0], r[1]) for r in got.collect()), key=str) == sorted([(3, a), (3, a), (5, b), (7, None), (7, ""), (8, "c d e f g h")], key=str)
