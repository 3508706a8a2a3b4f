import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import quality, toxicity
from marginalia.llm.labelled import remainder, sample

DOCS = "doc_id long, text string, score string"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n=600):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice(["an", "th", "er", "on", "re", "sti"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 80))]
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        if bad:
            words = [w.upper() + "!!" for w in words] if i % 2 else [w for w in words[:6] for _ in range(9)]
        if toxic:
            for _ in range(rng.randint(1, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(["grumblefoo", "snarlbar", "vexqux"]))
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d, lb = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    train = remainder("doc_id", 3) != 1
    scored, c = quality.annotate(d, quality.fit(d, lb, train))
    got = {r[0]: r[1] for r in scored.filter(~train).select("doc_id", f"{c}.predicted").collect()}
    assert np.mean([got[i] == labels[i][1] for i in got]) > 0.95
    scored, c = toxicity.annotate(d, toxicity.fit(d, lb, train))
    rows = scored.filter(~train).select("doc_id", f"{c}.grade", f"{c}.severity", f"{c}.at_least").collect()
    assert np.mean([(r[1] > 0) == labels[r[0]][2] for r in rows]) > 0.95
    assert all(0 <= r[2] <= 3 and sorted(r[3], reverse=True) == r[3] for r in rows)


def test_no_examples_nulls_and_extra_columns(spark):
    docs = spark.createDataFrame([(None, None, None), (1, "", "a"), (1, "", "a"), (2, "x " * 5000, "b")], DOCS)
    none = spark.createDataFrame([(None, 1, 1), (1, None, None)], LABELS)
    scored, c = quality.annotate(docs, quality.fit(docs, none, F.lit(True)))
    assert [r[0] for r in scored.select(f"{c}.score").collect()] == [0.5] * 4 and scored.columns[:3] == docs.columns
    scored, c = toxicity.annotate(docs, toxicity.fit(docs, none, F.lit(True)))
    assert {r[0] for r in scored.select(f"{c}.grade").collect()} == {0}
    assert quality.annotate(docs.limit(0), quality.fit(docs, none, F.lit(True)))[0].count() == 0


def test_a_task_fits_the_quality_model_and_not_the_driver(spark, monkeypatch):
    docs, labels = corpus(80)
    d, lb = spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(labels, LABELS)
    want = quality.QualityModel.fit(sample(d, lb, "quality", 50, F.lit(True))).margin
    monkeypatch.setattr(quality.QualityModel, "fit", lambda *_: pytest.fail("fitted in the driver"))
    got = quality.fit(d, lb, F.lit(True), rows=50).margin
    assert np.allclose(got, want, atol=1e-6) and np.ptp(got) > 0


def test_sample_is_bounded_and_repeatable(spark):
    docs, labels = corpus(100)
    d, lb = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels + labels, LABELS)
    one = sample(d, lb, "quality", 20, F.lit(True))
    assert len(one) == 20 and one == sample(d.repartition(7), lb.repartition(3), "quality", 20, F.lit(True))


def test_sample_is_bounded_in_rows_and_bytes(spark):
    one_key = spark.createDataFrame([(1, f"text {i}", "x") for i in range(500)] + [(2, "y" * 5000, "x"), (3, None, "x"), (None, "z", "x")], DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 0)], LABELS)
    assert sorted(sample(one_key, labels, "quality", 10, F.lit(True)), key=str) == [("text 0", 1), ("y" * 5000, 1), (None, 0)]
    assert sorted(sample(one_key, labels, "quality", 10, F.lit(True), max_bytes=100), key=str) == [("text 0", 1), (None, 0)]


def test_grades_do_not_rest_on_the_examples_own_marks():
    texts = [f"w{i} w{i + 1} " + "vile " * (i % 5) + "calm plain words " * 4 for i in range(400)]
    toxic = np.array([int(i % 5 > 0) for i in range(400)])
    grade = toxicity._grades(texts, toxic)
    assert set(grade[toxic == 0]) == {0} and set(grade[toxic == 1]) == {1, 2, 3}
    by_count = [grade[[i for i in range(400) if i % 5 == k]].mean() for k in range(1, 5)]
    assert by_count == sorted(by_count)


def test_clashing_column_and_very_long_text(spark):
    docs = spark.createDataFrame([(1, "grim " * 400_000, "mine"), (2, "", "mine")], "doc_id long, text string, toxicity string")
    scored, c = toxicity.annotate(docs, toxicity.SeverityModel.fit([("grim " + str(i), i % 2) for i in range(50)]))
    assert c == "_toxicity" and {r["toxicity"] for r in scored.collect()} == {"mine"}


def test_sample_of_a_key_with_any_name(spark):
    docs, labels = corpus(40)
    d, lb = (spark.createDataFrame(rows, kind).withColumnRenamed("doc_id", "doc id") for rows, kind in ((docs, DOCS), (labels, LABELS)))
    got = sample(d, lb, "quality", 10, F.lit(True), key="doc id")
    assert len(got) == 10
