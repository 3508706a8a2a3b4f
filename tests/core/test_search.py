import random

import pytest

from marginalia.operators import reader, search

KIND = "id string, parent_id string, text string, heading string, gram string"


@pytest.fixture(scope="module")
def passages(spark):
    rng = random.Random(3)
    rows = [(f"p.{k}", None if k % 3 == 0 else f"p.{k - k % 3}", rng.choice([None, "", "ab", "É", " ".join(rng.choice(["Stone", "walls", "ÉTÉ", "aaaa", "a%b_c", "x\ny"]) for _ in range(rng.randint(1, 5)))]), rng.choice([None, "Of Walls"]), "g") for k in range(90)]
    return spark.createDataFrame([*rows, (None, None, "Stone", None, None)], KIND).cache()


@pytest.fixture(scope="module")
def index(passages, tmp_path_factory):
    return search.build_index(passages, f"file://{tmp_path_factory.mktemp('index')}/i", ["text", "heading", "id"])


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize("query", ["stone", " STONE ", "ston", "été", "É", "b", "ab", "of w", "aaa", "a%b", "b_c", "x\ny", "e w", "p.1", ".", "stonewalls", "qqq", "zz", "walls  "])
def test_same_rows_as_a_scan(passages, index, query):
    known = passages.filter("id IS NOT NULL")
    assert ids(index.search(passages, query)) == ids(known.filter(reader.matches(query, *[known[c] for c in index.columns])))


def test_children_and_parents(passages, index):
    known = passages.filter("id IS NOT NULL").drop("gram")
    for query in ("stone", "b", " "):
        assert ids(search.visible(known, index, query)) == ids(reader.visible(known, query))
        assert ids(search.selectable(known, index, query)) == ids(reader.selectable(known, query))


def test_few_folders_are_read(index):
    plan = index.candidates("stone")._jdf.queryExecution().executedPlan().toString()
    folders = {f.split("folder=")[1].split("/")[0] for f in index.postings.inputFiles()}
    assert "PartitionFilters: [isnotnull(folder" in plan or "PartitionFilters: [folder" in plan
    asked = index.candidates("b")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(gram,b)" in asked and len(folders) > 8
    with pytest.raises(ValueError):
        index.candidates("  ")


def test_empty(passages, tmp_path):
    nothing = search.build_index(passages.limit(0), f"file://{tmp_path}/i", ["text"])
    assert nothing.search(passages.limit(0), "stone").count() == 0
