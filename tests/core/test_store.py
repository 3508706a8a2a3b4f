import random
import re

import pytest

from marginalia.sources import triples as S
from marginalia.sources.store import drop_store, save_store

rng = random.Random(5)
FACTS = {(f"a{rng.randrange(60)}", rng.choice(["cites", "partOf"]), f"a{rng.randrange(60)}", "iri") for _ in range(300)}
FACTS |= {(f"a{k}", "type", "Thing", "iri") for k in range(150)} | {("Thing", "cites", "a1", "iri"), ("a1", "number", "a2", "literal"), ("Thing", "partOf", "Thing", "iri")}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    made = save_store(spark.createDataFrame(sorted(FACTS) + [(None, "cites", "a1", "iri")], S.SCHEMA), "given", f"file://{tmp_path_factory.mktemp('store')}/t", buckets=16)
    yield made
    drop_store(made)


def rows(df):
    found = [tuple(r) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_patterns(store):
    assert rows(store.match()) == FACTS and rows(store.hot) == {f for f in FACTS if f[2] == "Thing"}
    for s, p, o in [("a1", None, None), (None, "cites", None), (None, None, "a7"), (None, "type", "Thing"), ("a1", "number", "a2"), (None, "cites", "a7"), ("no", None, None)]:
        assert rows(store.match(s, p, o)) == {f for f in FACTS if s in (None, f[0]) and p in (None, f[1]) and o in (None, f[2])}


def test_joins(store):
    cites, inside = ({(f[0], f[2]) for f in FACTS if f[1] == p and f[3] == "iri"} for p in ("cites", "partOf"))
    assert rows(store.star("cites", "partOf")) == {(s, o, x) for s, o in cites for t, x in inside if s == t}
    assert rows(store.path("partOf", "cites")) == {(s, o, x) for s, o in inside for t, x in cites if o == t}
    assert ("a3", "Thing", "a1") in rows(store.path("type", "cites"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, store):
    """One bucket of one relation for a bound term; no exchange where buckets meet."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else plans don't tell the buckets of a single scan
        told = plan(store.match("a1", "cites"))
        assert "SelectedBucketsCount: 1 out of 16" in told and "PartitionFilters: [isnotnull(p" in told
        assert plan(store.match(None, "cites", "a7")).count("SelectedBucketsCount: 1 out of 16") == 1
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        assert "Exchange" not in plan(store.star("cites", "partOf"))
        cold, hot = re.split(r"Union", plan(store.path("partOf", "cites")))[1].split("SortMergeJoin")[1:]
        assert "Exchange" not in cold and "Exchange" in hot  # only the hot objects are dealt anew
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_empty(spark, tmp_path):
    made = save_store(spark.createDataFrame([], S.SCHEMA), "nothing", f"file://{tmp_path}/t", buckets=2)
    assert made.match().count() == made.path("a", "b").count() == made.star("a", "b").count() == 0
    drop_store(made)
