import pytest
from pyspark.sql import functions as F

from marginalia.operators.alignment import complete
from marginalia.plans import ingest
from marginalia.plans import queries as Q


@pytest.fixture
def tables(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    write("customer", [(k, k % 25) for k in range(40)], "c_custkey long, c_nationkey long")
    write("supplier", [(k, k % 25) for k in range(10)], "s_suppkey long, s_nationkey long")
    write("nation", [(k, k % 5) for k in range(25)], "n_nationkey long, n_regionkey long")
    write("conversations", [(c, t, "user" if t == 0 else "assistant", f"said {c} {t}") for c in range(1200) for t in range(2)], "conv_id long, turn int, role string, text string")
    spark.createDataFrame([(k, f"small ring {k}", f"Brand#{k % 4}", "PROMO <A> & B") for k in range(700)], "p_partkey long, p_name string, p_brand string, p_type string").withColumn("p_size", F.col("p_partkey") % 9).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_every_subject_is_traced(spark, tables):
    lines = Q.trace_depth_first(spark, tables).collect()
    assert {r.origin for r in lines} == {f"{kind}.{k}" for kind, n in (("C", 40), ("S", 10), ("N", 25)) for k in range(n)}
    # N.1 leads to (1 * 3 + 1) % 25 and (1 * 7 + 2) % 25
    assert [(r.node, r.depth) for r in sorted(lines, key=lambda r: r.place) if r.origin == "C.1"] == [("C.1", 0), ("N.1", 1), ("N.4", 2), ("N.9", 2)]


def test_parts_have_a_fixed_size(spark, tables):
    assert sorted(r.part_number for r in Q.passage_markup(spark, tables).collect()) == [1, 2, 3]


def test_queries_over_files_match_their_sql(spark, tables, tmp_path):
    import duckdb

    from marginalia.plans import ingest, ingest_oracle

    spark.createDataFrame([(1, "http://a/b", "<p>Ça va — bien</p><p>ok 🙂</p>"), (2, "http://c", None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, 'a "b"\nc'), (1200, "é"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("customer", "supplier", "nation", "conversations", "part", "pages", "documents"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("n3_written", "n3_abbreviated", "ordered_xml", "explorer_outline", "marked_appendix", "parallel_json", "latin1_pages", "aligned_in_order"):
        got, want = ingest.QUERIES[name](spark, tables), duckdb.sql(ingest_oracle.ORACLE_SQL[name])
        rows = sorted((tuple(str(r[c]) for c in sorted(got.columns)) for r in got.collect()))
        names = [c for c in want.columns]
        assert rows == sorted(tuple(str(r[names.index(c)]) for c in sorted(names)) for r in want.fetchall()), name


def test_missing_parallel_text_is_an_error(spark):
    passages = spark.createDataFrame([("I.prop.1", "x", False), ("I.prop.2", "y", False), ("I.prop.3", "", False), ("I.prop.4", "z", True)], "id string, text string, is_editorial boolean")
    aligned = spark.createDataFrame([("I.prop.1", "a")], "id string, text string")
    assert complete(passages.filter("id <> 'I.prop.2'"), aligned).count() == 1
    with pytest.raises(Exception, match="no parallel text for 1 passages, the first of which is I.prop.2"):
        complete(passages, aligned).collect()


def test_library_from_files(spark, tables):
    store = {r["p"]: (r["n"], r["subjects"]) for r in ingest.library_store(spark, tables).collect()}
    assert store["provedBy"] == (1200, 1200) and store["partOf"] == (1200, 1200) and store["latin texts"] == (1200, 1200)
    assert store["dependsUpon"][0] == store["cites"][0] + 1200
