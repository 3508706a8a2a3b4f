import pytest

from marginalia.operators.rules import derive
from marginalia.sources import n3
from marginalia.sources import triples as S
from marginalia.streaming.triples import append_n3, streamed_n3

TEXT = '''@prefix e: <http://example.org/e#> . @prefix : <http://example.org/plain/> .
# a comment with { and """ and .
e:a e:p e:b . e:a e:q e:c; e:r "one. two" , 'x # y'@en-GB, "7"^^e:int .   e:b e:p 3.5, -2e3, true .
e:long e:text """first "line" .
{ not a rule } .
  e:x e:y e:z . \\u00e9 ends""" , \'\'\'it's
"""quoted""" \'\'\' .
_:k e:p _:k , [ e:in [] ; e:of ( e:a "b" ) ; ] .
[ e:alone true ] .
{ ?x e:p ?y .
  ?y e:q "a } b" . }
=> { ?x e:far ?y .
} .
e:I.def.1 a :Thing ; e:n .5 ;
.
@prefix e: <http://example.org/other#o_> .
e:a <rel> <#frag> . <http://example.org/e#v1.2> e:end e:last
'''
PLAIN = {
    ("a", "p", "b", "iri"), ("a", "q", "c", "iri"), ("a", "r", "one. two", "literal"), ("a", "r", "x # y", "literal"), ("a", "r", "7", "literal"),
    ("b", "p", "3.5", "literal"), ("b", "p", "-2e3", "literal"), ("b", "p", "true", "literal"),
    ("long", "text", 'first "line" .\n{ not a rule } .\n  e:x e:y e:z . é ends', "literal"), ("long", "text", 'it\'s\n"""quoted""" ', "literal"),
    ("I.def.1", "type", "http://example.org/plain/Thing", "iri"), ("I.def.1", "n", ".5", "literal"),
    ("o_a", "rel", "frag", "iri"), ("v1.2", "o_end", "o_last", "iri"),
}


def rows(df):
    found = [tuple(r) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_all_of_the_grammar(spark, tmp_path):
    (tmp_path / "a.n3").write_text(TEXT)
    found = rows(n3.read_n3(spark, str(tmp_path / "a.n3")))
    blank = {r for r in found if "_:" in r[0] + r[2]}
    assert found - blank == PLAIN
    by = {(r[0], r[1]): r[2] for r in blank}
    k = next(r[0] for r in blank if r[0].endswith(".k"))
    other = next(r[2] for r in blank if r[0] == k and r[2] != k)
    assert (k, "p", k, "iri") in blank and by[other, "in"].startswith("_:")
    first = by[other, "of"]
    assert by[first, "first"] == "a" and by[by[first, "rest"], "first"] == "b" and by[by[first, "rest"], "rest"] == "nil"
    assert sum(r[1] == "alone" for r in blank) == 1 and len(blank) == 9
    text = n3.rules_in(spark, str(tmp_path / "a.n3"))
    given = spark.createDataFrame([("1", "p", "2", "iri"), ("2", "q", "a } b", "literal")], S.SCHEMA)
    assert rows(derive(given, text)) == {("1", "far", "2", "iri")}


def test_cut_anywhere(spark, tmp_path):
    """The same triples, whatever the size of the splits: states at every line's start, and edges joined."""
    for k in range(2):
        (tmp_path / f"{k}.n3").write_text(TEXT.replace("e:alone", f"e:alone{k}"))
    want = rows(n3.read_n3(spark, str(tmp_path)))
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for size in (37, 150):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            assert rows(n3.read_n3(spark, str(tmp_path))) == want
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_pieces_are_the_same_from_any_line_on():
    lines = TEXT.split("\n")
    whole = n3.cut(TEXT)
    for k in range(len(lines) + 1):
        mode = depth = 0
        for line in lines[:k]:
            mode, depth = n3._after(line, mode, depth)
        left, right = n3.cut("\n".join(lines[:k])), n3.cut("\n".join(lines[k:]), mode, depth)
        joined = [*left[:-1], (left[-1][0] + "\n" * (0 < k <= len(lines)) + right[0][0], right[0][1]), *right[1:]]
        strip = lambda pieces: [(t.strip(), e) for t, e in pieces]
        assert strip(joined) == strip(whole)


@pytest.mark.parametrize("text", ["e:a e:b .", "x:a x:b x:c .", "e:a e:b e:c e:d .", '"s" e:p e:o .', 'e:a "p" e:o .', "e:a e:b [ e:c .", "e:a e:b ) ."])
def test_bad_statements_are_errors(spark, tmp_path, text):
    (tmp_path / "a.n3").write_text("@prefix e: <e#> .\n" + text + "\n")
    with pytest.raises(Exception, match="ValueError"):
        n3.read_n3(spark, str(tmp_path / "a.n3")).collect()


def test_empty_files_and_what_is_written(spark, tmp_path):
    (tmp_path / "none.n3").write_text("")
    assert n3.read_n3(spark, str(tmp_path / "none.n3")).count() == 0 and n3.rules_in(spark, str(tmp_path / "none.n3")) == ""
    given = spark.createDataFrame([("a", "cites", "b", "iri"), ("a", "number", "4", "literal"), ("b", "says", 'a "b" \\ {c}. d', "literal")], S.SCHEMA)
    S.write_triples(given, str(tmp_path / "out"), rules=True)
    assert rows(n3.read_n3(spark, str(tmp_path / "out"))) == rows(given)
    assert n3.rules_in(spark, str(tmp_path / "out")).count("=>") == len(S.RULES)


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.n3").write_text(f"@prefix e: <http://example.org/{k}#p{k}.> . e:a e:b e:c . <#same> <#as> <#ever> .")
        append_n3(spark, str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "ck")).awaitTermination(120)
    assert rows(streamed_n3(spark, str(tmp_path / "table"))) == {("p0.a", "p0.b", "p0.c", "iri"), ("p1.a", "p1.b", "p1.c", "iri"), ("same", "as", "ever", "iri")}
