import hashlib
import random

import numpy as np

from marginalia.llm import fingerprint as P

DOCS = "doc_id long, text string, n_chars string"


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        e = P.edited(t, nxt)
        a, b, c = (P.digests([x.encode()]) for x in (t, e, nxt))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), P.as_hex(a)[0], P.as_hex(b)[0], float(P.likeness(a, b)[0]), float(P.likeness(a, c)[0])))
    return sorted(out, key=str)


def test_against_one_by_one(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(10**12), "".join(rng.choice("abcdé ü\n") for _ in range(rng.choice([0, 1, 3, 4, 5, 900])))) for _ in range(60)]
    rows += [(None, None), (5, "same"), (5, "same"), (5, "other"), (7, "x" * 200_000)]
    df = spark.createDataFrame([(*r, "?") for r in rows], DOCS)
    assert sorted((tuple(r) for r in P.compare_with_next(df).collect()), key=str) == expected(rows)


def test_small_tables(spark):
    df = spark.createDataFrame([(1, "abcd", "")], DOCS)
    assert P.compare_with_next(df.limit(0)).count() == 0
    (row,) = P.compare_with_next(df).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abca").hexdigest() and row.near_next == 1.0


def test_hex_round_trip_and_order_of_likeness():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(2000)) for _ in range(20)]
    codes = P.digests([t.encode() for t in texts])
    assert (P.from_hex(P.as_hex(codes)) == codes).all()
    changed = P.digests([P.edited(t, texts[0]).encode() for t in texts])
    assert np.all(P.likeness(codes, changed)[1:] > P.likeness(codes, np.roll(codes, 1, 0))[1:])


def test_rows_of_one_key_are_dealt_by_their_text(spark):
    """All ids null, and a third of the rows equal: partitions are still many, and their ends meet in order."""
    rows = [(None, f"{k % 7}{k} text") for k in range(200)] + [(None, "copy")] * 100
    df = spark.createDataFrame([(*r, "?") for r in rows], DOCS)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("7", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert sorted((tuple(r) for r in P.compare_with_next(df).collect()), key=str) == expected(rows)
        ranged = df.repartitionByRange(8, "doc_id", df.text.substr(1, P.RANGED_CHARS)).rdd.glom().map(len).collect()
        assert max(ranged) < 200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
