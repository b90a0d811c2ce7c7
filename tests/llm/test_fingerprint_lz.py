import numpy as np

from fleetgauge.llm import fingerprint_lz as L


def test_phrases_and_likeness():
    assert L.phrases(b"") == set() and L.phrases(b"aaaaaa") == {b"a", b"aa", b"aaa"} and L.phrases(b"abab") == {b"a", b"b", b"ab"}
    a, b = L.signature(b"one text about things " * 3), L.signature(b"another matter entirely " * 3)
    assert len(L.signature(b"x" * 100000)) == L.SIZE and (np.diff(a.astype(np.int64)) > 0).all()
    assert L.alike(a, a) == 1 and 0 <= L.alike(a, b) < 0.6 and L.alike(a, a[:0]) == 0 and L.alike(a[:0], a[:0]) == 1
    assert (L.from_hex(L.to_hex(a)) == a).all()
    p, q = L.phrases(b"abcabcabd"), L.phrases(b"abcabcabe")
    assert L.alike(L.signature(b"abcabcabd"), L.signature(b"abcabcabe")) == len(p & q) / len(p | q)  # short texts: exact


def plain(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for i, (k, t) in enumerate(rows):
        t, n = t or "", rows[(i + 1) % len(rows)][1] or ""
        e = t[:len(t) - len(t) // 3] + n[:len(t) // 3]
        mark = lambda x: L.to_hex(L.signature(x.encode()))
        out.append((k, len(t), e, mark(t), mark(e), mark(n)))
    return sorted(out, key=str)


def test_chain_matches_the_plain_version(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    for n in (0, 1, 2, 200):
        rows = [((i * 37) % 1009 - 50, None if i % 17 == 3 else "" if i % 13 == 5 else f"text {i} é日 " * (i % 9)) for i in range(n)] + ([(None, "last of all")] if n else [])
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
        got = sorted((tuple(r) for r in L.chain(df).collect()), key=str)
        assert got == plain(rows)


def test_columns_and_repeats(spark):
    df = spark.createDataFrame([(5, "same", "f"), (5, "same", None), (4, "z" * 70000, "g")], "doc_id long, text string, fingerprint string")
    out = L.chain(df).collect()
    assert len(out) == 3 and len({r.fingerprint for r in out if r.doc_id == 5}) == 1
    likes = df.select(L.likeness(L.fingerprint("text"), L.fingerprint("text")).alias("x"), L.likeness("fingerprint", "fingerprint").alias("y")).limit(0).count()
    assert likes == 0
