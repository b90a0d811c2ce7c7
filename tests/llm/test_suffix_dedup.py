import random

from brute import repeated
from fleetgauge.llm import suffix_dedup as S


def made(seed):
    r = random.Random(seed)
    letters = r.choice(["ab", "abcd efgh", "aé日\n x"])
    base = ["".join(r.choice(letters) for _ in range(r.randint(0, 220))) for _ in range(12)]
    out = []
    for i in range(60):
        t = "".join(r.choice(base)[r.randint(0, 60):] if r.random() < 0.7 else "".join(r.choice(letters) for _ in range(30)) for _ in range(r.randint(0, 4)))
        out.append((r.randrange(10_000), t))
    return [*dict(out).items(), (20_000, "z" * 5000), (20_001, "z" * 49), (20_002, "z" * 50), (20_003, base[0] * 40)]


def result(df, **options):
    return sorted((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in S.repeated_spans(df, **options).collect() if r.doc_id is not None)


def plain(rows, span=50):
    out = []
    for (k, t), c in zip(rows, repeated(rows, span), strict=True):
        starts = [i for i in range(len(c)) if c[i] and (i == 0 or not c[i - 1])]
        ends = [i + 1 for i in range(len(c)) if c[i] and (i + 1 == len(c) or not c[i + 1])]
        out.append((k, len(t), list(zip(starts, ends, strict=True)), bytes(b for b, x in zip(t, c, strict=True) if not x)))
    return sorted(out)


def test_spans_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 1500)
    for seed, span in ((1, 50), (2, 50), (3, 20), (4, 50)):
        rows = made(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert result(df, span=span) == plain([(k, t.encode()) for k, t in rows], span), seed


def test_long_texts_are_cut_into_segments_without_loss(monkeypatch):
    r = random.Random(9)
    text = bytes(r.choice(b"abcdef ") for _ in range(4000))
    whole = S.anchors([text], 50)
    monkeypatch.setattr(S, "SEGMENT", 300)
    monkeypatch.setattr(S, "SLICE", 700)
    parts = S.anchors([text], 50)
    cover = lambda a: sorted((int(x), int(p)) for x, lo, hi in zip(a["at"], a["lo"], a["hi"], strict=True) for p in range(lo, hi + 1))
    assert cover(whole) == cover(parts) and [p for _, p in cover(whole)] == list(range(4000 - 49))


def test_merge_is_a_sort_and_its_prefixes_are_exact():
    r = random.Random(2)
    for _ in range(60):
        lists = [sorted(bytes(r.choice(b"ab\0") for _ in range(r.randint(1, 12))) for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 9))]
        runs = []
        for keys in lists:
            run = object.__new__(S.Run)
            run.keys = keys
            run.prefix = [0] + [S._compare(a, b, 0)[1] for a, b in zip(keys, keys[1:], strict=False)]
            runs.append(run)
        got = [(n, runs[w].keys[i]) for n, w, i in S.merge(runs)]
        assert [k for _, k in got] == sorted(k for keys in lists for k in keys)
        assert [n for n, _ in got[1:]] == [S._compare(a[1], b[1], 0)[1] for a, b in zip(got, got[1:], strict=False)]


def test_edges(spark):
    p = "This passage of more than fifty bytes stands in several texts. "
    rows = [(5, p + "é" * 30, 1), (5, p + "é" * 30, 1), (2, "x" + p, 2), (None, p, 3), (9, None, 4), (8, "", None), (4, p, 5), (4, p, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int")  # clashing names
    out = S.repeated_spans(df.withColumn("kept", df.n_bytes)).collect()
    got = sorted((r.doc_id, len(r.spans), bytes(r.kept)) for r in out if r.doc_id is not None)
    assert got == [(2, 0, ("x" + p).encode()), (4, 1, b""), (4, 1, b""), (5, 1, ("é" * 30).encode()), (5, 1, ("é" * 30).encode()), (8, 0, b""), (9, 0, b"")]
    assert [bytes(r.kept) for r in out if r.doc_id is None] == [p.encode()]
    assert S.repeated_spans(df.limit(0)).count() == 0
    e = [(1, "ab" + "é" * 30), (2, "cb" + "é" * 30), (3, "Ãb" + "é" * 29 + "è")]  # the shared bytes of 3 end inside a character
    whole = {r.doc_id: bytes(r.kept) for r in S.repeated_spans(spark.createDataFrame(e, "doc_id long, text string"), whole_characters=True).collect()}
    assert whole == {1: e[0][1].encode(), 2: b"c", 3: "Ãè".encode()}
    kept = S.repeated_spans(spark.createDataFrame([(1, p, "a"), (2, p, None)], "doc_id long, text string, source string"), carry=("source",)).collect()
    assert {(r.doc_id, r.source, bytes(r.kept)) for r in kept} == {(1, "a", p.encode()), (2, None, b"")}
