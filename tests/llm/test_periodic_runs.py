import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import Row

from fleetgauge.llm import periodic_runs as P
from fleetgauge.llm import queries as Q


def plain_runs(w, least=6, times=4):
    """Every maximal stretch of every period, tried one by one; the smallest period of a stretch counts."""
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, times * q) and not any(all(w[x] == w[x + p] for x in range(i, i + n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    return " ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs))


def made(r):
    """Words with loops of all kinds: nested, side by side, overlapping, cut short."""
    w = []
    while len(w) < r.randint(0, 120):
        k = r.random()
        part = [r.choice("abAB") for _ in range(r.randint(1, 9))]
        if k < 0.6:
            w += (part * r.randint(2, 9))[:r.randint(1, 60)]
        elif k < 0.8:
            w += ((part[:2] * 5 + part[2:3]) * r.randint(3, 6))[:r.randint(5, 80)]
        else:
            w += part
    return w


def test_runs_match_every_stretch_tried():
    r = random.Random(3)
    for least, times in ((6, 4), (1, 3), (9, 3), (1, 5)):
        docs = [made(r) for _ in range(150)]
        flat = np.array([ord(x) for w in docs for x in w], np.int64)
        ends = np.cumsum([len(w) for w in docs])
        start, length, period = (x.tolist() for x in P.runs_of(flat, ends, least, times))
        got = list(zip(start, length, period, strict=True))
        base, want = 0, []
        for w in docs:
            want += [(s + base, n, q) for s, n, q in plain_runs(w, least, times)]
            base += len(w)
        assert got == want


def test_fewer_than_three_periods_are_refused(spark):
    with pytest.raises(ValueError):
        P.find_runs(spark.createDataFrame([(1, "a")], "doc_id long, text string"), times=2)


def test_edges(spark):
    rows = [(1, None, 1, "x"), (2, "", 2, None), (None, "a a a a a a b", 3, "y"), (3, " \t\n", 4, "z"), (4, "x y " * 40_000 + "end", 5, "z"), (4, "x y " * 40_000 + "end", 5, "z"),
            (5, "one", 6, "z"), (6, "a a a a a", 7, "z"), (7, "A a A a A a a", 8, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, runs string")
    got = sorted((r for r in P.find_runs(df).collect()), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [(r.doc_id, r.n_words, [tuple(x) for x in r.runs]) for r in got] == [
        (1, 0, []), (2, 0, []), (3, 0, []), (4, 80_001, [(0, 80_000, 2)]), (4, 80_001, [(0, 80_000, 2)]), (5, 1, []), (6, 5, []), (7, 6, []), (None, 7, [(0, 6, 1)])]
    assert [r.collapsed for r in got] == ["", "", "", "x y end", "x y end", "one", "a a a a a", "A a A a A a a", "a b"]
    assert P.find_runs(df.limit(0)).count() == 0


def test_ties_of_the_longest_run(spark):
    df = spark.createDataFrame([Row(runs=[(9, 8, 2), (0, 8, 1), (0, 8, 2)]), Row(runs=[])], f"runs array<{P._RUN}>")
    assert [r.best and tuple(r.best) for r in df.select(P.longest().alias("best")).collect()] == [(0, 8, 1), None]


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    r = random.Random(8)
    texts = [None, "", "  ", "word"] + [r.choice([" ", "\n", "\t "]).join(made(r)) for _ in range(150)] + [" ".join(r.choice(["und", "der", "tag"]) for _ in range(r.randint(1, 300))) for _ in range(250)]
    path = tmp_path_factory.mktemp("runs")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path), list(enumerate(texts))


def test_query_matches_plain_version(spark, folder):
    path, docs = folder
    looped = 0
    got = {r.doc_id: r for r in Q.QUERIES["op11_periodic_runs"](spark, path).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h, n = zlib.crc32(str(i).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
            looped += 1
        runs = plain_runs(w)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
    assert looped > 10
