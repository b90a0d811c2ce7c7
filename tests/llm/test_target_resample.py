import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from fleetgauge.llm import queries as Q
from fleetgauge.llm import target_resample as T


def grams(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def bucket(g):
    return zlib.crc32(g.encode()) % 10_000


def plain(docs, target, share=5):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(bucket, grams(x)[1]))
    for x in target:
        t.update(map(bucket, grams(x)[1]))
    S, T_ = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (S + 10000.0) / ((s[b] + 1.0) * (T_ + 10000.0)))) for b in range(10_000)}
    rows = []
    for k, x in docs:
        w, g = grams(x)
        weight = sum(gain[bucket(y)] for y in g)
        score = None
        if k is not None:
            h = int(hashlib.sha256(f"42:{k}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((k, len(g), weight, score, len(w)))
    able = sorted((-r[3], r[0]) for r in rows if r[0] is not None and r[4] >= 20)
    drawn = {}
    for i, x in enumerate(able[:len(able) * share // 100], 1):
        drawn.setdefault(x, []).append(i)
    return sorted(((r[0], r[1], r[2], r[3], drawn[-r[3], r[0]].pop() if drawn.get((-(r[3] or 0), r[0])) and r[4] >= 20 else None) for r in rows), key=str)


def test_check_sums_of_runs():
    r = random.Random(2)
    texts = [None, "", "a", " ".join("".join(r.choice("abcXYZ09é日_-") for _ in range(r.randint(1, 9))) for _ in range(300)), "x" * 31 + " " + "y" * 32 + " " + "z" * 400 + " q", "A b C"]
    got, of, words = T.features(texts, 3)
    for n in range(3):
        want = [(i, zlib.crc32(" ".join(w[j:j + n + 1]).encode())) for i, t in enumerate(texts) for w in [grams(t)[0]] for j in range(len(w) - n)]
        assert list(zip(of[n].tolist(), got[n].tolist(), strict=True)) == want
    assert words.tolist() == [len(grams(t)[0]) for t in texts]


def made(n, seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["Été", "Straße", "日本"]
    return [(i, " ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 2, 19, 20, 21, 60])))) for i in r.sample(range(5000), n)]


def test_query_matches_plain_version(spark, tmp_path):
    docs = made(400, 5) + [(6000, None), (6001, ""), (6002, "--- ..."), (6003, "word " * 50_000), (6004, "w1 w2 w3 " * 8)]
    target = ["w1 w2 w3 w4 w5", None, "W1 w2", "other words"]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = Q.QUERIES["op13_target_resample"](spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(docs, target)


def test_repeated_rows_ties_and_nulls(spark):
    text = "w1 w2 w3 w4 " * 6
    rows = [(7, text, 1, "x")] * 40 + [(None, text, 2, "y"), (8, None, 3, "z"), (9, "w1 w9 " * 30, 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, weight int, rank string").repartition(4)
    target = spark.createDataFrame([("w1 w2",)], "text string")
    got = T.resample(df, target, share=(50, 100))
    want = plain([r[:2] for r in rows], ["w1 w2"], 50)
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert T.resample(df.limit(0), target).count() == 0
    assert T.resample(df, target.limit(0)).count() == len(rows)


def test_ranks_are_those_of_a_full_sort(spark, monkeypatch):
    rng = np.random.default_rng(1)
    score = np.concatenate([rng.integers(0, 40, 3000), np.full(2000, 17), np.arange(5000) // 3])
    key = rng.integers(0, 500, len(score))
    df = spark.createDataFrame([(int(k), int(s)) for k, s in zip(key, score, strict=True)], "key long, score long").repartition(9, "score")
    for samples in (1 << 18, 20):
        monkeypatch.setattr(T, "SAMPLES", samples)
        got = sorted((r["rank"], -r.score, r.key) for r in T.ranked(df).collect())
        want = sorted(zip((-score).tolist(), key.tolist(), strict=True))
        assert got == [(i, *x) for i, x in enumerate(want, 1)]
