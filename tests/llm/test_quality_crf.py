import itertools

import numpy as np
from pyspark.sql import functions as F

from fleetgauge.llm import quality_crf as Q
from fleetgauge.llm.common import held_out


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    at = np.array([0, 3, 4, 9, 11])
    u, trans = rng.normal(size=11) * 2, rng.normal(size=(2, 2))
    p, pairs = Q.marginals(u, trans, at)
    want, both = np.zeros(11), np.zeros((2, 2))
    for a, b in zip(at[:-1], at[1:], strict=True):
        total, part, pp = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(u[a + i] * y[i] for i in range(b - a)) + sum(trans[y[i], y[i + 1]] for i in range(b - a - 1)))
            total += w
            part += w * np.array(y)
            for i in range(b - a - 1):
                pp[y[i], y[i + 1]] += w
        want[a:b] = part / total
        both += pp / total
    assert np.allclose(p, want) and np.allclose(pairs, both)


def test_line_features():
    f, w, at = Q.line_features(["a b b\nX1\n\na b b", None, "", "é%%"])
    assert at.tolist() == [0, 4, 5, 6, 7] and w.tolist() == [6, 3, 1, 6, 1, 1, 5]
    assert f[0, 9] == 1 / 3 and f[1, 1] == 0.5 and f[1, 2] == 0.5  # repeated word, upper case, digit
    assert f[:, 12].tolist() == [0, 0, 0, 1, 0, 0, 0] and f[:, 13].tolist() == [0, 0, 1, 0, 1, 1, 0]
    x = Q.with_neighbours(f, at)
    assert (x[1, Q.N_BASE:2 * Q.N_BASE] == f[0]).all() and (x[4, :-3].reshape(3, -1)[1:] == 0).all() and x[4, -3:].tolist() == [1, 1, 1]
    long, _, _ = Q.line_features(["w" * 300 + " " + "w" * 300])
    assert long[0, 9] == 0.5


def test_edges(spark):
    good, bad = "The quiet river went by the old house.\nIt was late.", "BUY!! BUY!! BUY!! BUY!!\n%%% $$$ BUY!!"
    docs = spark.createDataFrame([(i, bad if i % 2 else good) for i in range(60)] + [(100, None), (101, ""), (101, ""), (None, good * 3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)] + [(3, None), (None, 1)], "doc_id long, quality int")
    field = Q.fit(docs, labels)
    out = Q.score(docs.withColumn("score", F.lit("x")), field).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert all((r.score > 0.5) == (r.doc_id % 2 == 0) for r in out if r.doc_id is not None and r.doc_id < 60)
    assert [r.score > 0.5 for r in out if r.doc_id is None] == [True]
    assert Q.score(docs.limit(0), field).count() == 0
    none = Q.fit(docs, labels.filter("quality = 1"))
    assert {r.score for r in Q.score(docs, none).collect()} == {0.5}
    lines = Q.label_lines(docs.filter("doc_id = 0"), field).first().lines
    assert len(lines) == 2 and min(lines) > 0.5


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("held_out", held_out())
    labels = spark.read.parquet(f"{d}/labels.parquet")
    field = Q.fit(docs.filter("NOT held_out"), labels)
    out = Q.score(docs.filter("held_out"), field).join(labels, "doc_id")
    assert out.agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("quality")).cast("double"))).first()[0] > 0.97
