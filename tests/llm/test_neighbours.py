import numpy as np

from fleetgauge.llm import neighbours as N


def test_partition_is_balanced_and_follows_the_graph():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(8, 16))
    x = (centres[np.repeat(np.arange(8), 64)] + 0.1 * rng.normal(size=(512, 16))).astype(np.float32)
    near = N.graph(x / np.linalg.norm(x, axis=1, keepdims=True), 10)
    label = N.partition(x, near, 8)
    assert np.bincount(label, minlength=8).tolist() == [64] * 8
    assert (label[near] == label[:, None]).mean() > 0.8


def exact(rows, k, every):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and len(v) == 4 and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = []
    for q, x in sorted({(i, tuple(v)) for i, v in ok if i % every == 0}):
        best = sorted(((-float(np.dot(np.array(x), v)), i) for i, v in ok if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def test_small_tables_with_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(5)
    v = [[float(c) for c in rng.integers(-3, 4, 4)] for _ in range(40)]
    rows = [(i, v[i % 40]) for i in range(200)] + [(1000, None), (1020, [0.0] * 4), (1040, [float("nan"), 1.0, 1.0, 1.0]), (1060, [1.0, None, 0.0, 0.0]), (1080, [1.0]), (None, [1.0] * 4), (1100, [float("inf")] * 4), (1101, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "vec_id AS query_id", "'x' AS score")
    got = sorted(tuple(r) for r in N.search(df, k=20, every=20, coverage=1.0).collect())
    assert got == exact(rows, 20, 20)
    few = spark.createDataFrame([(20, [1.0, 0.0]), (3, [1.0, 1.0]), (40, [2.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in N.search(few).collect()) == [(20, 1, 40, 2.0), (20, 2, 3, 1.0), (40, 1, 3, 2.0), (40, 2, 20, 2.0)]
    assert N.search(df.limit(0)).count() == 0


def test_recall_and_block_splitting(spark, monkeypatch):
    monkeypatch.setattr(N, "BASE_BLOCK", 50)
    monkeypatch.setattr(N, "QUERY_BLOCK", 7)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.select("vec_id", "embedding").toPandas()
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding.to_numpy()).astype(np.float64)
    hit = total = 0
    got = N.search(df).toPandas()
    for q, g in got.groupby("query_id"):
        s = x @ x[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -np.inf
        floor = np.sort(s)[-20] - 1e-12
        assert np.allclose(g.sort_values("rank").score, [s[np.flatnonzero(ids == v)[0]] for v in g.sort_values("rank").vec_id], atol=1e-12)
        hit, total = hit + int((g.score >= floor).sum()), total + 20
    assert got.query_id.nunique() == (ids % 20 == 0).sum() and hit / total >= 0.9
