import random

import numpy as np
import pytest

from brute import near_groups
from fleetgauge.llm import linking as L
from fleetgauge.llm import odd_minhash as M


def alike(rng, n, j):
    """Two random sets of about ``n`` tokens and their similarity, near ``j``."""
    both = round(2 * n * j / (1 + j))
    x = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
    return np.unique(x[:n]), np.unique(x[n - both:]), both / (2 * n - both)


def test_bands_let_pairs_at_the_threshold_meet():
    bands, rows = M.tune(0.8)
    assert bands <= M.MOST_BANDS and (1 - 0.8 ** rows) ** bands <= 1 - M.RECALL < (1 - 0.8 ** (rows + 1)) ** M.MOST_BANDS


def test_sketches_estimate_the_similarity():
    rng = np.random.default_rng(4)
    samples = 160
    for j in (0.95, 0.9, 0.8, 0.6):
        off = []
        for _ in range(60):
            a, b, true = alike(rng, 200, j)
            sk = M.odd_sketches(np.stack([M.signature(a, samples), M.signature(b, samples)]))
            off.append(M.similarity(np.bitwise_count(sk[0] ^ sk[1]).sum(), samples) - true)
        assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.07
        assert j < 0.8 or min(off) + j > M.similarity(M.most_bits(0.8, samples), samples) - 1e-9


def edited(r, base, vocab, most):
    w = list(base)
    for _ in range(r.randint(0, most)):
        w[r.randrange(len(w))] = r.choice(vocab)
    return w


def made(seed, groups=12, copies=9, most=4):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(50)] + ["É", "日本"]
    rows = []
    for _ in range(groups):
        base = [r.choice(vocab) for _ in range(r.choice([1, 2, 3, 5, 9, 15, 40, 120]))]
        for _ in range(r.randint(1, copies)):
            w = edited(r, base, vocab, most)
            rows.append(" ".join(w).upper() if r.random() < 0.2 else r.choice([" ", "\n", " \t"]).join(w))
    ids = r.sample(range(5000), len(rows))
    return list(zip(ids, rows, strict=True)) + [(6000, None), (6001, ""), (6002, " \n\t"), (6003, "one"), (6004, "ONE"), (6005, "a\x00b c"), (6006, "word " * 30000)]


@pytest.mark.parametrize("block", [1024, 4])
def test_groups_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)  # 4: groups are cut into blocks, centres meet again
    for seed, (n, num) in ((1, (2, 80)), (2, (5, 80)), (3, (1, 60))):
        rows = made(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in M.near_copies(df, n=n, num=num).collect()}
        assert got == {k: (*v, v[1] == k) for k, v in near_groups(rows, n, num).items()}


def test_a_group_of_many_edited_copies(spark, monkeypatch):
    """Copies that are near the threshold of each other: chains, strays and one large component."""
    monkeypatch.setattr(L, "BLOCK", 64)
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(3000)]
    base = [r.choice(vocab) for _ in range(100)]
    rows = [(i, " ".join(edited(r, base, vocab, 14))) for i in r.sample(range(10_000), 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = near_groups(rows, 2, 80)
    assert 1 < len({c for _, c in want.values()}) < 350
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in M.near_copies(df, n=2).collect()} == want


def test_rows_of_a_group_do_not_grow_with_its_pairs(spark, monkeypatch):
    """A group of n sets in one component and one stray deals n + blocks rows to units."""
    monkeypatch.setattr(L, "BLOCK", 50)
    df = spark.createDataFrame([(1, i, 0 if i else 10_000) for i in range(1000)] + [(2, i, 0) for i in range(500)], "gid long, set_id long, root long")
    got = L._blocks(df).collect()
    assert len(got) == 1000 + 19 and {x.gid for x in got} == {1}
    met = {(x["__i"], x["__j"]) for x in got}
    assert met == {(0, j) for j in range(20)}
    assert sum(x["__kind"] != 1 for x in got) == 20


def test_edges(spark):
    rows = [(7, "a b c d e", 1, "x"), (7, "a b c d e", 1, "x"), (3, "A b c d e", 2, None), (None, "a b c d e", 3, "y"), (9, None, None, None), (7, "other words here", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles int, component_id string")
    got = sorted((tuple(r) for r in M.near_copies(df, n=2).collect()), key=str)
    assert got == [(3, 4, 3, True), (7, 2, 7, True), (7, 4, 3, False), (7, 4, 3, False), (9, 0, 9, True), (None, 4, None, False)]
    assert M.near_copies(df.limit(0)).count() == 0
