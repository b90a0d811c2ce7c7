import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from brute import near_groups
from fleetgauge.llm import linking as L
from fleetgauge.llm import ngram_join as J
from fleetgauge.llm.components import components


def test_pairs_within_the_threshold_share_an_entry():
    rng = np.random.default_rng(1)
    num, den = 85, 100
    for sets in (10, 1e5, 1e9):
        edge = J.bands(900, num, den)
        alloc = J.plan({b: sets for b in range(len(edge))}, 900, num, den)
        hashes = J.cell_entries(alloc, 900, num, den)
        for _ in range(300):
            n = int(rng.choice([1, 2, 3, 6, 7, 12, 13, 20, 37, 90, 300, 700]))
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            gone = int(rng.integers(0, n // 6 + 1))
            b = np.concatenate([a[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, n // 6 + 1)), dtype=np.uint64)])
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            if len(b) and den * both >= num * (len(a) + len(b) - both) and len(b) <= 900:
                assert set(np.concatenate(list(hashes(a))).tolist()) & set(np.concatenate(list(hashes(b))).tolist()), (len(a), len(b), both)


def test_bitmaps_never_exceed_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(100):
        a = np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64))
        b = np.unique(np.concatenate([a[:150], rng.integers(0, 1 << 63, int(rng.integers(0, 60)), dtype=np.uint64)]))
        assert np.bitwise_count((J.bitmap(a) ^ J.bitmap(b)).view(np.uint64)).sum() <= len(np.setxor1d(a, b))


def made(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["É", "日本"]
    rows = []
    for _ in range(12):
        base = [r.choice(vocab) for _ in range(r.choice([1, 3, 4, 5, 9, 15, 40, 120]))]
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(vocab)
            if r.random() < 0.3:
                w = w[r.randint(0, 1):] + [r.choice(vocab)]
            rows.append(r.choice([" ", "\n", " \t"]).join(w).upper() if r.random() < 0.2 else " ".join(w))
    ids = r.sample(range(1000), len(rows))
    return list(zip(ids, rows, strict=True)) + [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "one"), (2004, "ONE"), (2005, "a\x00b c"), (2006, "word " * 30000)]


def test_groups_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 3)  # entries are compared block by block
    for seed, (n, num) in ((1, (4, 85)), (2, (5, 80))):
        rows = made(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_groups(df, n=n, num=num).collect()}
        assert got == near_groups(rows, n, num)


def test_edges(spark):
    rows = [(7, "a b c d e", 1, "x"), (7, "a b c d e", 1, "x"), (3, "A b c d e", 2, None), (None, "a b c d e", 3, "y"), (9, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles int, component_id string")
    got = sorted(tuple(r) for r in J.near_groups(df).filter("doc_id IS NOT NULL").collect())
    assert got == [(3, 2, 3), (7, 2, 3), (7, 2, 3), (9, 0, 9)]
    assert [tuple(r) for r in J.near_groups(df).filter("doc_id IS NULL").collect()] == [(None, 2, None)]
    assert J.near_groups(df.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(4)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000 + i, 1000) for i in range(50)] + [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(60)] + [(5, 5), (None, 1), (5, 6), (6, 5)]
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {k: find(k) for k in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_units_are_counted_without_building_them(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 4)
    rows = [(g, s, s if s % 3 == 0 else -1) for g, n in ((1, 3), (2, 17), (3, 40)) for s in range(n)] + [(4, 1, 7), (4, 2, 7)]
    units, n_rows = L._counted_blocks(spark.createDataFrame(rows, "gid long, set_id long, root long"))
    assert units.count() == n_rows > len(rows)
    light, n_light = L._counted_blocks(spark.createDataFrame(rows, "gid long, set_id long, root long"), F.lit(1), 20)
    assert light.count() == n_light < n_rows  # larger blocks: a member is sent less often


def test_wide_bitmaps_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    raw = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (400, 700, 1000, 1030, 3000)]
    raw += [np.unique(np.concatenate([s[len(s) // 10:], rng.integers(0, 1 << 63, len(s) // 8, dtype=np.uint64)])) for s in raw]
    wide = L._Wide(pa.table({"wide": pa.array([J.wide_bitmap(s) for s in raw], pa.binary())}))
    i, j = (x.ravel() for x in np.indices((len(raw), len(raw))))
    for a, b, bits in zip(i.tolist(), j.tolist(), wide.bits(i, j).tolist(), strict=True):
        apart = len(np.setxor1d(raw[a], raw[b]))
        assert bits <= apart
        if min(len(raw[a]), len(raw[b])) > 512:
            assert bits >= 0.6 * min(apart, 64 * min(wide.words[a], wide.words[b]) // 2)
        else:
            assert bits == 0


def test_large_sets_meet_whole_only_if_they_may_be_alike(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 4)
    r = random.Random(6)
    texts = [[f"w{r.randrange(10 ** 6)}" for _ in range(r.choice([1500, 1600, 1700]))] for _ in range(11)]
    texts.append(["x" if i % 50 == 0 else w for i, w in enumerate(texts[0])])  # 0.8 of the five-word shingles and more
    texts.append([*texts[1][:1000], *(f"v{i}" for i in range(600))])
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    job = J.Join(df, "doc_id", "text", 5, 80, 100)
    read, asked = L.tokens_of(df, "doc_id", "text", 5, job.sets), set()

    def tokens(ids):
        asked.update(x.set_id for x in ids.collect())
        return read(ids)

    def near(x, y, bits):
        return (np.minimum(x, y) * 100 >= np.maximum(x, y) * 80) & (bits * 180 <= (x + y) * 20)
    got = L.connect(job.sets.select(F.lit(1).cast("long").alias("gid"), "set_id"), job.sets.drop("rep"), tokens, near, 80, 100).collect()
    alike = {x.set_id for x in job.sets.filter("rep IN (0, 11)").collect()}
    assert asked == {x.node for x in got} == alike and len({x.root for x in got}) == 1
