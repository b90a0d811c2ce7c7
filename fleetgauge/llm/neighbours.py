"""Nearest neighbours by inner product over learned partitions.

The neighbour graph of a sample is cut into balanced partitions: a set of nodes
is halved at the median of its main direction, then nodes change sides in pairs
as long as that puts more neighbours together, and the halves are halved again.
A small network with one hidden layer learns to predict, for a vector, in which
partitions its neighbours lie. Every vector is indexed in its most probable
partition; a query visits the most probable ones, as many as the sample's own
neighbours need to be found with the wanted recall, and exact inner products in
double precision rank what is there.

The sample holds at most ``SAMPLE`` distinct vectors, those of smallest hash; all
distinct vectors are indexed. Equal vectors are one entry that keeps its
``k + 1`` smallest ids, which are all that a list of k can need. Partitions are
dealt out in blocks of bounded size on both sides.

Vectors that are null, zero, of another length than most, or that hold null or
non-finite components take no part, and neither do null ids. Ties go to the
smaller id. With fewer than k candidates all are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm.common import settle

SAMPLE = 16384
#: Vectors a partition should hold, most partitions, hidden units, passes over the sample, neighbours in the graph.
PART_SIZE, MOST_PARTS, HIDDEN, EPOCHS, DEGREE = 256, 1024, 128, 20, 20
#: Share of the sample's neighbours that the visited partitions must hold.
COVERAGE = 0.94
#: Vectors and queries that meet in a task; partitions that lie side by side are dealt out together up to this size.
BASE_BLOCK, QUERY_BLOCK = 8192, 1024


def graph(x: np.ndarray, degree: int) -> np.ndarray:
    """The ``degree`` nearest other rows of each row."""
    out = np.empty((len(x), degree), np.int64)
    for i in range(0, len(x), 512):
        s = x[i:i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i:i + 512] = np.argpartition(-s, degree - 1, axis=1)[:, :degree]
    return out


def halve(x: np.ndarray, nodes: np.ndarray, near: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Side (0 or 1) of each node, equally many on both."""
    v = x[nodes] - x[nodes].mean(axis=0)
    d = v[np.abs(v).sum(axis=1).argmax()].copy()
    for _ in range(8):
        d = v.T @ (v @ d)
        d /= np.linalg.norm(d) + 1e-12
    side = np.zeros(len(nodes), np.int64)
    side[np.argsort(v @ d, kind="stable")[len(nodes) // 2:]] = 1
    local = np.full(len(x), -1, np.int64)
    local[nodes] = np.arange(len(nodes))
    to = local[near[nodes]]
    a = np.repeat(np.arange(len(nodes)), near.shape[1])[to.ravel() >= 0]
    b = to.ravel()[to.ravel() >= 0]
    u, w = np.concatenate([a, b]), np.concatenate([b, a])
    for _ in range(rounds):
        gain = np.bincount(u, np.where(side[u] != side[w], 1.0, -1.0), len(nodes))
        zero, one = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        zero, one = zero[np.argsort(-gain[zero], kind="stable")], one[np.argsort(-gain[one], kind="stable")]
        n = min(len(zero), len(one))
        swap = int(((gain[zero[:n]] + gain[one[:n]]) > 0).sum())
        swap = min(swap, max(1, n // 10)) if swap else 0
        if not swap:
            break
        side[zero[:swap]], side[one[:swap]] = 1, 0
    return side


def partition(x: np.ndarray, near: np.ndarray, parts: int) -> np.ndarray:
    """Balanced partition of the rows into ``parts`` (a power of two) by repeated halving of their graph."""
    label = np.zeros(len(x), np.int64)
    for _ in range(parts.bit_length() - 1):
        side = np.zeros(len(x), np.int64)
        for p in np.unique(label).tolist():
            nodes = np.flatnonzero(label == p)
            if len(nodes) > 1:
                side[nodes] = halve(x, nodes, near)
        label = 2 * label + side
    return label


class Router:
    """Network from a vector to the probability of each partition, and the number of partitions to visit."""

    def __init__(self, weights: list[np.ndarray], visits: int):
        self.weights, self.visits = weights, visits

    @property
    def parts(self) -> int:
        return len(self.weights[3])

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum(x.astype(np.float32) @ w1 + b1, 0) @ w2 + b2

    def place(self, x: np.ndarray) -> np.ndarray:
        return self.logits(x).argmax(axis=1)

    def route(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :self.visits]

    @classmethod
    def fit(cls, x: np.ndarray, parts: int, coverage: float = COVERAGE, seed: int = 7) -> Router:
        """Train on the sample's graph; ``visits`` is the smallest number that covers enough of its neighbours."""
        rng = np.random.default_rng(seed)
        x = x.astype(np.float32)
        near = graph(x, min(DEGREE, len(x) - 1)) if len(x) > 1 else np.zeros((len(x), 0), np.int64)
        label = partition(x, near, parts)
        own = np.concatenate([label[near], label[:, None]], axis=1)
        target = np.zeros((len(x), parts), np.float32)
        np.add.at(target, (np.repeat(np.arange(len(x)), own.shape[1]), own.ravel()), 1.0 / own.shape[1])
        w = [rng.normal(size=(x.shape[1], HIDDEN)).astype(np.float32) * np.float32(math.sqrt(2 / x.shape[1]) / max(1e-9, float(np.sqrt((x * x).mean() * x.shape[1])))) * np.float32(math.sqrt(x.shape[1])),
             np.zeros(HIDDEN, np.float32), rng.normal(size=(HIDDEN, parts)).astype(np.float32) / np.float32(math.sqrt(HIDDEN)), np.zeros(parts, np.float32)]
        m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(x))
            for i in range(0, len(x), 256):
                b = order[i:i + 256]
                h = np.maximum(x[b] @ w[0] + w[1], 0)
                z = h @ w[2] + w[3]
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                dz = (p - target[b]) / len(b)
                dh = (dz @ w[2].T) * (h > 0)
                step += 1
                for j, g in enumerate((x[b].T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0))):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.999 * v[j] + 0.001 * g * g
                    w[j] = w[j] - np.float32(3e-3 * (1 - epoch / EPOCHS)) * (m[j] / np.float32(1 - 0.9 ** step)) / (np.sqrt(v[j] / np.float32(1 - 0.999 ** step)) + np.float32(1e-8))
        out = cls(w, parts)
        if near.shape[1]:
            rank = np.empty((len(x), parts), np.int64)
            np.put_along_axis(rank, np.argsort(-out.logits(x), axis=1, kind="stable"), np.arange(parts)[None], axis=1)
            need = np.sort(np.take_along_axis(rank, out.place(x)[near], axis=1).ravel())
            out.visits = int(need[min(len(need) - 1, math.ceil(coverage * len(need)))]) + 1
        return out


def _pack(batches: Iterator[pa.RecordBatch], double: bool, k: int, every: int) -> Iterator[pa.RecordBatch]:
    """Equal vectors of a batch become one row with their k + 1 smallest ids."""
    kind = np.float64 if double else np.float32
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy()
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(ids), -1) + kind(0)  # + 0: no negative zeros
        order = np.argsort(ids, kind="stable")
        raw = [x[i].tobytes() for i in order.tolist()]
        got: dict[bytes, list[int]] = {}
        asks: dict[bytes, bool] = {}
        for i, r in zip(ids[order].tolist(), raw, strict=True):
            at = got.setdefault(r, [])
            if len(at) <= k and (not at or at[-1] != i):
                at.append(i)
            asks[r] = asks.get(r, False) or i % every == 0
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.binary()), pa.array(list(got.values()), pa.list_(pa.int64())), pa.array(list(asks.values()), pa.bool_())], ["vec", "ids", "asks"])


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows with an id and a finite vector, not zero, of the commonest length."""
    known = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter(F.col("id").isNotNull() & (F.size("v") > 0))
    fine = known.filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0))
    size = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return fine.filter(F.size("v") == (size[0] if size else -1))


def _top(k: int, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best, best first, ties to the smaller id."""
    at = np.arange(len(ids))
    if len(ids) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(ids) - k)[len(ids) - k])
    at = at[np.lexsort((ids[at], -scores[at]))[:k]]
    return at, scores[at]


def search(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, every: int = 20, coverage: float = COVERAGE) -> DataFrame:
    """(query_id, rank, key, score): for each row whose id is divisible by ``every`` its k nearest other rows found."""
    spark = df.sparkSession
    rows = usable(df, key, vector)
    double = dict(rows.dtypes)["v"] != "array<float>"
    kind = np.float64 if double else np.float32

    def distinct(batches):
        return _pack(batches, double, k, every)
    merged = lambda: (F.slice(F.array_distinct(F.sort_array(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"), F.bool_or("asks").alias("asks"))
    entry = rows.mapInArrow(distinct, "vec binary, ids array<long>, asks boolean").groupBy("vec", (F.spark_partition_id() % 64).alias("salt")).agg(*merged()).groupBy("vec").agg(*merged())
    entry = settle(entry.withColumn("vid", F.col("ids")[0]), "vectors")
    n = entry.count()
    parts = 1 << max(3, min(MOST_PARTS.bit_length() - 1, round(math.log2(max(1, n) / PART_SIZE)))) if n else 8
    sample = np.stack([np.frombuffer(r[0], kind) for r in entry.orderBy(F.xxhash64("vec"), "vid").limit(SAMPLE).select("vec").collect()]) if n else np.zeros((0, 1), kind)
    router = Router.fit(sample, parts, coverage) if n else None

    groups = 1
    while groups < parts and groups * BASE_BLOCK < n:
        groups *= 2
    per_group = parts // groups

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = router.place(np.stack([np.frombuffer(v.as_py(), kind) for v in batch.column(1)])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p // per_group, pa.int32()), pa.array(p[:, None].tolist(), pa.list_(pa.int32()))], ["vid", "vec", "grp", "parts"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each group of partitions that a query visits, with those of its partitions."""
        for batch in batches:
            if batch.num_rows:
                to = np.sort(router.route(np.stack([np.frombuffer(v.as_py(), kind) for v in batch.column(1)])), axis=1)
                at, grp, visited = [], [], []
                for i, t in enumerate(to):
                    for g in np.unique(t // per_group).tolist():
                        at.append(i)
                        grp.append(g)
                        visited.append(t[t // per_group == g].tolist())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(grp, pa.int32()), pa.array(visited, pa.list_(pa.int32()))], ["vid", "vec", "grp", "parts"])
    kinds = "vid long, vec binary, grp int, parts array<int>"
    base, asked = entry.select("vid", "vec").mapInArrow(place, kinds), entry.filter("asks").select("vid", "vec").mapInArrow(route, kinds)
    # at most MOST_PARTS rows
    shares = base.groupBy("grp").agg(F.ceil(F.count("*") / BASE_BLOCK).cast("int").alias("nb")).join(
        asked.groupBy("grp").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("nq")), "grp")
    shares = F.broadcast(settle(shares, "shares"))
    deal = lambda d, mine, other: (d.join(shares, "grp").withColumn(mine[0], F.pmod(F.xxhash64("vid"), F.col(mine[1])).cast("int"))
                                   .withColumn(other[0], F.explode(F.sequence(F.lit(0), F.col(other[1]) - 1))).select("grp", "b", "q", "vid", "vec", "parts"))

    def rank(asks: pa.Table, have: pa.Table) -> pa.Table:
        """The k + 1 best of a block for each query, over the partitions it visits."""
        found: dict[int, list] = {}
        if asks.num_rows and have.num_rows:
            x, y = (np.stack([np.frombuffer(v.as_py(), kind) for v in t.column("vec")]).astype(np.float64) for t in (asks, have))
            ids, askers = have.column("vid").to_numpy(), asks.column("vid").to_numpy()
            home = np.array([p[0] for p in have.column("parts").to_pylist()])
            visits = asks.column("parts").to_pylist()
            who, where = np.repeat(np.arange(len(visits)), [len(v) for v in visits]), np.concatenate(visits)
            for p in np.unique(home).tolist():
                q, h = who[where == p], np.flatnonzero(home == p)
                for i in range(0, len(q), 128):
                    for a, line in zip(q[i:i + 128].tolist(), x[q[i:i + 128]] @ y[h].T, strict=True):
                        at, best = _top(k + 1, line, ids[h])
                        found.setdefault(a, []).append((ids[h[at]], best))
        out = []
        for a, lists in found.items():
            cand, best = (np.concatenate(z) for z in zip(*lists, strict=True))
            at, best = _top(k + 1, best, cand)
            out.append((np.full(len(at), askers[a], np.int64), cand[at], best))
        a, b, c = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"asker": a, "vid": b, "score": c})
    left, right = deal(asked, ("q", "nq"), ("b", "nb")), deal(base, ("b", "nb"), ("q", "nq"))
    found = left.groupBy("grp", "b", "q").cogroup(right.groupBy("grp", "b", "q")).applyInArrow(rank, "asker long, vid long, score double")
    best = Window.partitionBy("asker").orderBy(F.desc("score"), "vid")
    found = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
    each = found.join(entry.select("vid", "ids"), "vid").select("asker", "score", F.explode("ids").alias("id"))
    each = each.withColumn("r", F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "id"))).filter(F.col("r") <= k + 1).drop("r")

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(batch.num_rows, -1) + kind(0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in x], pa.binary())], ["query_id", "vec"])
    asking = rows.filter(F.col("id") % every == 0).distinct().mapInArrow(one, "query_id long, vec binary").join(entry.select("vec", F.col("vid").alias("asker")), "vec").drop("vec")
    out = asking.join(each, "asker").filter(F.col("id") != F.col("query_id"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("id").alias(key), "score")
