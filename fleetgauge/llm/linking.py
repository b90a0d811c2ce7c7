"""Exact links among sets that met in groups, whatever the size of a group.

``connect`` takes groups of sets (one group per entry or bucket that two sets
share) and returns components of all true links within groups.

1. Stars: a group's centre is the member whose sketch is nearest to the bitwise
   majority of all sketches, the likely original of a group of edited copies.
   Of the centres a set meets, the nearest one is verified on whole sets. Groups
   of more than ``BLOCK`` members are cut into blocks that have a centre each;
   centres then meet in the same way.
2. What lies apart: of a group that still holds several components, members
   outside the largest one are strays. Strays meet all others, the others only
   strays, in blocks; sketches say which members could still be linked. Sketches
   of one length tell nothing about sets far larger than themselves; these may
   bring a bitmap as wide as they are large, which is compared as well.
3. These meet once more with their whole sets, and a block sends the links that
   connect its components, no others.

So a group's rows grow with its size and with its strays, never with its pairs,
and every pair of different components is compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import released, settle, slices
from fleetgauge.llm.components import components, forest

#: Members of a group that are compared at a time, rows and bytes that a task takes at a time.
BLOCK, PART_ROWS, PART_BYTES = 1024, 20_000, 32 << 20
#: Bytes of whole sets in a block, of at most 8 * BLOCK members.
WHOLE_BYTES = 16 << 20


def _units(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys and the places where another unit begins, the end included."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    if len(new):
        new[0] = True
    return order, np.append(np.flatnonzero(new), len(order))


def _sketches(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sketch").to_pylist()), "<u8").reshape(t.num_rows, -1)


class _Wide:
    """Parity bitmaps of power-of-two lengths; a row may have none. The longer of two is folded to the length of the shorter."""

    def __init__(self, t: pa.Table):
        raw = t.column("wide").to_pylist() if "wide" in t.column_names else [None] * t.num_rows
        self.words = np.array([len(x or b"") // 8 for x in raw], np.int64)
        self.place, self.rows = np.zeros(len(raw), np.int64), {}
        for w in np.unique(self.words[self.words > 0]).tolist():
            own = np.flatnonzero(self.words == w)
            self.place[own] = np.arange(len(own))
            self.rows[w] = np.frombuffer(b"".join(raw[k] for k in own.tolist()), "<u8").reshape(len(own), w)

    def bits(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many bits the bitmaps of rows i and j differ; 0 where one has none."""
        out = np.zeros(len(i), np.int64)
        if not self.rows:
            return out
        for v in self.rows:
            for w in self.rows:
                pairs, least = np.flatnonzero((self.words[i] == v) & (self.words[j] == w)), min(v, w)
                step = max(1, (1 << 19) // max(v, w))
                for a in range(0, len(pairs), step):
                    k = pairs[a:a + step]
                    x, y = (np.bitwise_xor.reduce(self.rows[z][self.place[of[k]]].reshape(len(k), -1, least), axis=1) for z, of in ((v, i), (w, j)))
                    out[k] = np.bitwise_count(x ^ y).sum(axis=1)
        return out


def _parts(rows: DataFrame, *keys: str, n_rows: int, size: int = PART_ROWS) -> DataFrame:
    """Deals whole units out to parts of about ``size`` of the ``n_rows`` rows."""
    n = max(1, math.ceil(n_rows / size))
    return rows.withColumn("__part", F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"))


def _stars(near):
    def star(t: pa.Table) -> pa.Table:
        gid, salt, ids, n, sk = (*(t.column(c).to_numpy() for c in ("gid", "__salt", "set_id", "n_shingles")), _sketches(t))
        wide = _Wide(t)
        order, cut = _units(salt, gid)
        gid, ids, n, sk = gid[order], ids[order], n[order], sk[order]
        size = np.diff(cut)
        of = np.repeat(np.arange(len(size)), size)
        far = np.empty(len(ids), np.int64)
        for a in range(0, len(size), 2000):
            b = min(len(size), a + 2000)
            x, y = cut[a], cut[b]
            bits = np.unpackbits(sk[x:y].view(np.uint8), axis=1)
            most = 2 * np.add.reduceat(bits, cut[a:b] - x, axis=0, dtype=np.int32) > size[a:b, None]
            most = np.packbits(most, axis=1).view("<u8")
            far[x:y] = np.bitwise_count(sk[x:y] ^ most[of[x:y] - a]).sum(axis=1)
        c = np.lexsort((ids, far, of))[cut[:-1]][of]
        pop = np.maximum(np.bitwise_count(sk ^ sk[c]).sum(axis=1).astype(np.int64), wide.bits(order, order[c]))
        itself = c == np.arange(len(ids))
        ok = itself | near(n, n[c], pop)
        return pa.table({"gid": gid[ok], "a": ids[c][ok], "b": ids[ok], "far": pop[ok]})
    return star


def _live(near):
    def live(t: pa.Table) -> pa.Table:
        gid, i, j, ids, root, n, kind = (t.column(c).to_numpy() for c in ("gid", "__i", "__j", "set_id", "root", "n_shingles", "__kind"))
        sk, wide = _sketches(t), _Wide(t)
        order, cut = _units(j, i, gid)
        x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            u = order[a:b]
            left, right = u[kind[u] != 1], u[kind[u] != 0]
            for k in range(0, len(left), 128):
                p = left[k:k + 128]
                pop = np.zeros((len(p), len(right)), np.int64)
                for w in range(sk.shape[1]):
                    pop += np.bitwise_count(sk[p, w][:, None] ^ sk[right, w][None])
                ok = near(n[p][:, None], n[right][None], pop) & (root[p][:, None] != root[right][None])
                i, j = np.nonzero(ok)
                i, j = p[i], right[j]
                if wide.rows and len(i):
                    ok = near(n[i], n[j], wide.bits(i, j))
                    i, j = i[ok], j[ok]
                x.append(ids[i])
                y.append(ids[j])
                if sum(map(len, x)) > 1 << 20:
                    x, y = ([z] for z in forest(np.concatenate(x), np.concatenate(y)))
        x, y = forest(np.concatenate(x), np.concatenate(y))
        return pa.table({"a": x, "b": y})
    return live


def _links(num: int, den: int):
    def links(t: pa.Table) -> pa.Table:
        gid, i, j, ids, root, kind = (t.column(c).to_numpy() for c in ("gid", "__i", "__j", "set_id", "root", "__kind"))
        sets = [np.frombuffer(x, np.uint64) for x in t.column("tokens").to_pylist()]
        order, cut = _units(j, i, gid)
        a, b = [], []
        for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            u = order[x:y]
            left, right = u[kind[u] != 1].tolist(), u[kind[u] != 0]
            if not (left and len(right)):
                continue
            size = np.array([len(sets[k]) for k in right.tolist()])
            flat, owner = np.concatenate([sets[k] for k in right.tolist()]), np.repeat(np.arange(len(right)), size)
            by = np.argsort(flat, kind="stable")
            flat, owner = flat[by], owner[by]
            part = {r: r for r in root[u].tolist()}  # components of this unit as links are found

            def top(r: int, part: dict = part) -> int:
                while part[r] != r:
                    part[r] = r = part[part[r]]
                return r
            there = root[right].tolist()
            for k in left:
                s = sets[k]
                lo, hi = np.searchsorted(flat, s), np.searchsorted(flat, s, side="right")
                n = hi - lo
                ends = np.cumsum(n)
                both = np.bincount(owner[np.repeat(lo - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)], minlength=len(right))
                for m in np.flatnonzero(den * both >= num * (len(s) + size - both)).tolist():
                    p, q = top(int(root[k])), top(there[m])
                    if p != q:
                        part[max(p, q)] = min(p, q)
                        a.append(int(ids[k]))
                        b.append(int(ids[right[m]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return links


def _blocks(rows: DataFrame) -> DataFrame:
    """The units of :func:`_counted_blocks` for blocks of ``BLOCK`` members."""
    return _counted_blocks(rows)[0]


def _counted_blocks(rows: DataFrame, weight=None, most: int | None = None) -> tuple[DataFrame, int]:
    """Deals the members (gid, set_id, root) of groups that hold several components to units (gid, __i, __j): strays of
    block __i (``__kind`` 0) meet members of block __j (1); a stray of both blocks is there once (2). Also the number of rows.
    A block holds about ``most`` of the members' ``weight`` (``BLOCK`` members)."""
    weight, most = (F.lit(1), BLOCK) if weight is None else (weight, most)
    each = rows.groupBy("gid", "root").agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    each = each.groupBy("gid").agg(F.sum("n").alias("__n"), F.max("n").alias("__most"), F.max_by("root", F.struct("n", "root")).alias("__main"), F.count("*").alias("__roots"),
                                   F.sum("w").alias("__w"), F.max_by("w", F.struct("n", "root")).alias("__main_w")).filter("__roots > 1")
    blocks = F.ceil(F.col("__w") / most).cast("int")
    lefts = F.ceil((F.col("__w") - F.col("__main_w")) / most).cast("int")
    each = settle(each, "split")
    n_rows = each.agg(F.sum(F.col("__n") * lefts + (F.col("__n") - F.col("__most")) * (blocks - 1))).first()[0] or 0
    rows = rows.join(each, "gid")
    stray = F.col("root") != F.col("__main")
    rows = rows.withColumns({"__right": F.pmod(F.xxhash64("set_id"), blocks).cast("int"), "__left": F.when(stray, F.pmod(F.xxhash64("set_id", F.lit(1)), lefts).cast("int"))})
    unit = lambda i, j, kind: F.struct(i.alias("__i"), j.alias("__j"), kind.cast("int").alias("__kind"))
    right = F.transform(F.sequence(F.lit(0), lefts - 1), lambda i: unit(i, F.col("__right"), F.when(F.col("__left") == i, F.lit(2)).otherwise(F.lit(1))))
    left = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: unit(F.col("__left"), j, F.lit(0)))
    left = F.filter(left, lambda u: u["__j"] != F.col("__right"))
    rows = rows.withColumn("__u", F.explode(F.when(stray, F.concat(right, left)).otherwise(right)))
    return rows.select("__u.*", *[c for c in rows.columns if c not in ("__n", "__most", "__main", "__roots", "__w", "__main_w", "__right", "__left", "__u")]), n_rows


def connect(members: DataFrame, sets: DataFrame, tokens, near, num: int, den: int) -> DataFrame:
    """(node, root): components of the true links among sets that share a group; sets without a link have no row.

    ``members``: (gid, set_id: long), each once. ``sets``: (set_id, n_shingles: long, sketch: binary of one length).
    They may have ``wide``, a binary that may be null: parity bitmaps of power-of-two lengths, a shorter one the folded longer one.
    ``tokens(ids)``: (set_id, tokens: binary of sorted 64-bit words) for a table of set_id. ``near(n, n', bits)``: whether
    sizes and the number of bits in which the sketches differ allow a link, for arrays.
    """
    rows = settle(members.join(sets, "set_id"), "members")
    groups = rows.groupBy("gid").count()
    # wide bitmaps count as the rows they take the place of in a part
    scale = (rows.agg(F.avg(1 + F.coalesce(F.octet_length("wide"), F.lit(0)) * PART_ROWS / PART_BYTES)).first()[0] or 1) if "wide" in sets.columns else 1
    stars, level, salted = None, rows, groups
    while True:
        top, n_rows = (x or 0 for x in salted.agg(F.max("count"), F.sum("count")).first())
        here = level.join(salted, "gid").withColumn("__salt", F.pmod(F.xxhash64("set_id"), F.ceil(F.col("count") / BLOCK)).cast("int")).drop("count")
        star = _parts(here, "gid", "__salt", n_rows=n_rows * scale).groupBy("__part").applyInArrow(_stars(near), "gid long, a long, b long, far long")
        star = settle(star, "stars")
        stars = star if stars is None else stars.union(star)
        if top <= BLOCK:
            break
        centres = star.filter("a = b").select("gid", F.col("a").alias("set_id"))
        salted = centres.groupBy("gid").count().filter("count > 1")
        level = rows.join(centres, ["gid", "set_id"], "left_semi")
    first = stars.filter("a <> b").groupBy("b").agg(F.min_by("a", F.struct("far", "a")).alias("a"))
    ids = first.select(F.col("a").alias("set_id")).union(first.select("b")).distinct()
    links = settle(verified(first.select("a", "b"), settle(tokens(ids), "tokens"), num, den), "links")
    parts = settle(components(links), "parts")

    # what lies apart
    rows = rows.join(parts.select(F.col("node").alias("set_id"), F.col("root").alias("__root")), "set_id", "left").withColumn("root", F.coalesce("__root", "set_id")).drop("__root")
    units, n_rows = _counted_blocks(rows)
    candidates = settle(_parts(units, "gid", "__i", "__j", n_rows=float(n_rows) * scale).groupBy("__part").applyInArrow(_live(near), "a long, b long"), "candidates")
    live = settle(components(candidates).select(F.col("root").alias("gid"), F.col("node").alias("set_id")), "live")
    whole = settle(tokens(live.select("set_id")), "tokens")
    own = live.join(parts.select(F.col("node").alias("set_id"), "root"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    # whole sets are sent once a block: blocks by bytes, as a component of short sets has many blocks by members
    own = own.join(sets.select("set_id", "n_shingles"), "set_id")
    units, n_rows = _counted_blocks(own, F.greatest(8 * F.col("n_shingles"), F.lit(WHOLE_BYTES // (8 * BLOCK))), WHOLE_BYTES)
    units = units.drop("n_shingles")
    more = _parts(units.join(whole, "set_id"), "gid", "__i", "__j", n_rows=n_rows, size=PART_ROWS // 4).groupBy("__part").applyInArrow(_links(num, den), "a long, b long")
    return components(links.union(more))


def verified(pairs: DataFrame, whole: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose whole sets reach the threshold."""
    @F.arrow_udf("long")
    def common(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            yield pa.array([len(np.intersect1d(np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64), assume_unique=True)) for p, q in zip(x, y, strict=True)], pa.int64())
    both = pairs.join(whole.select(F.col("set_id").alias("a"), F.col("tokens").alias("__x")), "a").join(whole.select(F.col("set_id").alias("b"), F.col("tokens").alias("__y")), "b")
    both = both.select("a", "b", common("__x", "__y").alias("i"), (F.octet_length("__x") / 8 + F.octet_length("__y") / 8).cast("long").alias("t"))
    return both.filter(den * F.col("i") >= num * (F.col("t") - F.col("i"))).select("a", "b")


def smallest(sets: DataFrame, found: DataFrame) -> DataFrame:
    """(set_id, __low): the smallest key (``rep``) of each set's component, given (node, root)."""
    of = settle(sets.select("set_id", "rep").join(found.select(F.col("node").alias("set_id"), "root"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id")), "roots")
    return of.join(of.groupBy("root").agg(F.min("rep").alias("__low")), "root").select("set_id", "__low")


def tokens_of(docs: DataFrame, key: str, text: str, n: int, sets: DataFrame):
    """``tokens`` for ``connect``: whole sets read again from one document each (``rep`` of ``sets``)."""
    from fleetgauge.llm.ngram_join import set_id, shingles

    @released
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0)):
                got = shingles(batch.column(0)[a:b].to_pylist(), n)
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in got], pa.int64()), pa.array([s.tobytes() for s in got], pa.binary())], ["set_id", "tokens"])

    def tokens(ids: DataFrame) -> DataFrame:
        reps = sets.join(ids, "set_id").select(F.col("rep").alias("__rep"))
        rows = docs.select(F.col(key).alias("__rep"), F.col(text).alias("__text")).join(reps, "__rep", "left_semi")
        return rows.select("__text").mapInArrow(make, "set_id long, tokens binary").dropDuplicates(["set_id"])
    return tokens
