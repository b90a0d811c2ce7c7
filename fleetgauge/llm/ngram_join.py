"""Exact Jaccard self-join of documents on word n-grams, by partitions of the token universe.

Two sets whose Jaccard similarity reaches the threshold differ in at most H
tokens, H following from their sizes. Sizes are cut into bands so narrow that a
pair lies in one band or in two that follow each other; a pair is looked for in
the cell of its smaller set's band. In a cell all tokens are hashed into
segments. An exact segment is met if both sets have the same tokens in it, a
one-deletion segment if they differ by at most one, for which a set files its
subset and that subset without each of its tokens. With m0 exact and m1
one-deletion segments and m0 + 2 m1 = H + 1 + k, any pair within H meets in a
one-deletion segment or in k + 1 exact ones; so each set may leave out its k
cheapest-to-share exact subsets, those with the fewest tokens (ties by hash), and
both still file a common one. m0, m1 and k are chosen per cell by the number of
entries filed and of unrelated sets expected to meet, given the corpus counts of
the bands.

Equal sets are one set. Sets filed under one entry are a group, and groups with
the same members are one; ``linking`` finds the links that connect a group, with
parity bitmaps, whose distance never exceeds the true difference, as a screen and
whole sets to verify. Pairs that share an entry but no component are all compared,
so no link is lost while copies are not expanded into all pairs.

Words are runs of bytes other than space, tab to carriage return, with A-Z
lowered; a text with fewer than n words is one shingle. Tokens and sets are
64-bit hashes. Null and empty texts have no shingles and no links. A null key
takes no part; its component is null.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import byte_weights, mix, released, settle, slices
from fleetgauge.llm.linking import connect, smallest, tokens_of

WORDS = 8  # 64-bit words of a bitmap
#: Entries that a task gathers before it sends them, text bytes per group of entries.
FLUSH, PART_BYTES = 1 << 20, 8 << 20
#: Cost of a pair that meets without being alike, in entries filed.
MEETING = 10.0
_HEADS = "n_shingles long, set_id long, sketch binary, wide binary"


# ---- sets --------------------------------------------------------------------------------
@functools.cache
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """Random value of each byte, with A-Z as a-z; whether it parts words."""
    value = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
    value[65:91] = value[97:123]
    parts = np.zeros(256, bool)
    parts[[32, *range(9, 14)]] = True
    return value, parts


@functools.cache
def _powers(n: int) -> np.ndarray:
    p = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def shingles(texts: list[str | None], n: int = 4) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word n-grams."""
    enc = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    flat = np.frombuffer(b" ".join(enc) + b" ", np.uint8)
    start = np.append(0, np.cumsum([len(e) + 1 for e in enc], dtype=np.int64))
    value, parts = _bytes()
    gap = parts[flat]
    first = np.flatnonzero(~gap & np.append(True, gap[:-1]))
    if not len(first):
        return [np.zeros(0, np.uint64) for _ in enc]
    inside = np.flatnonzero(~gap)
    heads = np.searchsorted(inside, first)
    size = np.diff(np.append(heads, len(inside)))
    place = np.arange(len(inside)) - np.repeat(heads, size)
    w = mix(np.add.reduceat(value[flat[inside]] * _powers(1 << int(size.max()).bit_length())[place], heads) + size.astype(np.uint64))
    at = np.searchsorted(first, start)
    c = byte_weights()
    grams = w[:len(w) - n + 1] * c[0] if len(w) >= n else np.zeros(0, np.uint64)
    for i in range(1, n):
        grams = grams + w[i:len(w) - n + 1 + i] * c[i] if len(grams) else grams
    grams = mix(grams)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a:b - n + 1]))
        elif b > a:
            out.append(mix(np.array([(w[a:b] * c[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(s: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    if not len(s):
        return 0
    x = mix(np.array([mix(s + np.uint64(1)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64))
    return int(x.astype(np.int64)[0])


def bitmap(s: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Parity of the tokens hashed to each bit."""
    bits = np.bincount((s >> np.uint64(20)).astype(np.int64) & (64 * words - 1), minlength=64 * words).astype(np.uint8) & 1
    return np.packbits(bits, bitorder="little").view("<i8")


def wide_bitmap(s: np.ndarray) -> bytes | None:
    """The bitmap of a set with more tokens than ``bitmap`` has bits, with a bit a token: half of the bits of a shorter one differ, whatever the sets."""
    return bitmap(s, 1 << (len(s) - 1 >> 6).bit_length()).tobytes() if len(s) > 64 * WORDS else None


# ---- cells -------------------------------------------------------------------------------
@functools.cache
def bands(most: int, num: int, den: int) -> tuple[int, ...]:
    """Smallest size of each band: sizes s and s' with num / den of each other lie in one band or in neighbours."""
    edge = [1]
    while edge[-1] <= most:
        edge.append(max(edge[-1] + 1, (edge[-1] - 1) * den // num + 1))
    return tuple(edge)


def allowed(total: int, num: int, den: int) -> int:
    """Most tokens by which two sets with ``total`` tokens together may differ."""
    return (den - num) * total // (den + num)


def allocate(size: int, h: int, sets: float) -> tuple[int, int, int]:
    """(m0, m1, k) of least cost for sets of about ``size`` tokens when ``sets`` of them share the cell."""
    best = None
    for k in (0, 1, 2, 3, 4, 6, 8, 12, 16):
        need = h + 1 + k
        for m1 in sorted({0, 1, 2, 3, 4, need // 8, need // 4, need // 2}):
            m0 = need - 2 * m1
            if m0 < 0 or (m0 == 0 and k > 0):
                continue
            a = size / need
            void = m0 * math.exp(-a)
            tail = 1 - sum(math.exp(-void) * void ** i / math.factorial(i) for i in range(k + 1))
            meet = m0 * math.exp(-2 * a) * max(tail, 1e-12) + m1 * (math.exp(-2 * a) * (1 + 2 * a)) ** 2
            cost = max(0, m0 - k) + m1 * (1 + 2 * a) + MEETING * sets * meet
            if best is None or cost < best[0]:
                best = cost, (m0, m1, k)
    return best[1]


def plan(counts: dict[int, int], most: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """Allocation of every cell, given the number of sets in each band."""
    edge = bands(most, num, den)
    out = []
    for b in range(len(edge) - 1):
        top = edge[b + 1] - 1
        h = allowed(top + top * den // num, num, den)
        out.append(allocate(edge[b], h, counts.get(b, 0) + counts.get(b + 1, 0)))
    return out


def entries(s: np.ndarray, cell: int, alloc: tuple[int, int, int]) -> np.ndarray:
    """Hashes under which a set is filed in a cell."""
    m0, m1, k = alloc
    t = mix(s + np.uint64(7))
    unit = ((t >> np.uint64(32)) * np.uint64(m0 + 2 * m1) >> np.uint64(32)).astype(np.int64)
    seg = np.where(unit < m0, unit, m0 + (unit - m0) // 2)
    total, n = np.zeros(m0 + m1, np.uint64), np.bincount(seg, minlength=m0 + m1)
    np.add.at(total, seg, t)
    tag = mix(np.arange(m0 + m1, dtype=np.uint64) + np.uint64((cell + 1) << 32))
    exact = mix(total[:m0] + tag[:m0])
    if k:
        exact = exact[np.lexsort((exact, n[:m0]))[k:]]
    if not m1:
        return exact
    part = seg >= m0
    return np.concatenate([exact, mix(total[m0:] + tag[m0:]), mix(total[seg[part]] - t[part] + tag[seg[part]])])


# ---- jobs --------------------------------------------------------------------------------
def heads(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, n_shingles, set_id, bitmap, wide bitmap) of every row."""
    @released
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                sets = shingles(batch.column(1)[a:b].to_pylist(), n)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64()),
                                                  pa.array([bitmap(s).tobytes() for s in sets], pa.binary()), pa.array([wide_bitmap(s) for s in sets], pa.binary())], [key, "n_shingles", "set_id", "sketch", "wide"])
    return df.select(F.col(key), F.col(text)).mapInArrow(make, f"{key} {dict(df.dtypes)[key]}, {_HEADS}")


class Packer:
    """Gathers (set, hashes it is filed under) and sends them packed by range of hash."""

    SCHEMA = "part int, low binary, place binary, sets binary"

    def __init__(self, n_parts: int):
        self.n_parts, self.hashes, self.owners, self.held = n_parts, [], [], 0
        self.seen: set[int] = set()

    def known(self, i: int) -> bool:
        """Whether the task has filed the set lately."""
        if i in self.seen:
            return True
        if len(self.seen) >= FLUSH:
            self.seen.clear()
        self.seen.add(i)
        return False

    def add(self, i: int, hashes: np.ndarray):
        self.hashes.append(hashes)
        self.owners.append(np.full(len(hashes), i, np.int64))
        self.held += len(hashes)

    def flush(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if self.held < least:
            return
        h, o = np.concatenate(self.hashes), np.concatenate(self.owners)
        self.hashes, self.owners, self.held = [], [], 0
        part = ((h >> np.uint64(40)) * np.uint64(self.n_parts) >> np.uint64(24)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        h, o, part = h[order], o[order], part[order]
        cut = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)).tolist()
        rows = []
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            sets, place = np.unique(o[x:y], return_inverse=True)
            low = h[x:y].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            rows.append((int(part[x]), low.tobytes(), place.astype("<u4" if len(sets) > 65535 else "<u2").tobytes(), sets.astype("<i8").tobytes()))
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["part", "low", "place", "sets"])


def file_entries(df: DataFrame, text: str, n: int, hashes, n_parts: int) -> DataFrame:
    """The entries of all rows, packed; ``hashes(set)`` yields arrays of them. Equal sets of a task are filed once."""
    @released
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Packer(n_parts)
        for batch in batches:
            for a, b in slices(batch.column(0)):
                for s in shingles(batch.column(0)[a:b].to_pylist(), n):
                    i = set_id(s)
                    if len(s) and not out.known(i):
                        for h in hashes(s):
                            out.add(i, h)
                yield from out.flush(FLUSH)
        yield from out.flush()
    return df.select(F.col(text)).mapInArrow(make, Packer.SCHEMA)


def cell_entries(alloc: list, most: int, num: int, den: int):
    edge = np.array(bands(most, num, den))

    def hashes(s: np.ndarray) -> Iterator[np.ndarray]:
        band = int(np.searchsorted(edge, len(s), side="right")) - 1
        for cell in (band, band - 1):
            if cell >= 0:
                yield entries(s, cell, alloc[cell])
    return hashes


def _meet(t: pa.Table) -> pa.Table:
    """(group, set) of all sets filed under an entry with others; a group is named by its members, so equal groups are one."""
    h, o = [], []
    for low, place, sets in zip(t.column("low"), t.column("place"), t.column("sets"), strict=True):
        raw = np.frombuffer(low.as_py(), np.uint8).reshape(-1, 5)
        x = np.zeros((len(raw), 8), np.uint8)
        x[:, :5] = raw
        ids = np.frombuffer(sets.as_py(), "<i8")
        h.append(x.view("<u8").ravel())
        o.append(ids[np.frombuffer(place.as_py(), "<u4" if len(ids) > 65535 else "<u2")])
    h, o = np.concatenate(h), np.concatenate(o)
    order = np.argsort(h, kind="stable")
    h, o = h[order], o[order]
    same = h[1:] == h[:-1]
    keep = np.append(same, False) | np.append(False, same)
    h, o = h[keep], o[keep]
    order = np.lexsort((o, h))
    h, o = h[order], o[order]
    keep = np.append(True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])) if len(h) else np.zeros(0, bool)
    h, o = h[keep], o[keep]
    start = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(h)))
    name = mix(np.add.reduceat(mix(o.view(np.uint64) + np.uint64(1)), start) + size.astype(np.uint64)) if len(start) else np.zeros(0, np.uint64)
    once = np.zeros(len(start), bool)
    once[np.unique(name, return_index=True)[1]] = True
    keep = np.repeat(once & (size > 1), size)
    return pa.table({"gid": np.repeat(name.view(np.int64), size)[keep], "set_id": o[keep]})


class Join:
    """One run of the join: the whole sets of candidates are read from the documents again, for those alone."""

    def __init__(self, docs: DataFrame, key: str, text: str, n: int, num: int, den: int):
        self.docs, self.key, self.text, self.n, self.num, self.den = docs, key, text, n, num, den
        self.heads = settle(heads(docs, key, text, n), "heads")
        known = self.heads.filter(F.col(key).isNotNull() & (F.col("n_shingles") > 0))
        self.sets = settle(known.groupBy("set_id").agg(F.min(key).alias("rep"), *(F.first(c).alias(c) for c in ("n_shingles", "sketch", "wide"))), "sets")

    def linked(self, filed: DataFrame) -> DataFrame:
        """(node, root): components of the sets, given their packed entries."""
        num, den = self.num, self.den

        def near(x, y, bits):
            return (np.minimum(x, y) * den >= np.maximum(x, y) * num) & (bits * (den + num) <= (x + y) * (den - num))
        members = filed.groupBy("part").applyInArrow(_meet, "gid long, set_id long").distinct()
        return connect(members, self.sets.select("set_id", "n_shingles", "sketch", "wide"), tokens_of(self.docs, self.key, self.text, self.n, self.sets), near, num, den)


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(key, n_shingles, component_id): rows linked by a similarity of at least ``num / den``, named by their smallest key."""
    docs = df.select(F.col(key).cast("long").alias(key), F.col(text))
    job = Join(docs, key, text, n, num, den)
    most, size = job.sets.agg(F.max("n_shingles"), F.sum("n_shingles")).first()
    out = job.heads.select(key, "n_shingles", F.when(F.col(key).isNotNull() & (F.col("n_shingles") > 0), F.col("set_id")).alias("set_id"))
    if not most:
        return out.select(key, "n_shingles", F.col(key).alias("component_id"))
    edge = bands(most, num, den)
    counts = job.sets.groupBy((F.size(F.filter(F.array(*map(F.lit, edge)), lambda e: e <= F.col("n_shingles"))) - 1).alias("band")).count()
    alloc = plan({r[0]: r[1] for r in counts.collect()}, most, num, den)  # a row a band
    filed = file_entries(docs.filter(F.col(key).isNotNull()), text, n, cell_entries(alloc, most, num, den), max(1, math.ceil(8 * size / PART_BYTES)))
    named = smallest(job.sets, job.linked(filed))
    return out.join(named, "set_id", "left").select(key, "n_shingles", F.coalesce("__low", key).alias("component_id"))
