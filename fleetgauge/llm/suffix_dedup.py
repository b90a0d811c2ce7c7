"""Removal of byte strings that repeat across documents, by a distributed merge sort of suffixes.

Every string of ``span`` bytes has an anchor, its 16-gram of smallest hash (the
first of equals), so equal strings have equal anchors. An anchor owns the strings
that chose it, a run of consecutive starts; the bytes of that run are its
context. Suffixes are sorted from anchors only:

1. Documents are dealt to blocks of a few MB. Each block sends the sorted set of
   its anchors' hashes; those that no other block has are dropped, unless two
   texts of the block share them.
2. For the rest a block sorts the suffixes that start at the anchors (with the
   bytes before the anchor behind them), collapses equal ones and sends them as
   front-coded runs: length of the common prefix with the one before, then the
   bytes that differ. Runs meet by anchor hash, so that no common opening makes a
   hot range.
3. Runs are merged by a loser tree that keeps common-prefix lengths: two suffixes
   are compared only beyond the prefix both are known to share with the last one
   that won. Suffixes with a common 16-gram come out together; for each string of
   ``span`` bytes in them the smallest document is found, and blocks are told
   where it is smaller than their own.
4. Each block covers the repeated bytes and returns its documents.

The documents' one shuffle serves the steps 1, 2 and 4. Equal texts of a block
are handled once, so a text that a third of all rows repeat costs one entry a
block. Strings are judged on the input: a string is removed from a document if it
also starts in one with a smaller key. Null texts are empty. Rows with a null key
take no part and are kept whole; rows with equal keys do not remove each other's
bytes. Columns are returned where ``carry`` names them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import mix

GRAM = 16
#: Text bytes of a block, and of a slice that is hashed at a time.
BLOCK, SLICE, SEGMENT = 4 << 20, 1 << 20, 8 << 20
_LOW = np.uint64((1 << 40) - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


# ---- anchors -----------------------------------------------------------------------------
def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n + 1, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def identity(flat: np.ndarray, lo: np.ndarray, hi: np.ndarray, gram_at: np.ndarray) -> np.ndarray:
    """64-bit names of the byte strings ``flat[lo:hi]`` with their anchor's place."""
    n = len(flat)
    total = np.append(np.uint64(0), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n)[:n], dtype=np.uint64))
    return mix((total[hi] - total[lo]) * _powers(_INVERSE, n)[lo] + (gram_at - lo).astype(np.uint64))


def _block_anchors(flat: np.ndarray, start: np.ndarray, size: np.ndarray, span: int) -> dict[str, np.ndarray]:
    """Anchors of texts laid out in ``flat``, positions counted in it."""
    n, width = len(flat), span - GRAM + 1
    empty = {k: np.zeros(0, np.int64) for k in ("at", "lo", "hi")} | {k: np.zeros(0, np.uint64) for k in ("gram", "name")}
    if n < span:
        return empty
    words = np.ndarray((n - 7,), "<u8", buffer=flat, strides=(1,))
    h = mix(words[:n - GRAM + 1] * np.uint64(0xD6E8FEB86659FD93) + mix(words[GRAM - 8:]))
    low = h >> np.uint64(24) << np.uint64(24) | np.arange(len(h), dtype=np.uint64)
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        low = np.minimum(low[:-step], low[step:])
        reach += step
    choice = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
    edge = np.zeros(len(choice) + 1, np.int32)
    long = size >= span
    edge[start[long]] += 1
    edge[(start + size - span + 1)[long]] -= 1
    valid = np.cumsum(edge[:-1]) > 0
    change = choice[1:] != choice[:-1]
    lo = np.flatnonzero(valid & (np.append(True, ~valid[:-1] | change)))
    hi = np.flatnonzero(valid & (np.append(~valid[1:] | change, True)))
    at = choice[lo]
    return {"at": at, "lo": lo, "hi": hi, "gram": h[at], "name": identity(flat, lo, hi + span, at)}


def anchors(texts: list[bytes], span: int) -> dict[str, np.ndarray]:
    """For all anchors of all texts: ``text`` (its number), ``at``, first and last string start ``lo`` and ``hi``, ``gram`` and ``name``."""
    parts: list[dict] = []
    pieces: list[tuple[int, int, bytes]] = []  # text, offset, bytes

    def flush():
        flat = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
        size = np.array([len(p[2]) for p in pieces], np.int64)
        start = np.cumsum(size) - size
        got = _block_anchors(flat, start, size, span)
        k = np.searchsorted(start, got["lo"], side="right") - 1
        shift = np.array([p[1] for p in pieces], np.int64)[k] - start[k]
        parts.append({"text": np.array([p[0] for p in pieces], np.int64)[k], "gram": got["gram"], "name": got["name"]} | {x: got[x] + shift for x in ("at", "lo", "hi")})
        pieces.clear()
    held = 0
    for i, t in enumerate(texts):
        if len(t) < span:
            continue
        for s in range(0, len(t) - span + 1, SEGMENT):
            piece = t[s:s + SEGMENT + span - 1]
            if pieces and held + len(piece) > SLICE:
                flush()
                held = 0
            pieces.append((i, s, piece))
            held += len(piece)
    if pieces:
        flush()
    if not parts:
        return {k: np.zeros(0, np.int64) for k in ("text", "at", "lo", "hi")} | {k: np.zeros(0, np.uint64) for k in ("gram", "name")}
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


class Block:
    """The documents of a block: distinct texts, each with its smallest key."""

    def __init__(self, keys: list, texts: list[bytes | None], span: int):
        order = sorted((i for i in range(len(keys)) if keys[i] is not None), key=lambda i: keys[i])
        number: dict[bytes, int] = {}
        self.first: list[int] = []  # key of each distinct text
        self.of = np.full(len(keys), -1, np.int64)
        for i in order:
            t = texts[i] or b""
            if t not in number:
                number[t] = len(number)
                self.first.append(keys[i])
            self.of[i] = number[t]
        self.texts, self.span = list(number), span
        self.first = np.array(self.first, np.int64)
        self.a = anchors(self.texts, span)

    def pick(self, n_ranges: int) -> tuple[np.ndarray, np.ndarray]:
        """Range and low bits of every anchor's hash."""
        g = self.a["gram"]
        return ((g >> np.uint64(40)) * np.uint64(n_ranges) >> np.uint64(24)).astype(np.int64), g & _LOW


def _five(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_five(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return out.view("<u8").ravel()


def _dump(*arrays: np.ndarray) -> bytes:
    import zstandard
    sizes = np.array([a.nbytes for a in arrays], "<u4")
    return zstandard.ZstdCompressor(level=1).compress(sizes.tobytes() + b"".join(a.tobytes() for a in arrays))


def _load(data: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes = np.frombuffer(raw[:4 * len(kinds)], "<u4").tolist()
    out, at = [], 4 * len(kinds)
    for kind, n in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(raw[at:at + n], kind))
        at += n
    return out


# ---- runs --------------------------------------------------------------------------------
_RUN = ("u1", "u1", "u1", "<i8", "<i8", "u1")


def _common(a: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Length of the prefix each row has in common with the row before."""
    if not len(a):
        return np.zeros(0, np.int64)
    differ = np.hstack([a[1:] != a[:-1], np.ones((len(a) - 1, 1), bool)]).argmax(axis=1)
    return np.append(0, np.minimum(differ, np.minimum(size[1:], size[:-1])))


def front_coded(block: Block, take: np.ndarray) -> bytes:
    """The suffixes at the anchors ``take`` as a sorted run without repeats: prefix lengths, lengths, anchor places, smallest and largest key, other bytes."""
    a, span = block.a, block.span
    text, at, lo, end = a["text"][take], a["at"][take], a["lo"][take], a["hi"][take] + span
    left, size = at - lo, end - lo
    width = int(size.max())
    rows = np.zeros((len(take), width), np.uint8)
    for i, (t, x, y, z) in enumerate(zip(text.tolist(), lo.tolist(), at.tolist(), end.tolist(), strict=True)):
        b = block.texts[t]
        rows[i, :z - x] = np.frombuffer(b[y:z] + b[x:y], np.uint8)
    keyed = np.hstack([rows, size[:, None].astype(np.uint8), left[:, None].astype(np.uint8)])
    name = np.ascontiguousarray(keyed).view(f"V{width + 2}").ravel()
    order = np.argsort(np.ascontiguousarray(keyed).view(f"S{width + 2}").ravel(), kind="stable")
    first = np.append(True, name[order][1:] != name[order][:-1])
    at = np.flatnonzero(first)
    key = block.first[text][order]
    rows, size, left = rows[order][at], size[order][at], left[order][at]
    prefix = _common(rows, size)
    rest = rows[(np.arange(width) >= prefix[:, None]) & (np.arange(width) < size[:, None])]
    return _dump(prefix.astype("u1"), size.astype("u1"), left.astype("u1"), np.minimum.reduceat(key, at).astype("<i8"), np.maximum.reduceat(key, at).astype("<i8"), rest)


class Run:
    def __init__(self, data: bytes):
        prefix, size, left, low, high, rest = _load(data, *_RUN)
        self.prefix, self.left, self.low, self.high = prefix.tolist(), left.tolist(), low.tolist(), high.tolist()
        self.keys, raw, at, last = [], rest.tobytes(), 0, b""
        for p, n in zip(self.prefix, size.tolist(), strict=True):
            last = last[:p] + raw[at:at + n - p]
            at += n - p
            self.keys.append(last)


def _compare(a: bytes, b: bytes, known: int) -> tuple[bool, int]:
    """Whether a <= b, and their common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    if not x:
        return len(a) <= len(b), n
    same = n - (x.bit_length() + 7) // 8
    return a[same] < b[same], same


def merge(runs: list[Run]) -> Iterator[tuple[int, int, int]]:
    """(common prefix with the one before, run, place in it) of all suffixes in order.

    A loser tree: each inner node keeps the run that lost there and the prefix it shares with the winner it lost to.
    Of two suffixes with different prefixes known to be shared with the last winner, the longer one comes first.
    """
    k = len(runs)
    place = [0] * k
    loser, shared = [0] * k, [0] * k
    keys = [r.keys for r in runs]

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        first, n = _compare(keys[a][0], keys[b][0], 0)
        if not first:
            a, b = b, a
        loser[node], shared[node] = b, n
        return a
    if not k:
        return
    win, n = (play(1), 0)
    alive, done = k, [False] * k
    while True:
        i = place[win]
        yield n, win, i
        i += 1
        place[win] = i
        if i < len(keys[win]):
            n = runs[win].prefix[i]
        else:
            done[win] = True
            alive -= 1
            if not alive:
                return
            n = -1  # an ended run loses to all
        cur, node = win, (win + k) >> 1
        while node:
            m = shared[node]
            other = loser[node]
            if done[other]:
                m = -1
            if m > n:
                loser[node], shared[node] = cur, n
                cur, n = other, m
            elif m == n and n >= 0:
                first, same = _compare(keys[cur][place[cur]], keys[other][place[other]], n)
                if first:
                    shared[node] = same
                else:
                    loser[node], shared[node] = cur, same
                    cur = other
            node >>= 1
        win = cur


def replies(runs: list[Run], owner: list[int], span: int) -> dict[int, list[tuple[bytes, int, int, int, int]]]:
    """Per block: (string, anchor place, first and last start in it, smallest key) where a block's largest key is not the smallest."""
    out: dict[int, list] = {}
    group: list[tuple[bytes, int, int, int, int]] = []

    def close():
        if len(group) == 1 and group[0][2] == group[0][3]:
            return
        same = all(e[0] == group[0][0] and e[1] == group[0][1] for e in group)
        if same:
            m = min(e[2] for e in group)
            for s, off, _, high, blk in group:
                if high > m:
                    out.setdefault(blk, []).append((s, off, 0, len(s) - span, m))
            return
        best: dict[bytes, int] = {}
        for s, _, low, _, _ in group:
            for i in range(len(s) - span + 1):
                w = s[i:i + span]
                if best.get(w, low) >= low:
                    best[w] = low
        for s, off, _, high, blk in group:
            i, last = 0, len(s) - span
            while i <= last:
                m, j = best[s[i:i + span]], i
                while j < last and best[s[j + 1:j + 1 + span]] == m:
                    j += 1
                if high > m:
                    out.setdefault(blk, []).append((s, off, i, j, m))
                i = j + 1
    for n, r, i in merge(runs):
        if n < GRAM and group:
            close()
            group = []
        run = runs[r]
        key, off = run.keys[i], run.left[i]
        cut = len(key) - off
        group.append((key[cut:] + key[:cut], off, run.low[i], run.high[i], owner[r]))
    if group:
        close()
    return out


# ---- operator ----------------------------------------------------------------------------
def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = 50, whole_characters: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, n_bytes, spans, kept): maximal removed byte ranges of each text and its other bytes; ``carry`` names columns to keep.

    ``whole_characters`` removes a character only if all its bytes repeat, so that ``kept`` stays valid text.
    """
    if not GRAM <= span <= 128:
        raise ValueError("span must be 16 to 128 bytes")
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n_blocks, n_ranges, n_groups = (max(1, math.ceil(total / x)) for x in (BLOCK, 16 << 20, 2 << 20))
    docs = df.select(F.pmod(F.xxhash64(key, F.octet_length(text)), F.lit(n_blocks)).cast("int").alias("blk"), F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"), *(F.col(c).alias(f"carry{i}") for i, c in enumerate(carry)))
    carried = [f for f in docs.columns if f.startswith("carry")]

    def block(t: pa.Table) -> Block:
        return Block(t.column("key").to_pylist(), t.column("text").to_pylist(), span)

    def send(t: pa.Table) -> pa.Table:
        b = block(t)
        part, low = b.pick(n_ranges)
        rows = []
        for p in np.unique(part).tolist():
            rows.append((t.column("blk")[0].as_py(), p, _five(np.unique(low[part == p]))))
        cols = list(zip(*rows, strict=True)) or [[]] * 3
        return pa.table({"blk": pa.array(cols[0], pa.int32()), "part": pa.array(cols[1], pa.int32()), "low": pa.array(cols[2], pa.binary())})

    def shared(t: pa.Table) -> pa.Table:
        lists = [_from_five(x.as_py()) for x in t.column("low")]
        blks, part = t.column("blk").to_pylist(), t.column("part")[0].as_py()
        every = np.concatenate(lists)
        v, n = np.unique(every, return_counts=True)
        v = v[n > 1]
        rows = [(b, part, _five(x[np.isin(x, v, assume_unique=True)])) for b, x in zip(blks, lists, strict=True)]
        rows = [r for r in rows if r[2]]
        cols = list(zip(*rows, strict=True)) or [[]] * 3
        return pa.table({"blk": pa.array(cols[0], pa.int32()), "part": pa.array(cols[1], pa.int32()), "low": pa.array(cols[2], pa.binary())})

    def runs(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows:
            b = block(left)
            part, low = b.pick(n_ranges)
            name = part.astype(np.uint64) << np.uint64(40) | low
            known = [np.uint64(p) << np.uint64(40) | _from_five(x) for p, x in zip(right.column("part").to_pylist(), right.column("low").to_pylist(), strict=True)]
            order = np.lexsort((b.a["text"], name))
            n, x = name[order], b.a["text"][order]
            again = n[1:][(n[1:] == n[:-1]) & (x[1:] != x[:-1])]
            wanted = np.unique(np.concatenate([*known, again])) if known or len(again) else np.zeros(0, np.uint64)
            take = np.flatnonzero(np.isin(name, wanted))
            group = ((b.a["gram"][take] >> np.uint64(8)) % np.uint64(n_groups)).astype(np.int64)
            by = np.argsort(group, kind="stable")
            take, group = take[by], group[by]
            cut = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group)) if len(group) else np.zeros(1, np.int64)
            for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                rows.append((int(group[x]), left.column("blk")[0].as_py(), front_coded(b, take[x:y])))
        cols = list(zip(*rows, strict=True)) or [[]] * 3
        return pa.table({"grp": pa.array(cols[0], pa.int32()), "blk": pa.array(cols[1], pa.int32()), "run": pa.array(cols[2], pa.binary())})

    def sort(t: pa.Table) -> pa.Table:
        got = replies([Run(x.as_py()) for x in t.column("run")], t.column("blk").to_pylist(), span)
        rows = []
        for b, r in got.items():
            flat = np.frombuffer(b"".join(x[0] for x in r), np.uint8)
            size = np.array([len(x[0]) for x in r], np.int64)
            lo = np.cumsum(size) - size
            name = identity(flat, lo, lo + size, lo + np.array([x[1] for x in r], np.int64))
            rows.append((b, _dump(name.astype("<u8"), np.array([x[2] for x in r], "u1"), np.array([x[3] for x in r], "u1"), np.array([x[4] for x in r], "<i8"))))
        cols = list(zip(*rows, strict=True)) or [[]] * 2
        return pa.table({"blk": pa.array(cols[0], pa.int32()), "reply": pa.array(cols[1], pa.binary())})

    def add(t: pa.Table, left: pa.Table) -> pa.Table:
        for c in carried:
            t = t.append_column(c, left.column(c))
        return t

    def cover(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
        if not left.num_rows:
            return add(schema.empty_table(), left)
        b = block(left)
        size = np.array([len(t) for t in b.texts], np.int64)
        start = np.append(0, np.cumsum(size))
        edge = np.zeros(int(start[-1]) + 1, np.int32)
        got = [_load(x, "<u8", "u1", "u1", "<i8") for x in right.column("reply").to_pylist()]
        if got:
            name, i, j, low = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.argsort(name, kind="stable")
            name, i, j, low = name[order], i[order].astype(np.int64), j[order].astype(np.int64), low[order]
            x, y = np.searchsorted(name, b.a["name"], "left"), np.searchsorted(name, b.a["name"], "right")
            who = np.repeat(np.arange(len(x)), y - x)
            which = np.repeat(x - np.append(0, np.cumsum(y - x)[:-1]), y - x) + np.arange(len(who))
            later = b.first[b.a["text"][who]] > low[which]
            who, which = who[later], which[later]
            at = start[b.a["text"][who]] + b.a["lo"][who]
            np.add.at(edge, at + i[which], 1)
            np.add.at(edge, at + j[which] + span, -1)
        covered = np.cumsum(edge[:-1]) > 0
        flat = np.frombuffer(b"".join(b.texts), np.uint8)
        if whole_characters and len(flat):
            lead = np.flatnonzero((flat & 0xC0) != 0x80)
            covered = np.repeat(np.minimum.reduceat(covered, lead), np.diff(np.append(lead, len(flat))))
        out, made = [], {}
        for k, t, n in zip(left.column("key").to_pylist(), left.column("text").to_pylist(), b.of.tolist(), strict=True):
            t = t or b""
            if n < 0:
                out.append((k, len(t), [], t))
            elif k != b.first[n]:
                gone = len(t) >= span
                out.append((k, len(t), [{"start": 0, "end": len(t)}] if gone else [], b"" if gone else t))
            else:
                if n not in made:
                    c = covered[start[n]:start[n + 1]].astype(np.int8)
                    d = np.diff(c, prepend=0, append=0)
                    spans = [{"start": x, "end": y} for x, y in zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist(), strict=True)]
                    made[n] = spans, flat[start[n]:start[n + 1]][c == 0].tobytes() if spans else t
                out.append((k, len(t), *made[n]))
        return add(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema), left)

    by_block = docs.groupBy("blk")
    keys = by_block.applyInArrow(send, "blk int, part int, low binary")
    common = keys.groupBy("part").applyInArrow(shared, "blk int, part int, low binary")
    sorted_runs = docs.groupBy("blk").cogroup(common.groupBy("blk")).applyInArrow(runs, "grp int, blk int, run binary")
    answers = sorted_runs.groupBy("grp").applyInArrow(sort, "blk int, reply binary")
    out = docs.groupBy("blk").cogroup(answers.groupBy("blk")).applyInArrow(cover, "key long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary" + "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carried))
    return out.select(F.col("key").alias(key), "n_bytes", "spans", "kept", *(F.col(a).alias(b) for a, b in zip(carried, carry, strict=True)))
