"""Lempel-Ziv fingerprints of documents.

A text's UTF-8 bytes are parsed into dictionary phrases: each phrase is the
shortest string that has not been a phrase before. Texts that compress well
together share phrases, so the Jaccard similarity of their phrase sets follows
their similarity under compression. A fingerprint holds the smallest ``SIZE``
32-bit hashes of the phrases, in hex; likeness estimates the Jaccard similarity
from the smallest hashes of both together, and is exact for short texts.

Null and empty texts have an empty fingerprint; two of these are alike (1), one
of these and any other text are not (0). Equal texts have equal fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import byte_weights, mix

SIZE = 128


def phrases(data: bytes) -> set[bytes]:
    """Phrases of the incremental parse; a rest that is a phrase already adds nothing."""
    seen: set[bytes] = set()
    add, start = seen.add, 0
    for end in range(1, len(data) + 1):
        p = data[start:end]
        if p not in seen:
            add(p)
            start = end
    return seen


def signature(data: bytes) -> np.ndarray:
    """The smallest distinct hashes of the phrases, in order."""
    seen = list(phrases(data))
    if not seen:
        return np.zeros(0, np.uint32)
    size = np.fromiter(map(len, seen), np.int64, len(seen))
    start = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(seen), np.uint8).astype(np.uint64)
    place = np.arange(len(flat)) - np.repeat(start, size)
    total = np.add.reduceat((flat + np.uint64(1)) * byte_weights()[place & 63] + (place >> 6).astype(np.uint64), start)
    return np.unique((mix(total + size.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32))[:SIZE]


def to_hex(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def from_hex(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint32)


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common hashes among the smallest of both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both, n = np.unique(np.concatenate([a, b]), return_counts=True)
    return float((n[:SIZE] == 2).mean())


def fingerprint(col: str | Column) -> Column:
    """Fingerprint of a text column."""
    @F.arrow_udf("string")
    def mark(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([to_hex(signature((t.as_py() or "").encode("utf-8", "surrogatepass"))) for t in texts], pa.string())
    return mark(F.col(col) if isinstance(col, str) else col)


def likeness(a: str | Column, b: str | Column) -> Column:
    """Likeness of two fingerprint columns, 0 to 1."""
    @F.arrow_udf("double")
    def near(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            yield pa.array([alike(from_hex(p or ""), from_hex(q or "")) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.float64())
    return near(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def edit(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``following``."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


CHAIN = "n_chars long, edited string, fingerprint string, edited_fingerprint string, next_fingerprint string"


def chain(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited, fingerprint, edited_fingerprint, next_fingerprint), each text edited with the next one by descending key.

    Nulls come last, equal keys go by text, and the first text follows the last. Keys are cut at quantiles into
    ranges; each range is dealt out with a copy of the first row of the range below it (the lowest with that of the
    highest), so every row meets its successor in one shuffle. The driver gets one key a range.
    """
    spark = df.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(F.col(key).cast("long").alias("__key"))
    cuts = keys.agg(F.percentile_approx("__key", [i / n for i in range(1, n)], 100 * n)).first()[0]
    cuts = np.unique(np.array(cuts or [], np.int64))

    def ranges(k: pa.Array) -> np.ndarray:
        known = k.fill_null(0).to_numpy(zero_copy_only=False)
        return np.where(k.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(cuts, known, side="left"))

    @F.arrow_udf("int")
    def range_of(k: pa.Array) -> pa.Array:
        return pa.array(ranges(k), pa.int32())
    tops = dict(keys.withColumn("__range", range_of("__key")).groupBy("__range").agg(F.max("__key")).collect())
    filled = sorted(tops)
    above = {r: filled[(i + 1) % len(filled)] for i, r in enumerate(filled)}

    @F.arrow_udf("array<struct<range: int, copy: boolean>>")
    def places(k: pa.Array) -> pa.Array:
        r = ranges(k).tolist()
        return pa.array([[{"range": x, "copy": False}] + ([{"range": above[x], "copy": True}] if tops[x] == y else []) for x, y in zip(r, k.to_pylist(), strict=True)],
                        pa.list_(pa.struct([("range", pa.int32()), ("copy", pa.bool_())])))
    rows = df.select(F.col(key).cast("long").alias("__key"), F.col(text).alias("__text"))
    rows = rows.select("__key", "__text", F.inline(places("__key")).alias("__range", "__copy"))
    rows = rows.repartition("__range").sortWithinPartitions("__range", "__copy", F.desc_nulls_last("__key"), "__text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(key, pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("next_fingerprint", pa.string())])
        out: list[tuple] = []
        held = None  # range, key, text, fingerprint

        def full(all_of_it=False):
            nonlocal out
            if out and (all_of_it or len(out) >= 500):
                cols = zip(*out, strict=True)
                out = []
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
        closed = None  # range whose first copy has been met
        for batch in batches:
            for k, t, r, copy in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if copy and closed == r:
                    continue
                t = t or ""
                mark = to_hex(signature(t.encode("utf-8", "surrogatepass")))
                if held is not None:
                    edited = edit(held[1], t)
                    out.append((held[0], len(held[1]), edited, held[2], to_hex(signature(edited.encode("utf-8", "surrogatepass"))), mark))
                held = None if copy else (k, t, mark)
                closed = r if copy else closed
                yield from full()
        yield from full(True)
    return rows.select("__key", "__text", "__range", "__copy").mapInArrow(walk, f"{key} long, {CHAIN}")
