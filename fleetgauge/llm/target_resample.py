"""Draw documents that look like a target corpus: importance weights and an exact distributed ranking.

Features are all runs of 1 to ``most`` consecutive words, joined by one space,
hashed to ``buckets`` by crc32 of their bytes. The bucket counts of the raw and of
the target texts give every bucket a gain, the scaled logarithm of the ratio of
its smoothed shares, rounded down; a document's weight is the sum over its features, repeats
included. Gumbel noise from a hash of the key turns the best scores into a draw
without replacement.

The check sum of a run follows from those of its words: appending a word shifts the
check sum by the word's length, a linear map of 32 bits that four table look-ups
apply to all words of a slice at once. Bucket counts are added up per task; what
reaches the driver is one number a bucket.

Ranks come from parallel sorting by regular sampling. Every task sorts its scored
rows as one run; rows at regular distances of all runs give the splitters; segments
between splitters go to one task each and merge there; the sizes of the
segments before it turn a row's place into its rank. Key, run and place break
ties, so a key with any number of rows is cut like any other.

Words are runs of 0-9, a-z (A-Z are lowered first) and all characters beyond
ASCII. Null texts have no words. Documents without words have weight 0; those of
fewer than ``min_words`` words take no part in the draw. A null key gets a null
score and takes no part. Repeated rows rank one after the other. An empty target or
no raw rows give gains by the smoothing alone. Only the key and the text are read.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import settle, slices

#: Rows that the driver sees of all runs together, rows of a segment, segments at most.
SAMPLES, SEGMENT_ROWS, MOST_SEGMENTS = 1 << 18, 1 << 19, 1 << 14
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Word bytes up to which shift tables are kept; longer words shift in several steps.
STEP = 32


# ---- features ----------------------------------------------------------------------------
@functools.cache
def _shifts() -> np.ndarray:
    """[bytes appended, byte of the check sum, its value]: the check sum register after that many zero bytes."""
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0xEDB88320), crc >> 1)
    out = np.empty((STEP + 1, 4, 256), np.uint32)
    for j in range(4):
        out[0, j] = np.arange(256, dtype=np.uint32) << np.uint32(8 * j)
    for n in range(1, STEP + 1):
        out[n] = crc[out[n - 1] & 255] ^ (out[n - 1] >> 8)
    return out


def append(crc: np.ndarray, more: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Check sums of two byte strings in a row, given that of each and the length of the second."""
    tables = _shifts()
    crc, left = crc.copy(), size
    while len(left):
        n = np.minimum(left, STEP)
        crc = tables[n, 0, crc & 255] ^ tables[n, 1, (crc >> 8) & 255] ^ tables[n, 2, (crc >> 16) & 255] ^ tables[n, 3, crc >> 24]
        left = left - n
        if not left.any():
            break
    return crc ^ more


def features(texts: list[str | None], most: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(check sums, text of each) of the runs of every length, and the words of each text."""
    split = [t.encode("utf-8", "surrogatepass").translate(_BYTES).split() if t else [] for t in texts]
    words = np.array([len(ws) for ws in split], np.int64)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for ws in split for w in ws), np.int64, int(words.sum()))
    sums = np.fromiter(map(zlib.crc32, known), np.uint32, len(known))[ids]
    spaced = np.fromiter((zlib.crc32(b" " + w) for w in known), np.uint32, len(known))[ids]
    size = np.fromiter(map(len, known), np.int64, len(known))[ids] + 1
    owner = np.repeat(np.arange(len(texts)), words)
    out, of = [sums], [owner]
    for n in range(1, most):
        whole = owner[n:] == owner[:-n] if len(owner) > n else np.zeros(0, bool)
        grams = append(out[-1][:len(whole)], spaced[n:], size[n:]) if len(whole) else np.zeros(0, np.uint32)
        out.append(grams)
        of.append(np.where(whole, owner[:len(whole)], -1))
    return [g[o >= 0] for g, o in zip(out, of, strict=True)], [o[o >= 0] for o in of], words


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = 10_000, most: int = 3) -> DataFrame:
    """(bucket, n) of the features of all rows; buckets without any have no row. A task sends one row a bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for a, b in slices(batch.column(0)):
                for grams in features(batch.column(0)[a:b].to_pylist(), most)[0]:
                    n += np.bincount(grams % buckets, minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["bucket", "n"])
    return df.select(F.col(text)).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = 10_000, scale: int = 1000) -> DataFrame:
    """(bucket, gain) of every bucket: ``scale`` times the logarithm of the ratio of smoothed shares, rounded down."""
    spark = raw.sparkSession
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    both = both.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    all_raw, all_target = both.agg(F.sum("s"), F.sum("t")).first()
    up = lambda n, more: (n + more).cast("double")
    ratio = up(F.col("t"), 1) * up(F.lit(all_raw), buckets) / (up(F.col("s"), 1) * up(F.lit(all_target), buckets))
    return both.select("bucket", F.floor(scale * F.log(ratio)).alias("gain"))


# ---- scores ------------------------------------------------------------------------------
def weights(df: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", most: int = 3) -> DataFrame:
    """(key: long, n_features, n_words, weight) of every row, given the gain of each bucket."""
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                grams, of, words = features(batch.column(1)[a:b].to_pylist(), most)
                n, total = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                for g, o in zip(grams, of, strict=True):
                    n += np.bincount(o, minlength=b - a)
                    added = np.append(0, np.cumsum(gain[g % len(gain)]))  # whole numbers, unlike weighted bincount
                    ends = np.searchsorted(o, np.arange(b - a + 1))
                    total += added[ends[1:]] - added[ends[:-1]]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *(pa.array(x, pa.int64()) for x in (n, words, total))], ["key", "n_features", "n_words", "weight"])
    return df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("__text")).mapInArrow(weigh, "key long, n_features long, n_words long, weight long")


def noise(key: str | Column, seed: int = 42, scale: int = 1000) -> Column:
    """Gumbel noise of a key, scaled and rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / 4294967296.0)))


# ---- ranks -------------------------------------------------------------------------------
def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's rows, best first, as one run with its number, places and size."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    key, score = (t.column(c).to_numpy() for c in ("key", "score"))
    t = t.take(np.lexsort((key, -score)))
    n = t.num_rows
    t = t.append_column("run", pa.array(np.full(n, TaskContext.get().partitionId(), np.int32))).append_column("place", pa.array(np.arange(n, dtype=np.int32)))
    yield from t.append_column("size", pa.array(np.full(n, n, np.int32))).to_batches(max_chunksize=1 << 16)


def _order(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Sort columns, the last one first."""
    key, score, run, place = (t.column(c).to_numpy() for c in ("key", "score", "run", "place"))
    return place, run, key, -score


def ranked(scored: DataFrame) -> DataFrame:
    """``scored`` (key, score: long, and others; no nulls in these two) with ``rank`` from 1: highest score first, ties to the smaller key.

    ``scored`` is sorted where it lies, written, and read twice as narrow rows.
    """
    spark = scored.sparkSession
    names = [f.name for f in scored.schema]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scored.schema)
    runs = settle(scored.mapInArrow(_sorted_runs, f"{schema}, run int, place int, size int"), "runs")
    rows, parts = runs.agg(F.count("*"), F.count_distinct("run")).first()
    if not rows:
        return runs.select(*names, F.lit(0).cast("long").alias("rank"))
    segments = min(MOST_SEGMENTS, max(spark.sparkContext.defaultParallelism, math.ceil(rows / SEGMENT_ROWS)))
    each = max(1, min(8 * segments, SAMPLES // parts))  # of every run; SAMPLES rows at most as long as there are fewer runs
    step = F.ceil(F.col("size") / each).cast("int")
    regular = runs.filter(F.col("place") % step == F.floor(step / 2)).select(-F.col("score"), "key", "run", "place")
    regular = sorted(tuple(r) for r in regular.collect())
    splitters = [regular[len(regular) * i // segments] for i in range(1, segments)] if len(regular) >= segments else regular
    marks = tuple(np.array(c, np.int64) for c in zip(*splitters, strict=True)) if splitters else (np.zeros(0, np.int64),) * 4

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = tuple(np.concatenate([np.asarray(x, np.int64), m]) for x, m in zip(_order(batch), reversed(marks), strict=True))
            order = np.lexsort(columns)
            before = np.empty(len(order), np.int64)
            before[order] = np.cumsum(order >= batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before[:batch.num_rows].astype(np.int32))], [*batch.schema.names, "segment"])
    dealt = runs.drop("size").mapInArrow(deal, f"{schema}, run int, place int, segment int")
    sizes = dict(dealt.groupBy("segment").count().collect())  # a row a segment
    offset = np.cumsum([0, *(sizes.get(i, 0) for i in range(segments))])

    def merge(t: pa.Table) -> pa.Table:
        t = t.take(np.lexsort(_order(t)))
        rank = np.arange(1, t.num_rows + 1, dtype=np.int64) + offset[t.column("segment")[0].as_py()]
        return t.select(names).append_column("rank", pa.array(rank))
    return dealt.groupBy("segment").applyInArrow(merge, f"{schema}, rank long")


def resample(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", share: tuple[int, int] = (5, 100), min_words: int = 20,
             buckets: int = 10_000, most: int = 3, seed: int = 42, scale: int = 1000) -> DataFrame:
    """(key, n_features, weight, score, rank) of every row; the rank is null for rows that are not drawn.

    Of the N rows with at least ``min_words`` words, ``share`` (a fraction, rounded down) are drawn.
    """
    table = gains(bucket_counts(df, text, buckets, most), bucket_counts(target, target_text, buckets, most), buckets, scale)
    gain = np.zeros(buckets, np.int64)
    for r in table.collect():  # a row a bucket
        gain[r.bucket] = r.gain
    scored = settle(weights(df, gain, key, text, most).withColumn("score", F.col("weight") + noise("key", seed, scale)), "scored")
    able = (F.col("n_words") >= min_words) & F.col("key").isNotNull()
    draw = scored.filter(able).count() * share[0] // share[1]
    order = ranked(scored.filter(able))
    order = order.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    rest = scored.filter(~able).withColumn("rank", F.lit(None).cast("long"))
    return order.unionByName(rest).select(F.col("key").alias(key), "n_features", "weight", "score", "rank")
