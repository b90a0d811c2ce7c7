"""Near copies by MinHash bands, checked by odd sketches.

Words are runs of bytes other than space and tab to carriage return, A-Z
lowered; a document's set holds the hashes of its ``n``-word shingles, or of all its
words as one where it has fewer. ``samples`` MinHash values of a set are cut into
bands, which makes sets that are alike meet; ``tune`` takes the longest bands that still
let a pair at the threshold meet with a probability of ``RECALL``. The same samples, hashed with their number, are
folded into a bitmap of parities, the odd sketch: samples that two sets share
cancel out, so the population count of the exclusive-or of two sketches estimates how many samples
differ, the more precisely the fewer they are. Pairs whose estimate lies more
than ``SIGMAS`` standard deviations below the threshold are dropped; all others
are confirmed on whole sets (see ``linking``, which also says how large groups
are compared). Equal sets are one set.

Null and empty texts, and those without a word, have an empty set and no links; rows with a null
key take no part, their component is null and they are not kept. Rows with one key are one node if
their sets are equal; otherwise each row has its own set and component. Tokens and sets are 64-bit
hashes. Only the key and the text are read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import mix, settle, slices
from fleetgauge.llm.linking import connect, smallest, tokens_of
from fleetgauge.llm.ngram_join import set_id, shingles

BITS, SIGMAS = 512, 5.0
MOST_BANDS, RECALL = 32, 1 - 4e-6


def tune(threshold: float, recall: float = RECALL, most: int = MOST_BANDS) -> tuple[int, int]:
    """(bands, rows): the longest bands with which ``most`` of them reach the recall at the threshold, and as few as do."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-threshold ** rows))
        if bands <= most:
            return bands, rows
    return most, 1


@functools.cache
def _multipliers(samples: int) -> np.ndarray:
    return np.random.default_rng(29).integers(1, 1 << 62, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(s: np.ndarray, samples: int) -> np.ndarray:
    """Smallest product of the tokens with each of the multipliers."""
    mul = _multipliers(samples)
    low = np.full(samples, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 512):
        np.minimum(low, (s[i:i + 512, None] * mul).min(axis=0), out=low)
    return low


def odd_sketches(low: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the rows of samples, each sample hashed with its number."""
    rows, samples = low.shape
    bit = (mix(low + mix(np.arange(samples, dtype=np.uint64))) >> np.uint64(40)).astype(np.int64) % BITS
    n = np.bincount((np.arange(rows)[:, None] * BITS + bit).ravel(), minlength=rows * BITS).reshape(rows, BITS)
    return np.packbits((n & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8")


def similarity(bits, samples: int):
    """Estimate of the Jaccard similarity, given the number of bits in which two sketches differ."""
    share = np.minimum(2 * np.asarray(bits) / BITS, 1 - 1e-9)
    return np.maximum(0.0, 1 + BITS / (4 * samples) * np.log1p(-share))


def most_bits(threshold: float, samples: int) -> int:
    """Bits by which sketches may differ so that the threshold is not out of reach."""
    spread = math.sqrt(threshold * (1 - threshold) / samples + BITS / (16 * samples ** 2) * (math.exp(8 * samples * (1 - threshold) / BITS) - 1))
    least = max(0.0, threshold - SIGMAS * spread)
    return int(np.flatnonzero(similarity(np.arange(BITS + 1), samples) >= least)[-1])


def heads(df: DataFrame, key: str, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """(key, n_shingles, set_id, sketch, bands) of every row."""
    samples = bands * rows

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = mix(np.arange(rows, dtype=np.uint64) + np.uint64(3)) | np.uint64(1)
        tag = mix(np.arange(bands, dtype=np.uint64) + np.uint64(101))
        for batch in batches:
            for a, b in slices(batch.column(1)):
                sets = shingles(batch.column(1)[a:b].to_pylist(), n)
                low = np.stack([signature(s, samples) for s in sets])
                sk = odd_sketches(low)
                met = mix((low.reshape(len(sets), bands, rows) * weight).sum(axis=2, dtype=np.uint64) + tag).astype(np.int64)
                met = pa.ListArray.from_arrays(pa.array(np.arange(0, met.size + 1, bands, dtype=np.int32)), pa.array(met.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64()),
                                                  pa.array([x.tobytes() for x in sk], pa.binary()), met], [key, "n_shingles", "set_id", "sketch", "bands"])
    return df.select(F.col(key), F.col(text)).mapInArrow(make, f"{key} {dict(df.dtypes)[key]}, n_shingles long, set_id long, sketch binary, bands array<long>")


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(key, n_shingles, component_id, kept): rows linked by a similarity of at least ``num / den``; the smallest key of each component is kept."""
    docs = df.select(F.col(key).cast("long").alias(key), F.col(text))
    bands, per_band = tune(num / den)
    rows = settle(heads(docs, key, text, n, bands, per_band), "heads")
    known = rows.filter(F.col(key).isNotNull() & (F.col("n_shingles") > 0))
    sets = settle(known.groupBy("set_id").agg(F.min(key).alias("rep"), *(F.first(c).alias(c) for c in ("n_shingles", "sketch", "bands"))), "sets")

    # a group of sets that meet in several bands is one group
    filed = sets.select("set_id", F.explode("bands").alias("entry"))
    mark = F.xxhash64("set_id").cast("decimal(20,0)")
    groups = filed.groupBy("entry").agg(F.count("*").alias("n"), F.sum(mark).alias("s"), F.bit_xor(F.xxhash64("set_id", F.lit(5))).alias("x")).filter("n > 1")
    members = filed.join(groups.select("entry", F.xxhash64("n", "s", "x").alias("gid")), "entry").select("gid", "set_id").distinct()

    most = most_bits(num / den, bands * per_band)

    def near(x, y, bits):
        return (np.minimum(x, y) * den >= np.maximum(x, y) * num) & (bits <= most)
    found = connect(members, sets.select("set_id", "n_shingles", "sketch"), tokens_of(docs, key, text, n, sets), near, num, den)
    named = smallest(sets, found)
    out = rows.select(key, "n_shingles", F.when(F.col(key).isNotNull() & (F.col("n_shingles") > 0), F.col("set_id")).alias("set_id")).join(named, "set_id", "left")
    component = F.coalesce("__low", key)
    return out.select(key, "n_shingles", component.alias("component_id"), F.coalesce(F.col(key) == component, F.lit(False)).alias("kept"))
