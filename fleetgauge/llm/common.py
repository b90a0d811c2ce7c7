"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.lineage import discard, settle, stage_folder  # noqa: F401

#: Bytes of text that a Python worker takes at a time within an Arrow batch.
SLICE_BYTES = 2 << 20
#: Rows of an Arrow batch: texts are long, and the default of 10,000 takes a worker hundreds of MB.
ARROW_ROWS = 1000


def small_batches(spark) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def new_folder(spark) -> str:
    """A fresh folder name in the shared folder of the cluster."""
    return f"{stage_folder(spark)}/{uuid.uuid4().hex}"


def slices(column, budget: int = SLICE_BYTES):
    """Cut an Arrow string column into (start, stop) row ranges of about ``budget`` bytes; a longer row stands alone."""
    import pyarrow.compute as pc
    n = len(column)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
    start, size = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if i > start and size + s > budget:
            yield start, i
            start, size = i, 0
        size += s
    if start < n:
        yield start, n


@functools.cache
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's


def released(make: Callable) -> Callable:
    """``make``, an iterator function of a task; as it ends, what it has freed goes back to the system.

    Workers are kept from task to task, and idle ones with the memory their allocators hold.
    """
    @functools.wraps(make)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from make(batches)
        finally:
            import pyarrow as pa
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := _trim():
                trim(0)
    return run


def held_out(col: str | Column = "doc_id") -> Column:
    """Whether a row is kept out of training: crc32 of its id as text leaves 1 modulo 3. A null id is held out."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def held_out_id(i) -> bool:
    """``held_out`` for one value, for tests."""
    return i is None or zlib.crc32(str(i).encode()) % 3 == 1


@functools.cache
def byte_weights(n: int = 64) -> np.ndarray:
    """Fixed odd multipliers for hashing."""
    return np.random.default_rng(20240501).integers(1, 1 << 62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
