"""Order-dependent operators that never put a whole device into one task.

A plain ``Window.partitionBy(device).orderBy(ts)`` sends every row of a device
to a single task, which fails when one device holds a third of the archive.
The operators here cut each device into chunks along its order (a day of
timestamps, a range of row ids). ``(device, ts)`` is unique, so a chunk is
bounded by the cadence and not by the archive. Each operator is a two-level
prefix scan: a window inside the chunk, plus an offset taken from one summary
row per chunk. The summaries are pre-aggregated map side and read only the key
and order columns; the running window over them sees one row per active chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_SECONDS = 86400
ROW_ID_CHUNK = 65536
FIRST_CHUNK = -(1 << 62)  # rows without an order key come before all others


def day_chunk(ts: str = "ts", chunk_seconds: int = DAY_SECONDS) -> Column:
    return F.floor(F.unix_seconds(F.col(ts)) / F.lit(chunk_seconds))


def id_chunk(row_id: str, size: int = ROW_ID_CHUNK) -> Column:
    return F.floor(F.col(row_id) / F.lit(size))


def _prepare(df, keys, order, chunk):
    ck = [*keys, "_chunk"]
    inside = Window.partitionBy(*ck).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("_chunk")
    return df.withColumn("_chunk", F.coalesce(chunk.cast("long"), F.lit(FIRST_CHUNK))), ck, inside, across


def _with_summary(local, summary, ck):
    return local.join(summary, ck, "left")


def ordinal(df: DataFrame, keys, order, chunk: Column, name: str = "rn") -> DataFrame:
    """0-based position of every row inside its key group."""
    d, ck, inside, across = _prepare(df, keys, order, chunk)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy(*ck).agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.select(*ck, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    local = d.withColumn("_i", F.row_number().over(inside))
    return (_with_summary(local, offsets, ck)
            .withColumn(name, F.col("_off") + F.col("_i") - 1)
            .drop("_chunk", "_i", "_off"))


def previous(df: DataFrame, keys, order: str, chunk: Column, cols: dict[str, Column]) -> DataFrame:
    """``lag`` of each expression in ``cols`` (new name -> expression)."""
    d, ck, inside, across = _prepare(df, keys, [order], chunk)
    packed = F.struct(F.lit(True).alias("_seen"), *[e.alias(n) for n, e in cols.items()])
    last = d.groupBy(*ck).agg(F.max_by(packed, F.col(order)).alias("_last"))
    carried = last.select(*ck, F.lag("_last").over(across).alias("_carry"))
    local = d.withColumn("_prev", F.lag(packed).over(inside))
    out = _with_summary(local, carried, ck).withColumn("_prev", F.coalesce("_prev", "_carry"))
    for n in cols:
        out = out.withColumn(n, F.col(f"_prev.{n}"))
    return out.withColumn("has_previous", F.col("_prev").isNotNull()).drop("_chunk", "_prev", "_carry")


def running_total(df: DataFrame, keys, order, chunk: Column, value: Column, name: str) -> DataFrame:
    """Inclusive running sum of ``value`` in order."""
    d, ck, inside, across = _prepare(df, keys, order, chunk)
    d = d.withColumn("_x", value)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy(*ck).agg(F.sum("_x").alias("_s"))
    offsets = sums.select(*ck, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    local = d.withColumn("_r", F.sum("_x").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return (_with_summary(local, offsets, ck)
            .withColumn(name, F.col("_off") + F.coalesce("_r", F.lit(0)))
            .drop("_chunk", "_x", "_r", "_off"))


def carry_last(df: DataFrame, keys, order, chunk: Column, value: str, name: str) -> DataFrame:
    """Last non-NULL ``value`` at or before each row."""
    d, ck, inside, across = _prepare(df, keys, order, chunk)
    rank = F.struct(*[F.col(o) for o in order]) if len(order) > 1 else F.col(order[0])
    last = d.where(F.col(value).isNotNull()).groupBy(*ck).agg(F.max_by(value, rank).alias("_lv"))
    chunks = d.select(*ck).groupBy(*ck).agg(F.count(F.lit(1)).alias("_c")).join(last, ck, "left")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select(*ck, F.last("_lv", ignorenulls=True).over(before).alias("_carry"))
    local = d.withColumn("_l", F.last(value, ignorenulls=True)
                         .over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return (_with_summary(local, carried, ck)
            .withColumn(name, F.coalesce("_l", "_carry"))
            .drop("_chunk", "_l", "_carry"))
