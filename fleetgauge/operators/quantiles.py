"""Exact linear-interpolated quantiles per group, safe for very large groups.

The built-in ``percentile`` keeps every distinct value of a group in one
aggregation buffer. Here ranks are found by radix selection on an image of the
double that keeps its order: binary exponent, then mantissa. The first pass
counts ``buckets`` parts of every power of two, map side; only the parts that
hold a wanted rank go on, and two more digits of the mantissa settle the value
itself. Outliers do not matter: a spike lies in a part of its own. No task
orders more than the parts of a group's powers of two, 2**22 counts in the
second pass or 2**21 in the third (at the default), and nothing is approximated.

Groups of at most ``WHOLE`` values are ordered whole: one shuffle of bare values
instead of three counts and two joins. Which groups are larger is counted first.

Use the built-in instead where a group is bounded by construction, such as the
288 rows of a sliding window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.functions.cols import all_of, any_of, dbl
from fleetgauge.functions.lineage import settle

BUCKETS = 1024  # parts of a power of two that the first pass counts
LAST_BITS = 21  # bits of the last digit
WHOLE = 1 << 16  # values of a group that may be ordered in one task


def _with_digits(rows: DataFrame, buckets: int) -> DataFrame:
    """Adds ``_q1``, ``_q2`` and ``_q3``: together they order and tell apart all doubles as ``_v`` does.

    The logarithm may be off by one next to a power of two. It never falls, and
    the scaled mantissa is an integer whichever of the two exponents was found,
    so the order still holds. Infinities and NaN (largest) have parts of their own.
    """
    v = F.col("_v").cast("double")
    x, odd = F.abs(v), F.isnan("_v") | (F.abs(v) == dbl("inf"))
    up = F.lit(53) - F.col("_q_exp")
    half = F.floor(up / F.lit(2))  # in two steps, as 2**1127 is no double
    scaled = (x * F.pow(dbl(2.0), half) * F.pow(dbl(2.0), up - half)).cast("long") - F.lit(1 << 52)
    width = -(-(1 << 53) // buckets)
    rest = F.pmod("_q_man", F.lit(width))
    first = ((F.col("_q_man") - rest) / F.lit(width)).cast("long")
    side = F.when(odd, F.when(F.isnan("_v"), 3001).otherwise(F.signum(v) * 3000)).otherwise(F.signum(v) * F.coalesce(F.col("_q_exp") + 1100, F.lit(0))).cast("long")
    return (rows.withColumn("_q_exp", F.floor(F.log2(F.when(~odd & (x > 0), x))))
            .withColumn("_q_man", F.coalesce(F.when(v < 0, F.lit(1 << 54) - scaled).otherwise(scaled), F.lit(0)))
            .withColumns({"_q1": side * F.lit(4 * buckets) + first, "_q2": F.shiftright(rest, LAST_BITS), "_q3": rest.bitwiseAND(F.lit((1 << LAST_BITS) - 1))})
            .drop("_q_exp", "_q_man"))


def _interpolated(probs: dict[str, float], value_at) -> list[Column]:
    out = []
    for name, p in probs.items():
        r = dbl(p) * (F.col("q_n") - F.lit(1))
        lo, hi = value_at(F.floor(r), f"_l_{name}"), value_at(F.ceil(r), f"_h_{name}")
        out.append((lo + (hi - lo) * (r - F.floor(r))).alias(name))
    return out


def exact_quantiles(long: DataFrame, keys, value: str, probs: dict[str, float], buckets: int = BUCKETS, whole: int = WHOLE) -> DataFrame:
    """One row per key group: ``q_n`` (non-NULL count) and one column per probability."""
    keys = list(keys)
    rows = settle(long.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v")), "values")
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > whole).select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    if large.isEmpty():
        return _ordered_whole(rows, keys, probs)
    large = F.broadcast(settle(large, "large_groups"))  # at most one group in ``whole`` rows
    same = all_of(F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys)
    return _ordered_whole(rows.join(large, same, "left_anti"), keys, probs).unionByName(_selected(rows.join(large, same, "left_semi"), keys, probs, buckets))


def _ordered_whole(rows: DataFrame, keys: list, probs: dict[str, float]) -> DataFrame:
    """Groups that fit a task: their values in order, NaN last."""
    g = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("_s")).withColumn("q_n", F.size("_s").cast("long"))
    return g.select(*keys, "q_n", *_interpolated(probs, lambda r, _: F.get("_s", r.cast("int"))))


def _selected(rows: DataFrame, keys: list, probs: dict[str, float], buckets: int) -> DataFrame:
    """Groups of any size, by radix selection."""
    rows = _with_digits(rows, buckets)

    def rank(p):
        return dbl(p) * (F.col("q_n") - F.lit(1))

    def counted(at: DataFrame, path: list[str], digit: str, *more: Column) -> DataFrame:
        """Counts per digit with the number of values before them, ``_c0``, and up to them, ``_c1``."""
        fixed = [c for c in ("_before", "q_n") if c in at.columns]
        c = at.groupBy(*keys, *path, *fixed, digit).agg(F.count(F.lit(1)).alias("_w"), *more)
        before = F.col("_before") if fixed else F.lit(0)
        upto = F.sum("_w").over(Window.partitionBy(*keys, *path).orderBy(digit).rowsBetween(Window.unboundedPreceding, 0)) + before
        if not fixed:
            c = c.withColumn("q_n", F.sum("_w").over(Window.partitionBy(*keys)))
        return c.withColumn("_c1", upto).withColumn("_c0", F.col("_c1") - F.col("_w"))

    wanted = any_of((r >= F.col("_c0")) & (r < F.col("_c1")) for p in probs.values() for r in (F.floor(rank(p)), F.ceil(rank(p))))
    at, path = rows, []
    for digit in ("_q1", "_q2"):
        held = counted(at, path, digit).where(wanted)
        path = [*path, digit]
        held = held.select(*[F.col(c).alias(f"_k_{c}") for c in (*keys, *path)], F.col("_c0").alias("_before"), "q_n")
        at = rows.join(held, all_of(F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (*keys, *path))).drop(*[f"_k_{c}" for c in (*keys, *path)])
    ranked = counted(at, path, "_q3", F.min("_v").alias("_v"))

    def value_at(r):
        return F.max(F.when((F.col("_c0") <= r) & (r < F.col("_c1")), F.col("_v")))

    aggs = [F.max("q_n").alias("q_n")]
    for name, p in probs.items():
        aggs += [value_at(F.floor(rank(p))).alias(f"_l_{name}"), value_at(F.ceil(rank(p))).alias(f"_h_{name}")]
    picked = ranked.groupBy(*keys).agg(*aggs)
    return picked.select(*keys, "q_n", *_interpolated(probs, lambda _, c: F.col(c)))


def wide_quantiles(df: DataFrame, keys, metrics: dict, probs: dict[str, float]) -> DataFrame:
    """Quantiles of several expressions in one pass.

    ``metrics`` maps a name to a Column (NULL rows are ignored). Output columns
    are ``<metric>_n`` and ``<metric>_<prob name>``.
    """
    keys = list(keys)
    cells = F.array(*[F.struct(F.lit(m).alias("m"), e.cast("double").alias("v")) for m, e in metrics.items()])
    long = (df.select(*keys, F.explode(F.filter(cells, lambda c: c["v"].isNotNull())).alias("c"))
            .select(*keys, F.col("c.m").alias("_m"), F.col("c.v").alias("_x")))
    q = exact_quantiles(long, [*keys, "_m"], "_x", probs)
    aggs = []
    for m in metrics:
        hit = F.col("_m") == m
        aggs.append(F.coalesce(F.max(F.when(hit, F.col("q_n"))), F.lit(0)).alias(f"{m}_n"))
        aggs += [F.max(F.when(hit, F.col(p))).alias(f"{m}_{p}") for p in probs]
    return q.groupBy(*keys).agg(*aggs)
