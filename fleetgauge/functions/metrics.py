"""Error metrics as ordinary aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.cols import col, dbl, is_true, ratio, share_pct

CVRMSE_MAX, NMBE_MAX = 30.0, 5.0
MIN_COVERAGE = 0.95
INTERVAL_QUANTITIES = ("temperature",)
T_ADMISSIBLE_K = 1.0


def gl14_pass(cvrmse, nmbe) -> Column:
    return is_true((col(cvrmse) <= CVRMSE_MAX) & (F.abs(col(nmbe)) <= NMBE_MAX))


def error_sums(measured, simulated, prefix: str = "", where: Column | None = None) -> list[Column]:
    """Aggregates behind every metric, over pairs with both sides finite."""
    m, s = col(measured), col(simulated)
    ok = m.isNotNull() & s.isNotNull()
    ok = ok if where is None else ok & where
    e = F.when(ok, s - m)
    mm = F.when(ok, m)
    return [F.count(e).alias(f"{prefix}N"), F.avg(e * e).alias(f"{prefix}_e2"), F.avg(F.abs(e)).alias(f"{prefix}_ae"), F.avg(e).alias(f"{prefix}_e"),
            F.avg(mm).alias(f"{prefix}_m"), F.var_pop(mm).alias(f"{prefix}_v"), F.avg(F.abs(e / F.nullif(mm, dbl(0.0)))).alias(f"{prefix}_pe")]


def metric_columns(prefix: str = "", quantity: str = "generic") -> list[Column]:
    """Metrics from :func:`error_sums`.

    An interval scale has no meaningful zero, so only absolute metrics and the
    skill (an error over an error) survive for temperatures.
    """
    p = F.col
    v = F.nullif(p(f"{prefix}_v"), dbl(0.0))
    rmse = F.sqrt(f"{prefix}_e2")
    interval = quantity in INTERVAL_QUANTITIES

    def normalised(x):
        return F.lit(None).cast("double") if interval else x
    cv, nmbe = dbl(100.0) * ratio(rmse, p(f"{prefix}_m")), dbl(100.0) * ratio(p(f"{prefix}_e"), p(f"{prefix}_m"))
    return [p(f"{prefix}N").alias(f"{prefix}N"), rmse.alias(f"{prefix}RMSE"), p(f"{prefix}_ae").alias(f"{prefix}MAE"), p(f"{prefix}_e").alias(f"{prefix}MBE"),
            (dbl(1.0) - p(f"{prefix}_e2") / v).alias(f"{prefix}R2"), (rmse / F.sqrt(v)).alias(f"{prefix}skill"),
            normalised(dbl(100.0) * p(f"{prefix}_pe")).alias(f"{prefix}MAPE_pct"), normalised(cv).alias(f"{prefix}CVRMSE_pct"), normalised(nmbe).alias(f"{prefix}NMBE_pct"),
            F.lit("absolute_only_interval_scale" if interval else "raw_interval_custom").alias(f"{prefix}criterion"),
            (F.lit(None).cast("boolean") if interval else gl14_pass(cv, nmbe)).alias(f"{prefix}criterion_pass")]


def regression_metrics(df: DataFrame, keys, measured, simulated, quantity: str = "generic") -> DataFrame:
    """One row per key group; groups without a finite pair report N = 0 and NULL metrics."""
    g = df.groupBy(*keys).agg(*error_sums(measured, simulated))
    return g.select(*keys, *metric_columns("", quantity))


def coverage_gate(df: DataFrame, keys, measured, simulated, minimum: float = MIN_COVERAGE) -> DataFrame:
    """Share of finite pairs; a group below the minimum may not be scored."""
    if not 0.0 < minimum <= 1.0:
        raise ValueError("minimum coverage must be in (0, 1]")
    both = (col(measured).isNotNull() & col(simulated).isNotNull()).cast("double")
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.avg(both).alias("coverage"))
    return g.withColumn("status", F.when(F.col("coverage") < minimum, "insufficient_coverage").otherwise("ok"))


def coverage_row(df: DataFrame, keys, on: Column, valid: Column, evaluated: Column) -> DataFrame:
    """Nested row counts; a row outside the wider set never counts in the narrower one."""
    on, valid, evaluated = is_true(on), is_true(on & valid), is_true(on & valid & evaluated)
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_total"), F.count_if(on).alias("rows_on"), F.count_if(valid).alias("rows_valid"),
                              F.count_if(evaluated).alias("rows_evaluated"))
    return g.withColumns({"coverage_of_on_pct": share_pct(F.col("rows_evaluated"), F.col("rows_on")),
                          "coverage_of_total_pct": share_pct(F.col("rows_evaluated"), F.col("rows_total"))})


def cvrmse_guarded(prefix: str = "") -> Column:
    """CVRMSE that is infinite when there are fewer than two pairs or the mean vanishes."""
    bad = (F.col(f"{prefix}N") < 2) | (F.abs(f"{prefix}_m") < 1e-9)
    return F.when(is_true(bad) | F.col(f"{prefix}_m").isNull(), dbl(float("inf"))).otherwise(
        dbl(100.0) * F.sqrt(f"{prefix}_e2") / F.nullif(F.col(f"{prefix}_m"), dbl(0.0)))
