"""Evaluation of selected models and of set-point channels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge import KEYS
from fleetgauge.contracts import PROFILES, per_family
from fleetgauge.functions import metrics as mx
from fleetgauge.functions.cols import dbl, is_true, ratio, unpivot
from fleetgauge.operators import ordered

# --- fixed values: published power errors per family, for context ----------------------------------
PUBLISHED_MAPE = {
    "pump": "5.27 (CHWP) / 0.8 (CWP) [manufacturer curve + single-pump windows]",
    "cooling_tower": "2.29 (fan) [affinity Eq.15 + single-tower windows]",
    "chiller": "4.31-8.25 [ElectricReformulatedEIR FMU; needs measured power]",
    "heat_exchanger": "Tchws 2.68 / Tcwr 1.5 [eff-NTU, FC mode; needs flow]",
}


def controlled_variable_stats(masked: DataFrame) -> DataFrame:
    """Spread of regulated channels on operating rows; evidence of control, never a model error."""
    roles = sorted({r for p in PROFILES.values() for r in p["controlled"] if r in masked.columns})
    mine = per_family(lambda p: F.array(*[F.lit(r) for r in p["controlled"]]).cast("array<string>"))
    d = masked.where("operating").withColumn("_c", mine)
    long = unpivot(d, [*KEYS, "equipment_type", "_c"], roles, "variable").where(F.array_contains("_c", F.col("variable")))
    g = long.groupBy(*KEYS, "equipment_type", "variable").agg(F.count(F.lit(1)).alias("N"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return g.withColumn("role", F.lit("controlled_setpoint"))


def chiller_score(d: DataFrame, keys, p_m="P_m", p_s="P_s", q_m="Q_m", q_s="Q_s") -> DataFrame:
    """Power, load and COP metrics over rows with positive measured and simulated power."""
    ok = is_true((F.col(p_m) > 0) & (F.col(p_s) > 0)) & F.col(q_m).isNotNull() & F.col(q_s).isNotNull()
    e = d.withColumns({"_cm": F.when(ok, ratio(q_m, p_m)), "_cs": F.when(ok, ratio(q_s, p_s))})
    g = e.groupBy(*keys).agg(*mx.error_sums(p_m, p_s, "P_", ok), *mx.error_sums(q_m, q_s, "Q_", ok), *mx.error_sums("_cm", "_cs", "COP_"))

    def cv(x):
        return dbl(100.0) * ratio(F.sqrt(f"{x}__e2"), F.col(f"{x}__m"))

    def skill(x):
        return F.sqrt(f"{x}__e2") / F.sqrt(F.nullif(F.col(f"{x}__v"), dbl(0.0)))
    return g.select(*keys, F.col("P_N").alias("N"), cv("P").alias("P_CVRMSE_pct"), (dbl(100.0) * ratio("P__e", "P__m")).alias("P_NMBE_pct"), cv("Q").alias("Q_CVRMSE_pct"),
                    cv("COP").alias("COP_CVRMSE_pct"), (dbl(100.0) * ratio("COP__e", "COP__m")).alias("COP_NMBE_pct"), skill("P").alias("P_skill"), skill("Q").alias("Q_skill"))


def full_period_validation(devices: DataFrame, selected: DataFrame, scored: DataFrame, coverage: DataFrame) -> DataFrame:
    """Metrics and coverage of the selected model on every valid row.

    Devices that were refused keep their status; a device nobody selected a
    model for reports ``no_candidate``.
    """
    m = mx.regression_metrics(scored, KEYS, "measured", "simulated")
    j = devices.join(selected.select(*KEYS, "candidate", F.col("status").alias("_s")), list(KEYS), "left").join(m, list(KEYS), "left").join(coverage, list(KEYS), "left")
    status = F.when(F.col("_s").isNull(), "no_candidate").when(F.col("_s") != "ok", F.col("_s")).when(F.coalesce("N", F.lit(0)) == 0, "no_valid_rows").otherwise("ok")
    ok = F.col("status") == "ok"
    cols = ["N", "RMSE", "MAE", "MAPE_pct", "CVRMSE_pct", "NMBE_pct", "R2", "criterion_pass", "rows_total", "rows_on", "rows_valid", "rows_evaluated", "coverage_of_on_pct", "coverage_of_total_pct"]
    return j.withColumn("status", status).select(*KEYS, "equipment_type", "status", "candidate", *[F.when(ok, F.col(c)).alias(c) for c in cols])


def validation_series(scored: DataFrame) -> DataFrame:
    return scored.select(*KEYS, "ts", "measured", "simulated")


def published_comparison(selected: DataFrame, published: dict[str, str] | None = None) -> DataFrame:
    """Own MAPE beside the published figure of the family, where it is finite."""
    p = published or PUBLISHED_MAPE
    text = F.create_map(*[F.lit(x) for kv in p.items() for x in kv])
    s = selected.where((F.col("status") == "ok") & F.col("MAPE_pct").isNotNull() & ~F.isnan("MAPE_pct"))
    return s.select(*KEYS, "equipment_type", "candidate", F.bround("MAPE_pct", 2).alias("our_MAPE_pct"), F.coalesce(F.try_element_at(text, F.col("equipment_type")), F.lit("")).alias("published_MAPE_pct"))


def reconcile_series(series_scores: DataFrame, published: DataFrame, tolerance: float = 0.02, floor: float = 1e-3) -> DataFrame:
    """The captured series that belongs to each published figure.

    ``series_scores`` is ``(series_id, N, rmse, cvrmse)``; ``published`` is
    ``(device_id, N, kind, expected)``. The nearest metric at the same N wins
    (to nine decimals; ties to the smaller series), within the larger of 2 % and
    1e-3. Series that agree to nine decimals count once. The nearest one is the
    last at or below the figure or the first at or above it, so figures and series
    are stacked and scanned in both directions; no pairs are formed. Null and NaN
    metrics, figures and N match nothing.
    """
    key = ["N", "_rmse"]
    cells = F.array(F.struct(F.lit(True).alias("r"), F.col("rmse").cast("double").alias("x")), F.struct(F.lit(False).alias("r"), F.col("cvrmse").cast("double").alias("x")))
    s = series_scores.where("N IS NOT NULL").select("series_id", "N", F.explode(cells).alias("c")).where(F.col("c.x").isNotNull() & ~F.isnan("c.x"))
    s = s.groupBy("N", F.col("c.r").alias("_rmse"), F.round("c.x", 9).alias("_r")).agg(F.min(F.struct("series_id", F.col("c.x").alias("x"))).alias("_s"))
    p = published.where(F.col("N").isNotNull() & F.col("expected").isNotNull()).select("device_id", "N", "kind", "expected").distinct()
    p = p.withColumns({"_rmse": is_true(F.col("kind") == "rmse"), "_x": F.col("expected").cast("double")}).where(~F.isnan("_x"))
    row = F.struct("device_id", "kind", "expected").alias("_row")
    p = p.select(*key, "_x", row, F.lit(1).alias("_late"))
    s = s.select(*key, F.col("_s.x").alias("_x"), "_s", F.lit(0).alias("_late"))
    d = p.unionByName(s, allowMissingColumns=True)
    for name, x in (("_below", F.col("_x")), ("_above", -F.col("_x"))):
        d = ordered.carry_last(d.withColumn("_o", x), key, ["_o", "_late"], F.floor(F.col("_o") * dbl(10.0)), "_s", name).drop("_o")
    gap = lambda c: F.abs(F.col(f"{c}.x") - F.col("_x"))
    near = F.array_min(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.round(gap(c), 9).alias("r"), F.col(f"{c}.series_id").alias("series_id"), gap(c).alias("gap"))) for c in ("_below", "_above")])))
    best = d.where("_late = 1").select("_row.device_id", "N", "_row.kind", "_row.expected", near.alias("b"))
    tol = F.greatest(dbl(tolerance) * F.abs("expected"), dbl(floor))
    return best.where(F.col("b.gap") <= tol).select("device_id", "N", "kind", "expected", "b.series_id", "b.gap")
