"""Metrics and evaluation aggregates."""

from pyspark.sql import functions as F

from catalog import bind
from catalog.bind import ATT_SQL, KEYS, MASK_SQL, with_
from catalog.registry import R, query, rounded
from fleetgauge.functions import metrics as mx
from fleetgauge.functions.cols import dbl
from fleetgauge.operators import evaluate as ev

PAIR_SQL = ATT_SQL + """,
pp AS (SELECT site, device_id, ts_s, power_W AS m, CASE WHEN speed_Hz>0 AND blk%5<>3 OR speed_Hz>25 THEN 39e3*(1e-1+9e-1*(speed_Hz/5e1)*(speed_Hz/5e1)*(speed_Hz/5e1)) END AS s FROM att WHERE equipment_type='pump'),
tp AS (SELECT site, device_id, ts_s, tcws_1_C AS m, twb_C+3e0 AS s FROM att WHERE equipment_type='cooling_tower')"""


def power_pairs(spark, d):
    a = bind.attributed(spark, d).where("equipment_type = 'pump'")
    y = F.col("speed_Hz") / dbl(50.0)
    sim = F.when((F.col("speed_Hz") > 0) & (F.col("blk") % 5 != 3) | (F.col("speed_Hz") > 25), dbl(39000.0) * (dbl(0.1) + dbl(0.9) * y * y * y))
    return a.select(*KEYS, "ts_s", "ts", F.col("power_W").alias("m"), sim.alias("s"), "run_signal")


def temperature_pairs(spark, d):
    a = bind.attributed(spark, d).where("equipment_type = 'cooling_tower'")
    return a.select(*KEYS, "ts_s", F.col("tcws_1_C").alias("m"), (F.col("twb_C") + dbl(3.0)).alias("s"))


def met_sql(src, keys, m="m", s="s", where="", d=4):
    """SQL twin of the metric aggregate."""
    w = f"{m} IS NOT NULL AND {s} IS NOT NULL" + (f" AND {where}" if where else "")
    k = ", ".join(keys)
    ok = f"CASE WHEN {w} THEN {s}-{m} END"
    return f"""(SELECT {k}, count(e) AS N, sqrt(avg(e*e)) AS RMSE, avg(abs(e)) AS MAE, avg(e) AS MBE, 1e0-avg(e*e)/nullif(var_pop(mm),0) AS R2, sqrt(avg(e*e))/sqrt(nullif(var_pop(mm),0)) AS skill,
 1e2*avg(abs(e/nullif(mm,0))) AS MAPE_pct, 1e2*sqrt(avg(e*e))/nullif(avg(mm),0) AS CVRMSE_pct, 1e2*avg(e)/nullif(avg(mm),0) AS NMBE_pct, avg(mm) AS mean_m
 FROM (SELECT *, {ok} AS e, CASE WHEN {w} THEN {m} END AS mm FROM {src}) GROUP BY {k})"""


COLS = ["RMSE", "MAE", "MBE", "R2", "skill", "MAPE_pct", "CVRMSE_pct", "NMBE_pct"]


def out_cols(cols=COLS, d=4):
    return ", ".join(f"{R(c, d)} AS {c}" for c in cols)


@query("k01_regression_metrics", with_(PAIR_SQL, body=f"SELECT site, device_id, N, {out_cols()}, 'raw_interval_custom' AS criterion, coalesce(CVRMSE_pct<=30 AND abs(NMBE_pct)<=5, false) AS criterion_pass FROM {met_sql('pp', KEYS)}"))
def k01(spark, d):
    return rounded(mx.regression_metrics(power_pairs(spark, d), KEYS, "m", "s"), _=4)


@query("k02_temperature_metrics", with_(PAIR_SQL, body=f"SELECT site, device_id, N, {out_cols(['RMSE', 'MAE', 'MBE', 'R2', 'skill'])}, 'absolute_only_interval_scale' AS criterion FROM {met_sql('tp', KEYS)}"))
def k02(spark, d):
    return rounded(mx.regression_metrics(temperature_pairs(spark, d), KEYS, "m", "s", "temperature").drop("MAPE_pct", "CVRMSE_pct", "NMBE_pct", "criterion_pass"), _=4)


@query("k03_metric_coverage_gate", with_(PAIR_SQL, body=f"SELECT site, device_id, rows, {R('c')} AS coverage, CASE WHEN c<95e-2 THEN 'insufficient_coverage' ELSE 'ok' END AS status FROM (SELECT site, device_id, count(*) AS rows, avg(CASE WHEN m IS NOT NULL AND s IS NOT NULL THEN 1e0 ELSE 0e0 END) AS c FROM pp GROUP BY 1,2)"))
def k03(spark, d):
    return rounded(mx.coverage_gate(power_pairs(spark, d), KEYS, "m", "s"))


@query("k04_gl14_pass", with_(PAIR_SQL, body=f"SELECT site, device_id, coalesce(CVRMSE_pct<=30 AND abs(NMBE_pct)<=5, false) AS pass FROM {met_sql('pp', KEYS)}"))
def k04(spark, d):
    return mx.regression_metrics(power_pairs(spark, d), KEYS, "m", "s").select(*KEYS, mx.gl14_pass("CVRMSE_pct", "NMBE_pct").alias("pass"))


@query("k05_coverage_row", with_(MASK_SQL, body=f"""SELECT site, device_id, rows_total, rows_on, rows_valid, rows_evaluated, {R('1e2*rows_evaluated/nullif(rows_on,0)')} AS coverage_of_on_pct, {R('1e2*rows_evaluated/nullif(rows_total,0)')} AS coverage_of_total_pct FROM
 (SELECT site, device_id, count(*) AS rows_total, count(CASE WHEN operating THEN 1 END) AS rows_on, count(CASE WHEN operating AND power_W IS NOT NULL THEN 1 END) AS rows_valid, count(CASE WHEN operating AND power_W>0 THEN 1 END) AS rows_evaluated FROM mk GROUP BY 1,2)"""))
def k05(spark, d):
    return rounded(mx.coverage_row(bind.masked(spark, d), KEYS, F.col("operating"), F.col("power_W").isNotNull(), F.col("power_W") > 0))


@query("k06_cvrmse_guarded", with_(PAIR_SQL, body=f"""SELECT site, device_id, N, CASE WHEN N<2 OR mean_m IS NULL OR abs(mean_m)<1e-9 THEN 'infinity'::DOUBLE ELSE {R('CVRMSE_pct', 4)} END AS cvrmse
 FROM {met_sql('(SELECT site, device_id, m, CASE WHEN m>3e4 THEN s END AS s FROM pp)', KEYS)}"""))
def k06(spark, d):
    g = power_pairs(spark, d).groupBy(*KEYS).agg(*mx.error_sums("m", "s", where=F.col("m") > 30000))
    c = mx.cvrmse_guarded()
    return g.select(*KEYS, "N", F.when(c == float("inf"), c).otherwise(F.round(c + F.lit(137e-9), 4) + 0.0).alias("cvrmse"))


CTRL = {"chiller": ["tchws_C"], "cooling_tower": ["tcws_C", "tcws_1_C"], "heat_exchanger": ["tchws_C"]}


@query("k11_controlled_variable_stats", with_(MASK_SQL, "cv AS (" + " UNION ALL ".join(f"SELECT site, device_id, equipment_type, '{r}' AS variable, {r} AS v FROM mk WHERE operating AND equipment_type='{f}' AND {r} IS NOT NULL" for f, rs in CTRL.items() for r in rs) + ")",
                                              body=f"SELECT site, device_id, equipment_type, variable, 'controlled_setpoint' AS role, count(*) AS N, {R('avg(v)')} AS mean, {R('stddev_pop(v)')} AS std FROM cv GROUP BY 1,2,3,4"))
def k11(spark, d):
    return rounded(ev.controlled_variable_stats(bind.masked(spark, d)))
