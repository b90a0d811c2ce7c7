"""Feature tables per equipment family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge import KEYS
from fleetgauge.contracts import per_family, role_or_null
from fleetgauge.functions.cols import all_of, clip, col, dbl, is_true, present, ratio
from fleetgauge.operators.attrition import first_failed, tower_criteria
from fleetgauge.operators.prepare import elapsed
from fleetgauge.operators.quantiles import exact_quantiles, wide_quantiles

KELVIN = 273.15
CP_KJ = 4.186        # chiller table, kJ/kg/K
CP_TOWER = 4180.0
CP_HX = 4186.0
FAN_ON_HZ = 5.0
FLOW_COVERAGE_MIN = 0.5
HX_MIN_FLOW, HX_MIN_DT, HX_MIN_Q, HX_MAX_BALANCE = 1.0, 0.05, 5000.0, 0.50


# ---- chiller ----------------------------------------------------------------------------------
def chiller_table(steady: DataFrame) -> DataFrame:
    """Steady rows in table units; a row that makes more cooling than physics allows is dropped."""
    c = F.col
    t = steady.where("steady").select(
        *KEYS, "ts", c("tchws_C").alias("CHWS"), c("tchwr_C").alias("CHWR"), c("tcws_C").alias("CDWS"), c("tcwr_C").alias("CDWR"),
        (c("chw_flow_m3_h") / dbl(3.6)).alias("CHW"), (c("cw_flow_m3_h") / dbl(3.6)).alias("CDW"), (c("power_W") / dbl(1000.0)).alias("P_kW"))
    t = t.withColumns({"dT_chw": c("CHWR") - c("CHWS"), "dT_cdw": c("CDWR") - c("CDWS")})
    t = t.withColumn("Q_evap_kW", c("CHW") * dbl(CP_KJ) * c("dT_chw"))
    return t.where(all_of(c(x) > 0 for x in ("P_kW", "Q_evap_kW", "CHW", "CDW", "dT_chw", "dT_cdw")) & c("CHWS").isNotNull() & (c("Q_evap_kW") > c("P_kW")))


def chiller_nominals(table: DataFrame, condenser: str = "entering") -> DataFrame:
    """Design values from the row of largest load (earliest on ties)."""
    tc = "CDWS" if condenser == "entering" else "CDWR"
    top = F.max_by(F.struct("Q_evap_kW", "P_kW", "CHW", "CDW", "CHWS", F.col(tc).alias("TC")), F.struct(F.col("Q_evap_kW"), -F.unix_micros("ts")))
    g = table.groupBy(*KEYS).agg(top.alias("m"), F.min("CHWS").alias("evmin"), F.max("CHWS").alias("evmax"), F.min(tc).alias("cmin"), F.max(tc).alias("cmax"),
                                 F.min("Q_evap_kW").alias("qmin"))
    m = F.col
    plr = F.greatest(dbl(0.05), m("qmin") / m("m.Q_evap_kW"))
    return g.select(*KEYS, (m("m.Q_evap_kW") * dbl(-1000.0)).alias("QEva_flow_nominal"),
                    F.when(m("m.P_kW") > 0, m("m.Q_evap_kW") / m("m.P_kW")).otherwise(5.0).alias("COP_nominal"),
                    m("m.CHW").alias("mEva_flow_nominal"), m("m.CDW").alias("mCon_flow_nominal"), (m("m.CHWS") + KELVIN).alias("TEvaLvg_nominal"),
                    (m("evmin") + KELVIN).alias("TEvaLvgMin"), (m("evmax") + KELVIN).alias("TEvaLvgMax"), (m("m.TC") + KELVIN).alias("TCon_nominal"),
                    (m("cmin") + KELVIN).alias("TConMin"), (m("cmax") + KELVIN).alias("TConMax"), dbl(1.15).alias("PLRMax"), plr.alias("PLRMin"))


# ---- cooling tower ------------------------------------------------------------------------------
def ct_features(df: DataFrame, fan_nominal_hz: float = 50.0) -> DataFrame:
    """Temperatures, per-tower flow and fan state; the leaving sensor falls back per device."""
    drives = [r for r in ("fan1_Hz", "fan2_Hz") if r in df.columns]
    out1, out2 = role_or_null(df, "tcws_1_C"), role_or_null(df, "tcws_C")
    has = df.groupBy(*KEYS).agg(F.max(out1.isNotNull()).alias("_has1"))
    d = df.join(has, list(KEYS))
    on = [is_true(F.col(r) > FAN_ON_HZ) for r in drives]
    n_on, hz = F.lit(0), dbl(0.0)
    for r, o in zip(drives, on):
        n_on, hz = n_on + o.cast("int"), hz + F.when(o, F.col(r)).otherwise(dbl(0.0))
    d = d.withColumns({
        "Tin_C": role_or_null(df, "tcwr_C"), "Tout_C": F.when(F.col("_has1"), out1).otherwise(out2), "Twb_C": role_or_null(df, "twb_C"),
        "total_kgps": role_or_null(df, "attributed_flow_m3_h") * dbl(1000.0) / dbl(3600.0),
        "nfan": F.when(role_or_null(df, "fans_on_count") > 0, role_or_null(df, "fans_on_count")), "fan_hz": F.when(n_on > 0, hz / n_on)}).drop("_has1")
    d = d.withColumns({"fr_air": F.col("fan_hz") / dbl(fan_nominal_hz), "TRan_C": F.col("Tin_C") - F.col("Tout_C"), "TApp_C": F.col("Tout_C") - F.col("Twb_C")})
    cell = F.col("total_kgps") / dbl(2.0)
    nom = exact_quantiles(d.select(*KEYS, F.when(cell > 0, cell).alias("_m")), KEYS, "_m", {"_nom": 0.5}).select(*KEYS, "_nom")
    d = d.join(nom, list(KEYS), "left")
    fr_wat = cell / F.greatest(F.col("_nom"), dbl(1e-9))
    return d.withColumn("rlg", clip(fr_wat / clip("fr_air", 0.05, 1.0), 0.05, 8.0)).drop("_nom")


def ct_table(feats: DataFrame, min_flow: float = 1.0, min_flow_frac: float = 0.25) -> DataFrame:
    """Valid rows above a real fraction of the tower's own flow, in per-cell units."""
    ok = feats.where(first_failed(tower_criteria(min_flow)).isNull())
    p90 = exact_quantiles(ok, KEYS, "total_kgps", {"_p90": 0.9}).select(*KEYS, "_p90")
    c = F.col
    t = ok.join(p90, list(KEYS)).where(c("total_kgps") >= F.greatest(dbl(1.0), dbl(min_flow_frac) * c("_p90")))
    t = elapsed(t.drop("_p90"), "time_s")
    t = t.select(*KEYS, "ts", "time_s", "Tin_C", c("Tout_C").alias("Tout_meas_C"), "Twb_C", "TRan_C", c("TApp_C").alias("TAppAct_C"),
                 (c("total_kgps") / c("nfan")).alias("mdot_cell_kgps"), clip(c("fan_hz") / dbl(50.0), 0.0, 1.0).alias("y_used"), c("fan_hz").alias("fanHz"),
                 c("nfan").alias("fans_on_count"), (c("total_kgps") * dbl(CP_TOWER) * c("TRan_C")).alias("Q_flow_W"), c("power_W").alias("PFan_meas_W"))
    return t.where(present(["Tin_C", "Tout_meas_C", "Twb_C", "mdot_cell_kgps", "y_used", "Q_flow_W", "PFan_meas_W"]))


def ct_base_values(table: DataFrame) -> DataFrame:
    q = wide_quantiles(table, KEYS, {c: F.col(c) for c in ("mdot_cell_kgps", "Twb_C", "TAppAct_C", "TRan_C", "Tin_C", "Tout_meas_C")}, {"m": 0.5})
    c = F.col
    return q.select(*KEYS, c("mdot_cell_kgps_m").alias("m_flow_nominal"), (c("Twb_C_m") + KELVIN).alias("TAirInWB_nominal"),
                    F.greatest(dbl(0.2), c("TAppAct_C_m")).alias("TApp_nominal"), F.greatest(dbl(0.3), c("TRan_C_m")).alias("TRan_nominal"),
                    (c("Tin_C_m") + KELVIN).alias("TWatIn_nominal"), (c("Tout_meas_C_m") + KELVIN).alias("TWatOut_nominal"),
                    dbl(0.05).alias("yMin"), dbl(1.0).alias("nFan"), dbl(0.1).alias("fraFreCon"))


def fan_nominal(table: DataFrame, alphas) -> DataFrame:
    """Nominal fan power per exponent: median of P / (fans * y^alpha), else the median power."""
    y, n = clip("y_used", 0.05, 1.0), F.greatest(F.col("fans_on_count"), dbl(1.0))
    est = {f"e{i}": F.col("PFan_meas_W") / (n * F.pow(y, dbl(a))) for i, a in enumerate(alphas)}
    q = wide_quantiles(table, KEYS, {k: F.when(e > 0, e) for k, e in est.items()} | {"p": F.col("PFan_meas_W")}, {"m": 0.5})
    each = F.array(*[F.struct(dbl(a).alias("alpha"), F.coalesce(f"e{i}_m", "p_m").alias("PFan_nominal")) for i, a in enumerate(alphas)])
    return q.select(*KEYS, F.inline(each))


# ---- pump ---------------------------------------------------------------------------------------
def pump_table(df: DataFrame, run_on: float = 0.5, nominal_hz: float = 50.0) -> DataFrame:
    """Running rows; the flow term survives only where it covers half of the running record."""
    attr, own = role_or_null(df, "attributed_flow_m3_h"), role_or_null(df, "flow_m3_h")
    run = is_true((F.col("power_W") > 0) & (F.col("speed_Hz") > run_on))
    has = df.groupBy(*KEYS).agg(F.max(attr.isNotNull()).alias("_attr"))
    d = df.join(has, list(KEYS))
    d = d.withColumns({"_m": F.when(F.col("_attr"), attr).otherwise(own) * dbl(1000.0) / dbl(3600.0), "_run": run})
    cov = d.groupBy(*KEYS).agg((F.count_if(F.col("_run") & is_true(F.col("_m") > 0)) / F.greatest(F.count_if("_run"), F.lit(1))).alias("_cov"))
    d = d.join(cov, list(KEYS))
    covered = F.col("_cov") >= FLOW_COVERAGE_MIN
    t = d.withColumns({"m_flow_in": F.when(covered, F.col("_m")).otherwise(dbl(1.0)), "flow_observed": covered & is_true(F.col("_m") > 0),
                       "y_in": F.greatest(F.col("speed_Hz") / dbl(nominal_hz), dbl(0.0)), "P_meas_W": F.col("power_W")})
    t = t.where(F.col("_run") & F.col("m_flow_in").isNotNull())
    return elapsed(t.select(*KEYS, "ts", "m_flow_in", "y_in", "P_meas_W", "flow_observed"), "time_s")


def pump_nominals(table: DataFrame) -> DataFrame:
    q = wide_quantiles(table, KEYS, {"p": F.col("P_meas_W"), "m": F.col("m_flow_in")}, {"q": 0.95})
    return q.select(*KEYS, F.col("p_q").alias("P_nominal"), F.col("m_q").alias("m_flow_nominal"), dbl(0.05).alias("y_min"), dbl(1.20).alias("y_max"))


# ---- heat exchanger -------------------------------------------------------------------------------
DIRECTIONS = [(a, b) for a in (("tchwr_C", "tchws_C"), ("tchws_C", "tchwr_C")) for b in (("tcws_C", "tcwr_C"), ("tcwr_C", "tcws_C"))]


def lmtd(da, db) -> Column:
    a, b = col(da), col(db)
    ok = (a > 0) & (b > 0)
    near = F.abs(a - b) < 1e-9
    return F.when(ok & near, (a + b) / dbl(2.0)).when(ok, (a - b) / F.ln(a / b))


def heat_balance_ratio(q1, q2) -> Column:
    return ratio(F.abs(col(q1) - col(q2)), F.greatest(F.abs(col(q1)), F.abs(col(q2))))


def _mass(role):
    return F.col(role) * dbl(1000.0) / dbl(3600.0)


def hx_direction(df: DataFrame) -> DataFrame:
    """Inlet/outlet labels per device: the assignment with most heat-positive rows, first on ties."""
    m1, m2 = _mass("chw_flow_m3_h"), _mass("cw_flow_m3_h")
    aggs = []
    for i, ((a_in, a_out), (b_in, b_out)) in enumerate(DIRECTIONS):
        q1, q2 = m1 * dbl(CP_HX) * (F.col(a_in) - F.col(a_out)), m2 * dbl(CP_HX) * (F.col(b_out) - F.col(b_in))
        ok = (m1 > HX_MIN_FLOW) & (m2 > HX_MIN_FLOW) & (q1 > HX_MIN_Q) & (q2 > HX_MIN_Q)
        aggs.append(F.count_if(ok).alias(f"n{i}"))
    g = df.groupBy(*KEYS).agg(*aggs)
    best = F.greatest(*[F.col(f"n{i}") for i in range(4)])
    pick = F.coalesce(*[F.when(F.col(f"n{i}") == best, F.lit(i)) for i in range(4)])
    return g.select(*KEYS, pick.alias("direction"), best.alias("usable_rows"))


def hx_table(df: DataFrame, direction: DataFrame) -> DataFrame:
    """Operating rows with duty, effectiveness and LMTD in the chosen direction."""
    d = df.join(direction.select(*KEYS, "direction"), list(KEYS))

    def pick(side, end):
        out = None
        for i, dirs in enumerate(DIRECTIONS):
            v, c = F.col(dirs[side][end]), F.col("direction") == i
            out = F.when(c, v) if out is None else out.when(c, v)
        return out
    c = F.col
    d = d.withColumns({"T1In_C": pick(0, 0), "T1Out_C": pick(0, 1), "T2In_C": pick(1, 0), "T2Out_C": pick(1, 1),
                       "m1_kgps": _mass("chw_flow_m3_h"), "m2_kgps": _mass("cw_flow_m3_h")})
    d = d.withColumns({"Q1_W": c("m1_kgps") * dbl(CP_HX) * (c("T1In_C") - c("T1Out_C")), "Q2_W": c("m2_kgps") * dbl(CP_HX) * (c("T2Out_C") - c("T2In_C"))})
    d = d.withColumn("Q_W_mean", (c("Q1_W") + c("Q2_W")) / dbl(2.0))
    cmin = F.least(c("m1_kgps"), c("m2_kgps")) * dbl(CP_HX)
    eps = clip(ratio(F.abs(c("Q_W_mean")), cmin * F.nullif(F.abs(c("T1In_C") - c("T2In_C")), dbl(0.0))), 0.0, 1.5)
    d = d.withColumns({"eps": F.coalesce(eps, dbl(0.0)),
                       "dT_lm": F.coalesce(lmtd(F.abs(c("T1In_C") - c("T2Out_C")), F.abs(c("T1Out_C") - c("T2In_C"))), dbl(0.0))})
    ok = ((c("m1_kgps") > HX_MIN_FLOW) & (c("m2_kgps") > HX_MIN_FLOW) & (c("T1In_C") - c("T1Out_C") > HX_MIN_DT) & (c("T2Out_C") - c("T2In_C") > HX_MIN_DT)
          & (c("Q1_W") > HX_MIN_Q) & (c("Q2_W") > HX_MIN_Q) & (heat_balance_ratio("Q1_W", "Q2_W") <= HX_MAX_BALANCE))
    t = d.where(ok).select(*KEYS, "ts", "T1In_C", "T1Out_C", "T2In_C", "T2Out_C", "m1_kgps", "m2_kgps", "Q1_W", "Q2_W", c("Q_W_mean").alias("Q_W"), "eps", "dT_lm",
                           F.coalesce(F.greatest(role_or_null(df, "power_W"), dbl(0.0)), dbl(0.0)).alias("P_aux_W"))
    return elapsed(t, "time_s")


def hx_nominals(table: DataFrame) -> DataFrame:
    c = F.col
    cmin = F.least(c("m1_kgps"), c("m2_kgps")) * dbl(CP_HX)
    eps = clip(ratio(F.abs(c("Q_W")), cmin * F.nullif(F.abs(c("T1In_C") - c("T2In_C")), dbl(0.0))), 0.05, 0.98)
    q = wide_quantiles(table, KEYS, {"m1": c("m1_kgps"), "m2": c("m2_kgps"), "q": F.abs("Q_W"), "eps": eps, "a1": c("T1In_C"), "b1": c("T1Out_C"), "a2": c("T2In_C"), "b2": c("T2Out_C")},
                       {"p95": 0.95, "m": 0.5})
    return q.select(*KEYS, c("m1_p95").alias("m1_flow_nominal"), c("m2_p95").alias("m2_flow_nominal"), c("q_p95").alias("Q_flow_nominal"),
                    F.coalesce("eps_m", dbl(0.8)).alias("eps_nominal"), (c("a1_m") + KELVIN).alias("T_a1_nominal"), (c("b1_m") + KELVIN).alias("T_b1_nominal"),
                    (c("a2_m") + KELVIN).alias("T_a2_nominal"), (c("b2_m") + KELVIN).alias("T_b2_nominal"))


# ---- shared ---------------------------------------------------------------------------------------
def nominal_only_params(df: DataFrame) -> DataFrame:
    """p95 and median of the family's nominal roles that have data, as a parameter map."""
    roles = per_family(lambda p: F.array(*[F.lit(r) for r in sorted({*p["nominal"], "cooling_load_W", "power_W_recon"})]))
    names = sorted({r for r in ("tchws_C", "tchwr_C", "tcws_C", "tcwr_C", "tcws_1_C", "chw_flow_m3_h", "speed_Hz", "cooling_load_W", "power_W_recon") if r in df.columns})
    cells = F.filter(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).cast("double").alias("v")) for r in names]),
                     lambda x: x["v"].isNotNull() & F.array_contains("_roles", x["role"]))
    long = df.withColumn("_roles", roles).select(*KEYS, F.explode(cells).alias("c")).select(*KEYS, "c.role", "c.v")
    q = exact_quantiles(long, [*KEYS, "role"], "v", {"p95": 0.95, "median": 0.5})
    both = F.explode(F.array(F.struct(F.concat("role", F.lit("_p95")).alias("k"), F.col("p95").alias("v")),
                             F.struct(F.concat("role", F.lit("_median")).alias("k"), F.col("median").alias("v"))))
    e = q.select(*KEYS, both.alias("e"))
    return e.groupBy(*KEYS).agg(F.map_from_entries(F.array_sort(F.collect_list("e"))).alias("params"))  # at most 12 entries


def liquid_gas_ratio(mdot, y, m_nominal, y_min: float = 0.05, lo: float = 0.05, hi: float = 8.0) -> Column:
    """Water-to-air ratio of the tower wrapper."""
    wat = F.greatest(dbl(0.0), col(mdot)) / F.greatest(dbl(1e-6), col(m_nominal))
    return clip(wat / F.greatest(dbl(1e-4), clip(y, y_min, 1.0)), lo, hi)
