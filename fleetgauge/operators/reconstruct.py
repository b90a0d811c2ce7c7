"""Un-metered quantities from first principles, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge import KEYS
from fleetgauge.contracts import role_or_null
from fleetgauge.functions.cols import col, dbl, is_true, ratio
from fleetgauge.operators.quantiles import wide_quantiles

RHO = 1000.0
CP = 4186.0
CP_TOWER = 4180.0


def water_heat(flow, hot, cold, cp: float = CP) -> Column:
    """rho*cp*flow/3600*(hot-cold) in W for a flow in m3/h, with no sign filter."""
    return dbl(RHO * cp) * (col(flow) / dbl(3600.0)) * (col(hot) - col(cold))


def energy_balance_load(flow, hot, cold) -> Column:
    q = water_heat(flow, hot, cold)
    return F.when((col(hot) - col(cold) > 0) & (col(flow) > 0), q)


def power_from_cop(load, cop: float) -> Column:
    if cop <= 0:
        raise ValueError("cop must be positive")
    return col(load) / dbl(cop)


def power_first_law(condenser, evaporator) -> Column:
    return F.when((col(condenser) > 0) & (col(evaporator) > 0), col(condenser) - col(evaporator))


def active_count(df: DataFrame, signals, threshold: float = 5.0, per_signal: float = 1.0) -> Column:
    """Parallel sub-components running; NULL only when no signal is mapped at all."""
    known = [s for s in signals if s in df.columns]
    if not known:
        return F.lit(None).cast("double")
    total = dbl(0.0)
    for s in known:
        total = total + F.when(is_true(F.col(s) > threshold), dbl(per_signal)).otherwise(dbl(0.0))
    return total


def heat_rejection(mass_flow, t_in, t_out) -> Column:
    return col(mass_flow) * dbl(CP_TOWER) * (col(t_in) - col(t_out))


def cooling_load(df: DataFrame) -> DataFrame:
    """Adds ``load_W``: the metered load of a device that has one, else flow times dT."""
    metered = role_or_null(df, "cooling_load_W")
    has = df.groupBy(*KEYS).agg(F.max(metered.isNotNull()).alias("_metered"))
    q = water_heat(role_or_null(df, "chw_flow_m3_h"), role_or_null(df, "tchwr_C"), role_or_null(df, "tchws_C"))
    return (df.join(has, list(KEYS), "left")
            .withColumn("load_W", F.when(F.col("_metered"), metered).otherwise(q)).drop("_metered"))


def apportion_total(df: DataFrame, total: str, share: str, group, name: str) -> DataFrame:
    """total * share / sum(share) inside each (group, ts); a negative share counts as 0."""
    s = F.greatest(F.coalesce(F.col(share), dbl(0.0)), dbl(0.0))
    denom = F.sum(s).over(Window.partitionBy(*group, "ts"))
    return df.withColumn(name, ratio(F.col(total) * s, denom))


HEAT_METHODS = ("chw_energy_balance", "cw_energy_balance", "energy_balance", "heat_rate")


def reconstruct(df: DataFrame, specs: list[dict]) -> DataFrame:
    """Apply ``{"output", "method", "types", ...}`` specs in order.

    ``types`` limits a spec to some equipment types. Reconstructed power goes
    to ``<output>_recon`` and never overwrites a measured column. Every spec is
    a Column, so the whole list is one projection.
    """
    out = df
    for s in specs:
        m, name = s["method"], s["output"]
        if m in HEAT_METHODS:
            expr = energy_balance_load(s["flow"], s["t_hot"], s["t_cold"])
        elif m == "active_count":
            expr = active_count(out, s["signals"], s.get("threshold", 5.0), s.get("per_signal", 1.0))
        elif m == "cop_estimate":
            if s["from"] not in out.columns:
                continue
            expr, name = power_from_cop(s["from"], s["cop"]), recon_name(name)
        elif m == "energy_balance_power":
            expr, name = power_first_law(s["condenser"], s["evaporator"]), recon_name(name)
        else:
            raise ValueError(f"unknown reconstruction method: {m}")
        if "types" in s:
            other = F.col(name) if name in out.columns else F.lit(None).cast("double")
            expr = F.when(F.col("equipment_type").isin(*s["types"]), expr).otherwise(other)
        out = out.withColumn(name, expr)
    return out


def recon_name(name: str) -> str:
    return name if name.endswith("_recon") else name + "_recon"


def implied_cop(df: DataFrame, evaporator: str, power: str, band=(2.0, 10.0)) -> DataFrame:
    """Median of evaporator heat over reconstructed power, and whether it is in band."""
    cop = F.when(F.col(power) > 0, F.col(evaporator) / F.col(power))
    q = wide_quantiles(df, KEYS, {"cop": cop}, {"median": 0.5})
    rows = df.groupBy(*KEYS).agg(F.count_if(F.col(power) > 0).alias("n"))
    j = rows.join(q, list(KEYS), "left")
    ok = (F.col("n") > 0) & F.col("cop_median").between(*band)
    return j.select(*KEYS, "n", "cop_median", F.when(is_true(ok), "pass").otherwise("FAIL").alias("verdict"))


def two_side_residual(df: DataFrame, q1: str = "Q_W", q2: str = "Q_cond_W") -> DataFrame:
    """Median disagreement of two heat rates that must be equal, in percent of the first."""
    both = is_true(F.col(q1) > 0) & F.col(q2).isNotNull()
    v = F.when(both, F.abs(F.col(q2) - F.col(q1)) / F.nullif(F.col(q1), dbl(0.0)))
    q = wide_quantiles(df, KEYS, {"r": v}, {"median": 0.5})
    return q.select(*KEYS, (F.col("r_median") * 100.0).alias("residual_pct"), F.col("r_n").alias("n"))


def method_flags(df: DataFrame, specs: list[dict]) -> DataFrame:
    """One text per device and reconstructed column: method, inputs and valid rows."""
    aggs, texts = [], []
    for i, s in enumerate(specs):
        m = s["method"]
        name = recon_name(s["output"]) if m in ("cop_estimate", "energy_balance_power") else s["output"]
        aggs.append(F.count(name).alias(f"n{i}"))
        if m in HEAT_METHODS:
            t = F.concat(F.lit(f"{name}={m}(flow={s['flow']},n="), F.col(f"n{i}").cast("string"), F.lit(")"))
        elif m == "active_count":
            k = len([x for x in s["signals"] if x in df.columns])
            t = F.lit(f"{name}=active_count(of {k}/{len(s['signals'])} signals > {s.get('threshold', 5.0)}, per_signal={s.get('per_signal', 1.0):g})"
                      if k else f"{name}=active_count(UNAVAILABLE: none of {','.join(s['signals'])} mapped)")
        elif m == "cop_estimate":
            t = F.lit(f"{name}=cop_estimate(COP={s['cop']},ASSUMPTION)")
        else:
            t = F.concat(F.lit(f"{name}=energy_balance_power(n="), F.col(f"n{i}").cast("string"), F.lit(")"))
        types = s.get("types")
        texts.append(F.when(F.col("equipment_type").isin(*types), t) if types else t)
    g = df.groupBy(*KEYS, "equipment_type").agg(*aggs)
    return g.select(*KEYS, "equipment_type", F.array_join(F.array_compact(F.array(*texts)), ";").alias("reconstructed"))


