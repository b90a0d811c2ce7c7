"""Result tables across devices, families and sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge import KEYS
from fleetgauge.contracts import FAMILIES
from fleetgauge.functions.cols import dbl, is_true, ratio, share_pct
from fleetgauge.operators.prepare import device_label, display_label
from fleetgauge.operators.quantiles import wide_quantiles

# --- fixed values: the metric each family is ranked on (error, bias, skill, label) ---------------------
PRIMARY = {
    "chiller": ("P_CVRMSE_pct", "P_NMBE_pct", "P_skill", "Electrical power CVRMSE (%)"),
    "cooling_tower": ("T_RMSE_K", "T_NMBE_pct", "T_skill", "Leaving-water-temperature RMSE (K)"),
    "pump": ("P_CVRMSE_pct", "P_NMBE_pct", "P_skill", "Electrical power CVRMSE (%)"),
    "heat_exchanger": ("Q_CVRMSE_pct", "Q_NMBE_pct", "Q_skill", "Reconstructed-heat CVRMSE (%)"),
}
# --- fixed values: display names of candidates ---------------------------------------------------------------
DISPLAY = {"EIR": "ElectricEIR", "EEIR": "ElectricReformulatedEIR", "Merkel": "Merkel", "YorkCalc": "YorkCalc27", "YorkCalc27": "YorkCalc27", "affinity": "Affinity",
           "speed_poly": "SpeedPoly", "ConstantEffectiveness": "ConstantEffectiveness", "PlateEffectivenessNTU": "PlateEffNTU"}
FAMILY_LABEL = {"chiller": "Chiller", "cooling_tower": "Cooling tower", "pump": "Pump", "heat_exchanger": "Heat exchanger"}
NOT_REACHED = "(not reached)"


def primary(i: int) -> Column:
    """The family's error (0), bias (1) or skill (2) column of a metrics row."""
    out = None
    for f in FAMILIES:
        v, c = F.col(PRIMARY[f][i]), F.col("equipment_type") == f
        out = F.when(c, v) if out is None else out.when(c, v)
    return out


def one_per_device(df: DataFrame, keys=KEYS) -> DataFrame:
    """One row per device, the smallest of any copies; pre-aggregates."""
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r"))
    return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


# ---- joins of result tables -----------------------------------------------------------------------------------
def gate_selected_join(gate: DataFrame, selected: DataFrame) -> DataFrame:
    """Gate with the selected model; the gate is the authority on shared columns."""
    shared = [c for c in selected.columns if c in gate.columns and c not in KEYS]
    return gate.join(selected.drop(*shared), list(KEYS), "left")


def metrics_enrich(metrics: DataFrame, gate: DataFrame, selected: DataFrame) -> DataFrame:
    g = one_per_device(gate.select(*KEYS, F.col("equipment_type").alias("_type"), "level", "reason", "flags", "valid_full_rows"))
    s = one_per_device(selected.select(*KEYS, F.col("candidate").alias("selected_candidate"), "selection_CVRMSE_pct", "test_CVRMSE_pct"))
    j = metrics.join(g, list(KEYS), "left").join(s, list(KEYS), "left")
    return j.withColumn("equipment_type", F.coalesce("equipment_type", "_type")).drop("_type")


def gate_only_rows(gate: DataFrame, metrics: DataFrame, selected: DataFrame) -> DataFrame:
    """Gated devices without a metric row; the status falls back to the level."""
    s = one_per_device(selected.select(*KEYS, F.col("candidate").alias("selected_candidate"), "status"))
    m = gate.join(metrics.select(*KEYS).distinct(), list(KEYS), "left_anti").join(s, list(KEYS), "left")
    return m.select(*KEYS, "equipment_type", "level", F.coalesce("status", "level").alias("status"), F.col("selected_candidate").alias("candidate"), "reason")


def power_sidecar_join(metrics: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Fan-power metrics of another run attached to towers only."""
    p = sidecar.where("equipment_type = 'pump' AND target = 'power_W'").select(
        *KEYS, F.lit("cooling_tower").alias("equipment_type"), F.col("CVRMSE_pct").alias("side_CVRMSE_pct"), F.col("NMBE_pct").alias("side_NMBE_pct"),
        F.col("MAPE_pct").alias("side_MAPE_pct"), F.col("R2").alias("side_R2"), F.lit(True).alias("has_sidecar"))
    return metrics.join(p, [*KEYS, "equipment_type"], "left").withColumn("has_sidecar", F.coalesce("has_sidecar", F.lit(False)))


def selected_test_lookup(selected: DataFrame, metrics: DataFrame) -> DataFrame:
    """Test-stage row of every scored device's selected candidate."""
    s = selected.where("status = 'ok'").select(*KEYS, "candidate")
    return s.join(metrics.where("stage = 'test'"), [*KEYS, "candidate"])


def missing_test_rows(selected: DataFrame, metrics: DataFrame) -> DataFrame:
    """Scored devices whose candidate has no test row: a disagreement, never an omission."""
    s = selected.where("status = 'ok'").select(*KEYS, "candidate")
    return s.join(metrics.where("stage = 'test'").select(*KEYS, "candidate"), [*KEYS, "candidate"], "left_anti")


def registry_errors(devices: DataFrame, profiles: DataFrame, adapters: DataFrame) -> DataFrame:
    """Missing ids, unknown types, missing adapters and an empty registry, as rows."""
    label = F.coalesce("device_id", F.lit("?"))
    a = devices.where("device_id IS NULL").select(F.lit("device id is required").alias("error"))
    b = devices.join(profiles.select("equipment_type").distinct(), "equipment_type", "left_anti").select(
        F.concat(label, F.lit(": unsupported equipment type: "), F.coalesce("equipment_type", F.lit("?"))).alias("error"))
    c = devices.join(adapters.select("adapter").distinct(), "adapter", "left_anti").select(F.concat(label, F.lit(": adapter config not found: "), F.coalesce("adapter", F.lit("?"))).alias("error"))
    none = devices.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("no devices defined").alias("error"))
    return a.unionByName(b).unionByName(c).unionByName(none)


def hash_mismatches(recorded: DataFrame, shipped: DataFrame) -> DataFrame:
    """Recorded model hashes that match no shipped artefact, compared by hash and not by name."""
    r = recorded.where(F.length("sha256") > 0)
    return r.join(shipped.select("sha256").distinct(), "sha256", "left_anti")


# ---- cross-site tables -------------------------------------------------------------------------------------------
def device_scores(joined: DataFrame) -> DataFrame:
    return joined.select(*KEYS, "equipment_type", "level", "status", "candidate", "test_CVRMSE_pct", "test_skill", "selection_skill", "driver", "driver_excitation", "on_rows", "flags")


def cross_site_summary(joined: DataFrame) -> DataFrame:
    """Per site and family: devices, scored, median test error, blocked as synthetic."""
    scored = F.col("status") == "ok"
    g = joined.groupBy("site", "equipment_type").agg(F.count(F.lit(1)).alias("devices"), F.count_if(scored).alias("scored"),
                                                     F.count_if(F.contains("flags", F.lit("synthetic_channel"))).alias("blocked_synthetic"))
    q = wide_quantiles(joined.where(scored), ["site", "equipment_type"], {"e": F.col("test_CVRMSE_pct")}, {"m": 0.5})
    j = g.join(q, ["site", "equipment_type"], "left")
    return j.select("site", F.col("equipment_type").alias("family"), "devices", "scored", F.bround("e_m", 2).alias("median_test_CVRMSE"), "blocked_synthetic")


def refusal_counts(joined: DataFrame) -> DataFrame:
    s = F.coalesce("status", F.lit(NOT_REACHED))
    return joined.select("site", F.col("equipment_type").alias("family"), s.alias("status")).where("status <> 'ok'").groupBy("site", "family", "status").agg(F.count(F.lit(1)).alias("devices"))


def explode_flags(joined: DataFrame) -> DataFrame:
    """One row per device flag; accepts a flag array or the comma-joined text of a sink."""
    a = F.col("flags") if joined.schema["flags"].dataType.typeName() == "array" else F.split("flags", ",")
    return joined.select(*KEYS, "equipment_type", F.explode(a).alias("flag")).select(*KEYS, "equipment_type", F.trim("flag").alias("flag")).where("flag <> ''")


def observability_matrix(flags: DataFrame, joined: DataFrame, checks: list[str]) -> DataFrame:
    """Distinct devices per site and check, with the fleet size and the scored devices."""
    per = flags.select(*KEYS, F.split_part(F.col("flag"), F.lit(":"), F.lit(1)).alias("check")).distinct()
    counts = per.groupBy("site").pivot("check", checks).count().na.fill(0)
    fleet = joined.groupBy("site").agg(F.count(F.lit(1)).alias("devices"), F.count_if(F.col("status") == "ok").alias("scored"))
    return fleet.join(counts, "site", "left").na.fill(0, checks)


def site_totals(summary: DataFrame) -> DataFrame:
    g = summary.groupBy("site").agg(F.sum("devices").alias("devices"), F.sum("scored").alias("scored"))
    return g.withColumn("scored_pct", F.bround(share_pct(F.col("scored"), F.col("devices")), 1))


def weak_scores(scores: DataFrame, min_span: float = 0.10) -> DataFrame:
    """Scored devices whose driver barely moved, or that a constant would beat."""
    d = scores.where("status = 'ok'").withColumns({"unexcited": is_true(F.col("driver_excitation") < min_span), "no_skill": is_true(F.col("test_skill") >= 1.0)})
    return d.where("unexcited OR no_skill").select(*KEYS, "equipment_type", "candidate", "test_CVRMSE_pct", "test_skill", "driver", "driver_excitation", "unexcited", "no_skill")


def readiness(joined: DataFrame) -> DataFrame:
    """Raw and operating records per site and family."""
    scored = F.col("status") == "ok"
    k = ["site", "equipment_type"]
    g = joined.groupBy(*k).agg(F.count(F.lit(1)).alias("devices"), F.count_if(scored).alias("scored"), F.sum("rows").alias("raw_records"), F.sum("on_rows").alias("operating_records"))
    q = wide_quantiles(joined.where(scored), k, {"e": F.col("test_CVRMSE_pct")}, {"m": 0.5})
    j = g.join(q, k, "left")
    return j.select("site", F.col("equipment_type").alias("family"), "devices", "scored", "raw_records", "operating_records",
                    F.coalesce(F.bround(share_pct(F.col("operating_records"), F.col("raw_records")), 1), dbl(0.0)).alias("operating_pct"), F.bround("e_m", 2).alias("median_test_error_pct"))


def site_profile(ready: DataFrame, cadence: DataFrame) -> DataFrame:
    """One row per site: cadence, span, families and totals. ``cadence`` is ``(site, step_min, span_days, window)``."""
    rank = F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family"))
    names = F.array_sort(F.collect_set(F.struct(rank.alias("o"), display_label("family", FAMILY_LABEL).alias("n"))))  # at most one per family
    g = ready.groupBy("site").agg(F.countDistinct("family").alias("families"), names.alias("f"), F.sum("devices").alias("devices"), F.sum("scored").alias("scored"),
                                  F.sum("raw_records").alias("raw_records"), F.sum("operating_records").alias("operating_records"))
    j = g.join(cadence, "site", "left")
    return j.select("site", F.concat(F.col("step_min").cast("string"), F.lit(" min")).alias("sampling_interval"), "span_days", "window", "families",
                    F.array_join(F.transform("f", lambda x: x["n"]), ", ").alias("family_list"), "devices", "scored",
                    F.bround(share_pct(F.col("scored"), F.col("devices")), 1).alias("scored_pct"), "raw_records", "operating_records")


def selection_vs_test(metrics: DataFrame, selected: DataFrame) -> DataFrame:
    """Selection and test error side by side per device and candidate."""
    e = metrics.withColumn("_e", primary(0))
    g = e.groupBy(*KEYS, "equipment_type", "candidate").agg(F.max(F.when(F.col("stage") == "selection", F.col("_e"))).alias("selection_error"),
                                                            F.max(F.when(F.col("stage") == "test", F.col("_e"))).alias("test_error"))
    g = g.where("selection_error IS NOT NULL OR test_error IS NOT NULL")
    j = g.join(selected.select(*KEYS, F.col("candidate").alias("_c")), list(KEYS), "left")
    return j.select("site", F.col("equipment_type").alias("family"), device_label().alias("device"), display_label("candidate", DISPLAY).alias("candidate"),
                    is_true(F.col("_c") == F.col("candidate")).alias("selected"), "selection_error", "test_error",
                    ratio("test_error", "selection_error").alias("ratio"), (F.col("test_error") - F.col("selection_error")).alias("gap"))


def device_results(selected: DataFrame, metrics: DataFrame, scores: DataFrame) -> DataFrame:
    """Test result of every scored device in its family's own metric."""
    label = F.create_map(*[F.lit(x) for f in FAMILIES for x in (f, PRIMARY[f][3])])
    t = selected_test_lookup(selected, metrics).select(*KEYS, "equipment_type", "candidate", F.col("N").alias("test_n"), primary(0).alias("test_error"), primary(1).alias("test_nmbe_pct"),
                                                       primary(2).alias("test_skill"))
    j = t.join(scores.select(*KEYS, "selection_skill", "driver", "driver_excitation"), list(KEYS), "left")
    return j.select("site", F.col("equipment_type").alias("family"), device_label().alias("device"), display_label("candidate", DISPLAY).alias("selected_model"),
                    label[F.col("equipment_type")].alias("metric_label"), "test_n", "test_error", "test_nmbe_pct", "test_skill", "selection_skill", F.coalesce("driver", F.lit("")).alias("driver"),
                    "driver_excitation")


def segment_counts(scores: DataFrame, metrics: DataFrame) -> DataFrame:
    """Scored samples per segment, refused devices included with 0."""
    n = metrics.groupBy(*KEYS).agg(F.max(F.when(F.col("stage") == "selection", F.col("N"))).alias("s"), F.max(F.when(F.col("stage") == "test", F.col("N"))).alias("t"))
    j = scores.join(n, list(KEYS), "left")
    return j.select("site", F.col("equipment_type").alias("family"), device_label().alias("device"), F.coalesce("on_rows", F.lit(0)).alias("retained_operating_rows"),
                    F.coalesce("s", F.lit(0)).alias("selection_n"), F.coalesce("t", F.lit(0)).alias("test_n"), F.col("status").alias("split_status"), is_true(F.col("status") == "ok").alias("scored"))


def generalisation_by_site(svt: DataFrame) -> DataFrame:
    """How often the test segment is worse than the selection segment."""
    s = svt.where("selected AND ratio IS NOT NULL")
    g = s.groupBy("site").agg(F.count(F.lit(1)).alias("devices"), F.count_if(F.col("ratio") > 1).alias("worse_on_test"), F.max("ratio").alias("max_ratio"))
    q = wide_quantiles(s, ["site"], {"r": F.col("ratio")}, {"m": 0.5})
    return g.join(q.select("site", F.col("r_m").alias("median_ratio")), "site")


def chiller_model_pivot(metrics: DataFrame, selected: DataFrame) -> DataFrame:
    """Both chiller models side by side on the untouched test stage."""
    m = metrics.where("equipment_type = 'chiller' AND stage = 'test'")
    p = m.groupBy(*KEYS).pivot("candidate", ["EIR", "EEIR"]).agg(F.bround(F.first("P_CVRMSE_pct"), 1).alias("P_CVRMSE"), F.bround(F.first("COP_CVRMSE_pct"), 1).alias("COP_CVRMSE"))
    return p.join(selected.select(*KEYS, F.col("candidate").alias("selected_candidate")), list(KEYS), "left")


def status_pivot(refusals: DataFrame, statuses: list[str]) -> DataFrame:
    return refusals.groupBy("site").pivot("status", statuses).sum("devices").na.fill(0)


def candidate_wins(scores: DataFrame) -> DataFrame:
    return scores.where("status = 'ok'").groupBy("equipment_type", "candidate", "site").agg(F.count(F.lit(1)).alias("wins"))


# ---- project reports ------------------------------------------------------------------------------------------------
_DETAIL = ["P_CVRMSE_pct", "P_NMBE_pct", "P_MAPE_pct", "P_R2", "Q_CVRMSE_pct", "Q_NMBE_pct", "COP_CVRMSE_pct", "COP_NMBE_pct", "T_out_CVRMSE_pct", "T_out_NMBE_pct"]


def normalise_metrics(m: DataFrame) -> DataFrame:
    """Family-specific metric columns on one common layout, with the list of missing artefacts.

    ``m`` is an enriched full-period row with the tower sidecar attached.
    """
    c, t = F.col, F.col("equipment_type")
    ch, ct, pu, hx = (t == f for f in FAMILIES)
    basis = (F.when(ch, "power_W + cooling_load_W + COP").when(ct, "heat_rejection_W + outlet_temperature + power_W").when(pu, "power_W")
             .when(hx, "leaving_temperature + heat_transfer_W").otherwise(F.coalesce("target", F.lit(""))))
    v = {
        "P_CVRMSE_pct": F.when(ch | pu, c("CVRMSE_pct")).when(ct, c("side_CVRMSE_pct")), "P_NMBE_pct": F.when(ch | pu, c("NMBE_pct")).when(ct, c("side_NMBE_pct")),
        "P_MAPE_pct": F.when(pu, c("MAPE_pct")).when(ct, c("side_MAPE_pct")), "P_R2": F.when(pu, c("R2")).when(ct, c("side_R2")),
        "Q_CVRMSE_pct": F.when(ch | hx, c("Q_CVRMSE_pct")).when(ct, F.coalesce("Q_CVRMSE_pct", "CVRMSE_pct")),
        "Q_NMBE_pct": F.when(ch, c("Q_NMBE_pct")).when(ct, F.coalesce("Q_NMBE_pct", "NMBE_pct")),
        "COP_CVRMSE_pct": F.when(ch, c("COP_CVRMSE_pct")), "COP_NMBE_pct": F.when(ch, c("COP_NMBE_pct")),
        "T_out_CVRMSE_pct": F.when(ct, c("T_CVRMSE_pct_diagnostic")).when(hx, F.coalesce("T2_CVRMSE_pct", "CVRMSE_pct")),
        "T_out_NMBE_pct": F.when(ct, c("T_NMBE_pct_diagnostic")).when(hx, c("NMBE_pct")),
    }
    d = m.select(*KEYS, "equipment_type", "level", "status", F.coalesce("candidate", "selected_candidate").alias("model"), "N", "has_sidecar", basis.alias("metric_basis"), "reason",
                 *[e.alias(n) for n, e in v.items()])
    ok = is_true(c("status") == "ok")

    def gap(name, cond):
        return F.when(ok & cond, F.lit(f"{name} validation artifact missing"))
    missing = F.array(gap("P", (ch | pu) & c("P_CVRMSE_pct").isNull()), gap("P", ct & ~c("has_sidecar")), gap("T_out", hx & c("T_out_CVRMSE_pct").isNull()),
                      gap("Q", (ch | ct | hx) & c("Q_CVRMSE_pct").isNull()), gap("COP", ch & c("COP_CVRMSE_pct").isNull()), gap("T_out", ct & c("T_out_CVRMSE_pct").isNull()))
    return d.withColumn("missing_metrics", F.array_join(F.array_compact(missing), "; ")).drop("has_sidecar")


def project_overview(detail: DataFrame) -> DataFrame:
    """Per family: devices, ok, limited, median and mean of the primary metric."""
    t = F.col("equipment_type")
    name = F.when(t == "cooling_tower", "Q_CVRMSE_pct").when(t == "heat_exchanger", "T_out_CVRMSE_pct").otherwise("P_CVRMSE_pct")
    val = F.when(t == "cooling_tower", F.col("Q_CVRMSE_pct")).when(t == "heat_exchanger", F.col("T_out_CVRMSE_pct")).otherwise(F.col("P_CVRMSE_pct"))
    ok = is_true(F.col("status") == "ok")
    d = detail.withColumns({"_v": F.when(ok, val), "primary_metric": name})
    g = d.groupBy("equipment_type", "primary_metric").agg(F.count(F.lit(1)).alias("devices"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("limited_or_blocked"), F.avg("_v").alias("mean_pct"),
                                                          F.count_if(F.col("missing_metrics") != "").alias("missing_metric_rows"))
    q = wide_quantiles(d, ["equipment_type"], {"v": F.col("_v")}, {"m": 0.5})
    return g.join(q.select("equipment_type", F.col("v_m").alias("median_pct")), "equipment_type", "left")


def project_detail(metrics: DataFrame, gate: DataFrame, selected: DataFrame, sidecar: DataFrame, exclude_prefix: str | None = None) -> DataFrame:
    """All scored and gated devices of a project on the common layout."""
    m = metrics_enrich(metrics, gate, selected)
    m = m.unionByName(gate_only_rows(gate, metrics, selected), allowMissingColumns=True)
    if exclude_prefix:
        m = m.where(~((F.col("equipment_type") == "pump") & F.startswith("device_id", F.lit(exclude_prefix))))
    return normalise_metrics(power_sidecar_join(m, sidecar))
