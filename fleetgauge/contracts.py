"""Equipment contracts and thresholds."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: canonical roles each equipment family needs -----------------------------
PROFILES = {
    "chiller": {
        "target": "power_W",
        "required": ["power_W", "tchws_C", "tchwr_C", "tcws_C", "tcwr_C", "chw_flow_m3_h", "cw_flow_m3_h"],
        "nominal": ["tchws_C", "tchwr_C", "chw_flow_m3_h"],
        "optional": ["cw_flow_m3_h", "tcws_C", "load_pct", "cooling_load_W"],
        "controlled": ["tchws_C"],
        "validation": ["power_W", "cooling_load_W"],
        "liveness": ["load_pct"],
        "driver": "cooling_load_W",
        "candidates": ["ElectricReformulatedEIR", "ElectricEIR", "Carnot_TEva"],
    },
    "cooling_tower": {
        "target": "heat_rejection_W",
        "required": ["heat_rejection_W", "power_W", "fan1_Hz", "tcwr_C", "tcws_1_C", "twb_C", "attributed_flow_m3_h",
                     "fans_on_count"],
        "nominal": ["tcwr_C", "tcws_1_C"],
        "optional": ["fan2_Hz", "tcws_2_C", "tcws_C"],
        "controlled": ["tcws_C", "tcws_1_C", "tcws_2_C"],
        "validation": ["heat_rejection_W", "power_W"],
        "liveness": [],
        "driver": "fan1_Hz",
        "candidates": ["YorkCalc", "Merkel", "fan_affinity_power"],
    },
    "pump": {
        "target": "power_W",
        "required": ["power_W", "speed_Hz"],
        "nominal": ["speed_Hz"],
        "optional": ["head_m", "flow_m3_h", "attributed_flow_m3_h"],
        "controlled": [],
        "validation": ["power_W"],
        "liveness": ["speed_Hz"],
        "driver": "speed_Hz",
        "candidates": ["SpeedControlled_Nrpm", "speed_poly_power", "affinity_power"],
    },
    "heat_exchanger": {
        "target": "tcwr_C",
        "required": ["tchws_C", "tchwr_C", "tcws_C", "tcwr_C", "chw_flow_m3_h", "cw_flow_m3_h"],
        "nominal": ["tchws_C", "tchwr_C", "tcws_C", "tcwr_C"],
        "optional": ["chw_valve_pct", "cw_valve_pct", "cw_flow_m3_h", "Q_W", "attributed_flow_m3_h"],
        "controlled": ["tchws_C"],
        "validation": ["Q_W", "tcwr_C"],
        "liveness": [],
        "driver": "",
        "candidates": ["ConstantEffectiveness", "PlateEffectivenessNTU"],
    },
}
FAMILIES = ["chiller", "cooling_tower", "pump", "heat_exchanger"]

# --- fixed values: evidence tiers, best first -----------------------------------------------
EVIDENCE_TIERS = ["T0_direct_measurement", "T1_conservation_reconstruction", "T2_topological_attribution",
                  "T3_system_boundary_approximation", "T4_nameplate_substitution",
                  "TX_synthetic_point_published_as_measurement", "T5_unavailable"]

# --- fixed values: channels each model type needs (family, model, channel, necessity) ------
SENSOR_SET = [
    ("cooling_tower", "YorkCalc", "tcwr_C", "required"),
    ("cooling_tower", "YorkCalc", "tcws_1_C", "required"),
    ("cooling_tower", "YorkCalc", "twb_C", "required"),
    ("cooling_tower", "YorkCalc", "attributed_flow_m3_h", "required"),
    ("cooling_tower", "YorkCalc", "fan1_Hz", "required"),
    ("cooling_tower", "YorkCalc", "fans_on_count", "required"),
    ("cooling_tower", "YorkCalc", "power_W", "optional"),
    ("cooling_tower", "Merkel", "tcwr_C", "required"),
    ("cooling_tower", "Merkel", "tcws_1_C", "required"),
    ("cooling_tower", "Merkel", "twb_C", "required"),
    ("cooling_tower", "Merkel", "attributed_flow_m3_h", "required"),
    ("cooling_tower", "Merkel", "fan1_Hz", "required"),
    ("chiller", "ElectricEIR", "power_W", "required"),
    ("chiller", "ElectricEIR", "tchws_C", "required"),
    ("chiller", "ElectricEIR", "tcws_C", "required"),
    ("chiller", "ElectricEIR", "chw_flow_m3_h", "required"),
    ("chiller", "ElectricEIR", "tchwr_C", "required"),
    ("chiller", "ElectricEIR", "cw_flow_m3_h", "required"),
    ("chiller", "ElectricReformulatedEIR", "tcwr_C", "required"),
    ("pump", "empirical_power", "power_W", "required"),
    ("pump", "empirical_power", "speed_Hz", "required"),
    ("pump", "empirical_power", "attributed_flow_m3_h", "conditional"),
    ("pump", "mover", "attributed_flow_m3_h", "required"),
    ("heat_exchanger", "ConstantEffectiveness", "tchws_C", "required"),
    ("heat_exchanger", "ConstantEffectiveness", "tcws_C", "required"),
    ("heat_exchanger", "ConstantEffectiveness", "chw_flow_m3_h", "required"),
    ("heat_exchanger", "ConstantEffectiveness", "cw_flow_m3_h", "required"),
    ("heat_exchanger", "ConstantEffectiveness", "tcwr_C", "required"),
    ("heat_exchanger", "PlateEffectivenessNTU", "tchwr_C", "required"),
]


@dataclass(frozen=True)
class Thresholds:
    """Project thresholds; the defaults suit five-minute records."""

    run_on: float = 0.5
    dead_run_policy: str = "fallback"
    min_full_rows: int = 500
    min_nominal_rows: int = 200
    min_calibration_rows: int = 200
    min_samples: int = 200
    block_synthetic: bool = True
    extra: dict = field(default_factory=dict)


def per_family(pick, default=None) -> Column:
    """Column that evaluates ``pick(profile)`` for the row's equipment type."""
    out = None
    for fam in FAMILIES:
        v = pick(PROFILES[fam])
        if v is None:
            continue
        v = v if isinstance(v, Column) else F.lit(v)
        cond = F.col("equipment_type") == fam
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out if default is None else out.otherwise(default)


def role_or_null(df: DataFrame, role: str) -> Column:
    """The role's column, or NULL where the frame never mapped it."""
    return F.col(role).cast("double") if role in df.columns else F.lit(None).cast("double")


def profile_table(spark: SparkSession) -> DataFrame:
    """``(equipment_type, kind, ord, role)``: a fixed table of a few dozen rows."""
    rows = []
    for fam, p in PROFILES.items():
        rows.append((fam, "target", 0, p["target"]))
        for kind in ("required", "nominal", "optional", "controlled", "validation", "liveness"):
            rows += [(fam, kind, i, r) for i, r in enumerate(p[kind])]
    return spark.createDataFrame(rows, "equipment_type string, kind string, ord int, role string")
