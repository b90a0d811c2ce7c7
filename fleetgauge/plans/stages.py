"""The five stages, each one job over the whole fleet.

ingest -> attribute -> gate -> calibrate -> validate. A stage returns lazy
frames; :func:`run` writes the tables that several later stages read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge import KEYS
from fleetgauge.contracts import Thresholds
from fleetgauge.functions import metrics as mx
from fleetgauge.functions.lineage import settle
from fleetgauge.operators import attribution as at
from fleetgauge.operators import evaluate as ev
from fleetgauge.operators import fit, gate, observability, operating, reconstruct
from fleetgauge.sources import raw


def ingest(source: DataFrame, adapter: dict, stamp: str, policy: str = "reject", keep=("site", "device_id", "equipment_type", "grp", "row_id")) -> DataFrame:
    """Raw historian rows to canonical rows under the timestamp policy."""
    c = raw.canonicalise(source, adapter, keep=(*keep, stamp))
    return raw.apply_policy(raw.utc_normalise(c, stamp), policy)


def attribute(canonical: DataFrame, recon: list[dict], boundary: list[tuple[DataFrame, str, str]] = (), paired: DataFrame | None = None,
              paired_flow: str = "cw_flow_m3_h", solo: tuple[str, str, str] | None = None, th: Thresholds | None = None) -> DataFrame:
    """Shared signals, loop flow, reconstruction, then the operating mask and the chiller load.

    Reconstruction runs after attribution because a heat rate may use the
    attributed flow. ``solo`` is ``(target type, source type, flow role)``.
    """
    th = th or Thresholds()
    f = canonical
    for ext, column, alias in boundary:
        f = at.boundary_join(f, ext, column, alias)
    names, rows = [], f
    if paired is not None:
        f, names = at.attribute_named(f, paired, paired_flow, "_paired", source=rows), [*names, "_paired"]
    if solo is not None:
        f = at.attribute_solo(f, F.col("equipment_type") == solo[0], solo[1], solo[2], "_solo", run_on=th.run_on, source=rows)
        names.append("_solo")
    if names:
        f = f.withColumn("attributed_flow_m3_h", F.coalesce(*names)).drop(*names)
    f = settle(reconstruct.reconstruct(f, recon), "attributed")
    return reconstruct.cooling_load(operating.operating_mask(f, th))


def run(canonical: DataFrame, recon: list[dict], th: Thresholds, roles, forms: dict | None = None, fold: int = 3, **kw) -> dict[str, DataFrame]:
    """All stages after ingest; returns the tables a report is made of."""
    masked = settle(attribute(settle(canonical, "canonical"), recon, th=th, **kw), "masked")
    found = observability.dependency_scan(masked, roles, th.min_samples) if th.block_synthetic else None
    gated = settle(gate.gate_devices(masked, found, th), "gate")
    full = masked.join(gated.where("level = 'full_physical'").select(*KEYS), list(KEYS), "left_semi")
    tables = []
    for fam, fs in (forms or {"pump": fit.pump_forms(), "cooling_tower": fit.fan_forms()}).items():
        if all(c in masked.columns for n in fs for c in fit.FORM_INPUTS[n]):
            tables.append(fit.calibrate_power_models(full.where(F.col("equipment_type") == fam), fs, th.min_calibration_rows, fold)[0])
    out = {"masked": masked, "gate": gated, "levels": gate.level_counts(gated)}
    if tables:
        metrics = tables[0]
        for t in tables[1:]:
            metrics = metrics.unionByName(t)
        metrics = settle(metrics, "metrics")
        every = {n: f for fs in (forms or {"pump": fit.pump_forms(), "cooling_tower": fit.fan_forms()}).values() for n, f in fs.items()}
        chosen = fit.candidate_argmin(metrics, "MAPE_pct", list(every))
        every = {n: f for n, f in every.items() if all(c in masked.columns for c in fit.FORM_INPUTS[n])}
        scored = fit.apply_power_models(full, every, chosen)
        cov = mx.coverage_row(masked, KEYS, F.col("operating"), F.col("power_W").isNotNull(), F.col("power_W").isNotNull())
        status = gated.select(*KEYS, "level").join(chosen.select(*KEYS, "candidate", "status"), list(KEYS), "left")
        status = status.withColumn("status", F.coalesce("status", F.when(F.col("level") == "nominal_only", "power_calibration_blocked").otherwise("blocked")))
        out |= {"metrics": metrics, "selected": chosen, "validation": ev.full_period_validation(gated.select(*KEYS, "equipment_type"), status, scored, cov)}
    return out
