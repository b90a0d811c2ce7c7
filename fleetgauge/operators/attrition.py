"""Row-attrition accounting: every lost row is charged to the first criterion it fails."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge import KEYS
from fleetgauge.contracts import PROFILES, role_or_null
from fleetgauge.functions.cols import dbl, is_true, share_pct


@dataclass(frozen=True)
class Criterion:
    """``keep`` is TRUE for rows to retain; a quarantine names impossible rows."""

    name: str
    category: str
    kind: str
    keep: Column


def gate(name: str, keep: Column, category: str = "operating_state") -> Criterion:
    return Criterion(name, category, "gate", is_true(keep))


def quarantine(name: str, impossible: Column, category: str = "physically_impossible") -> Criterion:
    return Criterion(name, category, "quarantine", ~is_true(impossible))


def first_failed(criteria: list[Criterion]) -> Column:
    """1-based index of the first criterion a row fails, NULL for a survivor."""
    return F.coalesce(*[F.when(~c.keep, F.lit(i + 1)) for i, c in enumerate(criteria)])


def _counts(df, criteria):
    d = df.withColumn("_f", first_failed(criteria))
    return d.groupBy(*KEYS, "equipment_type").agg(
        F.count(F.lit(1)).alias("n_total"), *[F.count_if(F.col("_f") == i + 1).alias(f"_r{i + 1}") for i in range(len(criteria))])


def waterfall(df: DataFrame, criteria: list[Criterion]) -> DataFrame:
    """``(device, ord, name, category, kind, removed, remaining, retained_pct)``; step 0 is the raw record.

    One aggregation pass; the steps are unfolded from the counts.
    """
    g = _counts(df, criteria)
    left = F.col("n_total")
    steps = [F.struct(F.lit(0).alias("ord"), F.lit("raw records").alias("name"), F.lit("source").alias("category"), F.lit("").alias("kind"),
                      F.lit(0).cast("bigint").alias("removed"), left.alias("remaining"))]
    for i, c in enumerate(criteria):
        left = left - F.col(f"_r{i + 1}")
        steps.append(F.struct(F.lit(i + 1).alias("ord"), F.lit(c.name).alias("name"), F.lit(c.category).alias("category"), F.lit(c.kind).alias("kind"),
                              F.col(f"_r{i + 1}").alias("removed"), left.alias("remaining")))
    out = g.select(*KEYS, "equipment_type", "n_total", F.explode(F.array(*steps)).alias("s"))
    return out.select(*KEYS, "equipment_type", "s.*", F.coalesce(share_pct(F.col("s.remaining"), F.col("n_total")), dbl(0.0)).alias("retained_pct"))


def summary(df: DataFrame, criteria: list[Criterion]) -> DataFrame:
    """Totals per device, by kind, with one count per quarantine rule."""
    g = _counts(df, criteria)

    def total(kind):
        out = F.lit(0).cast("bigint")
        for i, c in enumerate(criteria):
            if c.kind == kind:
                out = out + F.col(f"_r{i + 1}")
        return out
    kept = F.col("n_total") - total("gate") - total("quarantine")
    rules = [F.struct(F.lit(c.name).alias("k"), F.col(f"_r{i + 1}").alias("v")) for i, c in enumerate(criteria) if c.kind == "quarantine"]
    per_rule = F.map_from_entries(F.array(*rules)) if rules else F.lit(None).cast("map<string,bigint>")
    return g.select(*KEYS, "equipment_type", "n_total", kept.alias("n_retained"), F.coalesce(share_pct(kept, F.col("n_total")), dbl(0.0)).alias("retained_pct"),
                    total("gate").alias("removed_by_gate"), total("quarantine").alias("removed_by_quarantine"), per_rule.alias("quarantined"))


def tower_criteria(min_flow: float = 1.0) -> list[Criterion]:
    """Rules over the columns of ``features.ct_features``."""
    c = F.col
    return [
        gate("entering water temperature present", c("Tin_C").isNotNull(), "missing_channel"),
        gate("wet-bulb temperature present", c("Twb_C").isNotNull(), "missing_channel"),
        gate("attributed flow present", c("total_kgps").isNotNull(), "missing_channel"),
        gate("active fan count present", c("nfan").isNotNull(), "missing_channel"),
        gate("leaving water temperature present", c("Tout_C").isNotNull(), "missing_reference"),
        gate(f"total water flow above {min_flow:g} kg/s", c("total_kgps") > min_flow),
        gate("fans running", c("fr_air") > 0.05),
        quarantine("leaving water hotter than entering (range <= 0)", c("TRan_C") <= 0),
        quarantine("leaving water at or below wet bulb (approach <= 0)", c("TApp_C") <= 0),
    ]


def generic_criteria(df: DataFrame, family: str) -> list[Criterion]:
    """The profile's required roles one by one, then the run signal."""
    out = [gate(f"{r} present", role_or_null(df, r).isNotNull(), "missing_channel") for r in PROFILES[family]["required"]]
    if "run_signal" in df.columns:
        out.append(gate("device running", F.col("run_signal") > 0.5))
    return out


def family_waterfall(falls: DataFrame) -> DataFrame:
    """Removed rows summed over the devices of a family, with running remainder."""
    raw = falls.where("ord = 0").groupBy("equipment_type").agg(F.sum("remaining").alias("raw"))
    g = falls.where("ord > 0").groupBy("equipment_type", "ord", "name", "category", "kind").agg(F.sum("removed").alias("removed"))
    w = Window.partitionBy("equipment_type").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)  # a dozen steps
    j = g.join(raw, "equipment_type").withColumn("remaining", F.col("raw") - F.sum("removed").over(w))
    return j.select("equipment_type", "ord", "name", "category", "kind", "removed", share_pct(F.col("removed"), F.col("raw")).alias("pct_of_raw"), "remaining",
                    share_pct(F.col("remaining"), F.col("raw")).alias("retained_pct"))


def quarantine_by_device(summaries: DataFrame) -> DataFrame:
    q = F.col("removed_by_quarantine")
    return summaries.select(*KEYS, "n_total", q.alias("quarantined_total"), share_pct(q, F.col("n_total")).alias("quarantined_pct_of_raw"))
