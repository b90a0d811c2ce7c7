"""Time-and-motion accounting of manual and automated work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.cols import dbl

# --- fixed values: share of the manual effort per stage that survives automation (low, high) ------------
RETENTION = {1: (0.25, 0.60), 2: (0.10, 0.30), 3: (0.15, 0.40), 4: (0.00, 0.00), 5: (0.00, 0.00), 6: (0.00, 0.00), 7: (0.20, 0.50), 8: (0.10, 0.30)}
SETUP = "FAMILY_SETUP"


def per_family(log: DataFrame) -> DataFrame:
    """Setup hours, first two accepted devices, marginal hours and the learning effect.

    ``log`` is ``(family, device, ord, stage, minutes, blocked)``.
    """
    setup = log.where(F.col("device") == SETUP).groupBy("family").agg((F.sum("minutes") / 60.0).alias("setup_h"))
    d = log.where(F.col("device") != SETUP).groupBy("family", "device", "ord").agg(F.sum("minutes").alias("m"), F.max("blocked").alias("b"))
    ok = ~F.col("b")
    rank = F.struct("ord", "device")
    first = d.where(ok).groupBy("family").agg(F.min_by("m", rank).alias("m1"), F.min(rank).alias("r1"))
    rest = d.where(ok).join(first, "family").where(rank > F.col("r1")).groupBy("family").agg(F.min_by("m", rank).alias("m2"))
    g = d.groupBy("family").agg((F.avg(F.when(ok, F.col("m"))) / 60.0).alias("accepted_marginal_h"), F.coalesce(F.avg(F.when(~ok, F.col("m"))) / 60.0, dbl(0.0)).alias("blocked_marginal_h"))
    j = g.join(setup, "family", "left").join(first, "family", "left").join(rest, "family", "left")
    return j.select("family", F.coalesce("setup_h", dbl(0.0)).alias("setup_h"), (F.col("m1") / 60.0).alias("device_1_h"), (F.col("m2") / 60.0).alias("device_2_h"),
                    "accepted_marginal_h", "blocked_marginal_h", (dbl(1.0) - F.col("m2") / F.nullif(F.col("m1"), dbl(0.0))).alias("learning_effect"))


def extrapolate(family: DataFrame, inventory: DataFrame) -> DataFrame:
    """Full-inventory hours; ``inventory`` is ``(family, accepted, refused)``."""
    j = family.join(inventory, "family")
    total = F.col("setup_h") + F.col("accepted") * F.col("accepted_marginal_h") + F.col("refused") * F.col("blocked_marginal_h")
    return j.select("family", "accepted", "refused", "setup_h", "accepted_marginal_h", "blocked_marginal_h", total.alias("full_inventory_h"))


def by_stage(log: DataFrame) -> DataFrame:
    return log.groupBy("stage").agg((F.sum("minutes") / 60.0).alias("manual_h"))


def sensitivity(stages: DataFrame, retention: dict[int, tuple[float, float]] | None = None) -> DataFrame:
    """Hours an automated arm would still need per stage, and the implied reduction."""
    r = retention or RETENTION
    lo = F.create_map(*[x for k, v in r.items() for x in (F.lit(k), dbl(v[0]))])
    hi = F.create_map(*[x for k, v in r.items() for x in (F.lit(k), dbl(v[1]))])
    k = F.col("stage").cast("int")
    d = stages.withColumns({"auto_low_h": F.col("manual_h") * F.try_element_at(lo, k), "auto_high_h": F.col("manual_h") * F.try_element_at(hi, k)})
    tot = d.agg(F.sum("manual_h").alias("m"), F.sum("auto_low_h").alias("l"), F.sum("auto_high_h").alias("h"))
    total = tot.select(F.lit(None).cast("bigint").alias("stage"), F.col("m").alias("manual_h"), F.col("l").alias("auto_low_h"), F.col("h").alias("auto_high_h"))
    out = d.select(F.col("stage").cast("bigint").alias("stage"), "manual_h", "auto_low_h", "auto_high_h").unionByName(total)
    return out.withColumns({"reduction_low_pct": dbl(100.0) * (dbl(1.0) - F.col("auto_high_h") / F.nullif(F.col("manual_h"), dbl(0.0))),
                            "reduction_high_pct": dbl(100.0) * (dbl(1.0) - F.col("auto_low_h") / F.nullif(F.col("manual_h"), dbl(0.0)))})


def machine_wall_time(stages: DataFrame) -> DataFrame:
    """Minutes from creation to the last stage of each run; ``(run, created, stage, updated)``."""
    g = stages.groupBy("run").agg(F.countDistinct("stage").alias("stages"), F.max("updated").alias("z"), F.min("created").alias("a"))
    return g.select("run", "stages", ((F.unix_micros("z") - F.unix_micros("a")) / dbl(60e6)).alias("wall_min"))
