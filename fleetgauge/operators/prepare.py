"""Row-level preparation of canonical telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge import KEYS
from fleetgauge.contracts import profile_table
from fleetgauge.functions.cols import dbl, present
from fleetgauge.operators import ordered


def map_points(points: DataFrame, rules: dict[str, list[str]], owner=("site", "device_id"), name: str = "point") -> DataFrame:
    """Map a role to the one point whose name contains every part of its rule.

    A role with no hit or several hits in a header stays unmapped. The rules
    are literals in the projection, so no join is needed.
    """
    tried = F.array(*[F.struct(F.lit(role).alias("role"), F.forall(F.array(*[F.lit(x) for x in parts]), lambda x: F.contains(F.col(name), x)).alias("hit"))
                      for role, parts in rules.items()])
    hits = points.select(*owner, name, F.explode(F.filter(tried, lambda t: t["hit"])).alias("t")).select(*owner, name, "t.role")
    g = hits.groupBy(*owner, "role").agg(F.count(F.lit(1)).alias("c"), F.min(name).alias("source"))
    return g.where("c = 1").select(*owner, "role", "source")


def swap_columns(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.withColumns({a: F.col(b), b: F.col(a)})


def order_violations(df: DataFrame, low: str, high: str, keys=KEYS) -> DataFrame:
    """Rows where the lower quantity exceeds the higher one, over rows knowing both."""
    both = F.col(low).isNotNull() & F.col(high).isNotNull()
    return (df.groupBy(*keys).agg(F.count_if(F.col(low) > F.col(high)).alias("violations"), F.count_if(both).alias("both_known"))
            .withColumn("violation_pct", dbl(100.0) * F.col("violations") / F.greatest(F.col("both_known"), F.lit(1))))


def decimate(df: DataFrame, n: int) -> DataFrame:
    """Rows 0, n, 2n, ... of each device in time order."""
    d = ordered.ordinal(df, list(KEYS), ["ts"], ordered.day_chunk(), "_rn")
    return d.where(F.col("_rn") % n == 0).drop("_rn")


def subset_stride(df: DataFrame, max_rows: int) -> DataFrame:
    """Evenly strided rows of each device, keeping the real elapsed time."""
    d = ordered.ordinal(elapsed(df), list(KEYS), ["ts"], ordered.day_chunk(), "_rn")
    n = df.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"))
    d = d.join(n, list(KEYS))
    stride = F.when(F.col("_n") <= max_rows, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(F.col("_n") / F.lit(max_rows))))
    return d.where(F.col("_rn") % stride == 0).drop("_rn", "_n")


def elapsed(df: DataFrame, name: str = "elapsed_s") -> DataFrame:
    """Seconds since the device's first retained row."""
    first = df.groupBy(*KEYS).agg(F.min("ts").alias("_t0"))
    return (df.join(first, list(KEYS))
            .withColumn(name, (F.unix_micros("ts") - F.unix_micros("_t0")) / dbl(1e6)).drop("_t0"))


def compressed_axis(df: DataFrame, dt: float, name: str = "axis_s") -> DataFrame:
    """Gap-free axis ``i * dt``."""
    d = ordered.ordinal(df, list(KEYS), ["ts"], ordered.day_chunk(), "_rn")
    return d.withColumn(name, F.col("_rn") * dbl(dt)).drop("_rn")


def finite_rows(df: DataFrame, columns, mask: Column, name: str = "rows") -> DataFrame:
    """Rows under the mask where every listed column is finite; 0 for an absent column or empty list."""
    ok = mask & present(columns) if columns and all(c in df.columns for c in columns) else F.lit(False)
    return df.groupBy(*KEYS).agg(F.count_if(ok).alias(name))


def relabel_sites(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Attach the site letter; ``labels`` is ``(site, letter)``."""
    return df.join(labels, "site", "left")


def unmapped_sites(df: DataFrame, labels: DataFrame) -> DataFrame:
    return df.select("site").distinct().join(labels, "site", "left_anti")


def family_rank(c: str = "equipment_type") -> Column:
    """Ordered category: position of the family in the reporting order."""
    from fleetgauge.contracts import FAMILIES
    pos = F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col(c))
    return F.when(pos > 0, pos - 1).otherwise(F.lit(99))


def display_label(c, names: dict[str, str]) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    m = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])
    return F.coalesce(F.try_element_at(m, x), x)


def device_label(c: str = "device_id") -> Column:
    return F.replace(F.col(c), F.lit("_"), F.lit("-"))


def controlled_targets(requests: DataFrame) -> DataFrame:
    """Requests ``(equipment_type, target, ...)`` whose target a controller regulates."""
    p = profile_table(requests.sparkSession).where("kind = 'controlled'").select("equipment_type", F.col("role").alias("target"))
    return requests.join(p, ["equipment_type", "target"], "left_semi")


