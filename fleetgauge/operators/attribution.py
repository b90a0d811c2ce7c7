"""Joining shared signals and attributing loop flow to single devices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge import KEYS
from fleetgauge.functions.cols import all_of, is_true


def key_errors(df: DataFrame, keys, label: str) -> DataFrame:
    """Invalid (NULL) and duplicate key counts; empty when the side is one-to-one."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    bad_null = F.coalesce(F.sum(F.when(F.col(keys[-1]).isNull(), F.col("c"))), F.lit(0))
    bad_dup = F.coalesce(F.sum(F.when(F.col(keys[-1]).isNotNull(), F.col("c") - 1)), F.lit(0))
    a = per_key.agg(bad_null.alias("invalid"), bad_dup.alias("duplicate"))
    return (a.select(F.explode(F.array(F.struct(F.lit("invalid timestamp values").alias("error"), F.col("invalid").alias("rows")),
                                       F.struct(F.lit("duplicate timestamp values").alias("error"), F.col("duplicate").alias("rows"))))
                     .alias("e")).select(F.lit(label).alias("side"), "e.error", "e.rows").where("rows > 0"))


def require_empty(errors: DataFrame) -> None:
    """Strict mode: raise when an error table has rows."""
    found = errors.limit(5).collect()
    if found:
        raise ValueError("; ".join(str(r.asDict()) for r in found))


def boundary_join(df: DataFrame, ext: DataFrame, column: str, alias: str, on=("site", "ts"), strict: bool = False) -> DataFrame:
    """Left equi-join of one shared signal (say an outdoor wet bulb), validated one-to-one."""
    side = ext.select(*on, F.col(column).alias(alias))
    if strict:
        require_empty(key_errors(side, list(on), alias))
    return df.join(side, list(on), "left")


def total_source_flow(sources: DataFrame, keys, flow: str, name: str = "total_flow") -> DataFrame:
    """Sum of a flow role per time step; a device or value that is missing adds 0."""
    return sources.groupBy(*keys, "ts").agg(F.sum(F.coalesce(F.col(flow), F.lit(0.0))).alias(name))


def reference_errors(spec: DataFrame, registry: DataFrame) -> DataFrame:
    """Named source devices that the registry does not know."""
    named = spec.select("site", "device_id", F.explode("source_devices").alias("source_device"))
    known = registry.select("site", F.col("device_id").alias("source_device"))
    return named.join(known, ["site", "source_device"], "left_anti").select("site", "device_id", "source_device")


def _source_sets(spec: DataFrame) -> DataFrame:
    """Targets that read the same sources share one set, so each sum is built once."""
    return spec.withColumn("source_set", F.array_join(F.array_sort("source_devices"), "+"))


def attribute_named(df: DataFrame, spec: DataFrame, flow: str, name: str, source: DataFrame | None = None) -> DataFrame:
    """Flow summed over each target's named devices, left-joined on the time step.

    ``spec`` holds ``(site, device_id, source_devices)``. ``source`` holds the
    same rows as ``df`` where that is derived: flows are read from it.
    """
    source = df if source is None else source
    sets = _source_sets(spec)
    members = (sets.select("site", "source_set", F.explode("source_devices").alias("device_id")).distinct())
    totals = total_source_flow(source.select("site", "device_id", "ts", flow).join(members, ["site", "device_id"]), ["site", "source_set"], flow, name)
    tagged = df.join(sets.select("site", "device_id", "source_set"), ["site", "device_id"], "left")
    named = tagged.where(F.col("source_set").isNotNull()).join(totals, ["site", "source_set", "ts"], "left")
    return _with_rest(named, tagged.where(F.col("source_set").isNull()), name).drop("source_set")


def _with_rest(joined: DataFrame, rest: DataFrame, name: str) -> DataFrame:
    """``joined`` and the rows that have no attribution: only the former need to be shuffled."""
    return joined.unionByName(rest.withColumn(name, F.lit(None).cast("double")))


def attribute_by_type(df: DataFrame, targets: Column, source_type: str, flow: str, name: str, scope=("site",)) -> DataFrame:
    """Flow summed over every device of a type in scope, for the target rows."""
    totals = total_source_flow(df.where(F.col("equipment_type") == source_type).select(*scope, "ts", flow), list(scope), flow, name)
    return _with_rest(df.where(is_true(targets)).join(totals, [*scope, "ts"], "left"), df.where(~is_true(targets)), name)


def attribute_solo(df: DataFrame, targets: Column, source_type: str, flow: str, name: str, scope=("site",),
                   group=("site", "grp"), run_on: float = 0.5, source: DataFrame | None = None) -> DataFrame:
    """Type-wide flow kept only where the target runs alone in its group.

    A target without any usable run signal gets no attribution at all: it has
    no running row. Only running target rows meet the flows and the numbers of
    running devices. ``source`` as in :func:`attribute_named`.
    """
    source = df if source is None else source
    on = is_true(F.col("run_signal") > run_on)
    wanted = on & is_true(targets)
    alone = source.where(on).groupBy(*[F.col(c).alias(f"_{c}") for c in (*group, "ts")]).agg(F.count(F.lit(1)).alias("_on")).where("_on = 1")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*group, "ts")]
    totals = total_source_flow(source.where(F.col("equipment_type") == source_type).select(*scope, "ts", flow), list(scope), flow, "_total")
    j = df.where(wanted).join(alone, all_of(same), "left").join(totals, [*scope, "ts"], "left")
    return _with_rest(j.withColumn(name, F.when(F.col("_on") == 1, F.col("_total"))).drop("_on", "_total", *[f"_{c}" for c in (*group, "ts")]), df.where(~wanted), name)


def attribution_flags(df: DataFrame, column: str, label: Column, grade: Column, blocked: Column | None = None) -> DataFrame:
    """One row per device: the provenance text of an attributed column."""
    blk = F.max(blocked) if blocked is not None else F.lit(False)
    a = df.groupBy(*KEYS).agg(F.count(column).alias("rows"), F.max(label).alias("label"), F.max(grade).alias("grade"), blk.alias("blocked"))
    text = F.concat(F.lit(f"{column}<-sum("), F.col("label"), F.lit(")|grade="), F.col("grade"), F.lit("|rows="),
                    F.col("rows").cast("string"))
    return a.select(*KEYS, "rows", F.when(is_true(F.col("blocked")), F.lit("attribution_blocked:run_signal_absent"))
                    .otherwise(text).alias("flow_attribution"))
