"""Raw historian tables: scan, map to canonical roles, normalise time, write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge import KEYS
from fleetgauge.functions.cols import col, dbl, num
from fleetgauge.operators import ordered

POLICIES = ("reject", "sort", "sort_deduplicate")


def strip_bom(df: DataFrame) -> DataFrame:
    """Historian exports often carry a byte-order mark on the first header."""
    return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns if c.startswith("﻿")})


def raw_scan(spark: SparkSession, path: str, schema: str | None = None, fmt: str = "csv") -> DataFrame:
    """Headered text or parquet. With a declared schema no inference pass is made."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    reader = spark.read.option("header", True).option("enforceSchema", False if schema is None else True)
    return strip_bom(reader.schema(schema).csv(path) if schema else reader.csv(path))


def projected_scan(df: DataFrame, ts: str, keys=KEYS) -> DataFrame:
    """Record start and row count from the time column alone; the scan reads nothing else."""
    return df.select(*keys, ts).groupBy(*keys).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(ts).alias("rows"))


def canonicalise(raw: DataFrame, adapter: dict[str, dict], keep=()) -> DataFrame:
    """``role = number(source) * scale + offset`` for every mapped role."""
    missing = [s["source"] for s in adapter.values() if s["source"] not in raw.columns]
    if missing:
        raise ValueError(f"missing source column: {', '.join(missing)}")
    roles = [(num(s["source"]) * dbl(s.get("scale", 1.0)) + dbl(s.get("offset", 0.0))).alias(role) for role, s in adapter.items()]
    return raw.select(*keep, *roles)


def canonicalise_long(cells: DataFrame, adapter: DataFrame) -> DataFrame:
    """The same for a fleet with mixed headers.

    ``cells`` is ``(site, device_id, source, row_id, text)``; ``adapter`` is
    ``(site, device_id, role, source, scale, offset)``, joined on its key so
    that Spark picks the strategy from the real sizes.
    """
    j = cells.join(adapter, ["site", "device_id", "source"])
    return j.select("site", "device_id", "row_id", "role", (num("text") * F.col("scale") + F.col("offset")).alias("value"))


def numeric_coerce(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({c: num(c) for c in columns})


def to_utc(text: Column | str) -> Column:
    """Text with or without an offset to an instant; unreadable text becomes NULL."""
    return col(text).try_cast("timestamp")


def iso_z(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def utc_normalise(df: DataFrame, text: str, name: str = "ts") -> DataFrame:
    return df.withColumn(name, to_utc(text))


def timestamp_report(df: DataFrame, row_id: str = "row_id", ts: str = "ts") -> DataFrame:
    """Per device: rows, invalid and duplicate stamps, and steps that run backwards in input order."""
    d = ordered.previous(df, list(KEYS), row_id, ordered.id_chunk(row_id), {"_before": F.col(ts)})
    back = d.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(ts).isNull()).alias("invalid"),
                                F.count_if(F.col("_before") > F.col(ts)).alias("backward_steps"))
    per_ts = df.where(F.col(ts).isNotNull()).groupBy(*KEYS, ts).agg(F.count(F.lit(1)).alias("c"))
    dup = per_ts.groupBy(*KEYS).agg(F.sum(F.col("c") - 1).alias("duplicates"))
    return back.join(dup, list(KEYS), "left").withColumn("duplicates", F.coalesce("duplicates", F.lit(0)))


def policy_errors(report: DataFrame, policy: str) -> DataFrame:
    """Devices the policy refuses, with the reason; checks in a fixed order."""
    if policy not in POLICIES:
        raise ValueError(f"timestamp_policy must be one of: {', '.join(POLICIES)}")
    dup_bad = F.lit(policy != "sort_deduplicate") & (F.col("duplicates") > 0)
    sort_bad = F.lit(policy == "reject") & (F.col("backward_steps") > 0)
    err = (F.when(F.col("invalid") > 0, F.concat(F.lit("invalid timestamp values: "), F.col("invalid").cast("string")))
           .when(dup_bad, F.concat(F.lit("duplicate timestamp values: "), F.col("duplicates").cast("string")))
           .when(sort_bad, F.lit("timestamps are not sorted chronologically")))
    return report.select(*KEYS, err.alias("error")).where("error IS NOT NULL")


def keep_first(df: DataFrame, row_id: str = "row_id", ts: str = "ts") -> DataFrame:
    """First input row per (device, ts). Pre-aggregates, so a huge set of copies is harmless."""
    rest = [c for c in df.columns if c not in (*KEYS, ts)]
    g = df.groupBy(*KEYS, ts).agg(F.min_by(F.struct(*rest), F.col(row_id)).alias("_f"))
    return g.select(*KEYS, ts, *[F.col(f"_f.{c}").alias(c) for c in rest])


def apply_policy(df: DataFrame, policy: str, strict: bool = True) -> DataFrame:
    """Order is a property of the sink, so "sort" needs no sort here; dedup keeps the first row."""
    if strict:
        from fleetgauge.operators.attribution import require_empty
        require_empty(policy_errors(timestamp_report(df), policy))
    return keep_first(df) if policy == "sort_deduplicate" else df


def canonical_sink(df: DataFrame, path: str, partition_by=("site", "equipment_type"), mode: str = "overwrite") -> None:
    """Canonical table, partitioned by low-cardinality keys and ordered for time pruning.

    Range partitioning on (partition keys, device, ts) splits a dominant device
    over several files instead of one.
    """
    (df.repartitionByRange(*partition_by, "device_id", "ts").sortWithinPartitions(*partition_by, "device_id", "ts")
     .write.mode(mode).partitionBy(*partition_by).parquet(path))


def attributed_overlay(canonical: DataFrame, attributed: DataFrame) -> DataFrame:
    """Attributed rows of a device where they exist, canonical rows of the others."""
    done = attributed.select(*KEYS).distinct()
    rest = canonical.join(done, list(KEYS), "left_anti")
    return attributed.unionByName(rest, allowMissingColumns=True)


def report_sink(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Result table; the schema is written even when it has no rows."""
    df.write.mode(mode).parquet(path)


def params_to_json(df: DataFrame, params: str = "params", name: str = "parameters") -> DataFrame:
    """MAP to JSON text with sorted keys, so equal parameters give equal text."""
    entries = F.array_sort(F.map_entries(params))
    return df.withColumn(name, F.to_json(F.map_from_entries(entries)))


def params_from_json(df: DataFrame, text: str = "parameters", name: str = "params") -> DataFrame:
    return df.withColumn(name, F.from_json(F.col(text), "map<string,double>"))


