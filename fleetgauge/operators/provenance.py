"""Fingerprints and append-only run tables."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

# --- fixed values: schemas of the append-only run tables -------------------------------------------------
RUN_SCHEMAS = {
    "run_identity": "run_id string, dataset string, config_sha256 string, revision string, created_at timestamp",
    "run_stage": "run_id string, stage string, status string, at timestamp",
    "run_artifact": "run_id string, path string, sha256 string, at timestamp",
    "run_warning": "run_id string, message string, at timestamp",
}


def source_fingerprint(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """sha256 of every source file; files are read by the tasks, one at a time."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return f.select("path", "length", F.sha2("content", 256).alias("sha256"))


def _running_hash(schema: pa.Schema):
    """One sha256 per run of equal leading columns; the last column holds sorted lines. Memory is one batch."""
    def run(batches):
        now, h = None, None
        for batch in batches:
            done = []
            for *key, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if h is None or key != now:
                    if h is not None:
                        done.append((*now, h.hexdigest()))
                    now, h = key, hashlib.sha256(line.encode("utf-8"))
                else:
                    h.update(b"\n" + line.encode("utf-8"))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*now, h.hexdigest()), schema.types, strict=True)], schema=schema)
    return run


def config_fingerprint(config: DataFrame, by=("run_id",)) -> DataFrame:
    """sha256 over the sorted public ``key=value`` lines; keys that start with ``_`` are private.

    Lines are sorted within their partition and folded into a running hash, so a
    run may have any number of lines. Lines with a null key are left out.
    """
    by = list(by)
    line = F.concat("key", F.lit("="), F.coalesce("value", F.lit("")))
    lines = config.where(~F.startswith("key", F.lit("_"))).select(*by, line.alias("config_sha256"))
    ordered = lines.repartition(*by).sortWithinPartitions(*by, "config_sha256")
    return ordered.mapInArrow(_running_hash(to_arrow_schema(lines.schema)), lines.schema)


def bind_conflicts(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Runs that would rebind an id to another configuration or code revision."""
    e = existing.select("run_id", F.col("config_sha256").alias("_c"), F.col("revision").alias("_r"))
    j = new.join(e, "run_id")
    other = (F.col("_c") != F.col("config_sha256"))
    rev = (F.coalesce("_r", F.lit("")) != "") & (F.coalesce("revision", F.lit("")) != "") & (F.col("_r") != F.col("revision"))
    msg = F.when(other, "run-id is already bound to a different project config").when(rev, "run-id is already bound to a different code revision")
    return j.select("run_id", msg.alias("error")).where("error IS NOT NULL")


def latest(df: DataFrame, keys, at: str = "at") -> DataFrame:
    """Last record per key wins; pre-aggregates instead of ranking a whole run."""
    rest = [c for c in df.columns if c not in keys and c != at]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, *rest)).alias("_r"), F.max(at).alias(at))
    return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest], at)


def distinct_warnings(df: DataFrame) -> DataFrame:
    return df.groupBy("run_id", "message").agg(F.min("at").alias("first_at"))


def mapping_provenance(adapter: DataFrame) -> DataFrame:
    """Where every canonical role of a device came from."""
    return adapter.select("site", "device_id", "role", "source", F.coalesce("scale", F.lit(1.0)).alias("scale"), F.coalesce("offset", F.lit(0.0)).alias("offset"), F.coalesce("unit", F.lit("")).alias("unit"))


def append(df: DataFrame, name: str, folder: str) -> None:
    """Append rows to one of the run tables in its fixed schema."""
    cols = [c.strip().split(" ") for c in RUN_SCHEMAS[name].split(",")]
    df.select(*[F.col(n).cast(t) for n, t in cols]).write.mode("append").parquet(f"{folder}/{name}")
