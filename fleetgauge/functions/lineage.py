"""Stage tables: cut a plan that several later steps read.

Composed lazily, every aggregate over a derived table would recompute the whole
chain below it, and the work doubles per level. A stage is therefore written
once to shared storage and read back as a columnar scan, so later aggregates
prune its columns and a lost executor costs one task, not the chain.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only for a local session."""
    conf = spark.sparkContext.getConf()
    shared = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if shared:
        return f"{shared.rstrip('/')}/{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/{spark.sparkContext.applicationId}"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside delete their shuffle files as they end: a written table is read instead of them."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def discard(table: DataFrame) -> None:
    """Delete the stage table that ``table`` scans; what was derived from it and is still read has to be written before."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if not folder.rsplit("/", 2)[1] == spark.sparkContext.applicationId:
            raise ValueError(f"no stage table: {folder}")
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame, label: str = "stage", spread: bool = False) -> DataFrame:
    """Write ``df`` once and continue from the written table.

    ``spread`` is for a table that compute-heavy passes will read: it is dealt
    out evenly over the session's shuffle partitions as it is written.
    """
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if spread:
        df = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
