"""The row-wise part of ingest on a streaming frame.

Mapping, numeric coercion and time parsing keep no state, so the batch
expressions run unchanged on ``readStream``. Nothing here needs a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from fleetgauge.sources import raw


def canonical_stream(source: DataFrame, adapter: dict, stamp: str, keep=("site", "device_id")) -> DataFrame:
    return raw.utc_normalise(raw.canonicalise(source, adapter, keep=(*keep, stamp)), stamp).where("ts IS NOT NULL")


def start_sink(stream: DataFrame, path: str, checkpoint: str, partition_by=("site",)):
    """Append canonical rows to parquet; the checkpoint makes each file exactly once."""
    return (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy(*partition_by)
            .outputMode("append").trigger(availableNow=True).start())
