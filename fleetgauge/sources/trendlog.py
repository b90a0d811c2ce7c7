"""Ring-buffer trend logs published as XML, one document per point."""

from __future__ import annotations

from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetgauge.functions.cols import col, dbl, is_true, num

TIMER_WRAP = 2 ** 32

# --- fixed values: words a run-signal point may publish --------------------------------------
TRUE_WORDS = ["1", "active", "on", "running", "true", "yes"]
FALSE_WORDS = ["0", "inactive", "off", "stopped", "false", "no"]
ERROR_FLAG = "error-entry"


def scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path).select(F.col("value").alias("xml"))


_SCALARS = ["object-type", "object-name", "time-reference", "log-interval", "record-count", "total-record-count", "buffer-size", "next-index", "time-reference-count"]
_BUFFERS = {"timers": "timestamp-buffer", "flags": "flags-buffer", "data": "data-buffer"}
_PARSED = ", ".join([f"`{n}` string" for n in _SCALARS] + [f"{b}_{k} array<string>" for b in _BUFFERS for k in ("names", "values")])


def _parser():
    """Text of the scalar properties and of the buffers' names and values; every document is parsed once. NULL where it is NULL or empty."""
    scalars, buffers = list(_SCALARS), dict(_BUFFERS)

    def elements(x: str) -> list:
        """(depth, names, values) of every element below the root; like XPath here, attributes go by what follows their prefix."""
        out, depth, p = [], [0], expat.ParserCreate()
        prefixed = ":name" in x or ":value" in x

        def of(a: dict, k: str):
            return [v for c, v in a.items() if c.rpartition(":")[2] == k and not c.startswith("xmlns")] if prefixed else [a[k]] if k in a else ()

        def start(_, a):
            depth[0] += 1
            out.append((depth[0], of(a, "name"), of(a, "value")))

        def end(_):
            depth[0] -= 1
        p.StartElementHandler, p.EndElementHandler = start, end
        p.Parse(x, True)
        return out[1:]

    def run(xml: pa.Array) -> pa.Array:
        texts = xml.to_pylist()
        single: dict = {n: [] for n in scalars}
        flat: dict = {(b, k): [] for b in buffers for k in (1, 2)}
        ends: dict = {c: [0] for c in flat}
        for x in texts:
            first, within, children = {}, (), 0
            for e in elements(x) if x else ():
                if e[0] == 2:
                    within, children = [b for b, n in buffers.items() if n in e[1]], 0
                    for n in e[1] if e[2] else ():
                        first.setdefault(n, e[2][0])
                    continue
                children += e[0] == 3
                for b in within:
                    if e[0] == (4 if b == "data" else 3) and (b != "data" or children == 1):
                        flat[b, 1] += e[1]
                        flat[b, 2] += e[2]
            for n, out in single.items():
                out.append(first.get(n, ""))
            for c, v in flat.items():
                ends[c].append(len(v))
        columns = [pa.array(v, pa.string()) for v in single.values()] + [pa.ListArray.from_arrays(pa.array(ends[c], pa.int32()), pa.array(v, pa.string())) for c, v in flat.items()]
        names = [*scalars, *(f"{b}_{k}" for b in buffers for k in ("names", "values"))]
        return pa.StructArray.from_arrays(columns, names, mask=pa.array([not x for x in texts], pa.bool_()))
    return run


def _pairs(buffer: str) -> Column:
    """Child (index, value) pairs of a buffer."""
    return F.map_from_arrays(F.transform(F.col(f"_doc.{buffer}_names"), lambda x: x.cast("int")), F.col(f"_doc.{buffer}_values"))


def headers(docs: DataFrame) -> DataFrame:
    """Scalar properties and the three buffers of every document."""
    def attr(name: str) -> Column:
        return F.col(f"_doc.`{name}`")
    # a deterministic function would be run once more for each filter on what it returns
    d = docs.withColumn("_doc", F.arrow_udf(_parser(), _PARSED).asNondeterministic()("xml"))
    return d.select(
        *docs.columns, attr("object-type").alias("object_type"), attr("object-name").alias("object_name"), attr("time-reference").try_cast("timestamp").alias("time_reference"),
        (attr("log-interval").try_cast("long") / dbl(100.0)).alias("interval_s"),
        attr("record-count").try_cast("int").alias("record_count"),
        attr("total-record-count").try_cast("long").alias("total_record_count"),
        attr("buffer-size").try_cast("int").alias("buffer_size"), attr("next-index").try_cast("int").alias("next_index"),
        F.coalesce(attr("time-reference-count").try_cast("long"), F.lit(0)).alias("reference_count"),
        *[_pairs(b).alias(b) for b in _BUFFERS])


def decode(docs: DataFrame, doc_id: str) -> DataFrame:
    """Samples in ring order with wrapped timers resolved.

    A full buffer starts at ``next-index``; otherwise the first
    ``record-count`` entries count. A timer that drops has wrapped at 2**32.
    The window runs inside one document, whose length the buffer size bounds.
    """
    h = headers(docs)
    both = F.array_intersect(F.map_keys("timers"), F.map_keys("data"))
    full = is_true((F.col("record_count") >= F.col("buffer_size")) & F.array_contains("available", F.col("next_index")))
    h = h.withColumn("available", F.array_sort(both)).withColumn("full", full)
    e = h.select(doc_id, "object_name", "interval_s", "record_count", "total_record_count", "time_reference", "reference_count", "full",
                 "buffer_size", "next_index", "timers", "flags", "data", F.explode("available").alias("idx"))
    e = e.select(doc_id, "object_name", "interval_s", "record_count", "total_record_count", "time_reference", "reference_count", "full",
                 F.when(F.col("full"), F.pmod(F.col("idx") - F.col("next_index"), F.col("buffer_size"))).otherwise(F.col("idx")).alias("seq"),
                 F.element_at("timers", F.col("idx")).cast("long").alias("timer"), F.element_at("data", F.col("idx")).alias("value"),
                 F.coalesce(F.try_element_at("flags", F.col("idx")), F.lit("")).alias("flags"))
    w = Window.partitionBy(doc_id).orderBy("seq")
    e = e.withColumn("rank", F.row_number().over(w)).where(F.col("full") | (F.col("rank") <= F.col("record_count")))
    drop = F.when(F.col("timer") < F.lag("timer").over(w), 1).otherwise(0)
    e = e.withColumn("_d", drop)
    ticks = F.col("timer") + (F.col("reference_count") + F.sum("_d").over(w)) * F.lit(TIMER_WRAP)
    ts = F.timestamp_micros(F.unix_micros("time_reference") + ticks * F.lit(10000))
    return e.select(doc_id, "object_name", "interval_s", "record_count", "total_record_count", "rank", ts.alias("ts"), "value", "flags")


def decode_errors(docs: DataFrame, samples: DataFrame, doc_id: str) -> DataFrame:
    """Documents that break a contract: wrong type, lost records, time not strictly increasing."""
    w = Window.partitionBy(doc_id).orderBy("rank")
    s = samples.withColumn("_back", F.when(F.lag("ts").over(w) >= F.col("ts"), 1).otherwise(0))
    got = s.groupBy(doc_id).agg(F.count(F.lit(1)).alias("parsed"), F.max("_back").alias("back"))
    h = headers(docs).select(doc_id, "object_type", "record_count",
                             F.size(F.array_intersect(F.map_keys("timers"), F.map_keys("data"))).alias("available"))
    j = h.join(got, doc_id, "left")
    parsed = F.coalesce("parsed", F.lit(0))
    err = (F.when(F.col("object_type") != "trend-log", "not a trend-log object")
           .when(parsed != F.least("record_count", "available"), "record count mismatch")
           .when(F.col("back") == 1, "timestamps not strictly increasing"))
    return j.select(doc_id, err.alias("error")).where("error IS NOT NULL")


def parse_value(text, is_run_signal: Column | bool) -> Column:
    """Run-signal words to 1/0, anything else to a number or NULL."""
    t = F.lower(F.trim(col(text)))
    flag = is_run_signal if isinstance(is_run_signal, Column) else F.lit(is_run_signal)
    return F.when(flag & t.isin(*TRUE_WORDS), dbl(1.0)).when(flag & t.isin(*FALSE_WORDS), dbl(0.0)).otherwise(num(t))


def is_error(flags) -> Column:
    return F.array_contains(F.split(col(flags), ";"), ERROR_FLAG)


def parse_samples(samples: DataFrame, run_signal: Column | bool = False, scale=1.0) -> DataFrame:
    """Drop error entries, parse and scale the rest."""
    s = scale if isinstance(scale, Column) else dbl(scale)
    return samples.where(~is_error("flags")).withColumn("value", parse_value("value", run_signal) * s)


def point_manifest(samples: DataFrame, docs: DataFrame, doc_id: str) -> DataFrame:
    """Counts, span and payload hash per point."""
    a = samples.groupBy(doc_id, "object_name").agg(
        F.max("record_count").alias("record_count"), F.max("total_record_count").alias("total_record_count"),
        F.count_if(~is_error("flags")).alias("valid_record_count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    a = a.withColumn("error_entry_count", F.col("record_count") - F.col("valid_record_count"))
    return a.join(docs.select(doc_id, F.sha2("xml", 256).alias("sha256")), doc_id)


def periodic_align(samples: DataFrame, channels, keys=("site", "device_id")) -> DataFrame:
    """Periodic channels on their common dense grid, one column per channel.

    ``samples`` is ``(site, device_id, channel, ts, value, interval_s)``. The
    step is the median channel interval of the device (a handful of values);
    the last sample of a bucket wins and the grid spans only the time that
    every channel covers.
    """
    k = list(keys)
    p = samples.where((F.col("interval_s") > 0) & F.col("channel").isin(*channels))
    per_channel = p.groupBy(*k, "channel").agg(F.max("interval_s").alias("i"))
    step = per_channel.groupBy(*k).agg((F.bround(F.percentile("i", F.lit(0.5)), 0) * 1e6).cast("long").alias("step_us"))
    b = p.join(step, k).withColumn("bucket", F.bround(F.unix_micros("ts") / F.col("step_us"), 0).cast("long"))
    last = b.groupBy(*k, "channel", "step_us", "bucket").agg(F.max_by("value", F.col("ts")).alias("value"))
    span = last.groupBy(*k, "channel", "step_us").agg(F.min("bucket").alias("a"), F.max("bucket").alias("z"))
    common = span.groupBy(*k, "step_us").agg(F.max("a").alias("a"), F.min("z").alias("z"), F.count(F.lit(1)).alias("c"))
    grid = common.where("a <= z").select(*k, "step_us", F.explode(F.sequence("a", "z")).alias("bucket"))
    wide = last.groupBy(*k, "bucket").agg(*[F.max(F.when(F.col("channel") == c, F.col("value"))).alias(c) for c in channels])
    return (grid.join(wide, [*k, "bucket"], "left")
            .select(*k, F.timestamp_micros(F.col("bucket") * F.col("step_us")).alias("ts"), *channels))


def asof_backward(grid: DataFrame, events: DataFrame, channel: str, keys=("site", "device_id"), chunk_seconds: int = 86400) -> DataFrame:
    """Adds the last event value at or before each grid time, an exact match included.

    Events and grid are stacked and the last value is carried forward by a
    two-level scan, so neither a long gap nor a dominant device is a problem.
    """
    from fleetgauge.operators import ordered
    k = list(keys)
    ev = events.groupBy(*k, "ts").agg(F.max_by("value", "seq").alias("_v"))
    other = [c for c in grid.columns if c not in (*k, "ts")]
    g = grid.select(*k, "ts", F.struct(*[F.col(c) for c in other], F.lit(1).alias("_g")).alias("_row"), F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_is_grid"))
    e = ev.select(*k, "ts", F.lit(None).cast(g.schema["_row"].dataType).alias("_row"), F.col("_v").cast("double"), F.lit(0).alias("_is_grid"))
    d = ordered.carry_last(g.unionByName(e), k, ["ts", "_is_grid"], ordered.day_chunk("ts", chunk_seconds), "_v", channel)
    return d.where("_is_grid = 1").select(*k, "ts", *[F.col(f"_row.{c}").alias(c) for c in other], channel)
