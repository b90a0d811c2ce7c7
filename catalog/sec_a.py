"""Scans, sources and sinks."""

from pyspark.sql import functions as F

from catalog import bind
from catalog.bind import ATT_SQL, EVENTS_SQL, FLEET_SQL, KEYS, RAW_SQL, with_
from catalog.registry import R, query, r, rounded
from fleetgauge.functions.lineage import stage_folder
from fleetgauge.sources import raw as rw
from fleetgauge.sources import trendlog as tl


def _tmp(spark, name):
    import uuid
    return f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("a01_raw_scan", with_(RAW_SQL, body="SELECT site, device_id, row_id, stamp, power_kw, nullif(flow_lps,'') AS flow_lps FROM raw"))
def a01(spark, d):
    path = _tmp(spark, "csv")
    bind.raw(spark, d).withColumnRenamed("site", "﻿site").write.option("header", True).csv(path)
    return rw.raw_scan(spark, path, "`﻿site` string, device_id string, row_id bigint, stamp string, power_kw string, flow_lps string")


@query("a02_projected_scan", with_(FLEET_SQL, body="""SELECT site, device_id, min(ts_s) AS first_s, max(ts_s) AS last_s, count(*) AS rows
 FROM fleet GROUP BY 1,2"""))
def a02(spark, d):
    s = rw.projected_scan(bind.fleet(spark, d), "ts")
    return s.select(*KEYS, F.unix_seconds("first_ts").alias("first_s"), F.unix_seconds("last_ts").alias("last_s"), "rows")


@query("a03_canonical_sink", with_(FLEET_SQL, body=f"""SELECT site, equipment_type, device_id, count(*) AS rows, {R('sum(power_W)', 2)} AS power_sum
 FROM fleet GROUP BY 1,2,3"""))
def a03(spark, d):
    path = _tmp(spark, "canonical-sink")
    rw.canonical_sink(bind.fleet(spark, d), path)
    back = spark.read.parquet(path)
    return rounded(back.groupBy("site", "equipment_type", "device_id")
                   .agg(F.count(F.lit(1)).alias("rows"), F.sum("power_W").alias("power_sum")), _=2)


@query("a04_attributed_overlay", with_(ATT_SQL, body=f"""SELECT site, device_id, ts_s, power_W,
 CASE WHEN equipment_type='cooling_tower' THEN {R('attributed_flow_m3_h', 6)} END AS attributed_flow_m3_h FROM att"""))
def a04(spark, d):
    a = bind.attributed(spark, d).where("equipment_type = 'cooling_tower'")
    o = rw.attributed_overlay(bind.fleet(spark, d), a)
    return o.select(*KEYS, "ts_s", "power_W", r("attributed_flow_m3_h").alias("attributed_flow_m3_h"))


LIB = """lib AS (SELECT concat('L', CAST(p_partkey AS STRING)) AS lib_id, p_type AS family, 8e-1+p_size/1e2 AS c1, p_retailprice/1e4 AS c2,
 CASE WHEN p_size=7 THEN NULL ELSE 1e-3*p_size END AS c3 FROM part)"""


def library(spark, d):
    return bind.table(spark, d, "part").selectExpr("concat('L', CAST(p_partkey AS STRING)) AS lib_id", "p_type AS family", "8e-1+p_size/1e2 AS c1",
                                                   "p_retailprice/1e4 AS c2", "CASE WHEN p_size=7 THEN NULL ELSE 1e-3*p_size END AS c3")


@query("a05_curve_library_scan", with_(LIB, body=f"SELECT lib_id, family, {R('c1')} AS c1, {R('c2')} AS c2, {R('c3')} AS c3 FROM lib WHERE c3 IS NOT NULL"))
def a05(spark, d):
    path = _tmp(spark, "library")
    rw.report_sink(library(spark, d), path)
    return rounded(rw.raw_scan(spark, path, fmt="parquet").where("c3 IS NOT NULL"))


@query("a06_params_payload", with_(LIB, body=f"SELECT lib_id, {R('c1')} AS c1, {R('c2')} AS c2, {R('c3')} AS c3 FROM lib"))
def a06(spark, d):
    m = F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in ("c3", "c2", "c1")]))
    j = rw.params_to_json(library(spark, d).select("lib_id", m.alias("params"))).select("lib_id", "parameters")
    back = rw.params_from_json(j)
    return rounded(back.select("lib_id", *[F.try_element_at("params", F.lit(c)).alias(c) for c in ("c1", "c2", "c3")]))


DOC_SQL = EVENTS_SQL + """,
smp AS (SELECT concat_ws('|', site, device_id, channel, CAST(us//86400000000 AS STRING)) AS doc_id, us//10000*10000 AS us, value, event_id,
  CASE WHEN event_id%11=0 THEN 'fault;error-entry' ELSE 'ok' END AS flags,
  row_number() OVER (PARTITION BY site, device_id, channel, us//86400000000 ORDER BY us, event_id) AS rank,
  count(*) OVER (PARTITION BY site, device_id, channel, us//86400000000) AS n FROM ev)"""


@query("a07_trend_log_decode", with_(DOC_SQL, body=f"SELECT doc_id, rank, us, {R('value')} AS value, flags, 9e2 AS interval_s, n AS record_count FROM smp"))
def a07(spark, d):
    s = tl.decode(bind.trend_docs(spark, d), "doc_id")
    return rounded(s.select("doc_id", F.col("rank").cast("bigint").alias("rank"), F.unix_micros("ts").alias("us"), F.col("value").cast("double").alias("value"),
                            "flags", "interval_s", "record_count"))


@query("a08_trend_value_parse", with_(EVENTS_SQL, body=f"""SELECT event_id, {R('''CASE WHEN channel='view' THEN CASE event_id%4 WHEN 0 THEN 1e0 WHEN 1 THEN 0e0 WHEN 2 THEN value*2 END
   WHEN event_id%4=2 THEN value*2 END''')} AS value FROM ev WHERE event_id%11<>0"""))
def a08(spark, d):
    e = bind.events(spark, d)
    word = (F.when(F.col("event_id") % 4 == 0, " Active ").when(F.col("event_id") % 4 == 1, "OFF")
            .when(F.col("event_id") % 4 == 2, F.col("value").cast("string")).otherwise("n.a."))
    s = e.select("event_id", word.alias("value"), F.when(F.col("event_id") % 11 == 0, "fault;error-entry").otherwise("ok").alias("flags"),
                 (F.col("channel") == "view").alias("status"))
    run = F.col("status")
    p = tl.parse_samples(s, run, F.when(run & (F.col("event_id") % 4 != 2), 1.0).otherwise(2.0))
    return rounded(p.select("event_id", "value"))


@query("a09_trend_point_manifest", with_(DOC_SQL, body="""SELECT doc_id, n AS record_count, 3*n AS total_record_count, count_if(flags='ok')::BIGINT AS valid_record_count,
 n-count_if(flags='ok')::BIGINT AS error_entry_count, min(us) AS first_us, max(us) AS last_us, 64::BIGINT AS hash_length FROM smp GROUP BY doc_id, n"""))
def a09(spark, d):
    docs = bind.trend_docs(spark, d)
    m = tl.point_manifest(tl.decode(docs, "doc_id"), docs, "doc_id")
    return rounded(m.select("doc_id", "record_count", "total_record_count", "valid_record_count", "error_entry_count",
                            F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), F.length("sha256").alias("hash_length")))


@query("a09_payload_hash")
def a09_hash(spark, d):
    """The hash itself; a fixed SQL text cannot rebuild the documents byte by byte."""
    docs = bind.trend_docs(spark, d)
    return tl.point_manifest(tl.decode(docs, "doc_id"), docs, "doc_id").select("doc_id", "object_name", "record_count", "sha256")


@query("a10_report_sinks", with_(FLEET_SQL, body="""SELECT site, equipment_type, count(DISTINCT device_id) AS devices FROM fleet GROUP BY 1,2"""))
def a10(spark, d):
    path = _tmp(spark, "report")
    r = bind.fleet(spark, d).select("site", "equipment_type", "device_id").distinct().groupBy("site", "equipment_type").agg(F.count(F.lit(1)).alias("devices"))
    rw.report_sink(r, path + "/full")
    rw.report_sink(r.where("devices < 0"), path + "/empty")
    return spark.read.parquet(path + "/full").unionByName(spark.read.parquet(path + "/empty"))
