"""Joins (first half) and reconstruction."""

from pyspark.sql import functions as F

from catalog import bind
from catalog.bind import ATT_SQL, EVENTS_SQL, FLEET_SQL, KEYS, with_
from catalog.registry import R, query, rounded
from fleetgauge.functions.cols import dbl
from fleetgauge.operators import attribution as at
from fleetgauge.operators import reconstruct as rc
from fleetgauge.sources import trendlog as tl

WX_SQL = FLEET_SQL + ",\nwx AS (SELECT site, ts_s, max(tchws_C)+1e1 AS wb FROM fleet WHERE equipment_type='chiller' GROUP BY 1,2)"


def weather(spark, d):
    f = bind.fleet(spark, d).where("equipment_type = 'chiller'")
    return f.groupBy("site", "ts").agg((F.max("tchws_C") + dbl(10.0)).alias("wb"))


@query("e01_boundary_join", with_(WX_SQL, body=f"SELECT site, device_id, ts_s, {R('wb')} AS oat_wb_C FROM fleet LEFT JOIN wx USING (site, ts_s) WHERE equipment_type='cooling_tower'"))
def e01(spark, d):
    t = bind.fleet(spark, d).where("equipment_type = 'cooling_tower'")
    return rounded(at.boundary_join(t, weather(spark, d), "wb", "oat_wb_C", strict=True).select(*KEYS, "ts_s", "oat_wb_C"))


@query("e01_key_errors", """WITH e AS (SELECT concat('site_', CAST(user_id%3 AS STRING)) AS site, CASE WHEN event_id%97=0 THEN NULL ELSE epoch_us(ts)//3600000000 END AS h FROM events)
SELECT 'events' AS side, 'invalid timestamp values' AS error, count(*) AS rows FROM e WHERE h IS NULL UNION ALL
SELECT 'events', 'duplicate timestamp values', count(h)-count(DISTINCT (site,h)) FROM e WHERE h IS NOT NULL""")
def e01_errors(spark, d):
    e = bind.events(spark, d).select("site", F.when(F.col("event_id") % 97 != 0, F.floor(F.col("us") / F.lit(3600000000))).alias("h"))
    return at.key_errors(e, ["site", "h"], "events")


@query("e02_total_source_flow", with_(ATT_SQL, body=f"SELECT site, blk, ts_s, {R('cw_tot')} AS total_flow FROM src JOIN (SELECT DISTINCT site, blk FROM fleet) USING (blk)"))
def e02(spark, d):
    f = bind.fleet(spark, d).where("equipment_type = 'chiller'")
    return rounded(at.total_source_flow(f, ["site", "blk"], "cw_flow_m3_h").select("site", "blk", F.unix_seconds("ts").alias("ts_s"), "total_flow"))


@query("e03_paired_attribution", with_(ATT_SQL, body=f"SELECT site, device_id, ts_s, {R('attributed_flow_m3_h')} AS flow FROM att WHERE equipment_type='cooling_tower'"))
def e03(spark, d):
    a = at.attribute_named(bind.fleet(spark, d), bind.paired_spec(spark, d), "cw_flow_m3_h", "flow")
    return rounded(a.where("equipment_type = 'cooling_tower'").select(*KEYS, "ts_s", "flow"))


E03_TEXT = """SELECT site, device_id, count(attributed_flow_m3_h) AS rows, CASE WHEN equipment_type='pump' AND NOT bool_or(run_usable2) THEN 'attribution_blocked:run_signal_absent' ELSE
 concat('attributed_flow_m3_h<-sum(', CASE equipment_type WHEN 'pump' THEN 'all chiller.chw_flow_m3_h' ELSE 'paired.cw_flow_m3_h' END, ')|grade=', CASE equipment_type WHEN 'pump' THEN 'solo_window' ELSE 'paired_devices' END,
 '|rows=', CAST(count(attributed_flow_m3_h) AS STRING)) END AS flow_attribution
 FROM (SELECT *, run_signal IS NOT NULL AS run_usable2 FROM att) WHERE equipment_type IN ('pump','cooling_tower') GROUP BY site, device_id, equipment_type"""


@query("e03_attribution_flags", with_(ATT_SQL, body=E03_TEXT))
def e03_flags(spark, d):
    a = bind.attributed(spark, d).where("equipment_type IN ('pump', 'cooling_tower')")
    pump = F.col("equipment_type") == "pump"
    usable = a.groupBy(*KEYS).agg(F.max(F.col("run_signal").isNotNull()).alias("run_usable"))
    return at.attribution_flags(a.join(usable, KEYS), "attributed_flow_m3_h", F.when(pump, "all chiller.chw_flow_m3_h").otherwise("paired.cw_flow_m3_h"),
                                F.when(pump, "solo_window").otherwise("paired_devices"), pump & ~F.col("run_usable"))


@query("e04_solo_attribution", with_(ATT_SQL, body=f"SELECT site, device_id, ts_s, {R('attributed_flow_m3_h')} AS flow FROM att WHERE equipment_type='pump'"))
def e04(spark, d):
    a = at.attribute_solo(bind.fleet(spark, d), F.col("equipment_type") == "pump", "chiller", "chw_flow_m3_h", "flow", scope=("site", "blk"))
    return rounded(a.where("equipment_type = 'pump'").select(*KEYS, "ts_s", "flow"))


@query("e05_attribution_block", with_(ATT_SQL, body="""SELECT site, device_id, count(attributed_flow_m3_h) AS attributed_rows, CASE WHEN count(run_signal)=0 THEN 'attribution_blocked:run_signal_absent' END AS flag
 FROM att WHERE equipment_type='pump' GROUP BY 1,2"""))
def e05(spark, d):
    a = bind.attributed(spark, d).where("equipment_type = 'pump'")
    return a.groupBy(*KEYS).agg(F.count("attributed_flow_m3_h").alias("attributed_rows"),
                                F.when(F.count("run_signal") == 0, "attribution_blocked:run_signal_absent").alias("flag"))


@query("e06_attribution_reference_check", """WITH d AS (SELECT s_suppkey AS k, substr('ABCD', CAST(CAST(floor(s_suppkey/12) AS BIGINT)%4 AS INT)+1, 1) AS site FROM supplier)
SELECT a.site, concat('CT_', CAST(a.k AS STRING)) AS device_id, concat('CH_', CAST(a.k+11 AS STRING)) AS source_device FROM d a WHERE a.k%4=1 AND NOT EXISTS
 (SELECT 1 FROM d b WHERE b.k=a.k+11 AND b.k%4=0 AND b.site=a.site)""")
def e06(spark, d):
    g = bind.registry(spark, d)
    spec = g.where("equipment_type = 'cooling_tower'").select(
        "site", "device_id", F.array(F.concat(F.lit("CH_"), (F.col("k") - 1).cast("string")), F.concat(F.lit("CH_"), (F.col("k") + 11).cast("string"))).alias("source_devices"))
    return at.reference_errors(spec, g)


TREND_SQL = EVENTS_SQL + """,
bk AS (SELECT site, device_id, channel, us, event_id, value, round_even(us/216e8,0)::BIGINT AS bucket FROM ev WHERE channel IN ('click','view')),
lst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_id, channel, bucket ORDER BY us DESC) AS o FROM bk) WHERE o=1),
cm AS (SELECT site, device_id, max(a) AS a, min(z) AS z FROM (SELECT site, device_id, channel, min(bucket) AS a, max(bucket) AS z FROM lst GROUP BY 1,2,3) GROUP BY 1,2),
gr AS (SELECT site, device_id, unnest(range(a, z+1)) AS bucket FROM cm WHERE a<=z),
al AS (SELECT gr.site, gr.device_id, gr.bucket*21600 AS ts_s, max(CASE WHEN channel='click' THEN value END) AS click, max(CASE WHEN channel='view' THEN value END) AS "view"
  FROM gr LEFT JOIN lst USING (device_id, bucket) GROUP BY 1,2,3)"""


def aligned(spark, d):
    s = bind.events(spark, d).withColumn("interval_s", F.when(F.col("channel").isin("click", "view"), dbl(21600.0)).otherwise(dbl(0.0)))
    return tl.periodic_align(s, ["click", "view"])


@query("e07_periodic_align", with_(TREND_SQL, body=f'SELECT site, device_id, ts_s::BIGINT AS ts_s, {R("click")} AS click, {R(chr(34) + "view" + chr(34))} AS "view" FROM al'))
def e07(spark, d):
    return rounded(aligned(spark, d).select(*KEYS, F.unix_seconds("ts").alias("ts_s"), "click", "view"))


@query("e08_asof_backward", with_(TREND_SQL, body=f"""SELECT site, device_id, ts_s::BIGINT AS ts_s, {R('click')} AS click, {R('(SELECT arg_max(e.value, (e.us, e.event_id)) FROM ev e WHERE e.device_id=al.device_id AND e.channel=$$error$$ AND e.us<=al.ts_s*1000000)')} AS error FROM al""".replace("$$error$$", "'error'")))
def e08(spark, d):
    ev = bind.events(spark, d).where("channel = 'error'").withColumnRenamed("event_id", "seq")
    return rounded(tl.asof_backward(aligned(spark, d).select(*KEYS, "ts", "click"), ev, "error").select(*KEYS, F.unix_seconds("ts").alias("ts_s"), "click", "error"))


# ---- reconstruction -------------------------------------------------------------------------------
@query("f01_energy_balance_load", with_(FLEET_SQL, body="SELECT site, device_id, ts_s, CASE WHEN tchwr_C-tchws_C>0 AND chw_flow_m3_h>0 THEN 4186e3*(chw_flow_m3_h/36e2)*(tchwr_C-tchws_C) END AS q_W FROM fleet"))
def f01(spark, d):
    return bind.fleet(spark, d).select(*KEYS, "ts_s", rc.energy_balance_load("chw_flow_m3_h", "tchwr_C", "tchws_C").alias("q_W"))


@query("f02_power_from_cop", with_(ATT_SQL, body=f"SELECT site, device_id, ts_s, {R('cooling_load_W/5', 5)} AS power_W_recon FROM att WHERE equipment_type='chiller'"))
def f02(spark, d):
    a = bind.attributed(spark, d).where("equipment_type = 'chiller'").drop("power_W_recon")
    return rounded(rc.reconstruct(a, [{"output": "power_W", "method": "cop_estimate", "from": "cooling_load_W", "cop": 5.0}]).select(*KEYS, "ts_s", "power_W_recon"), _=5)


@query("f03_power_first_law", with_(ATT_SQL, body=f"SELECT site, device_id, ts_s, {R('power_W_recon', 5)} AS p FROM att WHERE equipment_type='chiller'"))
def f03(spark, d):
    a = bind.attributed(spark, d).where("equipment_type = 'chiller'")
    return rounded(a.select(*KEYS, "ts_s", rc.power_first_law("Q_cond_W", "cooling_load_W").alias("p")), _=5)


@query("f04_implied_cop_verify", with_(ATT_SQL, body=f"""SELECT site, device_id, count(CASE WHEN power_W_recon>0 THEN 1 END) AS n, {R('median(CASE WHEN power_W_recon>0 THEN cooling_load_W/power_W_recon END)')} AS cop_median,
 CASE WHEN coalesce(median(CASE WHEN power_W_recon>0 THEN cooling_load_W/power_W_recon END) BETWEEN 2 AND 10, false) THEN 'pass' ELSE 'FAIL' END AS verdict FROM att WHERE equipment_type='chiller' GROUP BY 1,2"""))
def f04(spark, d):
    return rounded(rc.implied_cop(bind.attributed(spark, d).where("equipment_type = 'chiller'"), "cooling_load_W", "power_W_recon"))


@query("f05_apportion_total", with_(ATT_SQL, body=f"""SELECT site, device_id, ts_s, {R('1e5*greatest(coalesce(cooling_load_W,0),0)/nullif(sum(greatest(coalesce(cooling_load_W,0),0)) OVER (PARTITION BY grp, ts_s),0)', 5)} AS share_W FROM att WHERE equipment_type='chiller'"""))
def f05(spark, d):
    a = bind.attributed(spark, d).where("equipment_type = 'chiller'").withColumn("total", dbl(1e5))
    return rounded(rc.apportion_total(a, "total", "cooling_load_W", ("site", "grp"), "share_W").select(*KEYS, "ts_s", "share_W"), _=5)


@query("f06_active_count", with_(ATT_SQL, body="SELECT site, device_id, ts_s, fans_on_count FROM att WHERE equipment_type='cooling_tower'"))
def f06(spark, d):
    t = bind.fleet(spark, d).where("equipment_type = 'cooling_tower'")
    return t.select(*KEYS, "ts_s", rc.active_count(t, ["fan1_Hz", "fan2_Hz", "fan3_Hz"]).alias("fans_on_count"))


F07_TEXT = """SELECT site, device_id, equipment_type, concat_ws(';',
 CASE WHEN equipment_type='cooling_tower' THEN 'fans_on_count=active_count(of 2/2 signals > 5.0, per_signal=1)' END,
 CASE WHEN equipment_type='cooling_tower' THEN concat('heat_rejection_W=heat_rate(flow=attributed_flow_m3_h,n=', CAST(count(heat_rejection_W) AS STRING), ')') END,
 CASE WHEN equipment_type='heat_exchanger' THEN concat('Q_W=heat_rate(flow=chw_flow_m3_h,n=', CAST(count(Q_W) AS STRING), ')') END,
 CASE WHEN equipment_type IN ('heat_exchanger','chiller') THEN concat('Q_cond_W=heat_rate(flow=cw_flow_m3_h,n=', CAST(count(Q_cond_W) AS STRING), ')') END,
 CASE WHEN equipment_type='chiller' THEN concat('cooling_load_W=chw_energy_balance(flow=chw_flow_m3_h,n=', CAST(count(cooling_load_W) AS STRING), ')') END,
 CASE WHEN equipment_type='chiller' THEN concat('power_W_recon=energy_balance_power(n=', CAST(count(power_W_recon) AS STRING), ')') END) AS reconstructed FROM att GROUP BY 1,2,3"""


@query("f07_recon_dispatch", with_(ATT_SQL, body=F07_TEXT))
def f07(spark, d):
    return rc.method_flags(bind.attributed(spark, d), bind.RECON)


@query("f07_recon_columns", with_(ATT_SQL, body=f"SELECT site, device_id, ts_s, {R('Q_W', 5)} AS Q_W, {R('Q_cond_W', 5)} AS Q_cond_W, {R('heat_rejection_W', 5)} AS heat_rejection_W FROM att"))
def f07_cols(spark, d):
    a = rc.reconstruct(bind.attributed(spark, d).drop("Q_W", "Q_cond_W", "heat_rejection_W", "fans_on_count", "cooling_load_W", "power_W_recon"), bind.RECON)
    return rounded(a.select(*KEYS, "ts_s", "Q_W", "Q_cond_W", "heat_rejection_W"), _=5)


@query("f08_two_side_residual", with_(ATT_SQL, body=f"""SELECT site, device_id, {R('1e2*median(abs(Q_cond_W-Q_W)/Q_W)')} AS residual_pct, count(CASE WHEN Q_W>0 AND Q_cond_W IS NOT NULL THEN 1 END) AS n
 FROM (SELECT * FROM att WHERE Q_W>0 AND Q_cond_W IS NOT NULL) GROUP BY 1,2"""))
def f08(spark, d):
    return rounded(rc.two_side_residual(bind.attributed(spark, d).where("equipment_type = 'heat_exchanger'")))


@query("f09_cooling_load", with_(ATT_SQL, body=f"""SELECT site, device_id, ts_s, {R('''CASE WHEN count(CASE WHEN blk%2=0 THEN cooling_load_W END) OVER (PARTITION BY device_id)>0 THEN cooling_load_W
 ELSE 1e3*4186*(chw_flow_m3_h/3600)*(tchwr_C-tchws_C) END''', 5)} AS load_W FROM att WHERE equipment_type='chiller'"""))
def f09(spark, d):
    a = bind.attributed(spark, d).where("equipment_type = 'chiller'").withColumn("cooling_load_W", F.when(F.col("blk") % 2 == 0, F.col("cooling_load_W")))
    return rounded(rc.cooling_load(a).select(*KEYS, "ts_s", "load_W"), _=5)


@query("f10_heat_rejection", with_(ATT_SQL, body=f"SELECT site, device_id, ts_s, {R('attributed_flow_m3_h*1e3/36e2*4180*(tcwr_C-tcws_1_C)', 5)} AS q_W FROM att WHERE equipment_type='cooling_tower'"))
def f10(spark, d):
    t = bind.attributed(spark, d).where("equipment_type = 'cooling_tower'")
    return rounded(t.select(*KEYS, "ts_s", rc.heat_rejection(F.col("attributed_flow_m3_h") * dbl(1000.0) / dbl(3600.0), "tcwr_C", "tcws_1_C").alias("q_W")), _=5)


