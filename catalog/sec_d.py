"""Operating state and time windows."""

from pyspark.sql import functions as F

from catalog import bind
from catalog.bind import ATT_SQL, FLEET_SQL, KEYS, MASK_SQL, with_
from catalog.registry import R, query, rounded
from fleetgauge.operators import operating as op
from fleetgauge.operators import reconstruct as rc


@query("d01_operating_mask", with_(MASK_SQL, body=f"""SELECT site, device_id, equipment_type, ts_s, bit, denied, operating,
 {R('live_floor')} AS live_floor FROM mk"""))
def d01(spark, d):
    return rounded(bind.masked(spark, d).select(*KEYS, "equipment_type", "ts_s", "bit", "denied", "operating", "live_floor"))


@query("d02_stuck_status_flags", with_(MASK_SQL, body=f"""SELECT site, device_id, equipment_type, rows, bit_rows, on_rows, denied_rows,
 {R('live_floor')} AS live_floor, {R('stuck')} AS stuck_pct,
 concat_ws(',', CASE WHEN NOT p THEN 'run_signal_absent' END, CASE WHEN p AND NOT s THEN 'run_signal_dead' END,
  CASE WHEN stuck>=5 THEN concat('run_signal_uncorroborated:', CAST(CAST(round_even(stuck,0) AS BIGINT) AS STRING), 'pct_by_',
   CASE equipment_type WHEN 'chiller' THEN 'load_pct' ELSE 'speed_Hz' END) END,
  CASE WHEN equipment_type IN ('chiller','pump') AND live_floor IS NULL THEN 'liveness_channel_absent' END) AS flags
 FROM (SELECT *, coalesce(100e0*denied_rows/nullif(bit_rows,0),0e0) AS stuck FROM (SELECT site, device_id, equipment_type,
  bool_or(run_present) AS p, bool_or(run_seen) AS s, max(live_floor) AS live_floor, count(*) AS rows, count_if(bit)::BIGINT AS bit_rows,
  count_if(operating)::BIGINT AS on_rows, count_if(denied)::BIGINT AS denied_rows FROM mk GROUP BY 1,2,3))"""))
def d02(spark, d):
    return rounded(op.mask_flags(bind.masked(spark, d)).withColumn("flags", F.array_join("flags", ",")))


STEADY_SQL = MASK_SQL + """,
ld AS (SELECT *, CASE WHEN count(cooling_load_W) OVER (PARTITION BY device_id)>0 THEN cooling_load_W ELSE 1e3*4186*(chw_flow_m3_h/3600)*(tchwr_C-tchws_C) END AS load_W
  FROM mk WHERE equipment_type='chiller'),
md AS (SELECT *, median(CASE WHEN operating AND power_W>0 AND load_W>0 THEN power_W END) OVER (PARTITION BY device_id) AS pm FROM ld),
bs AS (SELECT *, CASE WHEN operating AND power_W>0 AND load_W>0 AND power_W>2e-1*pm THEN load_W END AS qb FROM md),
lg AS (SELECT *, lag(qb) OVER w AS qp, row_number() OVER w AS rn1 FROM bs WINDOW w AS (PARTITION BY device_id ORDER BY ts_s)),
steady AS (SELECT *, qb IS NOT NULL AND coalesce(abs(qb-CASE WHEN rn1=1 THEN qb ELSE qp END)/nullif(abs(qb),0)<1e-1,false) AS steady FROM lg)"""


def steady(spark, d):
    m = bind.masked(spark, d).where("equipment_type = 'chiller'")
    return op.steady_mask(rc.cooling_load(m), "power_W", "load_W")


@query("d03_steady_mask", with_(STEADY_SQL, body=f"SELECT site, device_id, ts_s, {R('load_W', 4)} AS load_W, steady FROM steady"))
def d03(spark, d):
    return rounded(steady(spark, d).select(*KEYS, "ts_s", "load_W", "steady"), _=4)


@query("d04_align_run_signals", with_(FLEET_SQL, body="""SELECT site, grp, ts_s, count(*) AS devices,
 count(CASE WHEN run_signal>5e-1 THEN 1 END) AS on_devices FROM fleet GROUP BY 1,2,3"""))
def d04(spark, d):
    return (op.on_count(bind.fleet(spark, d)).groupBy("site", "grp", "ts_s")
            .agg(F.count(F.lit(1)).alias("devices"), F.max("on_devices").alias("on_devices")))


@query("d05_solo_run_mask", with_(ATT_SQL, body="SELECT site, device_id, ts_s, solo FROM att"))
def d05(spark, d):
    return op.solo_mask(bind.fleet(spark, d)).select(*KEYS, "ts_s", "solo")


@query("d06_solo_run_counts", with_(ATT_SQL, body="SELECT site, device_id, count_if(solo)::BIGINT AS solo_rows FROM att GROUP BY 1,2"))
def d06(spark, d):
    return op.solo_counts(op.solo_mask(bind.fleet(spark, d)))


ISL_SQL = FLEET_SQL + """,
isl AS (SELECT *, sum(CASE WHEN pv IS NOT NULL AND abs(ts_s-pv-1800)<=1e-6 THEN 0 ELSE 1 END) OVER (PARTITION BY device_id ORDER BY ts_s) AS island,
  row_number() OVER (PARTITION BY device_id ORDER BY ts_s)-1 AS rn
  FROM (SELECT *, lag(ts_s) OVER (PARTITION BY device_id ORDER BY ts_s) AS pv FROM fleet WHERE run_signal>5e-1 OR run_signal IS NULL)),
isp AS (SELECT *, row_number() OVER (PARTITION BY device_id, island ORDER BY ts_s)-1 AS pos, count(*) OVER (PARTITION BY device_id, island) AS ilen FROM isl)"""


def islands(spark, d):
    f = bind.fleet(spark, d).where("run_signal > 0.5 OR run_signal IS NULL")
    return op.contiguous_runs(f, 1800.0)


@query("d07_contiguous_runs", with_(ISL_SQL, body="""SELECT site, device_id, island::BIGINT AS island, min(ts_s) AS start_s, max(ts_s) AS end_s,
 count(*) AS rows FROM isl GROUP BY 1,2,3"""))
def d07(spark, d):
    s = op.island_summary(islands(spark, d))
    return s.select(*KEYS, F.col("island").cast("bigint").alias("island"), F.unix_seconds("start_ts").alias("start_s"),
                    F.unix_seconds("end_ts").alias("end_s"), "rows")


# windows of 24 rows every 4 rows here (the bound record has ~12-96 row runs); production uses 288 / 12
W, S = 24, 4
FEATS = ["power_W", "speed_Hz", "fan1_Hz"]


def _stat(f):
    return f"""avg({f}) AS {f}_mu, stddev_samp({f}) AS {f}_sd, quantile_cont({f},0.25) AS {f}_q1, quantile_cont({f},0.75) AS {f}_q3"""


def _part(f):
    s = f"coalesce(nullif(coalesce(nullif(r.{f}_q3-r.{f}_q1,0),r.{f}_sd),0),1e0)"
    return f"(abs(w.{f}_mu-r.{f}_mu)+5e-1*abs(w.{f}_q1-r.{f}_q1)+5e-1*abs(w.{f}_q3-r.{f}_q3))/{s}"


WIN_SQL = ISL_SQL + f""",
z AS (SELECT site, device_id, island, rn, pos, ilen, {', '.join(f'coalesce({f},0e0) AS {f}' for f in FEATS)} FROM isp),
rec AS (SELECT device_id, {', '.join(_stat(f) for f in FEATS)} FROM z GROUP BY device_id),
st AS (SELECT site, device_id, island, pos AS p0, rn AS start FROM z WHERE pos%{S}=0 AND pos+{W}<=ilen),
ws AS (SELECT st.site, st.device_id, st.start, {', '.join(_stat(f) for f in FEATS)} FROM st JOIN z ON z.device_id=st.device_id AND z.island=st.island
   AND z.pos BETWEEN p0 AND p0+{W - 1} GROUP BY 1,2,3),
sc AS (SELECT w.site, w.device_id, w.start, w.start+{W - 1} AS "end", ({'+'.join(_part(f) for f in FEATS)})/3 AS score FROM ws w JOIN rec r USING (device_id))"""


def scores(spark, d):
    return op.window_scores(islands(spark, d).na.fill(0.0, FEATS), FEATS, W, S)


@query("d08_sliding_window_scores", with_(WIN_SQL, body=f'SELECT site, device_id, start, "end", {R("score")} AS score FROM sc'))
def d08(spark, d):
    return rounded(scores(spark, d))


_PICK = f"""SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY score, start) AS o FROM """
GREEDY_SQL = WIN_SQL + f""",
s0 AS (SELECT site, device_id, start, "end" AS e, round(score,9) AS score FROM sc),
p1 AS (SELECT * FROM ({_PICK} s0) WHERE o=1),
s1 AS (SELECT s0.* FROM s0 JOIN p1 USING (device_id) WHERE s0.e<p1.start-{W} OR s0.start>p1.e+{W}),
p2 AS (SELECT * FROM ({_PICK} s1) WHERE o=1),
s2 AS (SELECT s1.* FROM s1 JOIN p2 USING (device_id) WHERE s1.e<p2.start-{W} OR s1.start>p2.e+{W}),
p3 AS (SELECT * FROM ({_PICK} s2) WHERE o=1)"""


@query("d09_select_windows", with_(GREEDY_SQL, body=f"""SELECT site, device_id, 1::BIGINT AS pick, start, e AS "end", {R('score')} AS score FROM p1
 UNION ALL SELECT site, device_id, 2, start, e, {R('score')} FROM p2 UNION ALL SELECT site, device_id, 3, start, e, {R('score')} FROM p3"""))
def d09(spark, d):
    s = scores(spark, d).withColumn("score", F.round("score", 9))
    return rounded(op.select_windows(s, 3, W))


@query("d10_record_span", with_(FLEET_SQL, body=f"""SELECT site, device_id, count(*) AS rows, {R('(max(ts_s)-min(ts_s))/864e2')} AS span_days
 FROM fleet GROUP BY 1,2"""))
def d10(spark, d):
    return rounded(op.record_span(bind.fleet(spark, d)))


