"""Quality profiles."""

from pyspark.sql import functions as F

from catalog import bind
from catalog.bind import ALL_ROLES, ATT_SQL, FLEET_SQL, KEYS, RAW_SQL, with_
from catalog.registry import R, query, rounded
from fleetgauge.operators import operating as op
from fleetgauge.operators import quality as ql
from fleetgauge.sources import raw as rw

QA_ROLES = ["power_W", "chw_flow_m3_h"]
QA_SQL = RAW_SQL + """,
fst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_id, ts_s ORDER BY row_id) AS o FROM canon WHERE ts_s IS NOT NULL) WHERE o=1),
stp AS (SELECT *, ts_s-lag(ts_s) OVER (PARTITION BY device_id ORDER BY ts_s) AS step FROM fst),
qa AS (SELECT site, device_id, count(*) AS rows, count(power_W) AS vp, count(chw_flow_m3_h) AS vf, median(step)*1e0 AS med FROM stp GROUP BY 1,2),
rp AS (SELECT device_id, count_if(ts_s IS NULL)*1e0 AS inv, (count(ts_s)-count(DISTINCT ts_s))*1e0 AS dup FROM canon GROUP BY 1),
qj AS (SELECT * FROM qa JOIN rp USING (device_id))"""


@query("c01_adapter_qa", with_(QA_SQL, body=f"""SELECT site, device_id, 'rows' AS "check", rows*1e0 AS value, 'info' AS status FROM qj
 UNION ALL SELECT site, device_id, 'duplicate_timestamps', dup, CASE WHEN dup=0 THEN 'pass' ELSE 'review' END FROM qj
 UNION ALL SELECT site, device_id, 'invalid_timestamps', inv, CASE WHEN inv=0 THEN 'pass' ELSE 'review' END FROM qj
 UNION ALL SELECT site, device_id, 'non_finite_cells', (2*rows-vp-vf)*1e0, 'info' FROM qj
 UNION ALL SELECT site, device_id, 'median_interval_seconds', {R('med')}, 'info' FROM qj
 UNION ALL SELECT site, device_id, 'missing_rate:power_W', {R('round_even(1e0-vp/rows, 6)')}, 'info' FROM qj
 UNION ALL SELECT site, device_id, 'missing_rate:chw_flow_m3_h', {R('round_even(1e0-vf/rows, 6)')}, 'info' FROM qj"""))
def c01(spark, d):
    c = bind.canonical_raw(spark, d)
    return rounded(ql.adapter_qa(rw.keep_first(c.where("ts IS NOT NULL")), rw.timestamp_report(c), QA_ROLES))


_CHANNELS = ("click", "error", "purchase", "signup", "view")


@query("c02_channel_quality", "WITH h AS (SELECT concat('site_', CAST(user_id%3 AS STRING)) AS site, concat('U_', CAST(user_id AS STRING)) AS device_id, event_type, value FROM events),\ng AS (" + " UNION ALL ".join(
    f"SELECT site, device_id, '{c}' AS field, count(*) AS rows, count(CASE WHEN event_type='{c}' THEN value END) AS valid_rows, " + ", ".join(f"{f}(CASE WHEN event_type='{c}' THEN value END) AS {n}" for f, n in (("min", "minimum"), ("max", "maximum"), ("avg", "mean"))) + " FROM h GROUP BY 1,2" for c in _CHANNELS) + """)
SELECT site, device_id, field, rows, valid_rows, """ + f"{R('1e0-valid_rows/rows')} AS missing_rate, {R('minimum')} AS minimum, {R('maximum')} AS maximum, {R('mean')} AS mean FROM g")
def c02(spark, d):
    e = bind.events(spark, d)
    w = e.select(*KEYS, *[F.when(F.col("channel") == c, F.col("value")).alias(c) for c in _CHANNELS])
    return rounded(ql.channel_quality(w, list(_CHANNELS)))


PROF_SQL = ATT_SQL + """,
lg AS (UNPIVOT (SELECT site, device_id, """ + ", ".join(ALL_ROLES) + """ FROM att) ON """ + ", ".join(ALL_ROLES) + """ INTO NAME role VALUE value),
cnt AS (SELECT site, device_id, count(*) AS n_total FROM att GROUP BY 1,2),
rl AS (SELECT unnest([""" + ", ".join(f"'{r}'" for r in ALL_ROLES) + """]) AS role),
pr AS (SELECT c.site, c.device_id, r.role, n_total, coalesce(n_finite,0) AS n_finite, coalesce(n_unique,0) AS n_unique, minimum, maximum, coalesce(std,0) AS std, coalesce(am<=1e-8,false) AS all_zero
  FROM cnt c CROSS JOIN rl r LEFT JOIN (SELECT device_id, role, count(value) AS n_finite, count(DISTINCT value) AS n_unique, min(value) AS minimum, max(value) AS maximum,
   stddev_pop(value) AS std, max(abs(value)) AS am FROM lg GROUP BY 1,2) g ON g.device_id=c.device_id AND g.role=r.role)"""


@query("c03_channel_profile", with_(PROF_SQL, body=f"""SELECT site, device_id, role, n_finite, n_total, n_unique, {R('minimum', 4)} AS minimum, {R('maximum', 4)} AS maximum,
 {R('std', 3)} AS std, n_unique<=1 AS dead, all_zero, {R('1e2*n_finite/n_total', 4)} AS coverage_pct FROM pr"""))
def c03(spark, d):
    return rounded(ql.channel_profile(bind.attributed(spark, d), ALL_ROLES), _=4, std=3)


@query("c04_cadence_profile", """WITH e AS (SELECT concat('site_', CAST(user_id%3 AS STRING)) AS site, concat('U_', CAST(user_id AS STRING)) AS device_id,
 epoch_us(ts)//3600000000*3600 AS s FROM events), u AS (SELECT DISTINCT * FROM e), l AS (SELECT *, s-lag(s) OVER (PARTITION BY device_id ORDER BY s) AS step FROM u),
m AS (SELECT device_id, step FROM (SELECT device_id, step, row_number() OVER (PARTITION BY device_id ORDER BY count(*) DESC, step) AS o FROM l WHERE step IS NOT NULL GROUP BY 1,2) WHERE o=1)
SELECT site, device_id, coalesce(step//60, 0) AS step_min, (max(s)-min(s))//86400 AS span_days,
 concat(strftime(make_timestamp(min(s)*1000000), '%Y-%m'), ' to ', strftime(make_timestamp(max(s)*1000000), '%Y-%m')) AS "window" FROM u LEFT JOIN m USING (device_id) GROUP BY site, device_id, step""")
def c04(spark, d):
    e = bind.events(spark, d).select(*KEYS, F.timestamp_seconds(F.floor(F.col("us") / F.lit(3600000000)) * 3600).alias("ts")).distinct()
    return ql.cadence_profile(e)


REQ = {f: p["required"] for f, p in __import__("fleetgauge.contracts", fromlist=["x"]).PROFILES.items()}
C05_ROLES = sorted({r for v in REQ.values() for r in v})
PRES_SQL = ATT_SQL + ",\nps AS (SELECT site, device_id, equipment_type, " + ", ".join(f"count({r})>0 AS has_{r}" for r in C05_ROLES) + " FROM att GROUP BY 1,2,3)"
MISSING = "CASE equipment_type " + " ".join(f"WHEN '{f}' THEN concat_ws(',', " + ", ".join(f"CASE WHEN NOT has_{r} THEN '{r}' END" for r in v) + ")" for f, v in REQ.items()) + " END"


@query("c05_channel_present", with_(PRES_SQL, body="SELECT site, device_id, equipment_type, concat_ws(',', " + ", ".join(f"CASE WHEN has_{r} THEN '{r}' END" for r in C05_ROLES) + f") AS present, {MISSING} AS missing FROM ps"))
def c05(spark, d):
    m = ql.missing_required(ql.presence(bind.attributed(spark, d), C05_ROLES))
    return m.withColumns({c: F.array_join(c, ",") for c in ("present", "missing")})


TARGET = "CASE equipment_type WHEN 'chiller' THEN power_W WHEN 'cooling_tower' THEN heat_rejection_W WHEN 'pump' THEN power_W ELSE tcwr_C END"


@query("c06_target_usable", with_(ATT_SQL, body=f"SELECT site, device_id, equipment_type, coalesce(max(abs({TARGET}))>0, false) AS target_ok FROM att GROUP BY 1,2,3"))
def c06(spark, d):
    return ql.target_usable(bind.attributed(spark, d))


@query("c07_run_signal_usable", with_(FLEET_SQL, body="SELECT site, device_id, count(run_signal)>0 AS run_usable FROM fleet GROUP BY 1,2"))
def c07(spark, d):
    return op.run_signal_usable(bind.fleet(spark, d))


