"""Shape the given tables into device telemetry, identically in Spark and SQL.

``lineitem`` becomes a fleet of chillers, towers, pumps and heat exchangers
(one device per supplier); ``events`` is an irregular source (user = device,
event type = channel); ``orders``/``customer`` supply result tables for the
roll-ups. The role formulas are plain expressions shared by both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.functions.lineage import settle
from fleetgauge.operators import ordered

START = 1714521600  # 2024-05-01T00:00:00Z
STEP = 1800
KEYS = ["site", "device_id"]
ALL_ROLES = ["power_W", "speed_Hz", "fan1_Hz", "fan2_Hz", "chw_flow_m3_h", "cw_flow_m3_h", "tchws_C", "tchwr_C",
             "tcws_C", "tcwr_C", "tcws_1_C", "twb_C", "load_pct", "run_signal"]

# ---- expressions valid in both engines -------------------------------------------------
_B0 = {
    "k": "l_suppkey", "n": "n", "q": "l_quantity", "p": "l_extendedprice", "d": "l_discount", "t": "l_tax",
    "f": "l_linestatus",
    "run": "CASE WHEN l_returnflag='R' THEN 0e0 ELSE 1e0 END",
    "fam": "CAST(l_suppkey % 4 AS INT)",
    "ts_s": "1714521600 + n*1800 + CAST(floor(n/97) AS BIGINT)*86400",
}
_B1 = {
    "k": "k", "n": "n", "ts_s": "ts_s", "fam": "fam", "q": "q", "d": "d", "t": "t", "f": "f", "run": "run",
    "blk": "CAST(floor(k/12) AS BIGINT)",
    "hz": "run*(20+6e-1*q)",
    "chw": "CASE WHEN k%20=8 THEN 7.01e1 WHEN fam IN (0,3) THEN 100+p/500 END",
    "cw": "CASE WHEN fam=0 AND k%16=4 THEN NULL WHEN fam=3 AND k%28=3 THEN 100+p/500 WHEN fam IN (0,3) THEN 120+p/400 END",
    "stuck": "CASE WHEN fam=0 AND k%5=0 AND run=1 AND f='F' THEN 1 ELSE 0 END",
}
_FAM = "CASE fam WHEN 0 THEN 'chiller' WHEN 1 THEN 'cooling_tower' WHEN 2 THEN 'pump' ELSE 'heat_exchanger' END"
_FLEET = {
    "site": "substr('ABCD', CAST(blk%4 AS INT)+1, 1)",
    "device_id": "concat(CASE fam WHEN 0 THEN 'CH' WHEN 1 THEN 'CT' WHEN 2 THEN 'PU' ELSE 'HX' END, '_', CAST(k AS STRING))",
    "equipment_type": _FAM,
    "grp": f"concat({_FAM}, '@', CAST(blk AS STRING))",
    "blk": "blk",
    "ts_s": "ts_s",
    "power_W": "CASE WHEN fam=3 THEN NULL"
               " WHEN fam=0 AND k%32=12 THEN 0e0"
               " WHEN fam=0 AND stuck=1 THEN 1900+q"
               " WHEN fam=0 THEN run*(1e3*4186*(chw/3600)*(3+4e1*t))/(4+2e1*d)*(CASE WHEN k%24=16 AND t<5e-3 THEN 6 ELSE 1 END)"
               " WHEN fam=1 THEN (CASE WHEN hz>5 THEN 1 ELSE 0 END + CASE WHEN k%3<>0 AND f='F' AND hz>5 THEN 1 ELSE 0 END)*5e3*(hz/50)*(hz/50)*(hz/50)*(1+t)"
               " WHEN k%8=2 THEN 1293.2e0*hz"
               " ELSE run*4e4*(1e-1+85e-2*(hz/50)*(hz/50)*(hz/50))*(1+(t-4e-2)/2) END",
    "speed_Hz": "CASE WHEN fam=2 THEN hz END",
    "fan1_Hz": "CASE WHEN fam=1 THEN hz END",
    "fan2_Hz": "CASE WHEN fam<>1 OR k%3=0 THEN NULL WHEN f='F' THEN hz ELSE 0e0 END",
    "chw_flow_m3_h": "chw",
    "cw_flow_m3_h": "cw",
    "tchws_C": "CASE fam WHEN 0 THEN 7+1e1*d WHEN 3 THEN 27+1e1*d END",
    "tchwr_C": "CASE fam WHEN 0 THEN 10+1e1*d+4e1*t WHEN 3 THEN 30+1e1*d+4e1*t END",
    "tcws_C": "CASE WHEN fam=0 AND q=7 THEN NULL WHEN fam=0 THEN 24+2e1*d WHEN fam=3 THEN 14+2e1*d END",
    "tcwr_C": "CASE fam WHEN 0 THEN 25+2e1*d+5e1*t WHEN 1 THEN 25+2e1*d+5e1*t WHEN 3 THEN 15+2e1*d+5e1*t END",
    "tcws_1_C": "CASE WHEN fam=1 THEN 22+6e1*d+1e1*t END",
    "twb_C": "CASE WHEN fam=1 AND q<>11 THEN 18+1e2*d END",
    "load_pct": "CASE WHEN fam<>0 OR (k%12=4 AND q<3) THEN NULL WHEN stuck=1 THEN 9e-1 ELSE run*(30+q) END",
    "run_signal": "CASE WHEN k%40=10 THEN NULL ELSE run END",
}


def _sel(d):
    return ", ".join(f"{e} AS {n}" for n, e in d.items())


FLEET_SQL = f"""li AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS n FROM lineitem),
b0 AS (SELECT {_sel(_B0)} FROM li),
b1 AS (SELECT {_sel(_B1)}, p FROM b0),
fleet AS (SELECT {_sel(_FLEET)} FROM b1)"""


def with_(*ctes, body):
    return "WITH " + ",\n".join(ctes) + "\n" + body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STAGES: dict = {}


def staged(name, written=False):
    """Write a stage once per application and input folder; later queries scan the written table. ``written``: the operator has done so."""
    def wrap(fn):
        def get(spark, sf_dir):
            key = (spark.sparkContext.applicationId, sf_dir, name)
            if key not in _STAGES:
                _STAGES[key] = fn(spark, sf_dir) if written else settle(fn(spark, sf_dir), name)
            return _STAGES[key]
        return get
    return wrap


@staged("canonical")
def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical telemetry of the whole fleet, one row per (site, device_id, ts)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
        "l_linestatus", "l_returnflag")
    li = ordered.ordinal(li, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"],
                         ordered.id_chunk("l_orderkey"), name="n")
    b0 = li.selectExpr(*[f"{e} AS {n}" for n, e in _B0.items()])
    b1 = b0.selectExpr(*[f"{e} AS {n}" for n, e in _B1.items()], "p")
    out = b1.selectExpr(*[f"{e} AS {n}" for n, e in _FLEET.items()])
    return out.withColumn("ts", F.timestamp_seconds("ts_s"))


# ---- irregular source --------------------------------------------------------------------
EVENTS_SQL = """ev AS (SELECT concat('site_', CAST(user_id % 3 AS STRING)) AS site, concat('U_', CAST(user_id AS STRING)) AS device_id,
 event_type AS channel, epoch_us(ts) AS us, value, event_id FROM events)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select(F.concat(F.lit("site_"), (F.col("user_id") % 3).cast("string")).alias("site"),
                    F.concat(F.lit("U_"), F.col("user_id").cast("string")).alias("device_id"),
                    F.col("event_type").alias("channel"), F.unix_micros(ts).alias("us"), ts.alias("ts"),
                    "value", "event_id")


# ---- attributed telemetry -----------------------------------------------------------------
RECON = [
    {"output": "fans_on_count", "method": "active_count", "signals": ["fan1_Hz", "fan2_Hz"], "threshold": 5.0, "types": ["cooling_tower"]},
    {"output": "heat_rejection_W", "method": "heat_rate", "flow": "attributed_flow_m3_h", "t_hot": "tcwr_C", "t_cold": "tcws_1_C",
     "types": ["cooling_tower"]},
    {"output": "Q_W", "method": "heat_rate", "flow": "chw_flow_m3_h", "t_hot": "tchwr_C", "t_cold": "tchws_C", "types": ["heat_exchanger"]},
    {"output": "Q_cond_W", "method": "heat_rate", "flow": "cw_flow_m3_h", "t_hot": "tcwr_C", "t_cold": "tcws_C",
     "types": ["heat_exchanger", "chiller"]},
    {"output": "cooling_load_W", "method": "chw_energy_balance", "flow": "chw_flow_m3_h", "t_hot": "tchwr_C", "t_cold": "tchws_C",
     "types": ["chiller"]},
    {"output": "power_W", "method": "energy_balance_power", "condenser": "Q_cond_W", "evaporator": "cooling_load_W", "types": ["chiller"]},
]


def registry(spark, sf_dir):
    """Device registry with attribution specs, one row per supplier."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    s = s.selectExpr("k", "CAST(k % 4 AS INT) AS fam", "CAST(floor(k/12) AS BIGINT) AS blk")
    d = s.selectExpr("k", "blk", f"{_FLEET['site']} AS site", f"{_FLEET['device_id']} AS device_id", f"{_FAM} AS equipment_type",
                     f"{_FLEET['grp']} AS grp")
    return d


def paired_spec(spark, sf_dir):
    """Towers name the chillers of their own plant as flow sources."""
    d = registry(spark, sf_dir)
    ch = (d.where("equipment_type = 'chiller'").groupBy("site", "blk")
          .agg(F.array_sort(F.collect_list("device_id")).alias("source_devices")))  # at most 3 per plant
    return d.where("equipment_type = 'cooling_tower'").join(ch, ["site", "blk"]).select("site", "device_id", "source_devices")


@staged("attributed")
def attributed(spark, sf_dir):
    """Fleet with paired tower flow, solo-window pump flow and reconstructed columns."""
    from fleetgauge.operators import attribution as at
    from fleetgauge.operators import reconstruct as rc
    rows = fleet(spark, sf_dir)
    f = at.attribute_named(rows, paired_spec(spark, sf_dir), "cw_flow_m3_h", "_paired")
    f = at.attribute_solo(f, F.col("equipment_type") == "pump", "chiller", "chw_flow_m3_h", "_solo", scope=("site", "blk"), source=rows)
    f = f.withColumn("attributed_flow_m3_h", F.coalesce("_paired", "_solo")).drop("_paired", "_solo")
    return rc.reconstruct(f, RECON)


def q_w(flow, hot, cold):
    return f"CASE WHEN {hot}-{cold}>0 AND {flow}>0 THEN 1e3*4186*({flow}/3600)*({hot}-{cold}) END"


ATT_SQL = FLEET_SQL + f""",
src AS (SELECT blk, ts_s, sum(coalesce(cw_flow_m3_h,0)) AS cw_tot, sum(coalesce(chw_flow_m3_h,0)) AS chw_tot FROM fleet
  WHERE equipment_type='chiller' GROUP BY blk, ts_s),
oncnt AS (SELECT grp, ts_s, count(CASE WHEN run_signal>5e-1 THEN 1 END) AS on_devices FROM fleet GROUP BY grp, ts_s),
usable AS (SELECT device_id AS dev, count(run_signal)>0 AS run_usable FROM fleet GROUP BY device_id),
att0 AS (SELECT f.*, CASE WHEN equipment_type='cooling_tower' THEN cw_tot
   WHEN equipment_type='pump' AND run_usable AND run_signal>5e-1 AND on_devices=1 THEN chw_tot END AS attributed_flow_m3_h,
   coalesce(run_signal>5e-1 AND on_devices=1, false) AS solo
  FROM fleet f LEFT JOIN src USING (blk, ts_s) LEFT JOIN oncnt USING (grp, ts_s) LEFT JOIN usable u ON u.dev=f.device_id),
att1 AS (SELECT *, CASE WHEN equipment_type='cooling_tower' THEN (CASE WHEN fan1_Hz>5 THEN 1e0 ELSE 0e0 END)+(CASE WHEN fan2_Hz>5 THEN 1e0 ELSE 0e0 END) END AS fans_on_count,
  CASE WHEN equipment_type='cooling_tower' THEN {q_w('attributed_flow_m3_h', 'tcwr_C', 'tcws_1_C')} END AS heat_rejection_W,
  CASE WHEN equipment_type='heat_exchanger' THEN {q_w('chw_flow_m3_h', 'tchwr_C', 'tchws_C')} END AS Q_W,
  CASE WHEN equipment_type IN ('heat_exchanger','chiller') THEN {q_w('cw_flow_m3_h', 'tcwr_C', 'tcws_C')} END AS Q_cond_W,
  CASE WHEN equipment_type='chiller' THEN {q_w('chw_flow_m3_h', 'tchwr_C', 'tchws_C')} END AS cooling_load_W FROM att0),
att AS (SELECT *, CASE WHEN equipment_type='chiller' AND Q_cond_W>0 AND cooling_load_W>0 THEN Q_cond_W-cooling_load_W END AS power_W_recon FROM att1)"""

# operating mask over the attributed table
MASK_SQL = ATT_SQL + """,
lv AS (SELECT *, CASE equipment_type WHEN 'chiller' THEN load_pct WHEN 'pump' THEN speed_Hz END AS live, coalesce(run_signal>5e-1, false) AS raw_bit FROM att),
rs AS (SELECT device_id AS dev, count(run_signal)>0 AS run_present, bool_or(raw_bit) AS run_seen FROM lv GROUP BY device_id),
bt AS (SELECT lv.*, run_present, run_seen, CASE WHEN NOT run_present OR NOT run_seen THEN true ELSE raw_bit END AS bit FROM lv JOIN rs ON dev=device_id),
fl AS (SELECT device_id AS dv, 2e-2*quantile_cont(CASE WHEN bit AND live>0 THEN live END, 0.99) AS live_floor FROM bt GROUP BY device_id),
mk AS (SELECT *, bit AND coalesce(live<=live_floor, false) AS denied, bit AND NOT coalesce(live<=live_floor, false) AS operating FROM bt JOIN fl ON dv=device_id)"""

SCALE_TH = dict(min_full_rows=25, min_nominal_rows=20, min_calibration_rows=20)


@staged("masked")
def masked(spark, sf_dir):
    from fleetgauge.operators import operating
    return operating.operating_mask(attributed(spark, sf_dir))


# ---- raw historian text ----------------------------------------------------------------------
_RAW = {
    "site": "substr('ABCD', CAST(CAST(floor(l_suppkey/12) AS BIGINT)%4 AS INT)+1, 1)",
    "device_id": "concat('RAW_', CAST(l_suppkey AS STRING))",
    "row_id": "n",
    "stamp": "CASE WHEN l_quantity=23 AND l_suppkey%7=0 THEN 'not-a-date' WHEN l_linestatus='F' THEN concat(day, '+08:00') ELSE concat(day, 'Z') END",
    "power_kw": "CASE WHEN l_quantity=13 THEN 'n/a' WHEN l_quantity=17 THEN 'NaN' WHEN l_quantity=19 THEN 'Infinity' WHEN l_quantity=29 THEN NULL"
                " ELSE CAST(CAST(floor(l_extendedprice*100) AS BIGINT) AS STRING) END",
    "flow_lps": "CASE WHEN l_quantity=31 THEN '' ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) END",
}
RAW_SQL = f"""li AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS n,
 strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS day FROM lineitem),
raw AS (SELECT {_sel(_RAW)} FROM li),
canon AS (SELECT site, device_id, row_id, stamp, epoch_us(TRY_CAST(stamp AS TIMESTAMPTZ))//1000000 AS ts_s,
 CASE WHEN isfinite(TRY_CAST(power_kw AS DOUBLE)) THEN TRY_CAST(power_kw AS DOUBLE) END*1e1+0e0 AS power_W,
 CASE WHEN isfinite(TRY_CAST(flow_lps AS DOUBLE)) THEN TRY_CAST(flow_lps AS DOUBLE) END*36e-1+1e0 AS chw_flow_m3_h FROM raw)"""
ADAPTER = {"power_W": {"source": "power_kw", "scale": 10.0, "unit": "W"},
           "chw_flow_m3_h": {"source": "flow_lps", "scale": 3.6, "offset": 1.0, "unit": "m3/h"}}


@staged("raw")
def raw(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity",
                                                 "l_linestatus", "l_shipdate")
    li = ordered.ordinal(li, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], ordered.id_chunk("l_orderkey"), name="n")
    li = li.withColumn("day", F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return li.selectExpr(*[f"{e} AS {n}" for n, e in _RAW.items()])


def canonical_raw(spark, sf_dir):
    from fleetgauge.sources import raw as rw
    c = rw.canonicalise(raw(spark, sf_dir), ADAPTER, keep=("site", "device_id", "row_id", "stamp"))
    return rw.utc_normalise(c, "stamp").withColumn("ts_s", F.unix_seconds("ts"))


# ---- trend-log documents, one per (device, channel, day) ------------------------------------------
RING = 16


@staged("documents")
def trend_docs(spark, sf_dir):
    """XML ring buffers built from the events of one channel and day."""
    e = events(spark, sf_dir).withColumn("day", F.floor(F.col("us") / F.lit(86400000000)))
    key = ["site", "device_id", "channel", "day"]
    g = e.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("us", "event_id", "value"))).alias("s"))
    n = F.size("s")
    size = F.greatest(n, F.lit(2))
    nxt = (F.pmod(F.col("day"), size) + 1).cast("int")
    # a full buffer is rotated so that its oldest record sits at next-index
    pos = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(n >= 2, F.pmod(i + nxt - 1, size) + 1).otherwise(i + 1))
    timer = F.transform("s", lambda x: F.pmod(F.floor(x["us"] / F.lit(10000)) - F.col("day") * F.lit(8640000) + F.lit(4290000000), F.lit(2 ** 32)))
    flag = F.transform("s", lambda x: F.when(x["event_id"] % 11 == 0, "fault;error-entry").otherwise("ok"))
    val = F.transform("s", lambda x: x["value"].cast("string"))

    def buf(name, values, inner=""):
        items = F.array_join(F.zip_with(pos, values, lambda p, v: F.concat(F.lit('<U name="'), p.cast("string"), F.lit('" value="'), v.cast("string"), F.lit('"/>'))), "")
        return F.concat(F.lit(f'<S name="{name}">' + (f"<{inner}>" if inner else "")), items, F.lit((f"</{inner}>" if inner else "") + "</S>"))

    def prop(name, v):
        return F.concat(F.lit(f'<P name="{name}" value="'), v.cast("string"), F.lit('"/>'))
    # timers start 4290000000 ticks above the reference, so some wrap at 2**32
    ref = F.date_format(F.timestamp_micros(F.col("day") * F.lit(86400000000) - F.lit(42900000000000)), "yyyy-MM-dd'T'HH:mm:ss")
    wraps = F.floor((F.floor(F.element_at("s", 1)["us"] / F.lit(10000)) - F.col("day") * F.lit(8640000) + F.lit(4290000000)) / F.lit(2 ** 32))
    label = F.concat_ws("|", "site", "device_id", "channel", F.col("day").cast("string"))
    xml = F.concat(F.lit("<Object>"), prop("object-type", F.lit("trend-log")), prop("object-name", label), prop("time-reference", ref),
                   prop("time-reference-count", wraps), prop("log-interval", F.lit(90000)), prop("record-count", n), prop("total-record-count", n * 3),
                   prop("buffer-size", size), prop("next-index", nxt), buf("timestamp-buffer", timer), buf("flags-buffer", flag),
                   buf("data-buffer", val, "Choice"), F.lit("</Object>"))
    return g.select(label.alias("doc_id"), xml.alias("xml"))
