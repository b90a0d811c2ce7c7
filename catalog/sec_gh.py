"""Feature tables and attrition accounting."""

from pyspark.sql import functions as F

from catalog import bind
from catalog.bind import ATT_SQL, KEYS, staged, with_
from catalog.registry import R, query, rounded
from catalog.sec_d import STEADY_SQL, steady
from fleetgauge.contracts import PROFILES
from fleetgauge.operators import attrition as al
from fleetgauge.operators import features as ft

# ---- SQL twins of the family tables ------------------------------------------------------------
CHT_SQL = STEADY_SQL + """,
ch0 AS (SELECT site, device_id, ts_s, tchws_C AS CHWS, tchwr_C AS CHWR, tcws_C AS CDWS, tcwr_C AS CDWR, chw_flow_m3_h/36e-1 AS CHW, cw_flow_m3_h/36e-1 AS CDW, power_W/1e3 AS P_kW FROM steady WHERE steady),
ch1 AS (SELECT *, CHWR-CHWS AS dT_chw, CDWR-CDWS AS dT_cdw, CHW*4186e-3*(CHWR-CHWS) AS Q_evap_kW FROM ch0),
cht AS (SELECT * FROM ch1 WHERE P_kW>0 AND Q_evap_kW>0 AND CHW>0 AND CDW>0 AND dT_chw>0 AND dT_cdw>0 AND CHWS IS NOT NULL AND Q_evap_kW>P_kW)"""
CTF_SQL = ATT_SQL + """,
cf0 AS (SELECT *, tcwr_C AS Tin_C, tcws_1_C AS Tout_C, attributed_flow_m3_h*1e3/36e2 AS total_kgps, CASE WHEN fans_on_count>0 THEN fans_on_count END AS nfan,
  (CASE WHEN fan1_Hz>5 THEN fan1_Hz ELSE 0e0 END + CASE WHEN fan2_Hz>5 THEN fan2_Hz ELSE 0e0 END)/nullif(CASE WHEN fan1_Hz>5 THEN 1 ELSE 0 END + CASE WHEN fan2_Hz>5 THEN 1 ELSE 0 END,0) AS fan_hz
  FROM att WHERE equipment_type='cooling_tower'),
cf1 AS (SELECT *, fan_hz/5e1 AS fr_air, Tin_C-Tout_C AS TRan_C, Tout_C-twb_C AS TApp_C, median(CASE WHEN total_kgps>0 THEN total_kgps/2 END) OVER (PARTITION BY device_id) AS nom FROM cf0),
cf AS (SELECT *, CASE WHEN total_kgps IS NOT NULL AND fr_air IS NOT NULL AND nom IS NOT NULL THEN least(8e0, greatest(5e-2, (total_kgps/2/greatest(nom,1e-9))/least(1e0, greatest(5e-2, fr_air)))) END AS rlg,
  CASE WHEN Tin_C IS NULL THEN 1 WHEN twb_C IS NULL THEN 2 WHEN total_kgps IS NULL THEN 3 WHEN nfan IS NULL THEN 4 WHEN Tout_C IS NULL THEN 5 WHEN NOT total_kgps>1 THEN 6
   WHEN NOT coalesce(fr_air>5e-2,false) THEN 7 WHEN TRan_C<=0 THEN 8 WHEN TApp_C<=0 THEN 9 END AS failed FROM cf1)"""
CTT_SQL = CTF_SQL + """,
cv AS (SELECT *, quantile_cont(total_kgps,0.9) OVER (PARTITION BY device_id) AS p90 FROM cf WHERE failed IS NULL),
cw1 AS (SELECT *, min(ts_s) OVER (PARTITION BY device_id) AS t0 FROM cv WHERE total_kgps>=greatest(1e0, 25e-2*p90)),
ctt AS (SELECT site, device_id, ts_s, (ts_s-t0)*1e0 AS time_s, Tin_C, Tout_C AS Tout_meas_C, twb_C AS Twb_C, TRan_C, TApp_C AS TAppAct_C, total_kgps/nfan AS mdot_cell_kgps,
  least(1e0, greatest(0e0, fan_hz/5e1)) AS y_used, fan_hz AS fanHz, nfan AS fans_on_count, total_kgps*4180*TRan_C AS Q_flow_W, power_W AS PFan_meas_W FROM cw1 WHERE power_W IS NOT NULL)"""
PUT_SQL = ATT_SQL + """,
pu0 AS (SELECT *, coalesce(power_W>0 AND speed_Hz>5e-1, false) AS rn, attributed_flow_m3_h*1e3/36e2 AS m FROM att WHERE equipment_type='pump'),
pu1 AS (SELECT *, count(CASE WHEN rn AND m>0 THEN 1 END) OVER (PARTITION BY device_id)/greatest(count(CASE WHEN rn THEN 1 END) OVER (PARTITION BY device_id),1) AS cov FROM pu0),
pu2 AS (SELECT site, device_id, ts_s, CASE WHEN cov>=5e-1 THEN m ELSE 1e0 END AS m_flow_in, cov>=5e-1 AND coalesce(m>0,false) AS flow_observed, greatest(speed_Hz/5e1,0) AS y_in, power_W AS P_meas_W FROM pu1 WHERE rn),
put AS (SELECT *, (ts_s-min(ts_s) OVER (PARTITION BY device_id))*1e0 AS time_s FROM pu2 WHERE m_flow_in IS NOT NULL)"""


def _dirsql():
    m1, m2 = "chw_flow_m3_h*1e3/36e2", "cw_flow_m3_h*1e3/36e2"
    outs = []
    for i, ((ai, ao), (bi, bo)) in enumerate(ft.DIRECTIONS):
        outs.append(f"count(CASE WHEN {m1}>1 AND {m2}>1 AND {m1}*4186*({ai}-{ao})>5e3 AND {m2}*4186*({bo}-{bi})>5e3 THEN 1 END) AS n{i}")
    return ", ".join(outs)


def _pick(side, end):
    return "CASE direction " + " ".join(f"WHEN {i} THEN {d[side][end]}" for i, d in enumerate(ft.DIRECTIONS)) + " END"


HXT_SQL = ATT_SQL + f""",
hd AS (SELECT site, device_id, CASE greatest(n0,n1,n2,n3) WHEN n0 THEN 0 WHEN n1 THEN 1 WHEN n2 THEN 2 ELSE 3 END AS direction, greatest(n0,n1,n2,n3) AS usable_rows FROM
  (SELECT site, device_id, {_dirsql()} FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts_s) AS i, count(*) OVER (PARTITION BY device_id) AS n FROM att WHERE equipment_type='heat_exchanger') WHERE i<=greatest(1, floor(n*6e-1)) GROUP BY 1,2)),
h0 AS (SELECT att.*, {_pick(0, 0)} AS T1In_C, {_pick(0, 1)} AS T1Out_C, {_pick(1, 0)} AS T2In_C, {_pick(1, 1)} AS T2Out_C, chw_flow_m3_h*1e3/36e2 AS m1_kgps, cw_flow_m3_h*1e3/36e2 AS m2_kgps FROM att JOIN hd USING (site, device_id)),
h1 AS (SELECT site, device_id, ts_s, T1In_C, T1Out_C, T2In_C, T2Out_C, m1_kgps, m2_kgps, m1_kgps*4186*(T1In_C-T1Out_C) AS Q1_W, m2_kgps*4186*(T2Out_C-T2In_C) AS Q2_W FROM h0),
h2 AS (SELECT *, (Q1_W+Q2_W)/2 AS qm, abs(T1In_C-T2Out_C) AS da, abs(T1Out_C-T2In_C) AS db FROM h1 WHERE m1_kgps>1 AND m2_kgps>1 AND T1In_C-T1Out_C>5e-2 AND T2Out_C-T2In_C>5e-2 AND Q1_W>5e3 AND Q2_W>5e3
  AND abs(Q1_W-Q2_W)/nullif(greatest(abs(Q1_W),abs(Q2_W)),0)<=5e-1),
hxt AS (SELECT * EXCLUDE (qm), qm AS Q_W, coalesce(least(15e-1, greatest(0, abs(qm)/(least(m1_kgps,m2_kgps)*4186*nullif(abs(T1In_C-T2In_C),0)))),0) AS eps,
  coalesce(CASE WHEN da>0 AND db>0 AND abs(da-db)<1e-9 THEN (da+db)/2 WHEN da>0 AND db>0 THEN (da-db)/ln(da/db) END,0) AS dT_lm, (ts_s-min(ts_s) OVER (PARTITION BY device_id))*1e0 AS time_s FROM h2)"""


@staged("chiller_table")
def chiller_table(spark, d):
    return ft.chiller_table(steady(spark, d))


@staged("ct_features")
def ct_features(spark, d):
    return ft.ct_features(bind.attributed(spark, d).where("equipment_type = 'cooling_tower'"))


@staged("ct_table")
def ct_table(spark, d):
    return ft.ct_table(ct_features(spark, d))


@staged("pump_table")
def pump_table(spark, d):
    return ft.pump_table(bind.attributed(spark, d).where("equipment_type = 'pump'"))


def hx_direction(spark, d):
    from fleetgauge.operators import ordered
    h = bind.attributed(spark, d).where("equipment_type = 'heat_exchanger'")
    r = ordered.ordinal(h, KEYS, ["ts"], ordered.day_chunk(), "rn").join(h.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")), KEYS)
    return ft.hx_direction(r.where(F.col("rn") < F.greatest(F.lit(1), F.floor(F.col("n") * 0.6))))


@staged("hx_table")
def hx_table(spark, d):
    return ft.hx_table(bind.attributed(spark, d).where("equipment_type = 'heat_exchanger'"), hx_direction(spark, d))


def _cols(names, digits=6):
    return ", ".join(f"{R(n, digits)} AS {n}" for n in names)


CH = ["CHWS", "CHWR", "CDWS", "CDWR", "CHW", "CDW", "P_kW", "dT_chw", "dT_cdw", "Q_evap_kW"]


@query("g01_chiller_table", with_(CHT_SQL, body=f"SELECT site, device_id, ts_s, {_cols(CH, 7)} FROM cht"))
def g01(spark, d):
    return rounded(chiller_table(spark, d).select(*KEYS, F.unix_seconds("ts").alias("ts_s"), *CH), _=7)


@query("g02_chiller_nominals", with_(CHT_SQL, f"""top AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY Q_evap_kW DESC, ts_s) AS o, min(CHWS) OVER w AS a, max(CHWS) OVER w AS b, min(CDWS) OVER w AS c, max(CDWS) OVER w AS e,
 min(Q_evap_kW) OVER w AS qm FROM cht WINDOW w AS (PARTITION BY device_id))""", body=f"""SELECT site, device_id, {R('Q_evap_kW*(-1e3)', 3)} AS QEva_flow_nominal, {R('Q_evap_kW/P_kW')} AS COP_nominal, {R('CHW')} AS mEva_flow_nominal, {R('CDW')} AS mCon_flow_nominal,
 {R('CHWS+27315e-2')} AS TEvaLvg_nominal, {R('a+27315e-2')} AS TEvaLvgMin, {R('b+27315e-2')} AS TEvaLvgMax, {R('CDWS+27315e-2')} AS TCon_nominal, {R('c+27315e-2')} AS TConMin, {R('e+27315e-2')} AS TConMax,
 115e-2 AS PLRMax, {R('greatest(5e-2, qm/Q_evap_kW)')} AS PLRMin FROM top WHERE o=1"""))
def g02(spark, d):
    return rounded(ft.chiller_nominals(chiller_table(spark, d)), QEva_flow_nominal=3)


CF = ["Tin_C", "Tout_C", "total_kgps", "nfan", "fan_hz", "fr_air", "TRan_C", "TApp_C", "rlg"]


@query("g03_ct_features", with_(CTF_SQL, body=f"SELECT site, device_id, ts_s, {_cols(CF)} FROM cf"))
def g03(spark, d):
    return rounded(ct_features(spark, d).select(*KEYS, "ts_s", *CF))


CT = ["time_s", "Tin_C", "Tout_meas_C", "Twb_C", "TRan_C", "TAppAct_C", "mdot_cell_kgps", "y_used", "fanHz", "fans_on_count", "PFan_meas_W"]


@query("g04_ct_table", with_(CTT_SQL, body=f"SELECT site, device_id, ts_s, {_cols(CT)}, {R('Q_flow_W', 4)} AS Q_flow_W FROM ctt"))
def g04(spark, d):
    return rounded(ct_table(spark, d).select(*KEYS, F.unix_seconds("ts").alias("ts_s"), *CT, "Q_flow_W"), Q_flow_W=4)


CTB_SQL = CTT_SQL + """,
ctb AS (SELECT site, device_id, median(mdot_cell_kgps) AS m_flow_nominal, median(Twb_C)+27315e-2 AS TAirInWB_nominal, greatest(2e-1, median(TAppAct_C)) AS TApp_nominal, greatest(3e-1, median(TRan_C)) AS TRan_nominal,
 median(Tin_C)+27315e-2 AS TWatIn_nominal, median(Tout_meas_C)+27315e-2 AS TWatOut_nominal FROM ctt GROUP BY 1,2)"""


@query("g05_ct_base_values", with_(CTB_SQL, body=f"SELECT site, device_id, {_cols(['m_flow_nominal', 'TAirInWB_nominal', 'TApp_nominal', 'TRan_nominal', 'TWatIn_nominal', 'TWatOut_nominal'])}, 5e-2 AS yMin, 1e0 AS nFan, 1e-1 AS fraFreCon FROM ctb"))
def g05(spark, d):
    return rounded(ft.ct_base_values(ct_table(spark, d)))


ALPHAS = (1.2, 1.6, 2.0, 2.5, 3.0)


@query("g06_fan_nominal", with_(CTT_SQL, body=f"""SELECT site, device_id, alpha, {R('coalesce(median(CASE WHEN e>0 THEN e END), median(PFan_meas_W))', 4)} AS PFan_nominal FROM (SELECT *, PFan_meas_W/(greatest(fans_on_count,1)*pow(least(1e0,greatest(5e-2,y_used)),alpha)) AS e
 FROM ctt CROSS JOIN (SELECT unnest([12e-1,16e-1,2e0,25e-1,3e0]) AS alpha)) GROUP BY 1,2,3"""))
def g06(spark, d):
    return rounded(ft.fan_nominal(ct_table(spark, d), ALPHAS), PFan_nominal=4)


@query("g07_pump_table", with_(PUT_SQL, body=f"SELECT site, device_id, ts_s, time_s, {_cols(['m_flow_in', 'y_in', 'P_meas_W'])}, flow_observed FROM put"))
def g07(spark, d):
    return rounded(pump_table(spark, d).select(*KEYS, F.unix_seconds("ts").alias("ts_s"), "time_s", "m_flow_in", "y_in", "P_meas_W", "flow_observed"))


@query("g08_pump_nominals", with_(PUT_SQL, body=f"SELECT site, device_id, {R('quantile_cont(P_meas_W,0.95)', 4)} AS P_nominal, {R('quantile_cont(m_flow_in,0.95)')} AS m_flow_nominal, 5e-2 AS y_min, 12e-1 AS y_max FROM put GROUP BY 1,2"))
def g08(spark, d):
    return rounded(ft.pump_nominals(pump_table(spark, d)), P_nominal=4)


@query("g09_hx_direction", with_(HXT_SQL, body="SELECT site, device_id, direction::BIGINT AS direction, usable_rows FROM hd"))
def g09(spark, d):
    return rounded(hx_direction(spark, d))


HX = ["T1In_C", "T1Out_C", "T2In_C", "T2Out_C", "m1_kgps", "m2_kgps", "eps", "dT_lm", "time_s"]


@query("g10_hx_table", with_(HXT_SQL, body=f"SELECT site, device_id, ts_s, {_cols(HX)}, {R('Q_W', 5)} AS Q_W FROM hxt"))
def g10(spark, d):
    return rounded(hx_table(spark, d).select(*KEYS, F.unix_seconds("ts").alias("ts_s"), *HX, "Q_W"), Q_W=5)


@query("g11_lmtd", with_(ATT_SQL, body=f"""SELECT site, device_id, ts_s, {R('CASE WHEN a>0 AND b>0 AND abs(a-b)<1e-9 THEN (a+b)/2 WHEN a>0 AND b>0 THEN (a-b)/ln(a/b) END')} AS lmtd FROM
 (SELECT *, tcwr_C-tchws_C AS a, tcws_C-tchwr_C AS b FROM att WHERE equipment_type='chiller')"""))
def g11(spark, d):
    c = bind.attributed(spark, d).where("equipment_type = 'chiller'")
    return rounded(c.select(*KEYS, "ts_s", ft.lmtd(F.col("tcwr_C") - F.col("tchws_C"), F.col("tcws_C") - F.col("tchwr_C")).alias("lmtd")))


@query("g12_heat_balance_ratio", with_(ATT_SQL, body=f"SELECT site, device_id, ts_s, {R('abs(Q_W-Q_cond_W)/nullif(greatest(abs(Q_W),abs(Q_cond_W)),0)')} AS ratio FROM att WHERE equipment_type='heat_exchanger' AND Q_W IS NOT NULL AND Q_cond_W IS NOT NULL"))
def g12(spark, d):
    h = bind.attributed(spark, d).where("equipment_type = 'heat_exchanger' AND Q_W IS NOT NULL AND Q_cond_W IS NOT NULL")
    return rounded(h.select(*KEYS, "ts_s", ft.heat_balance_ratio("Q_W", "Q_cond_W").alias("ratio")))


HXN_SQL = HXT_SQL + """,
hxn AS (SELECT site, device_id, quantile_cont(m1_kgps,0.95) AS m1_flow_nominal, quantile_cont(m2_kgps,0.95) AS m2_flow_nominal, quantile_cont(abs(Q_W),0.95) AS Q_flow_nominal,
 coalesce(median(least(98e-2, greatest(5e-2, abs(Q_W)/(least(m1_kgps,m2_kgps)*4186*nullif(abs(T1In_C-T2In_C),0))))),8e-1) AS eps_nominal,
 median(T1In_C)+27315e-2 AS T_a1_nominal, median(T1Out_C)+27315e-2 AS T_b1_nominal, median(T2In_C)+27315e-2 AS T_a2_nominal, median(T2Out_C)+27315e-2 AS T_b2_nominal FROM hxt GROUP BY 1,2)"""


@query("g13_hx_nominals", with_(HXN_SQL, body=f"SELECT site, device_id, {_cols(['m1_flow_nominal', 'm2_flow_nominal', 'eps_nominal', 'T_a1_nominal', 'T_b1_nominal', 'T_a2_nominal', 'T_b2_nominal'])}, {R('Q_flow_nominal', 4)} AS Q_flow_nominal FROM hxn"))
def g13(spark, d):
    return rounded(ft.hx_nominals(hx_table(spark, d)), Q_flow_nominal=4)


_NO = {f: sorted({*p["nominal"], "cooling_load_W", "power_W_recon"}) for f, p in PROFILES.items()}


@query("g14_nominal_only_params", with_(ATT_SQL, "nl AS (" + " UNION ALL ".join(f"SELECT site, device_id, '{r}' AS role, {r} AS v FROM att WHERE equipment_type='{f}'" for f, rs in _NO.items() for r in rs) + "),\nnq AS (SELECT site, device_id, role, quantile_cont(v,0.95) AS a, median(v) AS b FROM nl WHERE v IS NOT NULL GROUP BY 1,2,3)",
                                        body=f"SELECT site, device_id, concat(role, '_p95') AS param, {R('a', 4)} AS value FROM nq UNION ALL SELECT site, device_id, concat(role, '_median'), {R('b', 4)} FROM nq"))
def g14(spark, d):
    p = ft.nominal_only_params(bind.attributed(spark, d))
    return rounded(p.select(*KEYS, F.explode("params").alias("param", "value")), _=4)


# ---- attrition --------------------------------------------------------------------------------------
_CT = [("entering water temperature present", "missing_channel", "gate"), ("wet-bulb temperature present", "missing_channel", "gate"), ("attributed flow present", "missing_channel", "gate"),
       ("active fan count present", "missing_channel", "gate"), ("leaving water temperature present", "missing_reference", "gate"), ("total water flow above 1 kg/s", "operating_state", "gate"),
       ("fans running", "operating_state", "gate"), ("leaving water hotter than entering (range <= 0)", "physically_impossible", "quarantine"),
       ("leaving water at or below wet bulb (approach <= 0)", "physically_impossible", "quarantine")]


def _steps(rows):
    return "(VALUES (0,'raw records','source',''), " + ", ".join(f"({i + 1},'{a}','{b}','{c}')" for i, (a, b, c) in enumerate(rows)) + ") AS s(ord, name, category, kind)"


def _fall(src, rows):
    """SQL twin of a waterfall over a relation with a ``failed`` step number."""
    return f"""SELECT t.site, t.device_id, t.equipment_type, s.ord::BIGINT AS ord, s.name, s.category, s.kind, coalesce(x.c,0) AS removed, t.n-coalesce(sum(x.c) OVER (PARTITION BY t.device_id ORDER BY s.ord),0)::BIGINT AS remaining, t.n AS n
 FROM (SELECT site, device_id, equipment_type, count(*) AS n FROM {src} GROUP BY 1,2,3) t CROSS JOIN {_steps(rows)} LEFT JOIN (SELECT device_id, failed, count(*) AS c FROM {src} GROUP BY 1,2) x ON x.device_id=t.device_id AND x.failed=s.ord"""


FALL_SQL = CTF_SQL + f",\nfall AS ({_fall('cf', _CT)})"
_F = f"site, device_id, equipment_type, ord, name, category, kind, removed, remaining, {R('1e2*remaining/n')} AS retained_pct"


@query("h01_attrition_waterfall", with_(FALL_SQL, body=f"SELECT {_F} FROM fall WHERE ord<>9"))
def h01(spark, d):
    """The ledger of all criteria but the last, on its own list of rules."""
    return rounded(al.waterfall(ct_features(spark, d), al.tower_criteria()[:-1]))


@query("h02_attrition_summary", with_(FALL_SQL, body=f"""SELECT site, device_id, equipment_type, n AS n_total, min(remaining) AS n_retained, {R('1e2*min(remaining)/n')} AS retained_pct, sum(CASE WHEN kind='gate' THEN removed ELSE 0 END)::BIGINT AS removed_by_gate,
 sum(CASE WHEN kind='quarantine' THEN removed ELSE 0 END)::BIGINT AS removed_by_quarantine, max(CASE WHEN ord=8 THEN removed END) AS q_range, max(CASE WHEN ord=9 THEN removed END) AS q_approach FROM fall GROUP BY site, device_id, equipment_type, n"""))
def h02(spark, d):
    s = al.summary(ct_features(spark, d), al.tower_criteria())
    q = F.col("quarantined")
    return rounded(s.withColumns({"q_range": q[_CT[7][0]], "q_approach": q[_CT[8][0]]}).drop("quarantined"))


@query("h03_ct_attrition_rules", with_(FALL_SQL, body=f"SELECT {_F} FROM fall"))
def h03(spark, d):
    return rounded(al.waterfall(ct_features(spark, d), al.tower_criteria()))


def _generic(fam):
    req = PROFILES[fam]["required"]
    case = "CASE " + " ".join(f"WHEN {r} IS NULL THEN {i + 1}" for i, r in enumerate(req)) + f" WHEN NOT coalesce(run_signal>5e-1,false) THEN {len(req) + 1} END"
    rows = [(f"{r} present", "missing_channel", "gate") for r in req] + [("device running", "operating_state", "gate")]
    return f"g_{fam} AS (SELECT *, {case} AS failed FROM att WHERE equipment_type='{fam}')", _fall(f"g_{fam}", rows)


_G = [_generic(f) for f in ("chiller", "pump", "heat_exchanger")]
GEN_SQL = ATT_SQL + ",\n" + ",\n".join(a for a, _ in _G) + ",\nfall AS (" + " UNION ALL ".join(b for _, b in _G) + ")"


def generic(spark, d):
    a = bind.attributed(spark, d)
    parts = [al.waterfall(a.where(F.col("equipment_type") == f), al.generic_criteria(a, f)) for f in ("chiller", "pump", "heat_exchanger")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("h04_generic_attrition", with_(GEN_SQL, body=f"SELECT {_F} FROM fall"))
def h04(spark, d):
    return rounded(generic(spark, d))


@query("h05_family_waterfall", with_(GEN_SQL, body=f"""SELECT equipment_type, ord, name, category, kind, removed, {R('1e2*removed/raw')} AS pct_of_raw, remaining, {R('1e2*remaining/raw')} AS retained_pct FROM
 (SELECT *, raw-sum(removed) OVER (PARTITION BY equipment_type ORDER BY ord)::BIGINT AS remaining FROM (SELECT equipment_type, ord, name, category, kind, sum(removed)::BIGINT AS removed FROM fall WHERE ord>0 GROUP BY 1,2,3,4,5)
  JOIN (SELECT equipment_type, sum(remaining)::BIGINT AS raw FROM fall WHERE ord=0 GROUP BY 1) USING (equipment_type))"""))
def h05(spark, d):
    return rounded(al.family_waterfall(generic(spark, d)))


@query("h06_quarantine_by_device", with_(FALL_SQL, body=f"""SELECT site, device_id, n AS n_total, sum(CASE WHEN kind='quarantine' THEN removed ELSE 0 END)::BIGINT AS quarantined_total,
 {R("1e2*sum(CASE WHEN kind='quarantine' THEN removed ELSE 0 END)/n")} AS quarantined_pct_of_raw FROM fall GROUP BY site, device_id, n"""))
def h06(spark, d):
    return rounded(al.quarantine_by_device(al.summary(ct_features(spark, d), al.tower_criteria())))


