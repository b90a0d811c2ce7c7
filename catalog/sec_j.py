"""Fitting, prediction, selection."""

from itertools import permutations

from pyspark.sql import functions as F

from catalog import bind
from catalog.bind import KEYS, MASK_SQL, staged, with_
from catalog.registry import R, query, rounded
from catalog.sec_gh import CHT_SQL, CTB_SQL, CTT_SQL, HXN_SQL, HXT_SQL, PUT_SQL, chiller_table, ct_table, hx_table, pump_table
from catalog.sec_k import met_sql, out_cols, power_pairs
from catalog.sec_k import PAIR_SQL as KP_SQL
from fleetgauge.functions import metrics as mx
from fleetgauge.functions import models as md
from fleetgauge.functions.lineage import settle
from fleetgauge.functions.cols import dbl
from fleetgauge.operators import evaluate as ev
from fleetgauge.operators import features as ft
from fleetgauge.operators import fit
from fleetgauge.operators import splits as sp


# ---- SQL helpers ------------------------------------------------------------------------------------
def _det(m):
    n, terms = len(m), []
    for p in permutations(range(n)):
        inv = sum(1 for i in range(n) for j in range(i) if p[j] > p[i])
        terms.append(("-" if inv % 2 else "+") + "*".join(m[i][p[i]] for i in range(n)))
    return "(" + "".join(terms) + ")"


def ols_sql(src, keys, feats, target, where="true"):
    """Least squares by Cramer's rule on the Gram sums: columns b0..bk-1 and n_train."""
    k, ks = len(feats), ", ".join(keys)
    g = [[f"g{min(i, j)}_{max(i, j)}" for j in range(k)] for i in range(k)]
    sums = ", ".join([f"sum(({feats[i]})*({feats[j]})) AS g{i}_{j}" for i in range(k) for j in range(i, k)] + [f"sum(({feats[i]})*({target})) AS h{i}" for i in range(k)])
    sols = ", ".join(f"{_det([[f'h{r}' if c == i else g[r][c] for c in range(k)] for r in range(k)])}/nullif({_det(g)},0) AS b{i}" for i in range(k))
    return f"(SELECT {ks}, n_train, {sols} FROM (SELECT {ks}, count(*) AS n_train, {sums} FROM {src} WHERE {where} GROUP BY {ks}))"


def pred_sql(feats):
    return "greatest(" + "+".join(f"b{i}*({f})" for i, f in enumerate(feats)) + ",0e0)"


_W, _Q, _SW = "(speed_Hz/5e1)", "(attributed_flow_m3_h/1e2)", "((fan1_Hz/5e1)*(fan1_Hz/5e1)*(fan1_Hz/5e1)+(fan2_Hz/5e1)*(fan2_Hz/5e1)*(fan2_Hz/5e1))"
FORM_SQL = {"affinity_power": [f"{_W}*{_W}*{_W}"], "speed_poly_power": ["1e0", _W, f"{_W}*{_W}", f"{_W}*{_W}*{_W}"], "speed_flow_power": ["1e0", f"{_W}*{_W}*{_W}", _Q, f"{_Q}*{_Q}"],
            "fan_affinity_power": [_SW], "fan_affinity_intercept": ["1e0", _SW], "fan_flow_power": ["1e0", _SW, _Q, f"{_Q}*{_Q}"]}
# the same spans on centred variables: Cramer's rule on raw powers loses digits
_V, _U = f"({_W}-7e-1)", f"({_Q}-5e0)"
FIT_SQL = {**FORM_SQL, "speed_poly_power": ["1e0", _V, f"{_V}*{_V}", f"{_V}*{_V}*{_V}"], "speed_flow_power": ["1e0", f"{_W}*{_W}*{_W}", _U, f"{_U}*{_U}"], "fan_flow_power": ["1e0", _SW, _U, f"{_U}*{_U}"]}
PUMPS = ["affinity_power", "speed_poly_power", "speed_flow_power"]
FANS = ["fan_affinity_power", "fan_affinity_intercept", "fan_flow_power"]
MIN_ROWS = 40


def calib_sql():
    parts = []
    for n, feats in FIT_SQL.items():
        fam = "pump" if n in PUMPS else "cooling_tower"
        ok = " AND ".join(f"{c} IS NOT NULL" for c in fit.FORM_INPUTS[n])
        parts.append(f"""c_{n} AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts_s)-1 AS rn, count(*) OVER (PARTITION BY device_id) AS nv FROM mk WHERE equipment_type='{fam}' AND operating AND power_W IS NOT NULL AND {ok}),
p_{n} AS {ols_sql(f'c_{n}', KEYS, feats, 'power_W', f'nv>={MIN_ROWS} AND rn%3<>0')},
s_{n} AS (SELECT c.site, c.device_id, '{n}' AS candidate, c.ts_s, c.power_W AS measured, {pred_sql(feats)} AS simulated FROM c_{n} c JOIN p_{n} p ON p.device_id=c.device_id WHERE rn%3=0)""")
    alls = " UNION ALL ".join(f"SELECT * FROM s_{n}" for n in FORM_SQL)
    cnt = " UNION ALL ".join(f"SELECT d.site, d.device_id, '{n}' AS candidate, coalesce(c.k,0) AS n_valid, p.n_train FROM (SELECT DISTINCT site, device_id FROM mk WHERE equipment_type='{'pump' if n in PUMPS else 'cooling_tower'}') d LEFT JOIN (SELECT device_id, count(*) AS k FROM c_{n} GROUP BY 1) c ON c.device_id=d.device_id LEFT JOIN p_{n} p ON p.device_id=d.device_id" for n in FORM_SQL)
    return MASK_SQL + ",\n" + ",\n".join(parts) + f",\nscored AS ({alls}),\ncnts AS ({cnt}),\nmets AS (SELECT c.*, m.* EXCLUDE (site, device_id, candidate), CASE WHEN n_valid<{MIN_ROWS} THEN 'insufficient_rows' ELSE 'ok' END AS status FROM cnts c LEFT JOIN {met_sql('scored', [*KEYS, 'candidate'], 'measured', 'simulated')} m ON m.device_id=c.device_id AND m.candidate=c.candidate)"


CAL_SQL = calib_sql()
_POS = "list_position([" + ",".join(f"'{c}'" for c in FORM_SQL) + "], candidate)"
SEL_SQL = CAL_SQL + f",\nsel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY round(MAPE_pct+137e-11,6), {_POS}) AS o FROM mets WHERE MAPE_pct IS NOT NULL) WHERE o=1)"


def _calibrate(spark, d):
    m = bind.masked(spark, d)
    a = fit.calibrate_power_models(m.where("equipment_type = 'pump'"), fit.pump_forms(), MIN_ROWS)
    b = fit.calibrate_power_models(m.where("equipment_type = 'cooling_tower'"), fit.fan_forms(), MIN_ROWS)
    return a[0].unionByName(b[0]), a[1].unionByName(b[1])


_CALIBRATED: dict = {}


def _calibrated(spark, d):
    """Both tables of one calibration, which is run once per application and input folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _CALIBRATED:
        scores, rows = _calibrate(spark, d)
        _CALIBRATED[key] = settle(scores, "calibration"), settle(rows, "holdout")
    return _CALIBRATED[key]


def calibration(spark, d):
    return _calibrated(spark, d)[0]


def holdout(spark, d):
    return _calibrated(spark, d)[1]


def selected(spark, d):
    m = calibration(spark, d).withColumn("MAPE_round", F.round(F.col("MAPE_pct") + 137e-11, 6))
    return fit.candidate_argmin(m, "MAPE_round", list(FORM_SQL))


AFF = ["1e0", _W, f"{_W}*{_W}"]


@query("j01_grouped_ols", with_(MASK_SQL, body=f"SELECT site, device_id, n_train, {R('b0', 2)} AS b0, {R('b1', 2)} AS b1, {R('b2', 2)} AS b2 FROM {ols_sql('mk', KEYS, AFF, 'power_W', 'operating AND power_W IS NOT NULL AND speed_Hz IS NOT NULL')}"))
def j01(spark, d):
    w = F.col("speed_Hz") / dbl(50.0)
    m = bind.masked(spark, d).where("operating AND power_W IS NOT NULL AND speed_Hz IS NOT NULL")
    o = fit.grouped_ols(m, KEYS, {"b0": dbl(1.0), "b1": w, "b2": w * w}, F.col("power_W"))
    return rounded(o.select(*KEYS, "n_train", *[F.col("params")[b].alias(b) for b in ("b0", "b1", "b2")]), _=2)


@query("j02_pump_power_forms", with_(MASK_SQL, body=f"SELECT site, device_id, ts_s, {R(FORM_SQL['speed_poly_power'][1])} AS w, {R(FORM_SQL['speed_poly_power'][2])} AS w2, {R(FORM_SQL['affinity_power'][0])} AS w3, {R(_Q)} AS q, {R(f'{_Q}*{_Q}')} AS q2 FROM mk WHERE equipment_type='pump'"))
def j02(spark, d):
    p, s = fit.pump_forms(), fit.pump_forms()["speed_flow_power"]
    m = bind.masked(spark, d).where("equipment_type = 'pump'")
    return rounded(m.select(*KEYS, "ts_s", p["speed_poly_power"]["w"].alias("w"), p["speed_poly_power"]["w2"].alias("w2"), p["affinity_power"]["w3"].alias("w3"), s["q"].alias("q"), s["q2"].alias("q2")))


@query("j03_fan_power_forms", with_(MASK_SQL, body=f"SELECT site, device_id, ts_s, {R(_SW)} AS sum_w3, {R(_Q)} AS q, {R(f'{_Q}*{_Q}')} AS q2 FROM mk WHERE equipment_type='cooling_tower'"))
def j03(spark, d):
    p = fit.fan_forms()["fan_flow_power"]
    return rounded(bind.masked(spark, d).where("equipment_type = 'cooling_tower'").select(*KEYS, "ts_s", *[p[c].alias(c) for c in ("sum_w3", "q", "q2")]))


@query("j04_predict_power", with_(CAL_SQL, body=f"SELECT site, device_id, candidate, ts_s, {R('simulated', 1)} AS simulated FROM scored"))
def j04(spark, d):
    return rounded(holdout(spark, d).select(*KEYS, "candidate", F.unix_seconds("ts").alias("ts_s"), "simulated"), _=1)


_MC = ["RMSE", "MAE", "MAPE_pct", "CVRMSE_pct", "NMBE_pct", "skill"]


@query("j05_calibrate_power_models", with_(CAL_SQL, body=f"SELECT site, device_id, candidate, n_valid, n_train, status, N, {out_cols(['RMSE', 'MAE'], 1)}, {out_cols(_MC[2:], 3)} FROM mets"))
def j05(spark, d):
    return rounded(calibration(spark, d).select(*KEYS, "candidate", "n_valid", "n_train", "status", "N", *_MC), _=3, RMSE=1, MAE=1)


# ---- pump ---------------------------------------------------------------------------------------------
_PHI = "greatest(m_flow_in/greatest(mn,1e-6),0e0)"
NFORM = {"affinity": ["y_in*y_in*y_in"], "speed_poly": ["1e0", "y_in", "y_in*y_in*y_in"], "speed_flow": ["1e0", _PHI, "y_in", "y_in*y_in*y_in", f"{_PHI}*y_in"]}
SLOTS = {"affinity": [3], "speed_poly": [0, 2, 3], "speed_flow": [0, 1, 2, 3, 4]}
CHR = """row_number() OVER (PARTITION BY device_id ORDER BY ts_s)-1 AS rn, count(*) OVER (PARTITION BY device_id) AS n"""
SEG = "CASE WHEN n<5 THEN NULL WHEN rn<greatest(1, floor(n*6e-1)) THEN 'identification' WHEN rn<least(greatest(greatest(1, floor(n*6e-1))+1, floor(n*8e-1)), n-1) THEN 'selection' ELSE 'test' END AS segment"
_cs = {f: [(f"b{SLOTS[f].index(i)}" if i in SLOTS[f] else "0e0") for i in range(5)] for f in NFORM}
PSEL_SQL = PUT_SQL + f""",
pv0 AS (SELECT *, {CHR} FROM put), pv1 AS (SELECT *, {SEG} FROM pv0),
pnm AS (SELECT device_id AS dn, quantile_cont(P_meas_W,0.95) AS pn, quantile_cont(m_flow_in,0.95) AS mn FROM pv1 WHERE segment='identification' GROUP BY 1),
pfo AS (SELECT device_id AS df, avg(CASE WHEN flow_observed THEN 1e0 ELSE 0e0 END)>=5e-1 AS flow_ok FROM pv1 GROUP BY 1),
pv AS (SELECT * FROM pv1 JOIN pnm ON dn=device_id JOIN pfo ON df=device_id),
""" + ",\n".join(f"pf_{f} AS {ols_sql('pv', KEYS, NFORM[f], 'P_meas_W/greatest(pn,1e-6)', chr(115) + 'egment=' + chr(39) + 'identification' + chr(39))}" for f in NFORM) + ",\npfc AS (" + " UNION ALL ".join(
    f"SELECT site, device_id, '{f}' AS candidate, " + ", ".join(f"{c} AS c{i}" for i, c in enumerate(_cs[f])) + f" FROM pf_{f}" for f in NFORM) + """),
psim AS (SELECT pv.site, pv.device_id, c.candidate, segment AS stage, P_meas_W, greatest(0e0, pn*(c0+c1*phi+c2*ys+c3*ys*ys*ys+c4*phi*ys)) AS P_s FROM (SELECT *, least(12e-1, greatest(y_in,5e-2)) AS ys, greatest(greatest(m_flow_in,0)/greatest(mn,1e-6),0e0) AS phi FROM pv) pv
 JOIN pfc c ON c.device_id=pv.device_id WHERE segment IN ('selection','test') AND (c.candidate<>'speed_flow' OR flow_ok))"""


@query("j06_pump_normalised_fit", with_(PSEL_SQL, body=f"SELECT site, device_id, candidate, {', '.join(f'{R(f'c{i}', 4)} AS c{i}' for i in range(5))} FROM pfc WHERE candidate<>'speed_flow'"))
def j06(spark, d):
    t = sp.chronological_split(pump_table(spark, d)).where("segment = 'identification'")
    p = fit.pump_normalised_fit(t, ft.pump_nominals(t)).where("candidate <> 'speed_flow'")  # rank-deficient where the flow is constant
    return rounded(p.select(*KEYS, "candidate", *[F.col("c")[i].alias(f"c{i}") for i in range(5)]), _=4)


@query("j06_pump_flow_form")
def j06_all(spark, d):
    """All forms; where the flow is constant ``speed_flow`` is rank deficient and its coefficients are the solver's choice, so no twin."""
    t = sp.chronological_split(pump_table(spark, d)).where("segment = 'identification'")
    return rounded(fit.pump_normalised_fit(t, ft.pump_nominals(t)).select(*KEYS, "candidate", *[F.col("c")[i].alias(f"c{i}") for i in range(5)]), _=4)


@query("j07_scale_fit", with_(KP_SQL, body=f"""SELECT site, device_id, n, {R("CASE WHEN n<2 OR b IS NULL OR b<1e-9 THEN 1e0 ELSE a/b END")} AS scale FROM (SELECT site, device_id, count(CASE WHEN s>0 AND m IS NOT NULL THEN 1 END) AS n, sum(CASE WHEN s>0 THEN m*s END) AS a, sum(CASE WHEN s>0 AND m IS NOT NULL THEN s*s END) AS b FROM pp GROUP BY 1,2)"""))
def j07(spark, d):
    return rounded(fit.scale_fit(power_pairs(spark, d), KEYS, "m", "s"))


@staged("pump_selection")
def pump_stages(spark, d):
    return fit.pump_model_selection(pump_table(spark, d))


@query("j08_pump_model_selection", with_(PSEL_SQL, body=f"SELECT site, device_id, candidate, stage, N, {out_cols(['CVRMSE_pct', 'NMBE_pct', 'skill'], 3)} FROM {met_sql('psim', [*KEYS, 'candidate', 'stage'], 'P_meas_W', 'P_s')}"))
def j08(spark, d):
    return rounded(pump_stages(spark, d), _=3)


@query("k10_pump_score", with_(PSEL_SQL, body=f"SELECT site, device_id, candidate, N, {out_cols(['CVRMSE_pct', 'NMBE_pct', 'skill'], 3)} FROM {met_sql('psim', [*KEYS, 'candidate', 'stage'], 'P_meas_W', 'P_s')} WHERE stage='test'"))
def k10(spark, d):
    return rounded(pump_stages(spark, d).where("stage = 'test'").drop("stage"), _=3)


# ---- heat exchanger -----------------------------------------------------------------------------------
def hx_sql(eps, where="true", q="qs"):
    cmin = "least(m1_kgps,m2_kgps)*4186"
    return f"least(greatest({eps},0e0),1e0)*{cmin}*greatest(T1In_C-T2In_C,0e0)"


_EPSV, _QV, _FV = [0.75, 0.9, 1.0, 1.1, 1.25], [0.7, 1.0, 1.3], [0.85, 1.0, 1.15]
_GC = ", ".join(f"({i},{v}::DOUBLE,0e0)" for i, v in enumerate(_EPSV))
_GP = ", ".join(f"({i * 3 + j},{a}::DOUBLE,{b}::DOUBLE)" for i, a in enumerate(_QV) for j, b in enumerate(_FV))
HXS_SQL = HXT_SQL + f""",
hv0 AS (SELECT *, {CHR} FROM hxt), hv AS (SELECT *, {SEG} FROM hv0),
hn AS (SELECT device_id AS dn, quantile_cont(m1_kgps,0.95) AS m1n, quantile_cont(m2_kgps,0.95) AS m2n, quantile_cont(abs(Q_W),0.95) AS qn, coalesce(median(least(98e-2, greatest(5e-2, abs(Q_W)/(least(m1_kgps,m2_kgps)*4186*nullif(abs(T1In_C-T2In_C),0))))),8e-1) AS en,
  median(T1In_C)+27315e-2 AS ta1, median(T1Out_C)+27315e-2 AS tb1, median(T2In_C)+27315e-2 AS ta2, median(T2Out_C)+27315e-2 AS tb2 FROM hv WHERE segment='identification' GROUP BY 1),
hg AS (SELECT * FROM (SELECT 'ConstantEffectiveness' AS candidate, * FROM (VALUES {_GC}) AS g(grid_id, a, b) UNION ALL SELECT 'PlateEffectivenessNTU', * FROM (VALUES {_GP}) AS g(grid_id, a, b))),
he0 AS (SELECT hv.*, candidate, grid_id, a, b, m1n, m2n, qn, en, greatest(1e-1,ta1-tb2) AS d1, greatest(1e-1,tb1-ta2) AS d2, least(m1_kgps,m2_kgps)*4186 AS cmin, least(m1_kgps,m2_kgps)*4186/greatest(1e0,greatest(m1_kgps,m2_kgps)*4186) AS cr FROM hv JOIN hn ON dn=device_id CROSS JOIN hg),
he1 AS (SELECT *, abs(qn*a)/greatest(1e-1, CASE WHEN abs(d1-d2)<1e-2 THEN d1 ELSE (d1-d2)/nullif(ln(d1/d2),0) END)*pow(m1_kgps/greatest(1e-6,m1n*b),8e-1)*pow(m2_kgps/greatest(1e-6,m2n*b),8e-1)/greatest(1e0,cmin) AS ntu FROM he0 WHERE candidate='PlateEffectivenessNTU'),
he AS (SELECT site, device_id, candidate, grid_id, rn, segment, T1Out_C, T2Out_C, T1In_C, T2In_C, m1_kgps, m2_kgps, Q_W, least(98e-2, greatest(5e-2, en*a)) AS eps FROM he0 WHERE candidate='ConstantEffectiveness'
 UNION ALL SELECT site, device_id, candidate, grid_id, rn, segment, T1Out_C, T2Out_C, T1In_C, T2In_C, m1_kgps, m2_kgps, Q_W, CASE WHEN abs(1-cr)<1e-3 THEN ntu/(1+ntu) ELSE (1-exp(-ntu*(1-cr)))/(1-cr*exp(-ntu*(1-cr))) END FROM he1),
hs AS (SELECT *, T1In_C-Qs/greatest(1e0,m1_kgps*4186) AS t1s, T2In_C+Qs/greatest(1e0,m2_kgps*4186) AS t2s FROM (SELECT *, {hx_sql('eps')} AS Qs FROM he)),
hsc AS (SELECT site, device_id, candidate, grid_id, segment, count(*) AS N, sqrt(avg((t2s-T2Out_C)*(t2s-T2Out_C))) AS T2_RMSE_K, sqrt(avg((t1s-T1Out_C)*(t1s-T1Out_C))) AS T1_RMSE_K, 1e2*sqrt(avg((Qs-Q_W)*(Qs-Q_W)))/avg(Q_W) AS Q_CVRMSE_pct,
  1e2*avg(Qs-Q_W)/avg(Q_W) AS Q_NMBE_pct, sqrt(avg((Qs-Q_W)*(Qs-Q_W)))/sqrt(nullif(var_pop(Q_W),0)) AS Q_skill FROM hs WHERE rn>=1 GROUP BY ALL),
hb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_id, candidate ORDER BY Q_CVRMSE_pct+CASE WHEN T2_RMSE_K<=1 THEN 0 ELSE 1000 END, grid_id) AS o FROM hsc WHERE segment='identification') WHERE o=1),
hst AS (SELECT s.*, b.Q_CVRMSE_pct+CASE WHEN b.T2_RMSE_K<=1 THEN 0 ELSE 1000 END AS train_score FROM hsc s JOIN hb b ON b.device_id=s.device_id AND b.candidate=s.candidate AND b.grid_id=s.grid_id WHERE s.segment IN ('selection','test'))"""


@staged("hx_selection")
def hx_stages(spark, d):
    return fit.hx_model_selection(hx_table(spark, d))


@query("j09_hx_grid_search", with_(HXS_SQL, body=f"SELECT site, device_id, candidate, segment AS stage, grid_id::BIGINT AS grid_id, {R('train_score', 4)} AS train_score, {R('Q_CVRMSE_pct', 4)} AS Q_CVRMSE_pct FROM hst"))
def j09(spark, d):
    return rounded(hx_stages(spark, d).select(*KEYS, "candidate", "stage", "grid_id", "train_score", "Q_CVRMSE_pct"), _=4)


@query("k09_hx_score", with_(HXS_SQL, body=f"""SELECT site, device_id, candidate, segment AS stage, N, {R('T2_RMSE_K', 4)} AS T2_RMSE_K, {R('T1_RMSE_K', 4)} AS T1_RMSE_K, T2_RMSE_K<=1 AS T2_admissible, {R('Q_NMBE_pct', 4)} AS Q_NMBE_pct, {R('Q_skill', 4)} AS Q_skill,
 {R('Q_CVRMSE_pct+CASE WHEN T2_RMSE_K<=1 THEN 0 ELSE 1000 END', 4)} AS score FROM hst"""))
def k09(spark, d):
    return rounded(hx_stages(spark, d).select(*KEYS, "candidate", "stage", "N", "T2_RMSE_K", "T1_RMSE_K", "T2_admissible", "Q_NMBE_pct", "Q_skill", "score"), _=4)


# ---- cooling tower ------------------------------------------------------------------------------------
def fan_sql(curve, air):
    c = [f"pow({b}::DOUBLE,{curve})" for b in (0.0, 0.1, 0.3, 0.6, 1.0)]
    return (f"CASE WHEN {air}<=1e-1 THEN {c[0]}+({c[1]}-{c[0]})*{air}/1e-1 WHEN {air}<=3e-1 THEN {c[1]}+({c[2]}-{c[1]})*({air}-1e-1)/2e-1 WHEN {air}<=6e-1 THEN {c[2]}+({c[3]}-{c[2]})*({air}-3e-1)/3e-1 "
            f"ELSE {c[3]}+({c[4]}-{c[3]})*({air}-6e-1)/4e-1 END")


_RW, _CW = [0.8, 1.0, 1.2, 1.5, 1.8], [0.75, 1.0, 1.25, 1.5]
_GM = ", ".join(f"({i * 4 + j},{a}::DOUBLE,{b}::DOUBLE)" for i, a in enumerate(_RW) for j, b in enumerate(_CW))
_UA = "greatest(5e-2, 1082e-4*b+1667e-3*b*wat-7713e-4*b*wat*wat)"
CTS_SQL = CTT_SQL + f""",
cv0 AS (SELECT *, {CHR} FROM ctt), cvs AS (SELECT *, {SEG} FROM cv0),
csub AS (SELECT * FROM cvs WHERE segment='identification'),
cbn AS (SELECT device_id AS dn, median(mdot_cell_kgps) AS mn FROM csub GROUP BY 1),
cg AS (SELECT * FROM (VALUES {_GM}) AS g(grid_id, a, b)),
ce AS (SELECT c.*, grid_id, a, b, greatest(0,mdot_cell_kgps)/greatest(1e-6,mn) AS wat, least(1e0, greatest(y_used,5e-2)) AS air FROM cvs c JOIN cbn ON dn=device_id CROSS JOIN cg),
cm AS (SELECT *, Twb_C+greatest(0e0, TRan_C/greatest(1e0, 1+{_UA}*air/greatest(5e-2, wat*a))) AS ts FROM ce),
csc AS (SELECT site, device_id, grid_id, segment, count(*) AS N, sqrt(avg((ts-Tout_meas_C)*(ts-Tout_meas_C))) AS T_RMSE_K, avg(ts-Tout_meas_C) AS T_MBE_K, sqrt(avg((ts-Tout_meas_C)*(ts-Tout_meas_C)))/sqrt(nullif(var_pop(Tout_meas_C),0)) AS T_skill,
  1e2*sqrt(avg((ts-Tout_meas_C)*(ts-Tout_meas_C)))/nullif(avg(Tout_meas_C),0) AS T_CVRMSE_pct, 1e2*avg(ts-Tout_meas_C)/nullif(avg(Tout_meas_C),0) AS T_NMBE_pct, sqrt(avg((qs-Q_flow_W)*(qs-Q_flow_W)))/sqrt(nullif(var_pop(Q_flow_W),0)) AS Q_skill,
  1e2*sqrt(avg((qs-Q_flow_W)*(qs-Q_flow_W)))/avg(Q_flow_W) AS Q_CVRMSE_pct, 1e2*avg(qs-Q_flow_W)/avg(Q_flow_W) AS Q_NMBE_pct FROM (SELECT *, fans_on_count*greatest(0,mdot_cell_kgps)*4180*(Tin_C-ts) AS qs FROM cm) WHERE rn>=1 GROUP BY ALL),
cb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY T_RMSE_K, grid_id) AS o FROM csc WHERE segment='identification') WHERE o=1),
al AS (SELECT unnest([12e-1,16e-1,2e0,25e-1,3e0]) AS alpha),
fn AS (SELECT device_id AS dn, alpha AS an, coalesce(median(CASE WHEN e>0 THEN e END), median(PFan_meas_W)) AS pn FROM (SELECT *, PFan_meas_W/(greatest(fans_on_count,1)*pow(least(1e0,greatest(5e-2,y_used)),alpha)) AS e FROM csub CROSS JOIN al) GROUP BY 1,2),
fs AS (SELECT device_id, alpha, pn, count(*) AS k, 1e2*sqrt(avg((ps-PFan_meas_W)*(ps-PFan_meas_W)))/avg(PFan_meas_W) AS fcv FROM (SELECT *, pn*fans_on_count*{fan_sql('alpha', 'air')} AS ps FROM (SELECT *, least(1e0, greatest(y_used,5e-2)) AS air FROM csub) CROSS JOIN al JOIN fn ON dn=device_id AND an=alpha WHERE rn>=1) GROUP BY 1,2,3 HAVING count(*)>=10),
fb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY fcv, alpha) AS o FROM fs) WHERE o=1),
cps AS (SELECT device_id AS dp, segment AS sp, count(*) AS P_N, 1e2*sqrt(avg((ps-PFan_meas_W)*(ps-PFan_meas_W)))/nullif(avg(PFan_meas_W),0) AS P_CVRMSE_pct, 1e2*avg(ps-PFan_meas_W)/nullif(avg(PFan_meas_W),0) AS P_NMBE_pct,
  sqrt(avg((ps-PFan_meas_W)*(ps-PFan_meas_W)))/sqrt(nullif(var_pop(PFan_meas_W),0)) AS P_skill FROM (SELECT c.*, pn*fans_on_count*{fan_sql('alpha', 'air')} AS ps FROM (SELECT *, least(1e0, greatest(y_used,5e-2)) AS air FROM cvs WHERE segment<>'identification' AND rn>=1) c JOIN fb ON fb.device_id=c.device_id) GROUP BY 1,2 HAVING count(*)>=10),
cst AS (SELECT s.*, b.T_RMSE_K AS train_score, fb.alpha, fb.fcv, P_N, P_CVRMSE_pct, P_NMBE_pct, P_skill FROM csc s JOIN cb b ON b.device_id=s.device_id AND b.grid_id=s.grid_id LEFT JOIN fb ON fb.device_id=s.device_id LEFT JOIN cps ON dp=s.device_id AND sp=s.segment WHERE s.segment IN ('selection','test'))"""


@staged("ct_selection")
def ct_stages(spark, d):
    return fit.ct_model_selection(ct_table(spark, d))


@query("j10_ct_grid_search", with_(CTS_SQL, body=f"SELECT site, device_id, segment AS stage, grid_id::BIGINT AS grid_id, {R('train_score')} AS train_score, alpha, {R('fcv', 4)} AS fan_P_CVRMSE_pct, {R('T_RMSE_K')} AS T_RMSE_K FROM cst"))
def j10(spark, d):
    return rounded(ct_stages(spark, d).select(*KEYS, "stage", "grid_id", "train_score", "alpha", "fan_P_CVRMSE_pct", "T_RMSE_K"), fan_P_CVRMSE_pct=4)


_CTK = ["T_RMSE_K", "T_MBE_K", "T_CVRMSE_pct", "T_NMBE_pct", "T_skill", "Q_CVRMSE_pct", "Q_NMBE_pct", "Q_skill", "P_CVRMSE_pct", "P_NMBE_pct", "P_skill"]


@query("k08_ct_score", with_(CTS_SQL, body=f"SELECT site, device_id, segment AS stage, N, P_N, {out_cols(_CTK, 4)} FROM cst"))
def k08(spark, d):
    return rounded(ct_stages(spark, d).select(*KEYS, "stage", "N", "P_N", *_CTK), _=4)


@query("j11_fan_curve", with_(CTT_SQL, body=f"SELECT site, device_id, ts_s, {R(fan_sql('25e-1', 'least(1e0,greatest(y_used,5e-2))'))} AS fan_rel FROM ctt"))
def j11(spark, d):
    air = F.least(F.greatest(F.col("y_used"), dbl(0.05)), dbl(1.0))
    return rounded(ct_table(spark, d).select(*KEYS, F.unix_seconds("ts").alias("ts_s"), md.fan_relative_power(md.fan_curve(2.5), air).alias("fan_rel")))


# ---- chiller ------------------------------------------------------------------------------------------
def _bi(c, x, y):
    return f"({c[0]!r}::DOUBLE+({c[1]!r}::DOUBLE)*{x}+({c[2]!r}::DOUBLE)*{x}*{x}+({c[3]!r}::DOUBLE)*{y}+({c[4]!r}::DOUBLE)*{y}*{y}+({c[5]!r}::DOUBLE)*{x}*{y})"


EIR_SQL = CHT_SQL + f""",
cn AS (SELECT device_id AS dn, max(Q_evap_kW)*1e3 AS qn, arg_max(Q_evap_kW/P_kW, (Q_evap_kW, -ts_s)) AS copn, greatest(5e-2, min(Q_evap_kW)/max(Q_evap_kW)) AS plmin FROM cht GROUP BY 1),
e0 AS (SELECT *, qn*greatest(5e-2,{_bi(md.CAP_FT, 'CHWS', 'CDWS')}) AS avail, greatest(5e-2,{_bi(md.EIR_FT, 'CHWS', 'CDWS')}) AS eir, CHW*4180*greatest(CHWR-CHWS,0e0) AS rq FROM cht JOIN cn ON dn=device_id),
e1 AS (SELECT *, least(115e-2, greatest(plmin, rq/greatest(avail,1e0))) AS plr, least(115e-2, greatest(plmin, rq/greatest(qn,1e0))) AS plc FROM e0),
e2 AS (SELECT *, avail*plr AS qs, avail/greatest(copn,1e-1)*eir*greatest(5e-2, {md.EIR_FPLR[0]!r}::DOUBLE+{md.EIR_FPLR[1]!r}::DOUBLE*plr+{md.EIR_FPLR[2]!r}::DOUBLE*plr*plr) AS ps,
  qn*plc AS qc, qn*plc/greatest(1e-1, 45e-2*(CHWS+27315e-2)/greatest(1e0, CDWS-CHWS)) AS pc FROM e1)"""


def _chi(spark, d):
    t = chiller_table(spark, d)
    n = ft.chiller_nominals(t).select(*KEYS, (-F.col("QEva_flow_nominal")).alias("qn"), F.col("COP_nominal").alias("copn"), F.col("PLRMin").alias("plmin"))
    return t.join(n, KEYS)


def _eir(t):
    p = {"cap": md.CAP_FT, "eir": md.EIR_FT, "plr": md.EIR_FPLR, "QEva_flow_nominal": F.col("qn"), "COP_nominal": F.col("copn"), "PLRMin": F.col("plmin"), "PLRMax": 1.15}
    return md.chiller_eir(p, "CHWR", "CHWS", "CDWS", "CHW", "CDW")


@query("j12_chiller_eir_predict", with_(EIR_SQL, body=f"""SELECT site, device_id, ts_s, {R('qs', 3)} AS Q_s, {R('ps', 3)} AS P_s, {R('qs/greatest(ps,1e0)')} AS COP_s, {R('CHWR-qs/greatest(CHW*4180,1e0)')} AS TEvaLvg_s, {R('CDWS+(qs+ps)/greatest(CDW*4180,1e0)')} AS TConLvg_s, {R('plr')} AS PLR_s FROM e2"""))
def j12(spark, d):
    t = _chi(spark, d)
    return rounded(t.select(*KEYS, F.unix_seconds("ts").alias("ts_s"), *[c.alias(n) for n, c in _eir(t).items()]), Q_s=3, P_s=3)


@query("j13_chiller_carnot_predict", with_(EIR_SQL, body=f"SELECT site, device_id, ts_s, {R('qc', 3)} AS Q_s, {R('pc', 3)} AS P_s, {R('qc/greatest(pc,1e0)')} AS COP_s, {R('CHWR-qc/greatest(CHW*4180,1e0)')} AS TEvaLvg_s, {R('CDWS+(qc+pc)/greatest(CDW*4180,1e0)')} AS TConLvg_s, {R('plc')} AS PLR_s FROM e2"))
def j13(spark, d):
    t = _chi(spark, d)
    o = md.chiller_carnot({"QEva_flow_nominal": F.col("qn"), "PLRMin": F.col("plmin"), "PLRMax": 1.15}, "CHWR", "CHWS", "CDWS", "CHW", "CDW")
    return rounded(t.select(*KEYS, F.unix_seconds("ts").alias("ts_s"), *[c.alias(n) for n, c in o.items()]), Q_s=3, P_s=3)


def chi_score_sql():
    return f"""(SELECT site, device_id, count(*) AS N, 1e2*sqrt(avg((ps-pm)*(ps-pm)))/avg(pm) AS P_CVRMSE_pct, 1e2*avg(ps-pm)/avg(pm) AS P_NMBE_pct, 1e2*sqrt(avg((qs-qm)*(qs-qm)))/avg(qm) AS Q_CVRMSE_pct,
 1e2*sqrt(avg((qs/ps-qm/pm)*(qs/ps-qm/pm)))/avg(qm/pm) AS COP_CVRMSE_pct, 1e2*avg(qs/ps-qm/pm)/avg(qm/pm) AS COP_NMBE_pct, sqrt(avg((ps-pm)*(ps-pm)))/sqrt(nullif(var_pop(pm),0)) AS P_skill, sqrt(avg((qs-qm)*(qs-qm)))/sqrt(nullif(var_pop(qm),0)) AS Q_skill
 FROM (SELECT *, P_kW*1e3 AS pm, Q_evap_kW*1e3 AS qm FROM e2) WHERE pm>0 AND ps>0 GROUP BY 1,2)"""


_KC = ["P_CVRMSE_pct", "P_NMBE_pct", "Q_CVRMSE_pct", "COP_CVRMSE_pct", "COP_NMBE_pct", "P_skill", "Q_skill"]


@query("k07_chiller_score", with_(EIR_SQL, body=f"SELECT site, device_id, N, {out_cols(_KC, 4)} FROM {chi_score_sql()}"))
def k07(spark, d):
    t = _chi(spark, d)
    o = _eir(t)
    s = t.select(*KEYS, (F.col("P_kW") * 1000.0).alias("P_m"), o["P_s"].alias("P_s"), (F.col("Q_evap_kW") * 1000.0).alias("Q_m"), o["Q_s"].alias("Q_s"))
    return rounded(ev.chiller_score(s, KEYS), _=4)


@query("j14_pump_predict", with_(PUT_SQL, f"pn AS (SELECT device_id AS dn, quantile_cont(P_meas_W,0.95) AS pn, quantile_cont(m_flow_in,0.95) AS mn FROM put GROUP BY 1)", body=f"""SELECT site, device_id, ts_s, {R('greatest(0e0, pn*(5e-2+2e-2*phi+1e-1*ys+8e-1*ys*ys*ys-1e-2*phi*ys))', 3)} AS P_s, {R('phi')} AS phi_s, {R('ys')} AS y_s FROM
 (SELECT *, greatest(greatest(m_flow_in,0)/greatest(mn,1e-6),0e0) AS phi, least(12e-1, greatest(y_in,5e-2)) AS ys FROM put JOIN pn ON dn=device_id)"""))
def j14(spark, d):
    t = pump_table(spark, d)
    t = t.join(ft.pump_nominals(t), KEYS)
    o = md.pump_power({"P_nominal": F.col("P_nominal"), "m_flow_nominal": F.col("m_flow_nominal"), "c": [0.05, 0.02, 0.1, 0.8, -0.01]}, "m_flow_in", "y_in")
    return rounded(t.select(*KEYS, F.unix_seconds("ts").alias("ts_s"), *[c.alias(n) for n, c in o.items()]), P_s=3)


@query("j15_merkel_predict", with_(CTB_SQL, body=f"""SELECT site, device_id, ts_s, {R('tout')} AS TOut_s, {R('app')} AS TApp_s, {R('greatest(0,mdot_cell_kgps)*4180*(Tin_C-tout)', 3)} AS Q_s, {R('1e4*' + fan_sql('2e0', 'air'), 4)} AS PFan_s FROM
 (SELECT *, Twb_C+app AS tout FROM (SELECT *, greatest(0e0, TRan_C/greatest(1e0, 1+greatest(5e-2, 1082e-4+1667e-3*wat-7713e-4*wat*wat)*air/greatest(5e-2, wat*167e-2))) AS app FROM
  (SELECT ctt.*, greatest(0,mdot_cell_kgps)/greatest(1e-6,m_flow_nominal) AS wat, least(1e0, greatest(y_used,5e-2)) AS air FROM ctt JOIN ctb USING (site, device_id))))"""))
def j15(spark, d):
    t = ct_table(spark, d)
    t = t.join(ft.ct_base_values(t).select(*KEYS, "m_flow_nominal"), KEYS)
    o = md.merkel({"m_flow_nominal": F.col("m_flow_nominal"), "ratWatAir_nominal": 1.67, "PFan_nominal": 10000.0, "curve": md.fan_curve(2.0)}, "Tin_C", "Twb_C", "mdot_cell_kgps", "y_used", "TRan_C")
    return rounded(t.select(*KEYS, F.unix_seconds("ts").alias("ts_s"), *[c.alias(n) for n, c in o.items()]), Q_s=3, PFan_s=4)


@query("j16_hx_constant_eff_predict", with_(HXN_SQL, body=f"""SELECT site, device_id, ts_s, {R('q', 3)} AS Q_s, {R('T1In_C-q/greatest(m1_kgps*4186,1e0)')} AS T1Out_s, {R('T2In_C+q/greatest(m2_kgps*4186,1e0)')} AS T2Out_s, {R('e')} AS eps_s FROM
 (SELECT *, e*least(m1_kgps,m2_kgps)*4186*greatest(T1In_C-T2In_C,0e0) AS q FROM (SELECT hxt.*, least(1e0, greatest(0e0, eps_nominal)) AS e FROM hxt JOIN hxn USING (site, device_id)))"""))
def j16(spark, d):
    t = hx_table(spark, d)
    t = t.join(ft.hx_nominals(t).select(*KEYS, "eps_nominal"), KEYS)
    o = md.hx_constant({"eps": F.col("eps_nominal")}, "T1In_C", "T2In_C", "m1_kgps", "m2_kgps")
    return rounded(t.select(*KEYS, F.unix_seconds("ts").alias("ts_s"), *[c.alias(n) for n, c in o.items()]), Q_s=3)


@query("j17_hx_plate_ntu_predict", with_(HXN_SQL, body=f"""SELECT site, device_id, ts_s, {R('q', 3)} AS Q_s, {R('T1In_C-q/greatest(m1_kgps*4186,1e0)')} AS T1Out_s, {R('T2In_C+q/greatest(m2_kgps*4186,1e0)')} AS T2Out_s, {R('e')} AS eps_s, {R('ua', 4)} AS UA_s FROM
 (SELECT *, e*cmin*greatest(T1In_C-T2In_C,0e0) AS q FROM (SELECT *, least(1e0, greatest(0e0, CASE WHEN abs(1-cr)<1e-3 THEN ntu/(1+ntu) ELSE (1-exp(-ntu*(1-cr)))/(1-cr*exp(-ntu*(1-cr))) END)) AS e FROM (SELECT *, ua/greatest(1e0,cmin) AS ntu FROM
  (SELECT *, abs(Q_flow_nominal)/greatest(1e-1, CASE WHEN abs(d1-d2)<1e-2 THEN d1 ELSE (d1-d2)/nullif(ln(d1/d2),0) END)*pow(m1_kgps/greatest(1e-6,m1_flow_nominal),8e-1)*pow(m2_kgps/greatest(1e-6,m2_flow_nominal),8e-1) AS ua FROM
   (SELECT hxt.*, Q_flow_nominal, m1_flow_nominal, m2_flow_nominal, greatest(1e-1,T_a1_nominal-T_b2_nominal) AS d1, greatest(1e-1,T_b1_nominal-T_a2_nominal) AS d2, least(m1_kgps,m2_kgps)*4186 AS cmin, least(m1_kgps,m2_kgps)*4186/greatest(1e0,greatest(m1_kgps,m2_kgps)*4186) AS cr
    FROM hxt JOIN hxn USING (site, device_id))))))"""))
def j17(spark, d):
    t = hx_table(spark, d)
    t = t.join(ft.hx_nominals(t), KEYS)
    names = ("Q_flow_nominal", "m1_flow_nominal", "m2_flow_nominal", "T_a1_nominal", "T_b1_nominal", "T_a2_nominal", "T_b2_nominal")
    o = md.hx_plate({n: F.col(n) for n in names}, "T1In_C", "T2In_C", "m1_kgps", "m2_kgps")
    return rounded(t.select(*KEYS, F.unix_seconds("ts").alias("ts_s"), *[c.alias(n) for n, c in o.items()]), Q_s=3, UA_s=4)


# ---- York ---------------------------------------------------------------------------------------------
def _mono(t, r, g):
    pw = lambda x, k: "*".join([x] * k)
    return ["*".join(z for z in (pw(t, k), pw(r, q), pw(g, p)) if z) or "1e0" for p in range(3) for q in range(3) for k in range(3)]


def _slope(t, r, g):
    """d/dR of the monomials."""
    of = {1: "1e0", 2: f"2*{r}"}
    pw = lambda x, k: "*".join([x] * k)
    return ["*".join(z for z in (pw(t, k), of[q], pw(g, p)) if z) if q else "0e0" for p in range(3) for q in range(3) for k in range(3)]


def york_sql(t, r, g):
    return "(" + "+".join(f"({c!r}::DOUBLE)*{m}" for c, m in zip(md.YORK, _mono(t, r, g))) + ")"


def york_slope_sql(t, r, g):
    out = []
    for i, c in enumerate(md.YORK):
        p, q, k = i // 9, (i // 3) % 3, i % 3
        if q:
            out.append("*".join([f"({c!r}::DOUBLE)", str(q)] + [t] * k + [r] * (q - 1) + [g] * p))
    return "(" + "+".join(out) + ")"


def _rq(q, t, g):
    return "(" + "+".join("*".join([f"({md.YORK[9 * p + 3 * q + k]!r}::DOUBLE)"] + [t] * k + [g] * p) for p in range(3) for k in range(3)) + ")"


Y_SQL = CTB_SQL + """,
yr AS (SELECT ctt.*, least(8e0, greatest(5e-2, (greatest(0e0,mdot_cell_kgps)/greatest(1e-6,m_flow_nominal))/greatest(1e-4, least(1e0, greatest(y_used,5e-2))))) AS rlg, mdot_cell_kgps/m_flow_nominal AS fw FROM ctt JOIN ctb USING (site, device_id))"""


@staged("york_rows")
def york_rows(spark, d):
    t = ct_table(spark, d)
    t = t.join(ft.ct_base_values(t).select(*KEYS, "m_flow_nominal"), KEYS)
    return t.withColumns({"rlg": ft.liquid_gas_ratio("mdot_cell_kgps", "y_used", "m_flow_nominal"), "fw": F.col("mdot_cell_kgps") / F.col("m_flow_nominal")})


def _ts(t, *cols, **digits):
    return rounded(t.select(*KEYS, F.unix_seconds("ts").alias("ts_s"), *cols), **digits)


@query("g15_liquid_gas_ratio", with_(Y_SQL, body=f"SELECT site, device_id, ts_s, {R('rlg')} AS rlg FROM yr"))
def g15(spark, d):
    return _ts(york_rows(spark, d), "rlg")


@query("g16_york_design", with_(Y_SQL, body="SELECT site, device_id, ts_s, " + ", ".join(f"{R(m, 2)} AS m{i}" for i, m in enumerate(_mono("Twb_C", "TRan_C", "rlg"))) + ", " + ", ".join(f"{R(m, 2)} AS d{i}" for i, m in enumerate(_slope("Twb_C", "TRan_C", "rlg"))) + " FROM yr"))
def g16(spark, d):
    x, dx = md.york_design("Twb_C", "TRan_C", "rlg"), md.york_design_slope("Twb_C", "TRan_C", "rlg")
    return _ts(york_rows(spark, d), *[c.alias(f"m{i}") for i, c in enumerate(x)], *[c.alias(f"d{i}") for i, c in enumerate(dx)], _=2)


@query("j18_york_open_loop", with_(Y_SQL, body=f"SELECT site, device_id, ts_s, {R('a')} AS TApp_s, {R('Twb_C+a')} AS TOut_s FROM (SELECT *, least(4e1, greatest(0e0, {york_sql('Twb_C', 'TRan_C', 'rlg')})) AS a FROM yr)"))
def j18(spark, d):
    return _ts(york_rows(spark, d), *[c.alias(n) for n, c in md.york_open_loop("Twb_C", "TRan_C", "rlg").items()])


CL_SQL = Y_SQL + f""",
y0 AS (SELECT *, {_rq(0, 'Twb_C', 'rlg')} AS al, {_rq(1, 'Twb_C', 'rlg')} AS be, {_rq(2, 'Twb_C', 'rlg')} AS ga, greatest(Tin_C-Twb_C,0e0) AS D FROM yr),
y1 AS (SELECT *, ga AS A, -(be+2*ga*D+1) AS B, al+be*D+ga*D*D AS C FROM y0),
y2 AS (SELECT *, B*B-4*A*C AS disc, -5e-1*(B+CASE WHEN B>=0 THEN sqrt(greatest(B*B-4*A*C,0e0)) ELSE -sqrt(greatest(B*B-4*A*C,0e0)) END) AS qq FROM y1),
y3 AS (SELECT *, CASE WHEN abs(A)<1e-12 THEN -C/nullif(B,0) WHEN disc>=0 THEN qq/nullif(A,0) END AS r1, CASE WHEN abs(A)>=1e-12 AND disc>=0 THEN C/nullif(qq,0) END AS r2 FROM y2),
y4 AS (SELECT *, CASE WHEN r1>=0 AND r1<=least(D,4e1) THEN r1 END AS o1, CASE WHEN r2>=0 AND r2<=least(D,4e1) THEN r2 END AS o2 FROM y3),
ycl AS (SELECT *, C<=0 AS clipped, CASE WHEN C<=0 THEN 0e0 ELSE least(o1,o2) END AS app, (CASE WHEN o1 IS NULL THEN 0 ELSE 1 END+CASE WHEN o2 IS NULL THEN 0 ELSE 1 END)::BIGINT AS n_roots FROM y4)"""


def _closed(spark, d):
    t = york_rows(spark, d)
    t = t.withColumns(md.york_closed_loop_terms("Tin_C", "Twb_C", "rlg"))
    return t.withColumns(md.york_closed_loop())


@query("j19_york_closed_loop", with_(CL_SQL, body=f"SELECT site, device_id, ts_s, {R('app')} AS TApp_s, {R('Twb_C+app')} AS TOut_s, clipped, app IS NOT NULL AS admissible, n_roots FROM ycl"))
def j19(spark, d):
    return _ts(_closed(spark, d), "TApp_s", (F.col("Twb_C") + F.col("TApp_s")).alias("TOut_s"), "clipped", "admissible", "n_roots")


def _lq(p, t, r):
    return "(" + "+".join("*".join([f"({md.YORK[9 * p + 3 * q + k]!r}::DOUBLE)"] + [t] * k + [r] * q) for q in range(3) for k in range(3)) + ")"


@query("j20_york_frwat0", with_(CTB_SQL, f"""f0 AS (SELECT *, TAirInWB_nominal-27315e-2 AS t FROM ctb), f1 AS (SELECT *, {_lq(2, 't', 'TRan_nominal')} AS a, {_lq(1, 't', 'TRan_nominal')} AS b, {_lq(0, 't', 'TRan_nominal')}-TApp_nominal AS z FROM f0),
f2 AS (SELECT *, b*b-4*a*z AS disc, -5e-1*(b+CASE WHEN b>=0 THEN sqrt(greatest(b*b-4*a*z,0e0)) ELSE -sqrt(greatest(b*b-4*a*z,0e0)) END) AS qq FROM f1),
f3 AS (SELECT *, CASE WHEN disc>=0 THEN qq/nullif(a,0) END AS r1, CASE WHEN disc>=0 THEN z/nullif(qq,0) END AS r2 FROM f2)""",
                                body=f"SELECT site, device_id, {R('least(CASE WHEN r1>=1e-3 AND r1<=8 THEN r1 END, CASE WHEN r2>=1e-3 AND r2<=8 THEN r2 END)')} AS FRWat0 FROM f3"))
def j20(spark, d):
    b = ft.ct_base_values(ct_table(spark, d))
    return rounded(b.select(*KEYS, md.york_frwat0(F.col("TAirInWB_nominal") - 273.15, "TRan_nominal", "TApp_nominal").alias("FRWat0")))


@query("j21_york_sensitivity", with_(CL_SQL, body=f"""SELECT site, device_id, count(*) AS n, {R('min(sl)')} AS slope_min, {R('max(sl)')} AS slope_max, {R('1e2*avg(CASE WHEN sl<=0 OR sl>=1 THEN 1e0 ELSE 0e0 END)')} AS outside_pct,
 {R('1e2*avg(CASE WHEN n_roots>1 THEN 1e0 ELSE 0e0 END)')} AS multivalued_pct, {R('1e2*avg(CASE WHEN app IS NULL THEN 1e0 ELSE 0e0 END)')} AS inadmissible_pct FROM (SELECT *, {york_slope_sql('Twb_C', 'TRan_C', 'rlg')} AS sl FROM ycl) GROUP BY 1,2"""))
def j21(spark, d):
    t = _closed(spark, d).withColumn("slope", md.york_sensitivity("Twb_C", "TRan_C", "rlg"))
    return rounded(fit.york_diagnostics(t))


_IN = "Twb_C BETWEEN -344e-1 AND 267e-1 AND TRan_C BETWEEN 11e-1 AND 222e-1 AND TAppAct_C BETWEEN 11e-1 AND 4e1 AND fw BETWEEN 75e-2 AND 125e-2"


@query("j22_york_domain_check", with_(Y_SQL, body=f"SELECT site, device_id, count(*) AS n, {R(f'1e2*avg(CASE WHEN {_IN} THEN 0e0 ELSE 1e0 END)')} AS outside_pct FROM yr GROUP BY 1,2"))
def j22(spark, d):
    t = york_rows(spark, d).withColumn("inside", md.york_in_domain("Twb_C", "TRan_C", "TAppAct_C", "fw"))
    return rounded(t.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), (F.lit(100.0) * F.avg((~F.col("inside")).cast("double"))).alias("outside_pct")))


@query("j23_york_ridge_fit")
def j23(spark, d):
    """27x27 regularised solve in numpy; no SQL twin, checked against numpy in the tests."""
    t = york_rows(spark, d).select(*KEYS, F.col("Twb_C").alias("twb"), F.col("TRan_C").alias("rng"), "rlg", F.col("TAppAct_C").alias("app"))
    f = fit.york_ridge_fit(t)
    return rounded(f.select(*KEYS, "n", F.posexplode("coefficients").alias("pos", "coefficient")))


# ---- selection and status ---------------------------------------------------------------------------
@query("j24_candidate_argmin", with_(SEL_SQL, body=f"SELECT site, device_id, candidate, {R('MAPE_pct', 3)} AS MAPE_pct FROM sel"))
def j24(spark, d):
    return rounded(selected(spark, d).select(*KEYS, "candidate", "MAPE_pct"), _=3)


STAT_SQL = PSEL_SQL + """,
st0 AS (SELECT d.site, d.device_id, coalesce(n_rows,0) AS n_rows, i, s, t FROM (SELECT DISTINCT site, device_id FROM att WHERE equipment_type='pump') d LEFT JOIN (SELECT device_id, count(*) AS n_rows, count_if(segment='identification')::BIGINT AS i, count_if(segment='selection')::BIGINT AS s,
 count_if(segment='test')::BIGINT AS t FROM pv1 GROUP BY 1) c USING (device_id)),
stt AS (SELECT *, CASE WHEN n_rows<400 THEN 'data_limited' WHEN i<200 THEN 'blocked_insufficient_identification' WHEN s<70 OR t<70 THEN 'identification_only' ELSE 'ok' END AS status FROM st0)"""


def statuses(spark, d):
    t = pump_table(spark, d)
    dev = bind.attributed(spark, d).where("equipment_type = 'pump'").select(*KEYS).distinct()
    n = dev.join(t.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_rows")), KEYS, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    s = sp.split_counts(sp.chronological_split(t).withColumn("overlap", F.lit(False)), sp.SplitSpec(min_identification_rows=200, min_selection_rows=70, min_test_rows=70))
    return fit.fit_status(n, s, pump_stages(spark, d).select(*KEYS).distinct(), 400)


@query("j25_fit_status", with_(STAT_SQL, body="""SELECT site, device_id, n_rows, status, CASE WHEN n_rows<400 THEN concat(CAST(n_rows AS STRING), ' valid rows < 400') WHEN status<>'ok' THEN concat('record cannot support an independent test segment: train=', CAST(i AS STRING), ' select=', CAST(s AS STRING), ' test=', CAST(t AS STRING)) ELSE '' END AS reason FROM stt"""))
def j25(spark, d):
    return statuses(spark, d)


# ---- joins: library and grids -----------------------------------------------------------------------

_LC = {f"cap{i + 1}": (v, "95e-2+(p_size%11)/1e2") for i, v in enumerate(md.CAP_FT)} | {f"eir{i + 1}": (v, "9e-1+(p_partkey%21)/1e2") for i, v in enumerate(md.EIR_FT)} | {
    f"plr{i + 1}": (v, "9e-1+(p_size%7)/3e1") for i, v in enumerate(md.EIR_FPLR)}
_LSEL = ", ".join(f"CAST('{v!r}' AS DOUBLE)*({s}) AS {n}" if n != "plr3" else f"CASE WHEN p_size=9 THEN NULL ELSE CAST('{v!r}' AS DOUBLE)*({s}) END AS {n}" for n, (v, s) in _LC.items())
LIB_SQL = f"lib AS (SELECT concat('L', CAST(p_partkey AS STRING)) AS lib_id, {_LSEL} FROM part)"


def _bq(pfx):
    return f"({pfx}1+{pfx}2*CHWS+{pfx}3*CHWS*CHWS+{pfx}4*CDWS+{pfx}5*CDWS*CDWS+{pfx}6*CHWS*CDWS)"


_SCORES = """
lq AS (SELECT *, least(115e-2, greatest(plmin, rq/greatest(av,1e0))) AS pl FROM lp),
lz AS (SELECT site, device_id, lib_id, 1e2*sqrt(avg((ps-pm)*(ps-pm)))/avg(pm) AS P_CVRMSE_pct, 1e2*sqrt(avg((av*pl-qm)*(av*pl-qm)))/avg(qm) AS Q_CVRMSE_pct FROM (SELECT *, av/greatest(copn,1e-1)*ei*greatest(5e-2, plr1+plr2*pl+plr3*pl*pl) AS ps FROM lq) GROUP BY 1,2,3)"""
LP = f"""lp AS (SELECT e0.site, e0.device_id, lib_id, P_kW*1e3 AS pm, Q_evap_kW*1e3 AS qm, qn*greatest(5e-2,{_bq('cap')}) AS av, greatest(5e-2,{_bq('lib.eir')}) AS ei, plmin, rq, copn, plr1, plr2, plr3 FROM e0 CROSS JOIN lib WHERE plr3 IS NOT NULL"""
SCR_SQL = EIR_SQL + ",\n" + LIB_SQL + ",\n" + LP + ")," + _SCORES
TRAIN_SQL = CHT_SQL + ",\n" + LIB_SQL + f""",
chs AS (SELECT *, {SEG} FROM (SELECT *, {CHR} FROM cht)),
cn AS (SELECT device_id AS dn, max(Q_evap_kW)*1e3 AS qn, arg_max(Q_evap_kW/P_kW, (Q_evap_kW, -ts_s)) AS copn, greatest(5e-2, min(Q_evap_kW)/max(Q_evap_kW)) AS plmin FROM chs WHERE segment='identification' GROUP BY 1),
e0 AS (SELECT *, CHW*4180*greatest(CHWR-CHWS,0e0) AS rq FROM chs JOIN cn ON dn=device_id),
""" + LP + " AND segment='identification')," + _SCORES


def curves(spark, d):
    return bind.table(spark, d, "part").selectExpr("concat('L', CAST(p_partkey AS STRING)) AS lib_id", *_LSEL_SPARK)


@staged("screen")
def screen(spark, d):
    """Scores of distinct curves on every row of every chiller."""
    t = chiller_table(spark, d)
    n = ft.chiller_nominals(t).select(*KEYS, "QEva_flow_nominal", "COP_nominal", "PLRMin", "PLRMax")
    return fit.class_screen(fit.chiller_points(t.join(n, KEYS)), fit.curve_classes(curves(spark, d))[0])


_LSEL_SPARK = [(f"CAST('{v!r}' AS DOUBLE)*({s}) AS {n}" if n != "plr3" else f"CASE WHEN p_size=9 THEN NULL ELSE CAST('{v!r}' AS DOUBLE)*({s}) END AS {n}") for n, (v, s) in _LC.items()]


@query("e16_library_screen", with_(SCR_SQL, body=f"SELECT site, device_id, lib_id, {R('P_CVRMSE_pct')} AS P_CVRMSE_pct, {R('Q_CVRMSE_pct')} AS Q_CVRMSE_pct, {R('P_CVRMSE_pct+Q_CVRMSE_pct')} AS score FROM lz"))
def e16(spark, d):
    return fit.every_curve(rounded(screen(spark, d)), fit.curve_classes(curves(spark, d))[1])


BEST_SQL = TRAIN_SQL + """,
bc AS (SELECT site, device_id, min(P_CVRMSE_pct+Q_CVRMSE_pct) AS score, arg_min(lib_id, (round(P_CVRMSE_pct+Q_CVRMSE_pct,9), lib_id)) AS lib_id FROM lz GROUP BY 1,2)"""


@staged("best_curves")
def best_curves(spark, d):
    return fit.library_best(fit.chiller_points(fit.chiller_training(chiller_table(spark, d))[1]), curves(spark, d))


@query("e16_best_curve", with_(BEST_SQL, body=f"SELECT site, device_id, lib_id, {R('score')} AS score FROM bc"))
def e16_best(spark, d):
    return rounded(best_curves(spark, d).select(*KEYS, "lib_id", "score"))


CSEL_SQL = BEST_SQL + f""",
sx AS (SELECT e0.*, bc.lib_id, plr1, plr2, plr3, qn*greatest(5e-2,{_bq('cap')}) AS av, greatest(5e-2,{_bq('lib.eir')}) AS ei FROM e0 JOIN bc ON bc.device_id=e0.device_id JOIN lib ON lib.lib_id=bc.lib_id WHERE segment IN ('selection','test')),
sy AS (SELECT *, least(115e-2, greatest(plmin, rq/greatest(av,1e0))) AS pl FROM sx),
sz AS (SELECT site, device_id, 'ElectricEIR' AS candidate, segment AS stage, lib_id, P_kW*1e3 AS pm, Q_evap_kW*1e3 AS qm, av*pl AS qs, av/greatest(copn,1e-1)*ei*greatest(5e-2, plr1+plr2*pl+plr3*pl*pl) AS ps FROM sy
 UNION ALL SELECT site, device_id, 'CarnotTA', segment, NULL, P_kW*1e3, Q_evap_kW*1e3, qn*plc, qn*plc/greatest(1e-1, 45e-2*(CHWS+27315e-2)/greatest(1e0, CDWS-CHWS))
 FROM (SELECT *, least(115e-2, greatest(plmin, rq/greatest(qn,1e0))) AS plc FROM e0 WHERE segment IN ('selection','test'))),
csel AS (SELECT site, device_id, candidate, stage, lib_id, count(*) AS N, 1e2*sqrt(avg((ps-pm)*(ps-pm)))/avg(pm) AS P_CVRMSE_pct, 1e2*avg(ps-pm)/avg(pm) AS P_NMBE_pct, 1e2*sqrt(avg((qs-qm)*(qs-qm)))/avg(qm) AS Q_CVRMSE_pct,
 1e2*sqrt(avg((qs/ps-qm/pm)*(qs/ps-qm/pm)))/avg(qm/pm) AS COP_CVRMSE_pct, 1e2*avg(qs/ps-qm/pm)/avg(qm/pm) AS COP_NMBE_pct, sqrt(avg((ps-pm)*(ps-pm)))/sqrt(nullif(var_pop(pm),0)) AS P_skill, sqrt(avg((qs-qm)*(qs-qm)))/sqrt(nullif(var_pop(qm),0)) AS Q_skill
 FROM sz WHERE pm>0 AND ps>0 GROUP BY ALL)"""


@staged("chiller_selection")
def chiller_stages(spark, d):
    return fit.chiller_model_selection(chiller_table(spark, d), curves(spark, d))


@query("j24_chiller_model_selection", with_(CSEL_SQL, body=f"SELECT site, device_id, candidate, stage, lib_id, N, {out_cols(_KC, 3)} FROM csel"))
def j24_chiller(spark, d):
    return rounded(chiller_stages(spark, d).select(*KEYS, "candidate", "stage", "lib_id", "N", *_KC), _=3)


@query("j24_chiller_winner", with_(CSEL_SQL, body=f"""SELECT w.site, w.device_id, w.candidate, {R('selection_score', 3)} AS selection_score, t.N AS test_N, {R('t.P_CVRMSE_pct', 3)} AS test_score
 FROM (SELECT site, device_id, arg_min(candidate, (P_CVRMSE_pct, candidate='CarnotTA')) AS candidate, min(P_CVRMSE_pct) AS selection_score FROM csel WHERE stage='selection' GROUP BY 1,2) w
 LEFT JOIN csel t ON t.device_id=w.device_id AND t.candidate=w.candidate AND t.stage='test'"""))
def j24_winner(spark, d):
    return rounded(fit.select_on_stage(chiller_stages(spark, d), "P_CVRMSE_pct", ["ElectricEIR", "CarnotTA"]), _=3)


@query("e17_grid_expand", with_(HXN_SQL, body=f"""SELECT site, device_id, 'product' AS mode, grid_id::BIGINT AS grid_id, 'Q_flow_nominal' AS param, {R('Q_flow_nominal*a', 4)} AS value FROM hxn CROSS JOIN (VALUES {_GP}) AS g(grid_id, a, b)
 UNION ALL SELECT site, device_id, 'product', grid_id, 'm1_flow_nominal', {R('m1_flow_nominal*b', 4)} FROM hxn CROSS JOIN (VALUES {_GP}) AS g(grid_id, a, b)
 UNION ALL SELECT site, device_id, 'product', grid_id, 'm2_flow_nominal', {R('m2_flow_nominal*b', 4)} FROM hxn CROSS JOIN (VALUES {_GP}) AS g(grid_id, a, b)
 UNION ALL SELECT site, device_id, 'coordinate', grid_id, 'eps', {R('least(98e-2, greatest(5e-2, eps_nominal*a))', 4)} FROM hxn CROSS JOIN (VALUES {_GC}) AS g(grid_id, a, b)
 UNION ALL SELECT site, device_id, 'coordinate', g, 'Q_flow_nominal', {R('Q_flow_nominal*a', 4)} FROM hxn CROSS JOIN (VALUES (5,7e-1),(6,1e0),(7,13e-1)) AS v(g,a)"""))
def e17(spark, d):
    n = ft.hx_nominals(hx_table(spark, d))
    a = fit.expand_grid(n, fit.HX_PLATE_GRID).withColumn("mode", F.lit("product"))
    coord = {"mode": "coordinate", "axes": [*fit.HX_CONSTANT_GRID["axes"], fit.HX_PLATE_GRID["axes"][0]]}
    b = fit.expand_grid(n, coord).withColumn("mode", F.lit("coordinate"))
    u = a.unionByName(b)
    return rounded(u.select(*KEYS, "mode", "grid_id", F.explode("params").alias("param", "value")), _=4)


@query("e18_start_values", with_(HXN_SQL, body=f"""SELECT site, device_id, grid_id::BIGINT AS grid_id, 'm1_flow_nominal' AS name, {R('m1_flow_nominal', 4)} AS value FROM hxn CROSS JOIN (VALUES {_GC}) AS g(grid_id,a,b)
 UNION ALL SELECT site, device_id, grid_id, 'dp1_nominal', 0e0 FROM hxn CROSS JOIN (VALUES {_GC}) AS g(grid_id,a,b)
 UNION ALL SELECT site, device_id, grid_id, 'eps', {R('least(98e-2, greatest(5e-2, eps_nominal*a))', 4)} FROM hxn CROSS JOIN (VALUES {_GC}) AS g(grid_id,a,b)"""))
def e18(spark, d):
    n = ft.hx_nominals(hx_table(spark, d))
    g = fit.expand_grid(n, fit.HX_CONSTANT_GRID, keep=(*KEYS, "m1_flow_nominal"))
    g = g.withColumn("params", F.map_concat("params", F.create_map(F.lit("_private"), dbl(1.0))))
    s = fit.start_values(g, {"m1_flow_nominal": {"base": "m1_flow_nominal"}, "dp1_nominal": {"const": 0.0}, "eps": {"const": 0.8}})
    return rounded(s.select(*KEYS, "grid_id", F.explode("start_values").alias("name", "value")), _=4)


_ENB = {"chiller": ("EIR,EEIR,Carnot", "", "EIR,EEIR"), "cooling_tower": ("Merkel,YorkCalc", "YorkCalc,Merkel,Unknown", ""), "pump": ("empirical_power,mover", "", "empirical_power"),
        "heat_exchanger": ("ConstantEffectiveness,PlateEffectivenessNTU", "", "")}


@query("e19_candidate_filter", "WITH d AS (SELECT s_suppkey AS k, CAST(s_suppkey%4 AS INT) AS fam FROM supplier)\nSELECT k AS device, v.c AS candidate, v.p::BIGINT AS \"position\" FROM d JOIN (VALUES (0,'EIR',0),(0,'EEIR',1),(1,'YorkCalc',0),(1,'Merkel',1),(2,'empirical_power',0),(3,'ConstantEffectiveness',0),(3,'PlateEffectivenessNTU',1)) AS v(fam,c,p) USING (fam)")
def e19(spark, d):
    dev = bind.registry(spark, d).select(F.col("k").alias("device"), "equipment_type")
    cfg = spark.createDataFrame([(f, a.split(","), [x for x in p.split(",") if x], [x for x in c.split(",") if x]) for f, (a, p, c) in _ENB.items()],
                                "equipment_type string, names array<string>, p array<string>, c array<string>")
    cands = cfg.select("equipment_type", F.posexplode("names").alias("ord", "candidate"))
    e = fit.enabled_candidates(cands, cfg.select("equipment_type", F.col("p").alias("enabled")), cfg.select("equipment_type", F.col("c").alias("enabled")))
    return rounded(dev.join(e, "equipment_type").select("device", "candidate", "position"))


# ---- validation -----------------------------------------------------------------------------------------


def forms():
    return {**fit.pump_forms(), **fit.fan_forms()}


@staged("full_period")
def full_period(spark, d):
    return fit.apply_power_models(bind.masked(spark, d), forms(), selected(spark, d))


FP_SQL = SEL_SQL + ",\nfp AS (" + " UNION ALL ".join(
    f"SELECT c.site, c.device_id, c.ts_s, s.candidate, c.power_W AS measured, {pred_sql(f)} AS simulated FROM c_{n} c JOIN p_{n} p ON p.device_id=c.device_id JOIN sel s ON s.device_id=c.device_id AND s.candidate='{n}'" for n, f in FIT_SQL.items()) + ")"


@query("k12_full_period_validation", with_(FP_SQL, f"""dv AS (SELECT site, device_id, equipment_type, count(*) AS rows_total, count(CASE WHEN operating THEN 1 END) AS rows_on, count(CASE WHEN operating AND power_W IS NOT NULL THEN 1 END) AS rows_valid FROM mk WHERE equipment_type IN ('pump','cooling_tower') GROUP BY 1,2,3)""",
                                           body=f"""SELECT d.site, d.device_id, d.equipment_type, CASE WHEN s.candidate IS NULL THEN 'no_candidate' ELSE 'ok' END AS status, s.candidate, m.N, {R('m.RMSE', 1)} AS RMSE, {', '.join(f'{R(f"m.{c}", 3)} AS {c}' for c in ('MAPE_pct', 'CVRMSE_pct', 'NMBE_pct'))},
 CASE WHEN s.candidate IS NOT NULL THEN rows_on END AS rows_on FROM dv d LEFT JOIN sel s USING (device_id) LEFT JOIN {met_sql('fp', KEYS, 'measured', 'simulated')} m ON m.device_id=d.device_id"""))
def k12(spark, d):
    m = bind.masked(spark, d).where("equipment_type IN ('pump', 'cooling_tower')")
    dev = m.select(*KEYS, "equipment_type").distinct()
    cov = mx.coverage_row(m, KEYS, F.col("operating"), F.col("power_W").isNotNull(), F.col("power_W").isNotNull())
    v = ev.full_period_validation(dev, selected(spark, d), full_period(spark, d), cov)
    return rounded(v.select(*KEYS, "equipment_type", "status", "candidate", "N", "RMSE", "MAPE_pct", "CVRMSE_pct", "NMBE_pct", "rows_on"), _=3, RMSE=1)


@query("k13_validation_series", with_(FP_SQL, body=f"SELECT site, device_id, ts_s, {R('measured', 3)} AS measured, {R('simulated', 1)} AS simulated FROM fp"))
def k13(spark, d):
    s = ev.validation_series(full_period(spark, d))
    return rounded(s.select(*KEYS, F.unix_seconds("ts").alias("ts_s"), "measured", "simulated"), measured=3, simulated=1)


_PUB = "CASE equipment_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ev.PUBLISHED_MAPE.items()) + " END"


@query("k14_published_comparison", with_(SEL_SQL, body=f"SELECT s.site, s.device_id, equipment_type, candidate, {R('round_even(MAPE_pct,2)', 2)} AS our_MAPE_pct, {_PUB} AS published_MAPE_pct FROM sel s JOIN (SELECT DISTINCT device_id, equipment_type FROM mk) USING (device_id)"))
def k14(spark, d):
    s = selected(spark, d).join(bind.masked(spark, d).select(*KEYS, "equipment_type").distinct(), KEYS)
    return rounded(ev.published_comparison(s), _=2)


REC_SQL = CAL_SQL + """,
ser AS (SELECT concat(device_id, '/', candidate) AS series_id, N, RMSE AS rmse, CVRMSE_pct AS cvrmse FROM mets WHERE N>0),
pub AS (SELECT device_id, N, 'cvrmse' AS kind, round(CVRMSE_pct+137e-7,2) AS expected FROM mets WHERE N>0 AND candidate IN ('affinity_power','fan_affinity_power') AND CVRMSE_pct>1e-1)"""


@query("k15_reconcile_series", with_(REC_SQL, body=f"""SELECT device_id, N, kind, expected, series_id, {R('gap', 4)} AS gap FROM (SELECT p.*, min(abs(cvrmse-expected)) AS gap, arg_min(series_id, (round(abs(cvrmse-expected),9), series_id)) AS series_id FROM pub p JOIN ser USING (N) GROUP BY ALL) WHERE gap<=greatest(2e-2*abs(expected), 1e-3)"""))
def k15(spark, d):
    m = calibration(spark, d).where("N > 0")
    ser = m.select(F.concat("device_id", F.lit("/"), "candidate").alias("series_id"), "N", F.col("RMSE").alias("rmse"), F.col("CVRMSE_pct").alias("cvrmse"))
    pub = (m.where("candidate IN ('affinity_power', 'fan_affinity_power') AND CVRMSE_pct > 0.1")
           .select("device_id", "N", F.lit("cvrmse").alias("kind"), F.round(F.col("CVRMSE_pct") + 137e-7, 2).alias("expected")))
    return rounded(ev.reconcile_series(ser, pub), gap=4, expected=2)
