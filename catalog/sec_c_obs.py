"""Observability findings."""

from pyspark.sql import functions as F

from catalog import bind
from catalog.bind import ALL_ROLES, ATT_SQL, KEYS, MASK_SQL, staged, with_
from catalog.registry import R, query, rounded
from catalog.sec_c import PROF_SQL
from fleetgauge.contracts import EVIDENCE_TIERS, SENSOR_SET
from fleetgauge.operators import observability as ob
from fleetgauge.operators import quality as ql
from fleetgauge.operators import reconstruct as rc

PLAIN = r"regexp_replace(printf('%.{d}f', {x}), '\.?0+$', '')"


def plain(x, d):
    return PLAIN.format(x=x, d=d)


_W = {"chiller": ["chw_flow_m3_h", "cw_flow_m3_h"], "cooling_tower": ["power_W", "attributed_flow_m3_h"], "heat_exchanger": ["chw_flow_m3_h", "cw_flow_m3_h"]}
FROZEN_SQL = MASK_SQL + ",\nfl0 AS (" + " UNION ALL ".join(
    f"SELECT site, device_id, equipment_type, '{r}' AS channel, {i} AS pos, round_even({r},6) AS v FROM mk WHERE operating AND equipment_type='{f}' AND {r}<>0"
    for f, rs in _W.items() for i, r in enumerate(rs)) + """),
fl1 AS (SELECT site, device_id, channel, pos, v, count(*) AS c FROM fl0 GROUP BY ALL),
frz AS (SELECT site, device_id, channel, pos, sum(c)::BIGINT AS rows, max(c)/sum(c) AS modal_share, arg_min(v, (-c)*1e9+v) AS held_value FROM fl1 GROUP BY 1,2,3,4),
ld AS (SELECT *, CASE WHEN equipment_type='chiller' THEN (CASE WHEN count(cooling_load_W) OVER (PARTITION BY device_id)>0 THEN cooling_load_W ELSE 1e3*4186*(chw_flow_m3_h/3600)*(tchwr_C-tchws_C) END) END AS load_W FROM mk),
cp AS (SELECT *, CASE WHEN operating AND load_W>0 AND power_W>0 THEN load_W/power_W END AS cop FROM ld WHERE equipment_type='chiller'),
env AS (SELECT site, device_id, count(cop) AS usable_rows, count(CASE WHEN cop<=1 THEN 1 END) AS impossible_rows, median(CASE WHEN cop>1 THEN cop END) AS cop_median FROM cp GROUP BY 1,2),
drv AS (SELECT *, CASE equipment_type WHEN 'chiller' THEN load_W WHEN 'cooling_tower' THEN fan1_Hz WHEN 'pump' THEN speed_Hz END AS drv FROM ld),
exc AS (SELECT site, device_id, equipment_type, count(x) AS rows, quantile_cont(x,0.05) AS p5, median(x) AS med, quantile_cont(x,0.95) AS p95, count(DISTINCT round_even(x,6)) AS distinct_values
  FROM (SELECT *, CASE WHEN operating AND drv>0 THEN drv END AS x FROM drv) GROUP BY 1,2,3 HAVING count(x)>=100),
ex AS (SELECT *, (p95-p5)/abs(med) AS relative_span, (p95-p5)/abs(med)>=1e-1 AS excited,
  CASE equipment_type WHEN 'chiller' THEN 'cooling_load_W' WHEN 'cooling_tower' THEN 'fan1_Hz' ELSE 'speed_Hz' END AS driver FROM exc)"""


@staged("loaded")
def loaded(spark, d):
    m = bind.masked(spark, d)
    load = rc.cooling_load(m.where("equipment_type = 'chiller'"))
    return load.unionByName(m.where("equipment_type <> 'chiller'"), allowMissingColumns=True)


@query("c08_frozen_channels", with_(FROZEN_SQL, body=f"SELECT site, device_id, channel, rows, {R('modal_share')} AS modal_share, {R('held_value', 4)} AS held_value FROM frz WHERE rows>=200 AND modal_share>=95e-2"))
def c08(spark, d):
    return rounded(ob.frozen_findings(ob.frozen_channels(bind.masked(spark, d))), held_value=4)


@query("c09_cop_envelope", with_(FROZEN_SQL, body=f"""SELECT site, device_id, usable_rows, impossible_rows, {R('1e2*impossible_rows/nullif(usable_rows,0)')} AS impossible_pct, {R('cop_median')} AS cop_median,
 CASE WHEN 1e2*impossible_rows/nullif(usable_rows,0)>=1 THEN concat('cop_below_unity:reconstructed_COP=', {plain('round_even(1e2*impossible_rows/usable_rows,1)', 1)}) END AS below_flag,
 CASE WHEN cop_median>10 THEN concat('cop_above_envelope:reconstructed_COP=', CASE WHEN round_even(cop_median,2)>=100 THEN {plain('round_even(cop_median,1)', 1)} ELSE {plain('round_even(cop_median,2)', 2)} END) END AS above_flag FROM env"""))
def c09(spark, d):
    return rounded(ob.cop_envelope(ob.cop_rows(loaded(spark, d).where("equipment_type = 'chiller'"))))


@query("c10_excitation", with_(FROZEN_SQL, body=f"""SELECT site, device_id, count(x) AS rows, {R('quantile_cont(x,0.05)')} AS p5, {R('median(x)')} AS "median", {R('quantile_cont(x,0.95)')} AS p95,
 {R('(quantile_cont(x,0.95)-quantile_cont(x,0.05))/abs(median(x))')} AS relative_span, count(DISTINCT round_even(x,6)) AS distinct_values,
 (quantile_cont(x,0.95)-quantile_cont(x,0.05))/abs(median(x))>=1e-1 AS excited FROM (SELECT *, CASE WHEN operating AND chw_flow_m3_h>0 THEN chw_flow_m3_h END AS x FROM mk) GROUP BY 1,2 HAVING count(x)>=100"""))
def c10(spark, d):
    return rounded(ob.excitation(bind.masked(spark, d), F.col("chw_flow_m3_h")))


@query("c11_driver_excitation", with_(FROZEN_SQL, body=f"""SELECT site, device_id, equipment_type, driver, rows, {R('p5', 3)} AS p5, {R('med', 3)} AS "median", {R('p95', 3)} AS p95, {R('relative_span')} AS relative_span,
 distinct_values, excited, CASE WHEN NOT excited THEN concat('driver_not_excited:', driver, '=', printf('%.3f', relative_span)) END AS driver_flag FROM ex"""))
def c11(spark, d):
    return rounded(ob.driver_excitation(loaded(spark, d)), p5=3, median=3, p95=3)


FLAG_SQL = FROZEN_SQL + f""",
ff AS (SELECT site, device_id, 0 AS g, pos, concat('frozen_channel:', channel, '=', {plain('round_even(modal_share*100,1)', 1)}) AS flag FROM frz WHERE rows>=200 AND modal_share>=95e-2
 UNION ALL SELECT site, device_id, 1, 0, concat('cop_below_unity:reconstructed_COP=', {plain('round_even(1e2*impossible_rows/usable_rows,1)', 1)}) FROM env WHERE 1e2*impossible_rows/nullif(usable_rows,0)>=1
 UNION ALL SELECT site, device_id, 2, 0, concat('cop_above_envelope:reconstructed_COP=', CASE WHEN round_even(cop_median,2)>=100 THEN {plain('round_even(cop_median,1)', 1)} ELSE {plain('round_even(cop_median,2)', 2)} END) FROM env WHERE cop_median>10),
fa AS (SELECT site, device_id, string_agg(flag, ',' ORDER BY g, pos) AS envelope_flags FROM ff GROUP BY 1,2)"""


def flags(spark, d):
    lo = loaded(spark, d)
    frozen = ob.frozen_findings(ob.frozen_channels(lo)).join(lo.select(*KEYS, "equipment_type").distinct(), KEYS)
    return ob.envelope_flags(frozen, ob.cop_envelope(ob.cop_rows(lo.where("equipment_type = 'chiller'"))))


@query("c12_envelope_flags", with_(FLAG_SQL, body="SELECT * FROM fa"))
def c12(spark, d):
    f = flags(spark, d).where(F.size("envelope_flags") > 0)
    return f.withColumn("envelope_flags", F.array_join("envelope_flags", ","))


SCAN_ROLES = [*ALL_ROLES, "attributed_flow_m3_h", "fans_on_count", "heat_rejection_W", "Q_W", "Q_cond_W", "cooling_load_W"]
ACT_SQL = PROF_SQL.replace(", ".join(ALL_ROLES) + " FROM att) ON", ", ".join(ALL_ROLES) + " FROM att) ON") + """,
hs AS (SELECT device_id AS hd, count(run_signal)>0 AS hr, count(power_W)>0 AS hp, count(chw_flow_m3_h)>0 AS hc, count(cw_flow_m3_h)>0 AS hw, count(attributed_flow_m3_h)>0 AS ha,
  count(speed_Hz)>0 AS hsp, count(fan1_Hz)>0 AS hf FROM att GROUP BY 1),
ac AS (SELECT *, (CASE WHEN hr THEN coalesce(run_signal>0,false) WHEN hp THEN coalesce(power_W>0,false) WHEN hc THEN coalesce(chw_flow_m3_h>0,false) WHEN hw THEN coalesce(cw_flow_m3_h>0,false)
  WHEN ha THEN coalesce(attributed_flow_m3_h>0,false) ELSE true END) AND (CASE WHEN hsp THEN coalesce(speed_Hz>0,false) WHEN hf THEN coalesce(fan1_Hz>0,false) ELSE true END) AS active
  FROM att JOIN hs ON hd=device_id),
lga AS (UNPIVOT (SELECT site, device_id, """ + ", ".join(f"{r}::DOUBLE AS {r}" for r in SCAN_ROLES) + " FROM ac WHERE active) ON " + ", ".join(SCAN_ROLES) + """ INTO NAME role VALUE value),
mod AS (SELECT site, device_id, role, sum(c)::BIGINT AS rows, max(c)/sum(c) AS modal_share FROM (SELECT site, device_id, role, value, count(*) AS c FROM lga GROUP BY ALL) GROUP BY 1,2,3)"""


def active(spark, d):
    return ob.active_mask(bind.attributed(spark, d), SCAN_ROLES)


@query("c13_active_mask", with_(ACT_SQL, body="SELECT site, device_id, ts_s, active FROM ac"))
def c13(spark, d):
    return active(spark, d).select(*KEYS, "ts_s", "active")


@query("c14_degenerate_target", with_(ACT_SQL, body=f"SELECT site, device_id, role, rows, {R('modal_share')} AS modal_share, modal_share>95e-2 AS degenerate FROM mod"))
def c14(spark, d):
    m = ob.modal_share(active(spark, d), SCAN_ROLES)
    return rounded(m.withColumn("degenerate", F.col("modal_share") > ob.MODAL_MAX))


PAIR_SQL = ACT_SQL + """,
lgf AS (UNPIVOT (SELECT site, device_id, """ + ", ".join(f"{r}::DOUBLE AS {r}" for r in SCAN_ROLES) + " FROM att) ON " + ", ".join(SCAN_ROLES) + """ INTO NAME role VALUE value),
el AS (SELECT l.device_id, l.role, m.modal_share<=95e-2 AS tgt FROM (SELECT device_id, role FROM lgf GROUP BY 1,2 HAVING count(*)>=200 AND count(DISTINCT value)>1 AND max(abs(value))>1e-8) l
  JOIN mod m USING (device_id, role)),
lgt AS (UNPIVOT (SELECT site, device_id, ts_s, """ + ", ".join(f"{r}::DOUBLE AS {r}" for r in SCAN_ROLES) + " FROM ac WHERE active) ON " + ", ".join(SCAN_ROLES) + """ INTO NAME role VALUE value),
lge AS (SELECT lgt.*, tgt FROM lgt JOIN el USING (device_id, role)),
pr0 AS (SELECT a.site, a.device_id, a.role AS target, b.role AS driver, a.value AS y, b.value AS x FROM lge a JOIN lge b ON a.device_id=b.device_id AND a.ts_s=b.ts_s AND a.role<>b.role WHERE a.tgt),
pst AS (SELECT site, device_id, target, driver, count(*) AS n, avg(x) AS mx, avg(y) AS my, max(y)-min(y) AS sy, sum(x*y)/nullif(sum(x*x),0) AS pb, bool_and(x=y) AS same
  FROM pr0 GROUP BY 1,2,3,4 HAVING count(*)>=200 AND max(y)>min(y) AND max(x)>min(x)),
psl AS (SELECT p.device_id, p.target, p.driver, sum((x-mx)*(y-my))/sum((x-mx)*(x-mx)) AS b1 FROM pr0 p JOIN pst s USING (device_id, target, driver) GROUP BY 1,2,3),
pin AS (SELECT s.site, s.device_id, s.target, s.driver, s.n, s.same, count(CASE WHEN abs(y-pb*x)>1e-8*sy THEN 1 END) AS po, count(CASE WHEN abs(y-my-b1*(x-mx))>1e-8*sy THEN 1 END) AS ao
  FROM pr0 p JOIN pst s USING (device_id, target, driver) JOIN psl USING (device_id, target, driver) GROUP BY 1,2,3,4,5,6),
exa AS (SELECT *, CASE WHEN same THEN 'identity' WHEN 1e0-po/n>=99e-2 THEN 'proportional' ELSE 'affine' END AS form, CASE WHEN same THEN 0 WHEN 1e0-po/n>=99e-2 THEN po ELSE ao END AS n_outlier_rows
  FROM pin WHERE same OR 1e0-po/n>=99e-2 OR 1e0-ao/n>=99e-2)"""


@staged("cells", written=True)
def cells(spark, d):
    return ob.scan_cells(bind.attributed(spark, d), SCAN_ROLES)


@staged("forms")
def forms(spark, d):
    return ob.pair_forms(cells(spark, d), SCAN_ROLES)


@staged("findings")
def findings(spark, d):
    return ob.dependency_findings(forms(spark, d))


@query("c15_duplicate_channels", with_(PAIR_SQL, body="SELECT site, device_id, target, driver, n FROM pst WHERE same"))
def c15(spark, d):
    return ob.duplicate_channels(cells(spark, d), SCAN_ROLES)


# the fits of the library in sums: orthogonal polynomials q1, q2, q3 of a centred driver, fitted on all rows, then on the rows kept
_K = "site, device_id, target, driver"
_U = "USING (device_id, target, driver)"


def _steps(p: str, rows: str, keys: str, z: str, w: str) -> list[str]:
    """CTEs ``{p}a``, ``{p}b``, ``{p}c``: sums that orthogonalise 1, z, z^2, z^3 over ``rows`` and fit w. Sums of z are zero."""
    join = f"USING ({keys})"
    q2 = f"({z}*{z}-a2*{z}-b2)"
    q3 = f"({z}*{z}*{z}-c2*{q2}-c1*{z}-c0)"
    return [f"{p}a AS (SELECT {keys}, avg({w}) AS t0, sum({w}*{z})/nullif(sum({z}*{z}),0) AS t1, sum({z}**3)/nullif(sum({z}*{z}),0) AS a2, avg({z}*{z}) AS b2, sum({z}**4)/nullif(sum({z}*{z}),0) AS c1, avg({z}**3) AS c0 FROM {rows} GROUP BY ALL)",
            f"{p}b AS (SELECT {keys}, CASE WHEN avg({q2}*{q2})>1e-20 THEN sum({w}*{q2})/sum({q2}*{q2}) ELSE 0 END AS t2, CASE WHEN avg({q2}*{q2})>1e-20 THEN sum({z}**3*{q2})/sum({q2}*{q2}) ELSE 0 END AS c2 FROM {rows} JOIN {p}a {join} GROUP BY ALL)",
            f"{p}c AS (SELECT {keys}, CASE WHEN avg({q3}*{q3})>1e-20 THEN sum({w}*{q3})/sum({q3}*{q3}) ELSE 0 END AS t3 FROM {rows} JOIN {p}a {join} JOIN {p}b {join} GROUP BY ALL)",
            f"{p} AS (SELECT * FROM {p}a JOIN {p}b {join} JOIN {p}c {join})"]


_Q2, _Q3 = "(z*z-a2*z-b2)", "(z*z*z-c2*(z*z-a2*z-b2)-c1*z-c0)"
_FIT = f"t0 + coalesce(t1,0)*z + CASE WHEN o>=2 THEN t2*{_Q2} ELSE 0 END + CASE WHEN o>=3 THEN t3*{_Q3} ELSE 0 END"
FORM_SQL = PAIR_SQL + ",\n" + ",\n".join([
    f"f0 AS (SELECT {_K}, x, y, (x-mx)/xs AS z, (y-my)/sy AS w, pb, sy FROM pr0 JOIN (SELECT *, mx AS _m FROM pst) {_U.replace('device_id', 'site, device_id')} JOIN (SELECT device_id, target, driver, max(x)-min(x) AS xs FROM pr0 GROUP BY ALL) {_U})",
    *_steps("g", "f0", _K, "z", "w"),
    "o4 AS (SELECT unnest([0,1,2,3]) AS o)",
    f"e1 AS (SELECT f0.*, o, CASE WHEN o=0 THEN abs(y-pb*x)/sy ELSE abs(w-({_FIT})) END AS e FROM f0 JOIN g USING ({_K}), o4)",
    f"e2 AS (SELECT *, row_number() OVER (PARTITION BY {_K}, o ORDER BY e)-1 AS i, count(*) OVER (PARTITION BY {_K}, o) AS nn FROM e1)",
    f"ct AS (SELECT {_K}, o, max(e) AS cut FROM e2 WHERE i=CAST(floor(95e-2*(nn-1)) AS BIGINT) GROUP BY ALL)",
    f"k0 AS (SELECT {_K}, o, x, y, w, sy FROM e1 JOIN ct USING ({_K}, o) WHERE e<=cut*(1+1e-9)+1e-13)",
    f"ks AS (SELECT {_K}, o, avg(x) AS mk, CASE WHEN max(x)>min(x) THEN max(x)-min(x) ELSE 1 END AS sk, sum(x*y)/nullif(sum(x*x),0) AS kb FROM k0 GROUP BY ALL)",
    f"k1 AS (SELECT k0.*, (x-mk)/sk AS z FROM k0 JOIN ks USING ({_K}, o))",
    *_steps("h", "k1", _K + ", o", "z", "w"),
    f"e3 AS (SELECT {_K}, o, sy, CASE WHEN o=0 THEN abs(y-coalesce(kb,0)*x) ELSE abs(w-({_FIT}))*sy END AS err FROM (SELECT f0.site, f0.device_id, f0.target, f0.driver, x, y, w, sy, h.* EXCLUDE ({_K}), kb, (x-mk)/sk AS z FROM f0 JOIN ks USING ({_K}) JOIN h USING ({_K}, o)))",
    f"fo AS (SELECT {_K}, o, count(CASE WHEN err>1e-8*sy THEN 1 END) AS n_outlier_rows, 1e2*max(err)/any_value(sy) AS mr FROM e3 GROUP BY ALL)",
    f"fm AS (SELECT {_K}, n, same, o AS form_ord, ['proportional','affine','quadratic','cubic'][o+1] AS form, n_outlier_rows, mr, 1e0-n_outlier_rows/n AS inl FROM fo JOIN pst USING ({_K}))",
    "ex AS (SELECT * FROM fm WHERE same OR inl>=99e-2)",
    f"pk AS (SELECT * FROM ex QUALIFY row_number() OVER (PARTITION BY {_K} ORDER BY form_ord)=1)",
    "bs AS (SELECT * FROM fm WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.device_id=fm.device_id AND ex.target=fm.target) QUALIFY row_number() OVER (PARTITION BY device_id, target ORDER BY inl DESC, driver, form_ord)=1)",
    f"fd AS (SELECT {_K}, n, same AS duplicate, form_ord, CASE WHEN same THEN 'identity' ELSE form END AS form, CASE WHEN same THEN 1e0 ELSE inl END AS inlier_fraction, CASE WHEN same THEN 0 ELSE n_outlier_rows END AS n_outlier_rows, (same OR inl>=99e-2) AS synthetic FROM (SELECT * FROM pk UNION ALL SELECT * FROM bs))"])


@query("c16_trimmed_fit", with_(FORM_SQL, body=f"SELECT {_K}, n, same, form_ord::BIGINT AS form_ord, form, n_outlier_rows::BIGINT AS n_outlier_rows, {R('mr', 5)} AS max_residual_pct_of_range, {R('inl')} AS inlier_fraction FROM fm"))
def c16(spark, d):
    """All four forms of every pair after the trimmed refit."""
    return rounded(forms(spark, d).drop("coefficients"), max_residual_pct_of_range=5)


@query("c17_dependency_scan", with_(FORM_SQL, body=f"SELECT {_K}, form, n, n_outlier_rows::BIGINT AS n_outlier_rows, {R('inlier_fraction')} AS inlier_fraction, duplicate, synthetic FROM fd"))
def c17(spark, d):
    """Every finding: exact dependencies and, for targets without one, the best fit."""
    return rounded(findings(spark, d).select(*KEYS, "target", "driver", "form", "n", "n_outlier_rows", "inlier_fraction", "duplicate", "synthetic"))


SYN_SQL = PAIR_SQL + """,
syn AS (SELECT e.site, e.device_id, string_agg(DISTINCT target, ',' ORDER BY target) AS synthetic, bool_or(target=CASE equipment_type WHEN 'heat_exchanger' THEN 'tcwr_C' WHEN 'cooling_tower' THEN 'heat_rejection_W' ELSE 'power_W' END) AS target_synthetic
 FROM exa e JOIN (SELECT DISTINCT device_id, equipment_type FROM att) t USING (device_id)
 WHERE list_contains(CASE equipment_type WHEN 'chiller' THEN ['power_W','cooling_load_W'] WHEN 'cooling_tower' THEN ['heat_rejection_W','power_W'] WHEN 'pump' THEN ['power_W'] ELSE ['Q_W','tcwr_C'] END, target) GROUP BY 1,2)"""


@query("c18_synthetic_roles", with_(SYN_SQL, body="SELECT * FROM syn"))
def c18(spark, d):
    s = ob.synthetic_roles(findings(spark, d), bind.attributed(spark, d))
    return s.withColumn("synthetic", F.array_join("synthetic", ","))


_ORD = "list_position([" + ",".join(f"'{r}'" for r in SCAN_ROLES) + "], {})"
IND_SQL = PAIR_SQL + f""",
alv AS (SELECT site, device_id, role, {_ORD.format('role')} AS o FROM lgf GROUP BY 1,2,3 HAVING count(DISTINCT value)>1),
dd AS (SELECT site, device_id, role FROM lgf GROUP BY 1,2,3 HAVING count(DISTINCT value)<=1),
ind AS (SELECT a.site, a.device_id, a.role, a.o FROM alv a WHERE NOT EXISTS (SELECT 1 FROM exa e JOIN alv b ON b.device_id=e.device_id AND b.role=CASE WHEN e.target=a.role THEN e.driver ELSE e.target END
  WHERE e.device_id=a.device_id AND (e.target=a.role OR e.driver=a.role) AND b.o<a.o))"""


@query("c19_independent_signals", with_(IND_SQL, body="SELECT site, device_id, string_agg(role, ',' ORDER BY o) AS independent FROM ind GROUP BY 1,2"))
def c19(spark, d):
    p = ql.channel_profile(bind.attributed(spark, d), SCAN_ROLES)
    return ob.independent_signals(p, findings(spark, d), SCAN_ROLES).withColumn("independent", F.array_join("independent", ","))


@query("c20_device_observability", with_(IND_SQL, body="""SELECT m.site, m.device_id, mapped, coalesce(i.k,0) AS independent, coalesce(x.k,0) AS dead, coalesce(s.k,0) AS synthetic,
 coalesce(i.r,'') AS independent_roles, coalesce(x.r,'') AS dead_roles, coalesce(s.r,'') AS synthetic_roles
 FROM (SELECT site, device_id, count(DISTINCT role) AS mapped FROM lgf GROUP BY 1,2) m
 LEFT JOIN (SELECT device_id, count(*) AS k, string_agg(role, ',' ORDER BY o) AS r FROM ind GROUP BY 1) i USING (device_id)
 LEFT JOIN (SELECT device_id, count(*) AS k, string_agg(role, ',' ORDER BY role) AS r FROM dd GROUP BY 1) x USING (device_id)
 LEFT JOIN (SELECT device_id, count(DISTINCT target) AS k, string_agg(DISTINCT target, ',' ORDER BY target) AS r FROM exa GROUP BY 1) s USING (device_id)"""))
def c20(spark, d):
    return rounded(ob.device_observability(bind.attributed(spark, d), SCAN_ROLES, findings(spark, d)))


# coefficients in powers of z, then of the driver x = mk + sk z
_P = ["t0 + CASE WHEN o>=2 THEN -t2*b2 ELSE 0 END + CASE WHEN o>=3 THEN t3*(c2*b2-c0) ELSE 0 END", "coalesce(t1,0) + CASE WHEN o>=2 THEN -t2*a2 ELSE 0 END + CASE WHEN o>=3 THEN t3*(c2*a2-c1) ELSE 0 END",
      "CASE WHEN o>=2 THEN t2 ELSE 0 END - CASE WHEN o>=3 THEN t3*c2 ELSE 0 END", "CASE WHEN o>=3 THEN t3 ELSE 0 END"]
_R = ["my+sy*(p0-p1*mk/sk+p2*(mk/sk)**2-p3*(mk/sk)**3)", "sy*(p1/sk-2*p2*mk/sk**2+3*p3*mk**2/sk**3)", "sy*(p2/sk**2-3*p3*mk/sk**3)", "sy*p3/sk**3"]


@query("c21_dependency_text", with_(FORM_SQL, "zp AS (SELECT " + _K + ", o, mk, sk, kb, " + ", ".join(f"{e} AS p{i}" for i, e in enumerate(_P)) + f" FROM h JOIN ks USING ({_K}, o))",
                                    f"xp AS (SELECT {_K}, o, kb, [" + ", ".join(_R) + f"] AS r FROM zp JOIN pst USING ({_K}))", body=f"""
 SELECT {_K}, CASE WHEN duplicate THEN concat(target, ' is a copy of ', driver) WHEN form_ord=0 THEN concat(target, ' = ', printf('%.6g', kb), '*', driver)
  ELSE concat(target, ' = ', array_to_string([printf('%.6g', r[i+1]) || CASE i WHEN 0 THEN '' WHEN 1 THEN '*'||driver ELSE '*'||driver||'^'||i END for i in range(0, form_ord+1)], ' + ')) END AS relation
 FROM fd JOIN xp USING ({_K}) WHERE xp.o=fd.form_ord"""))
def c21(spark, d):
    return ob.dependency_text(findings(spark, d)).select(*KEYS, "target", "driver", "relation")


_T = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{EVIDENCE_TIERS[i]}'" for i, e in enumerate(["view", "click", "signup", "purchase"])) + f" ELSE '{EVIDENCE_TIERS[5]}' END"


@query("c22_evidence_tier_rank", f"WITH e AS (SELECT user_id, CAST(event_id%5 AS BIGINT) AS variable, {_T} AS tier FROM events) SELECT user_id, variable, min(tier_rank) AS rank, arg_min(tier, tier_rank) AS tier FROM (SELECT *, list_position([{', '.join(chr(39) + t + chr(39) for t in EVIDENCE_TIERS)}], tier)::BIGINT AS tier_rank FROM e) GROUP BY 1,2")
def c22(spark, d):
    e = bind.table(spark, d, "events").selectExpr("user_id", "CAST(event_id%5 AS BIGINT) AS variable", f"{_T} AS tier")
    return ob.best_tier(e, ["user_id", "variable"])


_V = ", ".join(f"('{f}','{m}','{c}','{n}')" for f, m, c, n in SENSOR_SET)


@query("c23_sensor_readiness", with_(ATT_SQL, f"ss(fam, model_type, ch, need) AS (VALUES {_V})", body="""SELECT d.site, d.device_id, d.equipment_type, model_type, count(*) AS channels, count(CASE WHEN need='required' AND p.role IS NULL THEN 1 END)=0 AS ready,
 coalesce(string_agg(CASE WHEN need='required' AND p.role IS NULL THEN ch END, ',' ORDER BY ch), '') AS missing FROM (SELECT DISTINCT site, device_id, equipment_type FROM att) d JOIN ss ON fam=equipment_type
 LEFT JOIN (SELECT DISTINCT device_id, role FROM (UNPIVOT (SELECT device_id, """ + ", ".join(f"{r}::DOUBLE AS {r}" for r in sorted({c for _, _, c, _ in SENSOR_SET})) + " FROM att) ON " + ", ".join(sorted({c for _, _, c, _ in SENSOR_SET})) + """ INTO NAME role VALUE value)) p ON p.device_id=d.device_id AND p.role=ch GROUP BY 1,2,3,4"""))
def c23(spark, d):
    s = rounded(ob.sensor_readiness(bind.attributed(spark, d)))
    return s.withColumn("missing", F.array_join(F.array_sort(F.split("missing", ",")), ","))


