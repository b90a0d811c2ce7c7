"""Roll-ups and reporting tables over result tables derived from orders, customers and events."""

from pyspark.sql import functions as F

from catalog import bind
from catalog.bind import KEYS
from catalog.registry import R, query, rounded
from fleetgauge.operators import effort as ef
from fleetgauge.operators import quality as ql
from fleetgauge.operators import rollup as ru

_FAM = "CASE CAST({k}%4 AS INT) WHEN 0 THEN 'chiller' WHEN 1 THEN 'cooling_tower' WHEN 2 THEN 'pump' ELSE 'heat_exchanger' END"
_C1 = "CASE CAST({k}%4 AS INT) WHEN 0 THEN 'EIR' WHEN 1 THEN 'Merkel' WHEN 2 THEN 'affinity' ELSE 'ConstantEffectiveness' END"
_C2 = "CASE CAST({k}%4 AS INT) WHEN 0 THEN 'EEIR' WHEN 1 THEN 'YorkCalc' WHEN 2 THEN 'speed_poly' ELSE 'PlateEffectivenessNTU' END"
_DEV = "substr('ABCD', CAST(c_nationkey%4 AS INT)+1, 1) AS site, concat('DV_', CAST(c_custkey AS STRING)) AS device_id"
_LEVEL = "CASE WHEN c_acctbal<0 THEN 'blocked' WHEN c_acctbal<2000 THEN 'nominal_only' ELSE 'full_physical' END"
_EXC = "CASE WHEN c_custkey%13=0 THEN NULL ELSE abs(c_acctbal)/1e4 END"


def fam(k, t=_FAM):
    return t.replace("{k}", k)


# one text for both engines; {customer} and {orders} are the given tables
VIEWS = {
    "gate": f"""SELECT {_DEV}, {fam('c_custkey')} AS equipment_type, {_LEVEL} AS level, concat('balance ', c_mktsegment) AS reason, CAST(1000+c_custkey%500 AS BIGINT) AS rows, CAST(1000+c_custkey%500-c_nationkey*10 AS BIGINT) AS on_rows,
 CAST(c_custkey%700 AS BIGINT) AS valid_full_rows, CASE CAST(c_custkey%4 AS INT) WHEN 0 THEN 'cooling_load_W' WHEN 1 THEN 'fan1_Hz' WHEN 2 THEN 'speed_Hz' END AS driver, {_EXC} AS driver_excitation,
 concat_ws(',', CASE WHEN c_custkey%17=0 THEN 'synthetic_channel:power_W' END, CASE WHEN c_custkey%5=0 THEN ' frozen_channel:chw_flow_m3_h=97' END, CASE WHEN {_EXC}<1e-1 THEN 'driver_not_excited:x=0.05' END, CASE WHEN c_custkey%5=0 AND c_nationkey%2=0 THEN 'frozen_channel:cw_flow_m3_h=98' END) AS flags
 FROM {{customer}}""",
    "selected": f"""SELECT {_DEV}, CASE WHEN c_acctbal>=2000 AND k>=5 THEN (CASE WHEN c_custkey%8<4 THEN {fam('c_custkey', _C1)} ELSE {fam('c_custkey', _C2)} END) END AS candidate,
 CASE WHEN c_acctbal<0 THEN 'blocked' WHEN c_acctbal<2000 THEN 'power_calibration_blocked' WHEN k<5 THEN 'identification_only' ELSE 'ok' END AS status, 'gate-copy' AS level,
 CASE WHEN c_acctbal>=2000 AND k>=5 AND c_custkey%19<>0 THEN m/1e4 END AS test_CVRMSE_pct, CASE WHEN c_acctbal>=2000 AND k>=5 THEN m/12e3 END AS selection_CVRMSE_pct, CASE WHEN c_acctbal>=2000 AND k>=5 THEN m/2e5 END AS test_skill, CASE WHEN c_acctbal>=2000 AND k>=5 THEN m/25e4 END AS selection_skill
 FROM {{customer}} JOIN (SELECT o_custkey, count(*) AS k, avg(o_totalprice) AS m FROM {{orders}} GROUP BY o_custkey) x ON o_custkey=c_custkey""",
    "metrics": f"""SELECT {_DEV}, {fam('c_custkey')} AS equipment_type, candidate, stage, CASE WHEN stage<>'train' THEN CAST(n*10 AS BIGINT) END AS N, CASE WHEN stage<>'train' AND c_custkey%4 IN (0,2) THEN m/1e4 END AS P_CVRMSE_pct, CASE WHEN stage<>'train' AND c_custkey%4 IN (0,2) THEN m/1e5-2 END AS P_NMBE_pct,
 CASE WHEN stage<>'train' AND c_custkey%4 IN (0,2) THEN m/2e5 END AS P_skill, CASE WHEN stage<>'train' AND c_custkey%4=1 THEN m/3e5 END AS T_RMSE_K, CASE WHEN stage<>'train' AND c_custkey%4=1 THEN m/1e5-1 END AS T_NMBE_pct, CASE WHEN stage<>'train' AND c_custkey%4=1 THEN m/4e5 END AS T_skill,
 CASE WHEN stage<>'train' AND c_custkey%4 IN (1,3) THEN m/2e4 END AS Q_CVRMSE_pct, CASE WHEN stage<>'train' AND c_custkey%4 IN (1,3) THEN m/2e5-1 END AS Q_NMBE_pct, CASE WHEN stage<>'train' AND c_custkey%4 IN (1,3) THEN m/3e5 END AS Q_skill, CASE WHEN stage<>'train' AND c_custkey%4=0 THEN m/9e3 END AS COP_CVRMSE_pct
 FROM {{customer}} JOIN (SELECT o_custkey, CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH','3-MEDIUM') THEN {fam('o_custkey', _C1)} ELSE {fam('o_custkey', _C2)} END AS candidate, CASE o_orderstatus WHEN 'F' THEN 'selection' WHEN 'O' THEN 'test' ELSE 'train' END AS stage, count(*) AS n, avg(o_totalprice) AS m
  FROM {{orders}} GROUP BY 1,2,3) x ON o_custkey=c_custkey WHERE c_acctbal>=2000""",
    "full_period": f"""SELECT {_DEV}, CASE WHEN c_custkey%9<>0 THEN {fam('c_custkey')} END AS equipment_type, CASE WHEN c_acctbal>=2000 AND k>=5 THEN 'ok' ELSE 'blocked' END AS status, CASE WHEN c_acctbal>=2000 AND k>=5 THEN {fam('c_custkey', _C1)} END AS candidate, 'power_W' AS target, CAST(k*100 AS BIGINT) AS N,
 CASE WHEN c_custkey%11<>0 THEN m/1e4 END AS CVRMSE_pct, m/1e5-2 AS NMBE_pct, m/11e3 AS MAPE_pct, 1-m/1e6 AS R2, CASE WHEN c_custkey%7<>0 THEN m/2e4 END AS Q_CVRMSE_pct, CASE WHEN c_custkey%7<>0 THEN m/2e5-1 END AS Q_NMBE_pct, CASE WHEN c_custkey%4=0 AND c_custkey%3<>0 THEN m/9e3 END AS COP_CVRMSE_pct,
 CASE WHEN c_custkey%4=0 THEN m/3e5 END AS COP_NMBE_pct, CASE WHEN c_custkey%4=1 AND c_custkey%5<>0 THEN m/5e4 END AS T_CVRMSE_pct_diagnostic, CASE WHEN c_custkey%4=1 THEN m/6e5 END AS T_NMBE_pct_diagnostic, CASE WHEN c_custkey%4=3 AND c_custkey%6<>1 THEN m/7e4 END AS T2_CVRMSE_pct
 FROM {{customer}} JOIN (SELECT o_custkey, count(*) AS k, avg(o_totalprice) AS m FROM {{orders}} GROUP BY o_custkey HAVING count(*)>=3) x ON o_custkey=c_custkey""",
    "sidecar": f"""SELECT {_DEV}, CASE WHEN c_custkey%2=1 THEN 'pump' ELSE 'chiller' END AS equipment_type, 'power_W' AS target, abs(c_acctbal)/1e3 AS CVRMSE_pct, c_acctbal/1e4 AS NMBE_pct, abs(c_acctbal)/11e2 AS MAPE_pct, 1-abs(c_acctbal)/1e5 AS R2 FROM {{customer}} WHERE c_custkey%3=0""",
}
SQL_VIEWS = {n: f"{n} AS ({t.format(customer='customer', orders='orders')})" for n, t in VIEWS.items()}


def view(spark, d, name):
    return spark.sql(VIEWS[name], customer=bind.table(spark, d, "customer"), orders=bind.table(spark, d, "orders"))


def sql(*names, extra="", body):
    ctes = [SQL_VIEWS[n] for n in names] + ([extra] if extra else [])
    return "WITH " + ",\n".join(ctes) + "\n" + body


JOINED = "joined AS (SELECT g.*, s.candidate, s.status, s.test_CVRMSE_pct, s.selection_CVRMSE_pct, s.test_skill, s.selection_skill FROM gate g LEFT JOIN selected s USING (device_id))"


def joined(spark, d):
    return ru.gate_selected_join(view(spark, d, "gate"), view(spark, d, "selected"))


def jsql(body, *more, extra=""):
    return sql("gate", "selected", *more, extra=JOINED + (",\n" + extra if extra else ""), body=body)


_SC = f"site, device_id, equipment_type, level, status, candidate, {R('test_CVRMSE_pct')} AS test_CVRMSE_pct, {R('test_skill')} AS test_skill, {R('selection_skill')} AS selection_skill, driver, {R('driver_excitation')} AS driver_excitation, on_rows, flags"


@query("e09_gate_selected_join", jsql(f"SELECT site, device_id, equipment_type, level, status, candidate, {R('test_CVRMSE_pct')} AS test_CVRMSE_pct FROM joined"))
def e09(spark, d):
    return rounded(joined(spark, d).select(*KEYS, "equipment_type", "level", "status", "candidate", "test_CVRMSE_pct"))


ENR = """enr AS (SELECT f.* EXCLUDE (equipment_type), coalesce(f.equipment_type, g.equipment_type) AS equipment_type, g.level, g.reason, g.flags, g.valid_full_rows, s.candidate AS selected_candidate, s.selection_CVRMSE_pct, s.test_CVRMSE_pct
 FROM full_period f LEFT JOIN gate g USING (device_id) LEFT JOIN selected s USING (device_id))"""


@query("e10_metrics_enrich", sql("gate", "selected", "full_period", extra=ENR, body=f"SELECT site, device_id, equipment_type, level, status, candidate, selected_candidate, valid_full_rows, {R('selection_CVRMSE_pct')} AS selection_CVRMSE_pct FROM enr"))
def e10(spark, d):
    m = ru.metrics_enrich(view(spark, d, "full_period"), view(spark, d, "gate"), view(spark, d, "selected"))
    return rounded(m.select(*KEYS, "equipment_type", "level", "status", "candidate", "selected_candidate", "valid_full_rows", "selection_CVRMSE_pct"))


GO = """go AS (SELECT g.site, g.device_id, g.equipment_type, g.level, coalesce(s.status, g.level) AS status, s.candidate, g.reason FROM gate g LEFT JOIN selected s USING (device_id) WHERE NOT EXISTS (SELECT 1 FROM full_period f WHERE f.device_id=g.device_id))"""


@query("e11_gate_only_rows", sql("gate", "selected", "full_period", extra=GO, body="SELECT * FROM go"))
def e11(spark, d):
    return ru.gate_only_rows(view(spark, d, "gate"), view(spark, d, "full_period"), view(spark, d, "selected"))


SID = """sd AS (SELECT device_id AS sdev, CVRMSE_pct AS side_CVRMSE_pct, NMBE_pct AS side_NMBE_pct, MAPE_pct AS side_MAPE_pct, R2 AS side_R2 FROM sidecar WHERE equipment_type='pump' AND target='power_W')"""


@query("e12_power_sidecar_join", sql("full_period", "sidecar", extra=SID, body=f"SELECT site, device_id, equipment_type, {R('side_CVRMSE_pct')} AS side_CVRMSE_pct, sdev IS NOT NULL AS has_sidecar FROM full_period LEFT JOIN sd ON sdev=device_id AND equipment_type='cooling_tower'"))
def e12(spark, d):
    j = ru.power_sidecar_join(view(spark, d, "full_period"), view(spark, d, "sidecar"))
    return rounded(j.select(*KEYS, "equipment_type", "side_CVRMSE_pct", "has_sidecar"))


@query("e13_selected_test_lookup", sql("selected", "metrics", body=f"SELECT m.site, m.device_id, candidate, N, {R('m.P_CVRMSE_pct')} AS P_CVRMSE_pct, 'found' AS outcome FROM metrics m JOIN selected s USING (device_id, candidate) WHERE s.status='ok' AND stage='test' UNION ALL "
                                       "SELECT s.site, s.device_id, s.candidate, NULL, NULL, 'missing' FROM selected s WHERE s.status='ok' AND NOT EXISTS (SELECT 1 FROM metrics m WHERE m.device_id=s.device_id AND m.candidate=s.candidate AND m.stage='test')"))
def e13(spark, d):
    s, m = view(spark, d, "selected"), view(spark, d, "metrics")
    a = ru.selected_test_lookup(s, m).select(*KEYS, "candidate", "N", "P_CVRMSE_pct", F.lit("found").alias("outcome"))
    b = ru.missing_test_rows(s, m).select(*KEYS, "candidate", F.lit("missing").alias("outcome"))
    return rounded(a.unionByName(b, allowMissingColumns=True))


_REG = "SELECT CASE WHEN s_suppkey%23=5 THEN NULL ELSE concat('EQ_', CAST(s_suppkey AS STRING)) END AS device_id, CASE WHEN s_suppkey%17=3 THEN 'boiler' ELSE 'pump' END AS equipment_type, CAST(s_nationkey AS STRING) AS adapter FROM {supplier}"


@query("e14_registry_validation", f"WITH r AS ({_REG.format(supplier='supplier')}) SELECT 'device id is required' AS error FROM r WHERE device_id IS NULL UNION ALL SELECT concat(coalesce(device_id,'?'), ': unsupported equipment type: ', equipment_type) FROM r WHERE equipment_type='boiler' "
       "UNION ALL SELECT concat(coalesce(device_id,'?'), ': adapter config not found: ', adapter) FROM r WHERE adapter NOT IN (SELECT CAST(n_nationkey AS STRING) FROM nation WHERE n_regionkey<>2)")
def e14(spark, d):
    from fleetgauge.contracts import profile_table
    r = spark.sql(_REG, supplier=bind.table(spark, d, "supplier"))
    ad = bind.table(spark, d, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").cast("string").alias("adapter"))
    return ru.registry_errors(r, profile_table(spark), ad)


@query("e15_hash_consistency", """WITH r AS (SELECT doc_id, CASE WHEN doc_id%10=0 THEN '' ELSE sha256(text) END AS h FROM documents), s AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE lang='en') SELECT doc_id, h AS sha256 FROM r WHERE length(h)>0 AND h NOT IN (SELECT h FROM s)""")
def e15(spark, d):
    t = bind.table(spark, d, "documents")
    rec = t.select("doc_id", F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.sha2("text", 256)).alias("sha256"))
    return ru.hash_mismatches(rec, t.where("lang = 'en'").select(F.sha2("text", 256).alias("sha256"))).select("doc_id", "sha256")


PIV = "SELECT site, device_id, " + ", ".join(f"{R(f'round_even(max(CASE WHEN candidate={chr(39)}{c}{chr(39)} THEN {m}_CVRMSE_pct END),1)', 1)} AS {c}_{m}_CVRMSE" for c in ("EIR", "EEIR") for m in ("P", "COP")) + " FROM metrics WHERE equipment_type='chiller' AND stage='test' GROUP BY 1,2"


@query("l05_chiller_model_pivot", sql("metrics", "selected", body=f"SELECT p.*, s.candidate AS selected_candidate FROM ({PIV}) p LEFT JOIN selected s USING (device_id)"))
def l05(spark, d):
    return rounded(ru.chiller_model_pivot(view(spark, d, "metrics"), view(spark, d, "selected")), _=1)


@query("l06_cross_site_summary", jsql(f"""SELECT site, equipment_type AS family, count(*) AS devices, count(CASE WHEN status='ok' THEN 1 END) AS scored, {R("round_even(median(CASE WHEN status='ok' THEN test_CVRMSE_pct END),2)", 2)} AS median_test_CVRMSE,
 count(CASE WHEN contains(flags,'synthetic_channel') THEN 1 END) AS blocked_synthetic FROM joined GROUP BY 1,2"""))
def l06(spark, d):
    return rounded(ru.cross_site_summary(joined(spark, d)), _=2)


REF = "ref AS (SELECT site, equipment_type AS family, coalesce(status,'(not reached)') AS status, count(*) AS devices FROM joined WHERE coalesce(status,'(not reached)')<>'ok' GROUP BY 1,2,3)"


@query("l07_refusal_counts", jsql("SELECT * FROM ref", extra=REF))
def l07(spark, d):
    return ru.refusal_counts(joined(spark, d))


FLG = "flg AS (SELECT * FROM (SELECT site, device_id, equipment_type, trim(unnest(string_split(flags, ','))) AS flag FROM joined) WHERE flag<>'')"


@query("l08_explode_flags", jsql("SELECT * FROM flg", extra=FLG))
def l08(spark, d):
    return ru.explode_flags(joined(spark, d))


@query("l09_device_score_table", jsql(f"SELECT {_SC} FROM joined"))
def l09(spark, d):
    return rounded(ru.device_scores(joined(spark, d)))


CHECKS = ["synthetic_channel", "frozen_channel", "driver_not_excited"]


@query("l10_observability_matrix", jsql("SELECT j.site, count(*) AS devices, count(CASE WHEN status='ok' THEN 1 END) AS scored, " + ", ".join(f"(SELECT count(DISTINCT device_id) FROM flg f WHERE f.site=j.site AND split_part(flag,':',1)='{c}') AS {c}" for c in CHECKS) + " FROM joined j GROUP BY 1", extra=FLG))
def l10(spark, d):
    j = joined(spark, d)
    return ru.observability_matrix(ru.explode_flags(j), j, CHECKS)


@query("l11_site_totals", jsql(f"SELECT site, count(*) AS devices, count(CASE WHEN status='ok' THEN 1 END) AS scored, {R("round_even(1e2*count(CASE WHEN status='ok' THEN 1 END)/count(*),1)", 1)} AS scored_pct FROM joined GROUP BY 1"))
def l11(spark, d):
    return rounded(ru.site_totals(ru.cross_site_summary(joined(spark, d))), _=1)


@query("l12_unexcited_no_skill", jsql(f"SELECT site, device_id, equipment_type, candidate, {R('test_CVRMSE_pct')} AS test_CVRMSE_pct, {R('test_skill')} AS test_skill, driver, {R('driver_excitation')} AS driver_excitation, coalesce(driver_excitation<1e-1,false) AS unexcited, coalesce(test_skill>=1,false) AS no_skill FROM joined WHERE status='ok' AND (driver_excitation<1e-1 OR test_skill>=1)"))
def l12(spark, d):
    return rounded(ru.weak_scores(ru.device_scores(joined(spark, d))))


RDY = """rdy AS (SELECT site, equipment_type AS family, count(*) AS devices, count(CASE WHEN status='ok' THEN 1 END) AS scored, sum(rows)::BIGINT AS raw_records, sum(on_rows)::BIGINT AS operating_records, coalesce(round_even(1e2*sum(on_rows)/sum(rows),1),0e0) AS operating_pct,
 round_even(median(CASE WHEN status='ok' THEN test_CVRMSE_pct END),2) AS median_test_error_pct FROM joined GROUP BY 1,2)"""


@query("l13_readiness_table", jsql(f"SELECT * EXCLUDE (operating_pct, median_test_error_pct), {R('operating_pct', 1)} AS operating_pct, {R('median_test_error_pct', 2)} AS median_test_error_pct FROM rdy", extra=RDY))
def l13(spark, d):
    return rounded(ru.readiness(joined(spark, d)), operating_pct=1, median_test_error_pct=2)


CAD = """ce AS (SELECT DISTINCT substr('ABCD', CAST(user_id%4 AS INT)+1, 1) AS site, concat('U_', CAST(user_id AS STRING)) AS dev, epoch_us(ts)//3600000000*3600 AS s FROM events), cl AS (SELECT *, s-lag(s) OVER (PARTITION BY dev ORDER BY s) AS step FROM ce),
cm AS (SELECT dev, step FROM (SELECT dev, step, row_number() OVER (PARTITION BY dev ORDER BY count(*) DESC, step) AS o FROM cl WHERE step IS NOT NULL GROUP BY 1,2) WHERE o=1),
cad AS (SELECT * FROM (SELECT site, dev, (max(s)-min(s))//86400 AS span_days, concat(strftime(make_timestamp(min(s)*1000000), '%Y-%m'), ' to ', strftime(make_timestamp(max(s)*1000000), '%Y-%m')) AS win, row_number() OVER (PARTITION BY site ORDER BY dev) AS o FROM ce GROUP BY 1,2) LEFT JOIN cm USING (dev) WHERE o=1)"""
_LAB = "CASE family WHEN 'chiller' THEN 'Chiller' WHEN 'cooling_tower' THEN 'Cooling tower' WHEN 'pump' THEN 'Pump' ELSE 'Heat exchanger' END"


@query("l14_site_profile", jsql(f"""SELECT r.site, concat(CAST(coalesce(any_value(step)//60,0) AS STRING), ' min') AS sampling_interval, any_value(span_days) AS span_days, any_value(win) AS "window", count(DISTINCT family) AS families,
 string_agg({_LAB}, ', ' ORDER BY list_position(['chiller','cooling_tower','pump','heat_exchanger'], family)) AS family_list, sum(devices)::BIGINT AS devices, sum(scored)::BIGINT AS scored, {R('round_even(1e2*sum(scored)/sum(devices),1)', 1)} AS scored_pct, sum(raw_records)::BIGINT AS raw_records, sum(operating_records)::BIGINT AS operating_records
 FROM rdy r LEFT JOIN cad USING (site) GROUP BY 1""", extra=RDY + ",\n" + CAD))
def l14(spark, d):
    e = bind.table(spark, d, "events").select(F.expr("substr('ABCD', CAST(user_id%4 AS INT)+1, 1)").alias("site"), F.expr("concat('U_', CAST(user_id AS STRING))").alias("device_id"),
                                              F.timestamp_seconds(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3600000000)) * 3600).alias("ts")).distinct()
    c = ql.cadence_profile(e)
    first = c.groupBy("site").agg(F.min_by(F.struct("step_min", "span_days", "window"), F.col("device_id")).alias("f")).select("site", "f.*")
    return rounded(ru.site_profile(ru.readiness(joined(spark, d)), first), scored_pct=1)


_PRI = "CASE equipment_type WHEN 'cooling_tower' THEN T_RMSE_K WHEN 'heat_exchanger' THEN Q_CVRMSE_pct ELSE P_CVRMSE_pct END"
_DISP = "CASE {c} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ru.DISPLAY.items()) + " ELSE {c} END"
SVT = f"""sv0 AS (SELECT site, device_id, equipment_type, candidate, max(CASE WHEN stage='selection' THEN {_PRI} END) AS selection_error, max(CASE WHEN stage='test' THEN {_PRI} END) AS test_error FROM metrics GROUP BY 1,2,3,4),
svt AS (SELECT v.site, equipment_type AS family, replace(v.device_id,'_','-') AS device, {_DISP.format(c='v.candidate')} AS candidate, coalesce(s.candidate=v.candidate,false) AS selected, selection_error, test_error, test_error/nullif(selection_error,0) AS ratio, test_error-selection_error AS gap
 FROM sv0 v LEFT JOIN selected s USING (device_id) WHERE selection_error IS NOT NULL OR test_error IS NOT NULL)"""


def svt(spark, d):
    return ru.selection_vs_test(view(spark, d, "metrics"), view(spark, d, "selected"))


@query("l15_selection_vs_test", sql("metrics", "selected", extra=SVT, body=f"SELECT site, family, device, candidate, selected, {R('selection_error')} AS selection_error, {R('test_error')} AS test_error, {R('ratio')} AS ratio, {R('gap')} AS gap FROM svt"))
def l15(spark, d):
    return rounded(svt(spark, d))


_LABEL = "CASE equipment_type " + " ".join(f"WHEN '{f}' THEN '{p[3]}'" for f, p in ru.PRIMARY.items()) + " END"


def _pri(i, pre="m."):
    return "CASE m.equipment_type " + " ".join(f"WHEN '{f}' THEN {pre}{p[i]}" for f, p in ru.PRIMARY.items()) + " END"


@query("l16_device_result_table", jsql(f"""SELECT m.site, m.equipment_type AS family, replace(m.device_id,'_','-') AS device, {_DISP.format(c='m.candidate')} AS selected_model, {_LABEL.replace('equipment_type', 'm.equipment_type')} AS metric_label, m.N AS test_n, {R(_pri(0))} AS test_error, {R(_pri(1))} AS test_nmbe_pct,
 {R(_pri(2))} AS test_skill, {R('j.selection_skill')} AS selection_skill, coalesce(j.driver,'') AS driver, {R('j.driver_excitation')} AS driver_excitation FROM metrics m JOIN joined j ON j.device_id=m.device_id AND j.candidate=m.candidate WHERE j.status='ok' AND stage='test'""", "metrics"))
def l16(spark, d):
    return rounded(ru.device_results(view(spark, d, "selected"), view(spark, d, "metrics"), ru.device_scores(joined(spark, d))))


@query("l17_segment_counts", jsql("""SELECT j.site, j.equipment_type AS family, replace(j.device_id,'_','-') AS device, coalesce(on_rows,0) AS retained_operating_rows, coalesce(s,0) AS selection_n, coalesce(t,0) AS test_n, status AS split_status, coalesce(status='ok',false) AS scored
 FROM joined j LEFT JOIN (SELECT device_id, max(CASE WHEN stage='selection' THEN N END) AS s, max(CASE WHEN stage='test' THEN N END) AS t FROM metrics GROUP BY 1) m USING (device_id)""", "metrics"))
def l17(spark, d):
    return rounded(ru.segment_counts(ru.device_scores(joined(spark, d)), view(spark, d, "metrics")))


@query("l18_generalisation_by_site", sql("metrics", "selected", extra=SVT, body=f"SELECT site, count(*) AS devices, count(CASE WHEN ratio>1 THEN 1 END) AS worse_on_test, {R('max(ratio)')} AS max_ratio, {R('median(ratio)')} AS median_ratio FROM svt WHERE selected AND ratio IS NOT NULL GROUP BY 1"))
def l18(spark, d):
    return rounded(ru.generalisation_by_site(svt(spark, d)))


STATUSES = ["blocked", "power_calibration_blocked", "identification_only"]


@query("l20_status_pivot", jsql("SELECT site, " + ", ".join(f"coalesce(sum(CASE WHEN status='{s}' THEN devices END),0)::BIGINT AS {s}" for s in STATUSES) + " FROM ref GROUP BY 1", extra=REF))
def l20(spark, d):
    return ru.status_pivot(ru.refusal_counts(joined(spark, d)), STATUSES)


@query("l21_candidate_wins", jsql("SELECT equipment_type, candidate, site, count(*) AS wins FROM joined WHERE status='ok' GROUP BY 1,2,3"))
def l21(spark, d):
    return ru.candidate_wins(ru.device_scores(joined(spark, d)))


def norm_sql(src):
    ch, ct, pu, hx = (f"equipment_type='{f}'" for f in ("chiller", "cooling_tower", "pump", "heat_exchanger"))
    v = {"P_CVRMSE_pct": f"CASE WHEN {ch} OR {pu} THEN CVRMSE_pct WHEN {ct} THEN side_CVRMSE_pct END", "P_NMBE_pct": f"CASE WHEN {ch} OR {pu} THEN NMBE_pct WHEN {ct} THEN side_NMBE_pct END",
         "P_MAPE_pct": f"CASE WHEN {pu} THEN MAPE_pct WHEN {ct} THEN side_MAPE_pct END", "P_R2": f"CASE WHEN {pu} THEN R2 WHEN {ct} THEN side_R2 END",
         "Q_CVRMSE_pct": f"CASE WHEN {ch} OR {hx} THEN Q_CVRMSE_pct WHEN {ct} THEN coalesce(Q_CVRMSE_pct, CVRMSE_pct) END", "Q_NMBE_pct": f"CASE WHEN {ch} THEN Q_NMBE_pct WHEN {ct} THEN coalesce(Q_NMBE_pct, NMBE_pct) END",
         "COP_CVRMSE_pct": f"CASE WHEN {ch} THEN COP_CVRMSE_pct END", "COP_NMBE_pct": f"CASE WHEN {ch} THEN COP_NMBE_pct END",
         "T_out_CVRMSE_pct": f"CASE WHEN {ct} THEN T_CVRMSE_pct_diagnostic WHEN {hx} THEN coalesce(T2_CVRMSE_pct, CVRMSE_pct) END", "T_out_NMBE_pct": f"CASE WHEN {ct} THEN T_NMBE_pct_diagnostic WHEN {hx} THEN NMBE_pct END"}
    vals = ", ".join(f"{e} AS {n}" for n, e in v.items())

    def gap(n, cond):
        return f"CASE WHEN status='ok' AND {cond} THEN '{n} validation artifact missing' END"
    miss = ", ".join([gap("P", f"({ch} OR {pu}) AND P_CVRMSE_pct IS NULL"), gap("P", f"{ct} AND NOT has_sidecar"), gap("T_out", f"{hx} AND T_out_CVRMSE_pct IS NULL"), gap("Q", f"({ch} OR {ct} OR {hx}) AND Q_CVRMSE_pct IS NULL"),
                      gap("COP", f"{ch} AND COP_CVRMSE_pct IS NULL"), gap("T_out", f"{ct} AND T_out_CVRMSE_pct IS NULL")])
    basis = f"CASE WHEN {ch} THEN 'power_W + cooling_load_W + COP' WHEN {ct} THEN 'heat_rejection_W + outlet_temperature + power_W' WHEN {pu} THEN 'power_W' WHEN {hx} THEN 'leaving_temperature + heat_transfer_W' ELSE coalesce(target,'') END"
    return f"(SELECT *, concat_ws('; ', {miss}) AS missing_metrics FROM (SELECT site, device_id, equipment_type, level, status, coalesce(candidate, selected_candidate) AS model, N, has_sidecar, {basis} AS metric_basis, reason, {vals} FROM {src}))"


SIDE_ENR = SID + ",\n" + ENR + ",\nsrc AS (SELECT e.*, sdev IS NOT NULL AS has_sidecar, side_CVRMSE_pct, side_NMBE_pct, side_MAPE_pct, side_R2 FROM enr e LEFT JOIN sd ON sdev=device_id AND equipment_type='cooling_tower')"
_ND = "site, device_id, equipment_type, level, status, model, N, metric_basis, reason, " + ", ".join(f"{R(c)} AS {c}" for c in ru._DETAIL) + ", missing_metrics"


@query("l22_normalise_metrics", sql("gate", "selected", "full_period", "sidecar", extra=SIDE_ENR, body=f"SELECT {_ND} FROM {norm_sql('src')}"))
def l22(spark, d):
    m = ru.metrics_enrich(view(spark, d, "full_period"), view(spark, d, "gate"), view(spark, d, "selected"))
    return rounded(ru.normalise_metrics(ru.power_sidecar_join(m, view(spark, d, "sidecar"))))


_FPC = ["target", "N", "CVRMSE_pct", "NMBE_pct", "MAPE_pct", "R2", "Q_CVRMSE_pct", "Q_NMBE_pct", "COP_CVRMSE_pct", "COP_NMBE_pct", "T_CVRMSE_pct_diagnostic", "T_NMBE_pct_diagnostic", "T2_CVRMSE_pct"]
_BASE = "site, device_id, equipment_type, level, status, candidate, reason, selected_candidate"
DETAIL_SQL = SID + ",\n" + ENR + ",\n" + GO + f""",
u AS (SELECT {_BASE}, {', '.join(_FPC)} FROM enr UNION ALL SELECT site, device_id, equipment_type, level, status, candidate, reason, NULL, {', '.join('NULL' for _ in _FPC)} FROM go),
src AS (SELECT u.*, sdev IS NOT NULL AS has_sidecar, side_CVRMSE_pct, side_NMBE_pct, side_MAPE_pct, side_R2 FROM u LEFT JOIN sd ON sdev=device_id AND equipment_type='cooling_tower' WHERE NOT (equipment_type='pump' AND starts_with(device_id,'DV_1'))),
dtl AS (SELECT * FROM {norm_sql('src')})"""


def detail(spark, d):
    v = {n: view(spark, d, n) for n in ("full_period", "gate", "selected", "sidecar")}
    return ru.project_detail(v["full_period"], v["gate"], v["selected"], v["sidecar"], "DV_1")


@query("l23_project_overview", sql("gate", "selected", "full_period", "sidecar", extra=DETAIL_SQL, body=f"""SELECT equipment_type, pm AS primary_metric, count(*) AS devices, count(CASE WHEN status='ok' THEN 1 END) AS ok, count(CASE WHEN status='ok' THEN NULL ELSE 1 END) AS limited_or_blocked, {R('avg(v)')} AS mean_pct, {R('median(v)')} AS median_pct,
 count(CASE WHEN missing_metrics<>'' THEN 1 END) AS missing_metric_rows FROM (SELECT *, CASE equipment_type WHEN 'cooling_tower' THEN 'Q_CVRMSE_pct' WHEN 'heat_exchanger' THEN 'T_out_CVRMSE_pct' ELSE 'P_CVRMSE_pct' END AS pm,
 CASE WHEN status='ok' THEN CASE equipment_type WHEN 'cooling_tower' THEN Q_CVRMSE_pct WHEN 'heat_exchanger' THEN T_out_CVRMSE_pct ELSE P_CVRMSE_pct END END AS v FROM dtl) GROUP BY 1,2"""))
def l23(spark, d):
    return rounded(ru.project_overview(detail(spark, d)))


@query("l24_project_detail", sql("gate", "selected", "full_period", "sidecar", extra=DETAIL_SQL, body=f"SELECT {_ND} FROM dtl"))
def l24(spark, d):
    return rounded(detail(spark, d))


# ---- effort -------------------------------------------------------------------------------------------------------
_LOG = "SELECT event_type AS family, CASE WHEN user_id%7=0 THEN 'FAMILY_SETUP' ELSE concat('dev_', CAST(user_id AS STRING)) END AS device, user_id AS ord, event_id%8+1 AS stage, value AS minutes, user_id%5=0 AS blocked FROM {events}"


def log(spark, d):
    return spark.sql(_LOG, events=bind.table(spark, d, "events"))


FAMILY_SQL = f"""lg AS ({_LOG.format(events='events')}), dv AS (SELECT family, device, ord, sum(minutes) AS m, bool_or(blocked) AS b FROM lg WHERE device<>'FAMILY_SETUP' GROUP BY 1,2,3),
rk AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY ord, device) AS o FROM dv WHERE NOT b),
fm AS (SELECT d.family, coalesce((SELECT sum(minutes)/60 FROM lg WHERE lg.family=d.family AND device='FAMILY_SETUP'),0e0) AS setup_h, (SELECT m FROM rk WHERE rk.family=d.family AND o=1) AS m1, (SELECT m FROM rk WHERE rk.family=d.family AND o=2) AS m2,
 avg(CASE WHEN NOT b THEN m END)/60 AS accepted_marginal_h, coalesce(avg(CASE WHEN b THEN m END)/60,0e0) AS blocked_marginal_h FROM dv d GROUP BY d.family)"""


@query("l25_effort_per_family", f"WITH {FAMILY_SQL} SELECT family, {R('setup_h')} AS setup_h, {R('m1/60')} AS device_1_h, {R('m2/60')} AS device_2_h, {R('accepted_marginal_h')} AS accepted_marginal_h, {R('blocked_marginal_h')} AS blocked_marginal_h, {R('1-m2/nullif(m1,0)')} AS learning_effect FROM fm")
def l25(spark, d):
    return rounded(ef.per_family(log(spark, d)))


@query("l26_effort_extrapolation", f"WITH {FAMILY_SQL}, iv AS (SELECT event_type AS family, count(DISTINCT CASE WHEN user_id%5<>0 THEN user_id END) AS accepted, count(DISTINCT CASE WHEN user_id%5=0 THEN user_id END) AS refused FROM events GROUP BY 1) SELECT family, accepted, refused, {R('setup_h')} AS setup_h, {R('accepted_marginal_h')} AS accepted_marginal_h, {R('blocked_marginal_h')} AS blocked_marginal_h, {R('setup_h+accepted*accepted_marginal_h+refused*blocked_marginal_h')} AS full_inventory_h FROM fm JOIN iv USING (family)")
def l26(spark, d):
    e = bind.table(spark, d, "events")
    inv = e.groupBy(F.col("event_type").alias("family")).agg(F.countDistinct(F.when(F.col("user_id") % 5 != 0, F.col("user_id"))).alias("accepted"), F.countDistinct(F.when(F.col("user_id") % 5 == 0, F.col("user_id"))).alias("refused"))
    return rounded(ef.extrapolate(ef.per_family(log(spark, d)), inv))


@query("l27_effort_by_stage", f"WITH {FAMILY_SQL} SELECT stage, {R('sum(minutes)/60', 4)} AS manual_h FROM lg GROUP BY 1")
def l27(spark, d):
    return rounded(ef.by_stage(log(spark, d)), _=4)


_LO = "CASE stage " + " ".join(f"WHEN {k} THEN {v[0]}::DOUBLE" for k, v in ef.RETENTION.items()) + " END"
_HI = "CASE stage " + " ".join(f"WHEN {k} THEN {v[1]}::DOUBLE" for k, v in ef.RETENTION.items()) + " END"


@query("l28_effort_sensitivity", f"WITH {FAMILY_SQL}, st AS (SELECT stage, sum(minutes)/60 AS h FROM lg GROUP BY 1), rt AS (SELECT stage, h, h*{_LO} AS l, h*{_HI} AS u FROM st), al AS (SELECT * FROM rt UNION ALL SELECT NULL, sum(h), sum(l), sum(u) FROM rt) SELECT stage, {R('h', 4)} AS manual_h, {R('l', 4)} AS auto_low_h, {R('u', 4)} AS auto_high_h, {R('1e2*(1-u/h)', 4)} AS reduction_low_pct, {R('1e2*(1-l/h)', 4)} AS reduction_high_pct FROM al")
def l28(spark, d):
    return rounded(ef.sensitivity(ef.by_stage(log(spark, d))), _=4)


@query("l29_machine_wall_time", f"SELECT user_id AS run, count(DISTINCT event_type) AS stages, {R('(max(epoch_us(ts))-min(epoch_us(ts)))/6e7')} AS wall_min FROM events GROUP BY 1")
def l29(spark, d):
    s = bind.table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("ts").cast("timestamp").alias("created"), F.col("event_type").alias("stage"), F.col("ts").cast("timestamp").alias("updated"))
    return rounded(ef.machine_wall_time(s))
