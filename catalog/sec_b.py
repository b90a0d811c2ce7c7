"""Projections, predicates, canonicalisation."""

from pyspark.sql import functions as F

from catalog import bind
from catalog.bind import FLEET_SQL, KEYS, MASK_SQL, RAW_SQL, with_
from catalog.registry import R, query, rounded
from fleetgauge.operators import prepare as pr
from fleetgauge.sources import raw as rw


@query("b01_canonicalise", with_(RAW_SQL, body=f"SELECT site, device_id, row_id, {R('power_W')} AS power_W, {R('chw_flow_m3_h')} AS chw_flow_m3_h FROM canon"))
def b01(spark, d):
    return rounded(bind.canonical_raw(spark, d).select(*KEYS, "row_id", "power_W", "chw_flow_m3_h"))


@query("b01_canonicalise_long", with_(RAW_SQL, body=f"""SELECT site, device_id, row_id, 'power_W' AS role, {R('power_W')} AS value FROM canon
 UNION ALL SELECT site, device_id, row_id, 'chw_flow_m3_h', {R('chw_flow_m3_h')} FROM canon"""))
def b01_long(spark, d):
    raw = bind.raw(spark, d)
    cells = raw.select(*KEYS, "row_id", F.explode(F.create_map(F.lit("power_kw"), "power_kw", F.lit("flow_lps"), "flow_lps")).alias("source", "text"))
    spec = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(s["source"]).alias("source"), F.lit(s["scale"]).alias("scale"), F.lit(s.get("offset", 0.0)).alias("offset"))
                     for r, s in bind.ADAPTER.items()])
    adapter = raw.select(*KEYS).distinct().select(*KEYS, F.explode(spec).alias("a")).select(*KEYS, "a.*")
    return rounded(rw.canonicalise_long(cells, adapter))


@query("b02_numeric_coerce", with_(RAW_SQL, body=f"""SELECT site, device_id, row_id, {R('CASE WHEN isfinite(TRY_CAST(power_kw AS DOUBLE)) THEN TRY_CAST(power_kw AS DOUBLE) END')} AS power_kw
 FROM raw"""))
def b02(spark, d):
    return rounded(rw.numeric_coerce(bind.raw(spark, d), ["power_kw"]).select(*KEYS, "row_id", "power_kw"))


@query("b03_utc_normalise", with_(RAW_SQL, body="""SELECT site, device_id, row_id, ts_s, strftime(make_timestamp(ts_s*1000000), '%Y-%m-%dT%H:%M:%SZ') AS iso FROM canon"""))
def b03(spark, d):
    return bind.canonical_raw(spark, d).select(*KEYS, "row_id", "ts_s", rw.iso_z("ts").alias("iso"))


POL_SQL = RAW_SQL + """,
pv AS (SELECT *, lag(ts_s) OVER (PARTITION BY device_id ORDER BY row_id) AS pts FROM canon),
rep AS (SELECT site, device_id, count(*) AS rows, count_if(ts_s IS NULL)::BIGINT AS invalid, count_if(pts>ts_s)::BIGINT AS backward_steps,
  (count(ts_s)-count(DISTINCT ts_s))::BIGINT AS duplicates FROM pv GROUP BY 1,2)"""


@query("b04_timestamp_policy", with_(POL_SQL, body="SELECT * FROM rep"))
def b04(spark, d):
    return rw.timestamp_report(bind.canonical_raw(spark, d)).select(*KEYS, "rows", "invalid", "backward_steps", "duplicates")


_ERR = """CASE WHEN invalid>0 THEN concat('invalid timestamp values: ', CAST(invalid AS STRING)) WHEN {dup} AND duplicates>0 THEN
 concat('duplicate timestamp values: ', CAST(duplicates AS STRING)) WHEN {srt} AND backward_steps>0 THEN 'timestamps are not sorted chronologically' END"""


@query("b04_policy_errors", with_(POL_SQL, body=" UNION ALL ".join(
    f"SELECT '{p}' AS policy, site, device_id, {_ERR.format(dup=a, srt=b)} AS error FROM rep WHERE {_ERR.format(dup=a, srt=b)} IS NOT NULL"
    for p, a, b in (("reject", "true", "true"), ("sort", "true", "false"), ("sort_deduplicate", "false", "false")))))
def b04_errors(spark, d):
    rep = rw.timestamp_report(bind.canonical_raw(spark, d))
    parts = [rw.policy_errors(rep, p).withColumn("policy", F.lit(p)) for p in rw.POLICIES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("b04_keep_first", with_(RAW_SQL, body=f"""SELECT site, device_id, ts_s, row_id, {R('power_W')} AS power_W FROM
 (SELECT *, row_number() OVER (PARTITION BY device_id, ts_s ORDER BY row_id) AS o FROM canon WHERE ts_s IS NOT NULL) WHERE o=1"""))
def b04_first(spark, d):
    c = rw.keep_first(bind.canonical_raw(spark, d).where("ts IS NOT NULL"))
    return rounded(c.select(*KEYS, "ts_s", "row_id", "power_W"))


RULES = {"supply": ["red", "bolt"], "return": ["blue", "gear"], "flow": ["anvil"], "status": ["hot", "ring"], "valve": ["old"]}


@query("b05_point_name_mapping", "WITH pts AS (SELECT p_type AS site, p_brand AS device_id, concat(p_name, '/', CAST(p_partkey AS STRING)) AS point FROM part),\nhits AS (" + " UNION ALL ".join(
    f"SELECT site, device_id, '{r}' AS role, point FROM pts WHERE {' AND '.join(f'contains(point, {chr(39)}{x}{chr(39)})' for x in parts)}" for r, parts in RULES.items())
    + ")\nSELECT site, device_id, role, min(point) AS source FROM hits GROUP BY 1,2,3 HAVING count(*)=1")
def b05(spark, d):
    p = bind.table(spark, d, "part").select(F.col("p_type").alias("site"), F.col("p_brand").alias("device_id"),
                                            F.concat("p_name", F.lit("/"), F.col("p_partkey").cast("string")).alias("point"))
    return pr.map_points(p, RULES)


@query("b06_column_swap_repair", with_(FLEET_SQL, body=f"SELECT site, device_id, ts_s, {R('tcws_1_C')} AS twb_C, {R('twb_C')} AS tcws_1_C FROM fleet WHERE equipment_type='cooling_tower'"))
def b06(spark, d):
    f = bind.fleet(spark, d).where("equipment_type = 'cooling_tower'")
    return rounded(pr.swap_columns(f, "tcws_1_C", "twb_C").select(*KEYS, "ts_s", "twb_C", "tcws_1_C"))


@query("b07_order_violation_report", with_(FLEET_SQL, body=f"""SELECT site, device_id, violations, both_known, {R('1e2*violations/greatest(both_known,1)')} AS violation_pct FROM
 (SELECT site, device_id, count(CASE WHEN twb_C>tcws_1_C THEN 1 END) AS violations, count_if(twb_C IS NOT NULL AND tcws_1_C IS NOT NULL)::BIGINT AS both_known FROM fleet GROUP BY 1,2)"""))
def b07(spark, d):
    return rounded(pr.order_violations(bind.fleet(spark, d), "twb_C", "tcws_1_C"))


RN_SQL = FLEET_SQL + """,
fr AS (SELECT *, row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY device_id) AS cnt, min(ts_s) OVER (PARTITION BY device_id) AS t0
  FROM fleet WHERE run_signal>5e-1 WINDOW w AS (PARTITION BY device_id ORDER BY ts_s))"""


def running(spark, d):
    return bind.fleet(spark, d).where("run_signal > 0.5")


@query("b08_decimate_nth", with_(RN_SQL, body="SELECT site, device_id, ts_s FROM fr WHERE rn%7=0"))
def b08(spark, d):
    return pr.decimate(running(spark, d), 7).select(*KEYS, "ts_s")


@query("b09_subset_stride", with_(RN_SQL, body=f"""SELECT site, device_id, ts_s, {R('(ts_s-t0)*1e0')} AS elapsed_s FROM fr
 WHERE rn%(CASE WHEN cnt<=150 THEN 1 ELSE greatest(1, cnt//150) END)=0"""))
def b09(spark, d):
    return rounded(pr.subset_stride(running(spark, d), 150).select(*KEYS, "ts_s", "elapsed_s"))


@query("b10_elapsed_seconds", with_(RN_SQL, body=f"SELECT site, device_id, ts_s, {R('(ts_s-t0)*1e0')} AS elapsed_s FROM fr"))
def b10(spark, d):
    return rounded(pr.elapsed(running(spark, d)).select(*KEYS, "ts_s", "elapsed_s"))


@query("b11_compressed_axis", with_(RN_SQL, body=f"SELECT site, device_id, ts_s, {R('rn*3e2')} AS axis_s FROM fr"))
def b11(spark, d):
    return rounded(pr.compressed_axis(running(spark, d), 300.0).select(*KEYS, "ts_s", "axis_s"))


@query("b12_finite_rows", with_(MASK_SQL, body="""SELECT site, device_id, count_if(operating AND power_W IS NOT NULL AND tcws_C IS NOT NULL AND cw_flow_m3_h IS NOT NULL)::BIGINT AS rows,
 0::BIGINT AS rows_absent FROM mk GROUP BY 1,2"""))
def b12(spark, d):
    m = bind.masked(spark, d)
    a = pr.finite_rows(m, ["power_W", "tcws_C", "cw_flow_m3_h"], F.col("operating"))
    return a.join(pr.finite_rows(m, ["power_W", "no_such_role"], F.col("operating"), "rows_absent"), KEYS)


_LABELS = "SELECT r_name AS site, substr('ABCDEFG', r_regionkey+1, 1) AS letter FROM region WHERE r_regionkey<4"


@query("b13_site_relabel", f"""WITH lab AS ({_LABELS}), dev AS (SELECT r_name AS site, s_suppkey FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey)
 SELECT s_suppkey AS device, site, letter, CASE WHEN letter IS NULL THEN 'unmapped' ELSE 'ok' END AS status FROM dev LEFT JOIN lab USING (site)""")
def b13(spark, d):
    s, n, r = (bind.table(spark, d, t) for t in ("supplier", "nation", "region"))
    dev = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("site"), F.col("s_suppkey").alias("device"))
    lab = r.where("r_regionkey < 4").selectExpr("r_name AS site", "substr('ABCDEFG', r_regionkey+1, 1) AS letter")
    bad = pr.unmapped_sites(dev, lab).withColumn("bad", F.lit(True))
    return (pr.relabel_sites(dev, lab).join(bad, "site", "left")
            .select("device", "site", "letter", F.when(F.col("bad"), "unmapped").otherwise("ok").alias("status")))


@query("b14_display_label", """SELECT DISTINCT replace(concat('EQ_', CAST(o_custkey AS STRING)), '_', '-') AS device, CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' WHEN '5-LOW' THEN 'Low'
 ELSE o_orderpriority END AS label, CASE CAST(o_custkey%4 AS INT) WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 99 END::BIGINT AS family_rank FROM orders""")
def b14(spark, d):
    o = bind.table(spark, d, "orders").withColumn("device_id", F.concat(F.lit("EQ_"), F.col("o_custkey").cast("string")))
    fam = F.element_at(F.array(*[F.lit(x) for x in ("chiller", "cooling_tower", "pump", "boiler")]), (F.col("o_custkey") % 4 + 1).cast("int"))
    o = o.withColumn("equipment_type", fam)
    return o.select(pr.device_label().alias("device"), pr.display_label("o_orderpriority", {"1-URGENT": "Urgent", "5-LOW": "Low"}).alias("label"),
                    pr.family_rank().cast("bigint").alias("family_rank")).distinct()


@query("b15_controlled_guard", with_(FLEET_SQL, body="""SELECT DISTINCT site, device_id, equipment_type, CASE equipment_type WHEN 'cooling_tower' THEN 'tcws_1_C' ELSE 'tchws_C' END AS target
 FROM fleet WHERE equipment_type IN ('chiller','heat_exchanger','cooling_tower')"""))
def b15(spark, d):
    req = bind.fleet(spark, d).select(*KEYS, "equipment_type").distinct()
    t = F.when(F.col("equipment_type") == "cooling_tower", "tcws_1_C").otherwise("tchws_C")
    return pr.controlled_targets(req.withColumn("target", t)).select(*KEYS, "equipment_type", "target")


