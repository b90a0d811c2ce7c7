"""Temporal splits."""

from pyspark.sql import functions as F

from catalog import bind
from catalog.bind import FLEET_SQL, KEYS, with_
from catalog.registry import R, query, rounded
from fleetgauge.operators import prepare as pr
from fleetgauge.operators import splits as sp

SPEC = sp.SplitSpec(buffer_hours=6.0, min_identification_rows=60, min_selection_rows=60, min_test_rows=120)
RUN_SQL = FLEET_SQL + ",\nru AS (SELECT * FROM fleet WHERE run_signal>5e-1)"


def run(spark, d):
    return bind.fleet(spark, d).where("run_signal > 0.5")


NUM = RUN_SQL + ",\nnu AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts_s)-1 AS rn, count(*) OVER (PARTITION BY device_id) AS n FROM ru)"


@query("i01_chronological_split", with_(NUM, body="""SELECT site, device_id, ts_s, CASE WHEN n<5 THEN NULL WHEN rn<greatest(1, floor(n*6e-1)) THEN 'identification'
 WHEN rn<least(greatest(greatest(1, floor(n*6e-1))+1, floor(n*8e-1)), n-1) THEN 'selection' ELSE 'test' END AS segment FROM nu"""))
def i01(spark, d):
    return sp.chronological_split(run(spark, d)).select(*KEYS, "ts_s", "segment")


_PAT = "CASE blk4 WHEN 0 THEN 'identification' WHEN 2 THEN 'selection' ELSE 'test' END"


def blocks_sql(src="ru", buffer=6.0, name="pb"):
    half = f"{buffer * 18e8:.0f}e0"
    return f"""{name}0 AS (SELECT site, device_id, min(ts_s*1000000)*1e0 AS t0, (max(ts_s*1000000)*1e0-min(ts_s*1000000)*1e0)/12 AS w FROM {src} GROUP BY 1,2 HAVING max(ts_s)>min(ts_s)),
{name}1 AS (SELECT *, CASE WHEN w<={half}*2 THEN w*1e-1 ELSE {half} END AS h, unnest(range(12)) AS block FROM {name}0),
{name} AS (SELECT * FROM (SELECT site, device_id, block, {_PAT.replace('blk4', '(block%4)')} AS segment, t0+block*w+h AS a_us, t0+(block+1)*w-h AS b_us FROM {name}1) WHERE b_us>a_us)"""


PB_SQL = RUN_SQL + ",\n" + blocks_sql()


@query("i02_proportional_blocks", with_(PB_SQL, body="SELECT site, device_id, block::BIGINT AS block, segment, round(a_us/1e6,3) AS a_s, round(b_us/1e6,3) AS b_s FROM pb"))
def i02(spark, d):
    b = sp.proportional_blocks(run(spark, d), SPEC)
    return b.select(*KEYS, F.col("block").cast("bigint").alias("block"), "segment", F.round(F.col("a_us") / 1e6, 3).alias("a_s"), F.round(F.col("b_us") / 1e6, 3).alias("b_s"))


SEASON = sp.SplitSpec(identification_months=(5,), selection_months=(6,))


@query("i03_seasonal_blocks", with_(RUN_SQL, body="""SELECT f.site, f.device_id, f.month AS block, CASE f.month WHEN 5 THEN 'identification' ELSE 'selection' END AS segment, a AS a_s, a+least(14, greatest(1, days//12))*86400 AS b_s
 FROM (SELECT site, device_id, month(make_timestamp(ts_s*1000000)) AS month, min(ts_s) AS a FROM ru GROUP BY 1,2,3) f JOIN (SELECT device_id, (max(ts_s)-min(ts_s))//86400 AS days FROM ru GROUP BY 1) USING (device_id) WHERE f.month IN (5,6)"""))
def i03(spark, d):
    b = sp.seasonal_blocks(run(spark, d), SEASON)
    return b.select(*KEYS, F.col("block").cast("bigint").alias("block"), "segment", (F.col("a_us") / 1e6).cast("bigint").alias("a_s"), (F.col("b_us") / 1e6).cast("bigint").alias("b_s"))


DECL = {"identification": [("2024-05-02 00:00:00", "2024-05-05 00:00:00"), ("2024-05-09 00:00:00", "2024-05-11 00:00:00")],
        "selection": [("2024-05-04 12:00:00", "2024-05-06 00:00:00")]}
_DV = ", ".join(f"('{s}', epoch_us(TIMESTAMP '{a}')*1e0, epoch_us(TIMESTAMP '{b}')*1e0)" for s, v in DECL.items() for a, b in v)
DB_SQL = RUN_SQL + f",\ndb AS (SELECT site, device_id, v.segment, a_us, b_us FROM (SELECT DISTINCT site, device_id FROM ru) CROSS JOIN (VALUES {_DV}) AS v(segment, a_us, b_us))"


def declared(spark, d):
    return sp.declared_blocks(run(spark, d).select(*KEYS).distinct(), DECL)


@query("i04_declared_blocks", with_(DB_SQL, body="SELECT site, device_id, segment, (a_us/1e6)::BIGINT AS a_s, (b_us/1e6)::BIGINT AS b_s FROM db"))
def i04(spark, d):
    return declared(spark, d).select(*KEYS, "segment", (F.col("a_us") / 1e6).cast("bigint").alias("a_s"), (F.col("b_us") / 1e6).cast("bigint").alias("b_s"))


def place_sql(src, blocks, buffer=6.0, name="pl", tcol="ts_s*1e6"):
    pad = f"{buffer * 36e8:.0f}e0"
    return f"""{name}0 AS (SELECT r.*, coalesce(bool_or(b.segment='identification' AND {tcol}>=a_us AND {tcol}<b_us),false) AS i, coalesce(bool_or(b.segment='selection' AND {tcol}>=a_us AND {tcol}<b_us),false) AS s,
  coalesce(bool_or(b.segment='test' AND {tcol}>=a_us AND {tcol}<b_us),false) AS t, coalesce(bool_or(b.segment<>'test' AND {tcol}>=a_us-{pad} AND {tcol}<b_us+{pad}),false) AS near, coalesce(bool_or(b.segment='test'),false) AS anyt
  FROM {src} r LEFT JOIN {blocks} b ON r.device_id=b.device_id GROUP BY ALL),
{name} AS (SELECT *, CASE WHEN i THEN 'identification' WHEN s THEN 'selection' WHEN near THEN 'buffer' WHEN t OR NOT anyt THEN 'test' ELSE 'unused' END AS segment, i AND s AS overlap FROM {name}0)"""


RS_SQL = RUN_SQL + ",\nrs AS (SELECT site, device_id, ts_s, power_W, speed_Hz, chw_flow_m3_h FROM ru)"
PL_SQL = RS_SQL + ",\n" + blocks_sql("rs") + ",\n" + place_sql("rs", "pb")
DPL_SQL = DB_SQL.replace(",\ndb AS", ",\nrs AS (SELECT site, device_id, ts_s FROM ru),\ndb AS") + ",\n" + place_sql("rs", "db")


def split(spark, d):
    r = run(spark, d)
    return sp.build_split(r, sp.proportional_blocks(r, SPEC), SPEC.buffer_hours)


@query("i05_build_split", with_(PL_SQL, body="SELECT site, device_id, ts_s, segment, overlap FROM pl"))
def i05(spark, d):
    return split(spark, d).select(*KEYS, "ts_s", "segment", "overlap")


@query("i05_build_split_declared", with_(DPL_SQL, body="SELECT site, device_id, ts_s, segment, overlap FROM pl"))
def i05_declared(spark, d):
    return sp.build_split(run(spark, d), declared(spark, d), 6.0).select(*KEYS, "ts_s", "segment", "overlap")


def counts_sql(src="pl", mi=60, ms=60, mt=120):
    def w(seg, floor):
        return f"CASE WHEN {seg}<{floor} THEN concat('{seg} has ', CAST({seg} AS STRING), ' samples, below the {floor} required; status=', status) END"
    return f"""cn AS (SELECT *, CASE WHEN identification<{mi} THEN 'blocked_insufficient_identification' WHEN selection<{ms} OR test<{mt} THEN 'identification_only' ELSE 'full_split' END AS status FROM
 (SELECT site, device_id, count(*) AS rows, count_if(segment='identification')::BIGINT AS identification, count_if(segment='selection')::BIGINT AS selection, count_if(segment='test')::BIGINT AS test, count_if(segment='buffer')::BIGINT AS buffer,
  count_if(segment='unused')::BIGINT AS unused, count_if(overlap)::BIGINT AS ov, (max(ts_s)-min(ts_s))/864e2 AS span_days FROM {src} GROUP BY 1,2)),
cnw AS (SELECT *, concat_ws('; ', CASE WHEN ov>0 THEN concat(CAST(ov AS STRING), ' samples were claimed by both identification and selection; assigned to identification') END, {w('identification', mi)}, {w('selection', ms)}, {w('test', mt)}) AS warnings FROM cn)"""


_CN = "site, device_id, rows, identification, selection, test, buffer, unused, status, status='full_split' AS usable, warnings"


@query("i06_split_counts_status", with_(DPL_SQL, counts_sql(), body=f"SELECT {_CN} FROM cnw"))
def i06(spark, d):
    return sp.split_counts(sp.build_split(run(spark, d), declared(spark, d), 6.0), SPEC)


@query("i07_split_from_elapsed", with_(RUN_SQL, "rs AS (SELECT site, device_id, ts_s-min(ts_s) OVER (PARTITION BY device_id)+946684800 AS ts_s FROM ru)", blocks_sql("rs"), place_sql("rs", "pb"),
                                       body="SELECT site, device_id, ts_s-946684800 AS elapsed_s, segment FROM pl"))
def i07(spark, d):
    e = pr.elapsed(run(spark, d))
    return sp.split_from_elapsed(e, "elapsed_s", SPEC).select(*KEYS, F.col("elapsed_s").cast("bigint").alias("elapsed_s"), "segment")


THIN_SQL = NUM + ",\nth AS (SELECT site, device_id, ts_s FROM nu WHERE rn%(CASE WHEN n<=150 THEN 1 ELSE greatest(1, n//150) END)=0),\n" + blocks_sql("th") + ",\n" + place_sql("th", "pb")


@query("i08_resolve_split", with_(THIN_SQL, """nn AS (SELECT device_id, count(*) AS kept FROM th GROUP BY 1), nt AS (SELECT device_id, count(*) AS native FROM ru GROUP BY 1),
mm AS (SELECT *, CASE WHEN native>kept THEN greatest(round_even(60e0*kept/native,0)::BIGINT,30) ELSE 60 END AS m1, CASE WHEN native>kept THEN greatest(round_even(12e1*kept/native,0)::BIGINT,30) ELSE 120 END AS m3 FROM nn JOIN nt USING (device_id)),
cc AS (SELECT site, device_id, count_if(segment='identification')::BIGINT AS identification, count_if(segment='selection')::BIGINT AS selection, count_if(segment='test')::BIGINT AS test FROM pl GROUP BY 1,2)""",
                                  body="""SELECT site, device_id, identification, selection, test, m1 AS min_ident, m3 AS min_test, CASE WHEN identification<m1 THEN 'blocked_insufficient_identification' WHEN selection<m1 OR test<m3 THEN 'identification_only' ELSE 'full_split' END AS status
 FROM cc JOIN mm USING (device_id)"""))
def i08(spark, d):
    native = run(spark, d)
    kept = pr.subset_stride(native, 150)
    mins = sp.scaled_minimums(native, kept, SPEC)
    c = sp.split_counts(sp.resolve_split(kept, SPEC), SPEC, mins).join(mins, KEYS)
    return rounded(c.select(*KEYS, "identification", "selection", "test", "min_ident", "min_test", "status"))


COMP_SQL = PL_SQL + """,
cpl AS (SELECT site, device_id, segment, 'power_W' AS variable, power_W AS x FROM pl UNION ALL SELECT site, device_id, segment, 'speed_Hz', speed_Hz FROM pl UNION ALL SELECT site, device_id, segment, 'chw_flow_m3_h', chw_flow_m3_h FROM pl),
cmp AS (SELECT site, device_id, segment, variable, count(x) AS n, min(x) AS minimum, quantile_cont(x,0.05) AS p05, median(x) AS med, quantile_cont(x,0.95) AS p95, max(x) AS maximum FROM cpl WHERE segment IN ('identification','selection','test') AND x IS NOT NULL GROUP BY 1,2,3,4)"""


def comp(spark, d):
    return sp.comparability(split(spark, d), ["power_W", "speed_Hz", "chw_flow_m3_h"])


@query("i09_comparability", with_(COMP_SQL, body=f'SELECT site, device_id, segment, variable, n, {R("minimum", 4)} AS minimum, {R("p05", 4)} AS p05, {R("med", 4)} AS "median", {R("p95", 4)} AS p95, {R("maximum", 4)} AS maximum FROM cmp'))
def i09(spark, d):
    return rounded(comp(spark, d), _=4)


@query("i10_fold_splits", with_(NUM, body="SELECT site, device_id, ts_s, rn%3=0 AS interleaved, rn>=greatest(1, floor(n*7e-1)) AS tail FROM nu"))
def i10(spark, d):
    a = sp.fold_split(run(spark, d), "interleaved", 3).select(*KEYS, "ts_s", F.col("holdout").alias("interleaved"))
    b = sp.fold_split(run(spark, d), "tail").select(*KEYS, "ts_s", F.col("holdout").alias("tail"))
    return a.join(b, [*KEYS, "ts_s"])


@query("i11_split_table_fleet", with_(PL_SQL, counts_sql(), body=f"SELECT {_CN}, {R('span_days')} AS span_days FROM cnw"))
def i11(spark, d):
    return rounded(sp.split_table(split(spark, d), SPEC))


@query("l19_segment_range_scaling", with_(COMP_SQL, body=f"""SELECT site, device_id, segment, variable, {R('(p05-lo)/coalesce(nullif(hi-lo,0),1)')} AS p05_scaled, {R('(med-lo)/coalesce(nullif(hi-lo,0),1)')} AS median_scaled,
 {R('(p95-lo)/coalesce(nullif(hi-lo,0),1)')} AS p95_scaled FROM (SELECT *, min(p05) OVER (PARTITION BY device_id, variable) AS lo, max(p95) OVER (PARTITION BY device_id, variable) AS hi FROM cmp)"""))
def l19(spark, d):
    return rounded(sp.segment_range_scaling(comp(spark, d)))
