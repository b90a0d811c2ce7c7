"""Single operators on hand values and on both sides of each decision boundary."""

import datetime as dt
import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetgauge.contracts import Thresholds
from fleetgauge.functions import metrics as mx
from fleetgauge.functions import models as md
from fleetgauge.operators import attribution as at
from fleetgauge.operators import attrition as al
from fleetgauge.operators import evaluate as ev
from fleetgauge.operators import features as ft
from fleetgauge.operators import fit, gate, operating, prepare, provenance, reconstruct
from fleetgauge.operators import observability as ob
from fleetgauge.operators import splits as sp
from fleetgauge.sources import raw as rw
from fleetgauge.sources import trendlog as tl
from helpers import STEP, T0, frame, rows

KEYS = ["site", "device_id"]


# ---- ingest ---------------------------------------------------------------------------------------
def _raw(spark, stamps, values=None):
    v = values or [str(i) for i in range(len(stamps))]
    return spark.createDataFrame([("S", "D", i, s, x) for i, (s, x) in enumerate(zip(stamps, v))], "site string, device_id string, row_id bigint, stamp string, Power string")


AD = {"power_W": {"source": "Power", "scale": 1000.0}}


def test_canonicalise_scale_bad_text_and_missing_column(spark):
    c = rw.canonicalise(_raw(spark, ["a", "b", "c", "d"], ["1.5", "bad", "NaN", "Infinity"]), AD, keep=("row_id",))
    assert [r["power_W"] for r in c.orderBy("row_id").collect()] == [1500.0, None, None, None]
    with pytest.raises(ValueError, match="missing source column"):
        rw.canonicalise(_raw(spark, ["a"]), {"x": {"source": "Nope"}})


@pytest.mark.parametrize("stamps,policy,error", [
    (["2024-01-01T00:00:00Z", "oops"], "sort_deduplicate", "invalid timestamp values: 1"),
    (["2024-01-01T00:00:00Z", "2024-01-01T08:00:00+08:00"], "sort", "duplicate timestamp values: 1"),
    (["2024-01-01T01:00:00Z", "2024-01-01T00:00:00Z"], "reject", "not sorted"),
    (["2024-01-01T01:00:00Z", "2024-01-01T00:00:00Z"], "sort", None),
    (["2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z"], "sort_deduplicate", None)])
def test_timestamp_policy(spark, stamps, policy, error):
    c = rw.utc_normalise(_raw(spark, stamps), "stamp")
    if error:
        with pytest.raises(ValueError, match=error):
            rw.apply_policy(c, policy)
    else:
        assert rw.apply_policy(c, policy).count() >= 1
    with pytest.raises(ValueError, match="timestamp_policy"):
        rw.policy_errors(rw.timestamp_report(c), "whatever")


def test_keep_first_input_row(spark):
    c = rw.utc_normalise(_raw(spark, ["2024-01-01T00:00:00Z"] * 3, ["7", "8", "9"]), "stamp")
    assert rw.keep_first(c).first()["Power"] == "7"


def test_map_points_needs_exactly_one_hit(spark):
    p = spark.createDataFrame([("S", "D", x) for x in ("CH CHWS-WTS", "CH CHWR-WTS", "P/kw a", "P/kw b")], "site string, device_id string, point string")
    assert rows(prepare.map_points(p, {"tchws": ["CHWS", "WTS"], "power": ["P/kw"], "none": ["zzz"]}).select("role", "source"), "role") == [("tchws", "CH CHWS-WTS")]


# ---- trend logs ------------------------------------------------------------------------------------
def _doc(count, size, nxt, timers, values, flags=("ok", "error-entry", "ok")):
    def buf(name, vals, wrap=False):
        inner = "".join(f'<U name="{i + 1}" value="{v}"/>' for i, v in enumerate(vals))
        return f'<S name="{name}">' + (f"<C>{inner}</C>" if wrap else inner) + "</S>"
    props = {"object-type": "trend-log", "object-name": "P", "time-reference": "2024-01-01T00:00:00", "log-interval": 90000, "record-count": count, "total-record-count": 9, "buffer-size": size, "next-index": nxt, "time-reference-count": 0}
    return "<Object>" + "".join(f'<P name="{k}" value="{v}"/>' for k, v in props.items()) + buf("timestamp-buffer", timers) + buf("flags-buffer", flags) + buf("data-buffer", values, True) + "</Object>"


def test_trend_log_ring_order_and_wrap(spark):
    top = 2 ** 32
    d = spark.createDataFrame([("full", _doc(3, 3, 3, [top - 100 + 50, 100, top - 100], ["2", "3", "1"])), ("part", _doc(2, 5, 3, [100, 200, 300], ["1", "2", "9"])), ("bad", _doc(3, 3, 1, [300, 300, 400], ["1", "2", "3"]))], "doc string, xml string")
    s = tl.decode(d, "doc")
    got = s.where("doc = 'full'").orderBy("rank").collect()
    assert [r["value"] for r in got] == ["1", "2", "3"]
    assert [(r["ts"] - got[0]["ts"]).total_seconds() for r in got] == [0.0, 0.5, 2.0]
    assert [r["value"] for r in s.where("doc = 'part'").orderBy("rank").collect()] == ["1", "2"]
    assert rows(tl.decode_errors(d, s, "doc"), "doc") == [("bad", "timestamps not strictly increasing")]
    kept = tl.parse_samples(s.where("doc = 'full'"), False, 2.0)
    assert sorted(r["value"] for r in kept.collect()) == [2.0, 4.0] or kept.count() == 2
    m = tl.point_manifest(s, d, "doc").where("doc = 'full'").first()
    assert (m["record_count"], m["valid_record_count"], m["error_entry_count"]) == (3, 2, 1)


def test_trend_value_words(spark):
    d = spark.createDataFrame([(" Active ",), ("OFF",), ("3.5",), ("n/a",)], "v string")
    assert [r[0] for r in d.select(tl.parse_value("v", True)).collect()] == [1.0, 0.0, 3.5, None]
    assert d.select(tl.parse_value("v", False)).collect()[0][0] is None


def test_asof_backward_exact_match_and_nothing_before(spark):
    g = spark.createDataFrame([("S", "D", T0 + dt.timedelta(seconds=900 * i), float(i)) for i in range(4)], "site string, device_id string, ts timestamp, p double")
    e = spark.createDataFrame([("S", "D", T0 + dt.timedelta(seconds=900), 0.0, 1), ("S", "D", T0 + dt.timedelta(seconds=2000), 1.0, 2)], "site string, device_id string, ts timestamp, value double, seq bigint")
    assert [r["run"] for r in tl.asof_backward(g, e, "run").orderBy("ts").collect()] == [None, 0.0, 0.0, 1.0]


# ---- operating state ------------------------------------------------------------------------------
def test_stuck_bit_is_corroborated_by_load(spark):
    load = np.where(np.arange(1000) < 700, 0.9, 65.0)
    m = operating.operating_mask(frame(spark, 1000, family="chiller", run_signal=1.0, load_pct=load))
    f = operating.mask_flags(m).first()
    assert f["on_rows"] == 300 and f["flags"] == ["run_signal_uncorroborated:70pct_by_load_pct"]


def test_null_liveness_never_convicts(spark):
    load = np.concatenate([np.full(200, np.nan), np.zeros(200), np.full(600, 60.0)])
    f = operating.mask_flags(operating.operating_mask(frame(spark, 1000, family="chiller", run_signal=1.0, load_pct=load))).first()
    assert (f["on_rows"], f["denied_rows"]) == (800, 200)


def test_absent_and_dead_run_signal(spark):
    a = operating.mask_flags(operating.operating_mask(frame(spark, 5, family="heat_exchanger", run_signal=np.nan))).first()
    assert a["on_rows"] == 5 and a["flags"] == ["run_signal_absent"]
    dead = frame(spark, 5, family="heat_exchanger", run_signal=0.0)
    assert operating.mask_flags(operating.operating_mask(dead)).first()["on_rows"] == 5
    assert operating.mask_flags(operating.operating_mask(dead, Thresholds(dead_run_policy="off"))).first()["on_rows"] == 0
    chiller = frame(spark, 50, family="chiller", run_signal=0.0, load_pct=np.linspace(10, 90, 50))
    assert operating.mask_flags(operating.operating_mask(chiller, Thresholds(dead_run_policy="off"))).first()["flags"] == ["run_signal_dead"]
    with pytest.raises(ValueError):
        operating.operating_mask(dead, Thresholds(dead_run_policy="x"))


def test_solo_rows(spark):
    a = frame(spark, device="A", run_signal=[1, 1, 0, np.nan])
    b = frame(spark, device="B", run_signal=[0, 1, 1, 1])
    assert rows(operating.solo_counts(operating.solo_mask(a.unionByName(b))), "device_id") == [("S", "A", 1), ("S", "B", 2)]


def test_window_scores_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=700)
    df = frame(spark, 700, x=x).where("unix_seconds(ts) <> unix_seconds(timestamp'2024-05-02 00:00:00')")
    p = df.toPandas().sort_values("ts").reset_index(drop=True)
    got = operating.window_scores(operating.contiguous_runs(df, 300.0), ["x"], 48, 12).toPandas().sort_values("start").reset_index(drop=True)
    v, cut, want = p.x.to_numpy(), 288, []
    iqr = np.quantile(v, 0.75) - np.quantile(v, 0.25)
    for lo, hi in ((0, cut), (cut, len(v))):
        for s in range(lo, hi - 48 + 1, 12):
            w = v[s:s + 48]
            want.append((s, (abs(w.mean() - v.mean()) + .5 * abs(np.quantile(w, .25) - np.quantile(v, .25)) + .5 * abs(np.quantile(w, .75) - np.quantile(v, .75))) / iqr))
    assert got.start.tolist() == [s for s, _ in want]
    assert np.allclose(got.score, [q for _, q in want])
    picks = operating.select_windows(spark.createDataFrame(got), 3, 48).toPandas()
    starts = sorted(picks.start)
    assert len(starts) == 3 and all(b - a > 48 for a, b in zip(starts, starts[1:]))


# ---- attribution and reconstruction --------------------------------------------------------------------
def test_named_attribution_sums_and_missing_device_adds_nothing(spark):
    ch = frame(spark, device="C1", family="chiller", cw_flow_m3_h=[10, np.nan, 30]).unionByName(frame(spark, device="C2", family="chiller", cw_flow_m3_h=[1, 2]))
    t = frame(spark, 4, device="T", family="cooling_tower", cw_flow_m3_h=np.nan)
    spec = spark.createDataFrame([("S", "T", ["C1", "C2"])], "site string, device_id string, source_devices array<string>")
    got = at.attribute_named(ch.unionByName(t), spec, "cw_flow_m3_h", "f").where("device_id = 'T'").orderBy("ts").collect()
    assert [r["f"] for r in got] == [11.0, 2.0, 30.0, None]
    bad = at.reference_errors(spec, ch.select(*KEYS).distinct().where("device_id = 'C1'"))
    assert rows(bad, "device_id") == [("S", "T", "C2")]


def test_boundary_join_refuses_duplicate_keys(spark):
    f = frame(spark, 2)
    ext = f.select("site", "ts", F.lit(1.0).alias("wb"))
    assert at.boundary_join(f, ext, "wb", "twb_C", strict=True).where("twb_C = 1").count() == 2
    with pytest.raises(ValueError, match="duplicate"):
        at.boundary_join(f, ext.unionByName(ext), "wb", "twb_C", strict=True)


def test_reconstruction_methods(spark):
    f = frame(spark, fan1_Hz=[40, 40, 0, 2], fan2_Hz=[35, 0, 30, np.nan], cooling_load_W=[100, 50, 0, 20], cond=[130, 40, 10, np.nan], flow=[36, 36, 0, 36], a=[12, 5, 9, 8], b=[7, 7, 7, 7])
    r = reconstruct.reconstruct(f, [{"output": "n", "method": "active_count", "signals": ["fan1_Hz", "fan2_Hz"]}, {"output": "power_W", "method": "energy_balance_power", "condenser": "cond", "evaporator": "cooling_load_W"},
                                    {"output": "q", "method": "heat_rate", "flow": "flow", "t_hot": "a", "t_cold": "b"}, {"output": "none", "method": "active_count", "signals": ["zz"]}]).orderBy("ts").collect()
    assert [x["n"] for x in r] == [2.0, 1.0, 1.0, 0.0]
    assert [x["power_W_recon"] for x in r] == [30.0, -10.0, None, None]
    assert [x["q"] for x in r] == [pytest.approx(1000 * 4186 * 0.01 * 5), None, None, pytest.approx(1000 * 4186 * 0.01)]
    assert [x["none"] for x in r] == [None] * 4
    with pytest.raises(ValueError, match="unknown reconstruction"):
        reconstruct.reconstruct(f, [{"output": "x", "method": "magic"}])


def test_apportion_conserves_total(spark):
    d = frame(spark, device="A", s=[3, 0, -5]).unionByName(frame(spark, device="B", s=[1, 0, 2])).withColumn("t", F.lit(8.0))
    got = {(r["device_id"], r["ts"]): r["o"] for r in reconstruct.apportion_total(d, "t", "s", ("site", "grp"), "o").collect()}
    v = [[got[(x, T0 + dt.timedelta(seconds=300 * i))] for i in range(3)] for x in "AB"]
    assert v == [[6.0, None, 0.0], [2.0, None, 8.0]]


# ---- observability --------------------------------------------------------------------------------------
ROLES = ["power_W", "speed_Hz", "flow_m3_h", "run_signal"]


def _scan(spark, chunk=None, n=3000, **cols):
    base = {"run_signal": 1.0, "flow_m3_h": np.nan} | cols
    c = ob.scan_cells(frame(spark, n, **base), ROLES)
    kw = {} if chunk is None else {"chunk_rows": chunk}
    return ob.dependency_findings(ob.pair_forms(c, ROLES, **kw)).toPandas()


@pytest.mark.parametrize("chunk", [None, 170])
def test_outlier_rows_do_not_hide_an_identity(spark, chunk):
    x = np.random.default_rng(0).uniform(20, 50, 3000)
    y = 1293.2 * x
    y[:7] = 0.0
    f = _scan(spark, chunk, speed_Hz=x, power_W=y)
    hit = f[(f.target == "power_W") & (f.driver == "speed_Hz")].iloc[0]
    assert hit.synthetic and hit.form == "proportional" and hit.n_outlier_rows == 7
    assert hit.coefficients[0] == pytest.approx(1293.2)


@pytest.mark.parametrize("chunk", [None, 170])
def test_cubic_noise_and_duplicate(spark, chunk):
    rng = np.random.default_rng(1)
    x = rng.uniform(20, 50, 3000)
    exact = _scan(spark, chunk, speed_Hz=x, power_W=5 + 2 * x - .1 * x ** 2 + .003 * x ** 3, flow_m3_h=x)
    e = exact[(exact.target == "power_W") & (exact.driver == "speed_Hz")].iloc[0]
    assert e.form == "cubic" and e.synthetic and np.allclose(e.coefficients, [5, 2, -.1, .003], rtol=1e-6)
    assert exact[(exact.target == "flow_m3_h") & (exact.driver == "speed_Hz")].iloc[0].duplicate
    noisy = _scan(spark, chunk, speed_Hz=x, power_W=x ** 3 * (1 + rng.normal(0, .01, 3000)))
    assert not noisy[noisy.target == "power_W"].synthetic.any()


@pytest.mark.parametrize("chunk", [None, 170])
def test_spike_in_the_driver_does_not_spoil_the_refit(spark, chunk):
    x = np.random.default_rng(6).uniform(28, 32, 3000)
    x[1234] = 5000.0
    f = _scan(spark, chunk, speed_Hz=x, power_W=7 - 3 * x + .2 * x ** 2 + .04 * x ** 3)
    e = f[(f.target == "power_W") & (f.driver == "speed_Hz")].iloc[0]
    assert e.form == "cubic" and e.synthetic and e.n_outlier_rows == 0 and e.max_residual_pct_of_range < 1e-3


def _plain_forms(x, y, trim=.05):
    """(outliers, largest residual) of each form: plain least squares, trimmed refit, judged on all rows."""
    out = []
    for k in range(4):
        v = x[:, None] if k == 0 else np.vander((x - x.mean()) / np.ptp(x), k + 1, increasing=True)
        err = np.abs(y - v @ np.linalg.lstsq(v, y, rcond=None)[0])
        keep = err <= np.sort(err)[int((1 - trim) * (len(err) - 1))]
        err = np.abs(y - v @ np.linalg.lstsq(v[keep], y[keep], rcond=None)[0])
        out.append((int((err > 1e-8 * np.ptp(y)).sum()), 100 * err.max() / np.ptp(y)))
    return out


def test_chunks_leave_the_fits_unchanged(spark):
    """A record in 1, 3 or 50 chunks, with gaps, ties and repeated values, against plain fits."""
    rng = np.random.default_rng(12)
    n = 3000
    x = rng.uniform(10, 60, n).round(1)
    y = 3 + .5 * x + .02 * x ** 2 + rng.normal(0, 1, n)
    y[:40] += 500
    z = np.where(rng.random(n) < .3, np.nan, np.where(rng.random(n) < .5, 4.0, 4.0 * x))
    d = frame(spark, n, speed_Hz=x, power_W=y, flow_m3_h=z, run_signal=1.0).unionByName(frame(spark, 400, device="E", speed_Hz=x[:400], power_W=7 * x[:400], flow_m3_h=np.nan, run_signal=1.0))
    cells = ob.scan_cells(d, ROLES)
    got = [{(r["device_id"], r["target"], r["driver"], r["form_ord"]): r for r in ob.pair_forms(cells, ROLES, chunk_rows=c).collect()} for c in (n, 1000, 60)]
    assert got[0].keys() == got[1].keys() == got[2].keys() and len(got[0]) == 4 * (6 + 2)
    columns = {"speed_Hz": x, "power_W": y, "flow_m3_h": z}
    for k, r in got[0].items():
        for other in got[1:]:
            assert (other[k]["n"], other[k]["same"], other[k]["n_outlier_rows"]) == (r["n"], r["same"], r["n_outlier_rows"])
            assert other[k]["max_residual_pct_of_range"] == pytest.approx(r["max_residual_pct_of_range"], rel=1e-9, abs=1e-9)
            assert np.allclose(other[k]["coefficients"], r["coefficients"], rtol=1e-6, atol=1e-6)
        if k[0] != "E":
            a, b = columns[k[2]], columns[k[1]]
            both = np.isfinite(a) & np.isfinite(b)
            want = _plain_forms(a[both], b[both])[k[3]]
            assert r["n"] == both.sum() and r["n_outlier_rows"] == want[0] and r["max_residual_pct_of_range"] == pytest.approx(want[1], rel=1e-6)
    assert ob.pair_forms(cells.limit(0), ROLES).count() == 0


def test_status_contradiction_does_not_mask_identity(spark):
    x = np.random.default_rng(2).uniform(20, 50, 3000)
    y = 1293.2 * x
    stopped = np.arange(3000) % 2 == 0
    f = _scan(spark, speed_Hz=np.where(stopped, 0.0, x), power_W=np.where(stopped, 900.0 + np.arange(3000), y))
    assert f[(f.target == "power_W") & (f.driver == "speed_Hz")].iloc[0].synthetic


def test_excitation_boundary_and_frozen(spark):
    n = 400
    still = operating.operating_mask(frame(spark, n, device="A", run_signal=1.0, speed_Hz=35 + np.arange(n) % 2 * .01, power_W=1.0))
    moved = operating.operating_mask(frame(spark, n, device="B", run_signal=1.0, speed_Hz=np.linspace(20, 50, n), power_W=1.0))
    e = {r["device_id"]: r for r in ob.driver_excitation(still.unionByName(moved)).collect()}
    assert e["A"]["driver_flag"].startswith("driver_not_excited:speed_Hz=0.000") and e["B"]["excited"]
    ch = operating.operating_mask(frame(spark, n, family="chiller", run_signal=1.0, load_pct=50.0, chw_flow_m3_h=np.where(np.arange(n) < 385, 70.1, 80.0), cw_flow_m3_h=np.linspace(1, 9, n)))
    fz = ob.frozen_findings(ob.frozen_channels(ch)).collect()
    assert [(r["channel"], r["held_value"]) for r in fz] == [("chw_flow_m3_h", 70.1)]


# ---- gate --------------------------------------------------------------------------------------------------
def test_synthetic_target_blocks_the_pump(spark):
    x = np.random.default_rng(4).uniform(20, 50, 600)
    m = operating.operating_mask(frame(spark, 600, speed_Hz=x, power_W=1293.2 * x, run_signal=1.0))
    th = Thresholds(min_full_rows=100, min_nominal_rows=100)
    found = ob.dependency_scan(m, ["power_W", "speed_Hz", "run_signal"])
    g = gate.gate_devices(m.withColumn("load_W", F.lit(None).cast("double")), found, th).first()
    assert g["level"] == "blocked" and "synthetic_channel:power_W" in g["flags"]
    off = gate.gate_devices(m.withColumn("load_W", F.lit(None).cast("double")), None, th).first()
    assert off["level"] == "full_physical"


# ---- attrition -----------------------------------------------------------------------------------------------
def test_twenty_impossible_tower_rows_are_quarantined(spark):
    n = 500
    tin, tout, twb = np.full(n, 32.0), np.full(n, 27.0), np.full(n, 22.0)
    tout[:10], tout[10:20] = 33.0, 21.0
    f = frame(spark, n, family="cooling_tower", tcwr_C=tin, tcws_1_C=tout, twb_C=twb, attributed_flow_m3_h=400.0, fans_on_count=2.0, fan1_Hz=40.0, fan2_Hz=40.0)
    feats = ft.ct_features(f)
    s = al.summary(feats, al.tower_criteria()).first()
    assert (s["n_total"], s["n_retained"], s["removed_by_quarantine"], s["removed_by_gate"]) == (500, 480, 20, 0)
    w = al.waterfall(feats, al.tower_criteria()).orderBy("ord").collect()
    assert w[0]["remaining"] == 500 and w[-1]["remaining"] == 480 and sum(r["removed"] for r in w) == 20


def test_first_failed_criterion_is_charged(spark):
    f = frame(spark, a=[1, -1, -1, 1], b=[1, 1, -1, -1])
    w = rows(al.waterfall(f, [al.gate("a", F.col("a") > 0), al.quarantine("b", F.col("b") < 0)]).select("ord", "removed", "remaining"), "ord")
    assert w == [(0, 0, 4), (1, 2, 2), (2, 1, 1)]


# ---- splits --------------------------------------------------------------------------------------------------
def test_buffered_split_is_disjoint_and_spaced(spark):
    f = frame(spark, 3000, step=1800, x=1.0)
    spec = sp.SplitSpec(buffer_hours=24, min_identification_rows=100, min_selection_rows=100, min_test_rows=100)
    s = sp.build_split(f, sp.proportional_blocks(f, spec), spec.buffer_hours).select("ts", "segment").toPandas().sort_values("ts")
    by = {k: g.ts for k, g in s.groupby("segment")}
    assert set(by) >= {"identification", "selection", "test", "buffer"}
    ident = by["identification"].to_numpy()
    for t in by["test"].to_numpy()[::37]:
        assert np.abs((ident - t) / np.timedelta64(1, "h")).min() >= 24
    c = sp.split_counts(sp.build_split(f, sp.proportional_blocks(f, spec), 24.0), spec).first()
    assert c["status"] == "full_split" and sum(c[x] for x in ("identification", "selection", "test", "buffer", "unused")) == 3000


def test_short_record_degrades(spark):
    f = frame(spark, 1442, x=1.0)
    c = sp.split_counts(sp.build_split(f, sp.proportional_blocks(f), 72.0)).first()
    assert c["status"] in ("blocked_insufficient_identification", "identification_only") and not c["usable"] and c["warnings"]


def test_chronological_split_needs_five_rows(spark):
    assert {r["segment"] for r in sp.chronological_split(frame(spark, 4, x=1.0)).collect()} == {None}
    got = [r["segment"] for r in sp.chronological_split(frame(spark, 5, x=1.0)).orderBy("ts").collect()]
    assert got == ["identification"] * 3 + ["selection", "test"]
    with pytest.raises(ValueError):
        sp.chronological_split(frame(spark, 5, x=1.0), 0.9, 0.2)


# ---- metrics ---------------------------------------------------------------------------------------------------
def test_temperature_metrics_do_not_depend_on_the_unit(spark):
    m = np.linspace(24, 30, 50)
    c = frame(spark, m=m, s=m + .5)
    k = c.withColumns({"m": F.col("m") + 273.15, "s": F.col("s") + 273.15})
    a, b = (mx.regression_metrics(d, KEYS, "m", "s", "temperature").first() for d in (c, k))
    assert a["CVRMSE_pct"] is None and a["criterion"] == "absolute_only_interval_scale"
    assert a["RMSE"] == pytest.approx(b["RMSE"]) and a["skill"] == pytest.approx(b["skill"], rel=1e-6)


def test_metrics_hand_values_and_coverage(spark):
    d = frame(spark, m=[10, 20, 30, np.nan], s=[11, 19, 33, 5])
    r = mx.regression_metrics(d, KEYS, "m", "s").first()
    assert r["N"] == 3 and r["RMSE"] == pytest.approx(np.sqrt(11 / 3)) and r["MBE"] == pytest.approx(1.0)
    assert r["CVRMSE_pct"] == pytest.approx(100 * np.sqrt(11 / 3) / 20) and r["R2"] == pytest.approx(1 - 11 / 200)
    assert mx.coverage_gate(d, KEYS, "m", "s").first()["status"] == "insufficient_coverage"
    none = mx.regression_metrics(d.withColumn("s", F.lit(None).cast("double")), KEYS, "m", "s").first()
    assert none["N"] == 0 and none["RMSE"] is None and none["criterion_pass"] is False


# ---- fits ---------------------------------------------------------------------------------------------------------
def test_grouped_ols_equals_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.uniform(0, 1, 300)
    y = 3 + 2 * x - x ** 2 + rng.normal(0, .1, 300)
    o = fit.grouped_ols(frame(spark, x=x, y=y), KEYS, {"1": F.lit(1.0), "x": F.col("x"), "x2": F.col("x") * F.col("x")}, F.col("y")).first()["params"]
    want = np.linalg.lstsq(np.vander(x, 3, increasing=True), y, rcond=None)[0]
    assert np.allclose([o["1"], o["x"], o["x2"]], want, rtol=1e-8)


def test_york_ridge_equals_numpy(spark):
    rng = np.random.default_rng(8)
    n = 300
    t, r, g = rng.uniform(10, 25, n), rng.uniform(2, 8, n), rng.uniform(.5, 1.5, n)
    app = rng.uniform(2, 6, n)
    got = fit.york_ridge_fit(frame(spark, twb=t, rng=r, rlg=g, app=app)).first()["coefficients"]
    x = np.stack([t ** k * r ** q * g ** p for p in range(3) for q in range(3) for k in range(3)], 1)
    prior = np.array(md.YORK)
    s = np.maximum(abs(prior), 1e-6)
    a = np.vstack([x * s / np.sqrt(n), np.sqrt(1e-2) * np.eye(27)])
    b = np.concatenate([(app - x @ prior) / np.sqrt(n), np.zeros(27)])
    assert np.allclose(got, prior + s * np.linalg.lstsq(a, b, rcond=None)[0], rtol=1e-5, atol=1e-9)


def test_york_closed_loop_equals_scan(spark):
    rng = np.random.default_rng(9)
    n = 400
    twb, lift, g = rng.uniform(10, 26, n), rng.uniform(3, 15, n), rng.uniform(.4, 1.6, n)
    f = frame(spark, tin=twb + lift, twb=twb, rlg=g)
    got = f.withColumns(md.york_closed_loop_terms("tin", "twb", "rlg")).withColumns(md.york_closed_loop()).orderBy("ts").toPandas()
    c = np.array(md.YORK)

    def york(t, r, q):
        return sum(c[9 * p + 3 * j + k] * t ** k * r ** j * q ** p for p in range(3) for j in range(3) for k in range(3))
    for i in range(n):
        grid = np.linspace(0, lift[i], 4001)
        h = np.clip(york(twb[i], lift[i] - grid, g[i]), 0, 40) - grid
        z = np.where(h[:-1] * h[1:] < 0)[0]
        if len(z) and not got.clipped[i]:
            assert got.TApp_s[i] == pytest.approx(grid[z[0]], abs=2 * lift[i] / 4000)


def test_library_screen_equals_brute_force(spark):
    rng = np.random.default_rng(10)
    n = 40
    f = frame(spark, n, family="chiller", QN=1e6, COPN=5.0, PLRMin=.1, PLRMax=1.15, CHWR=rng.uniform(11, 13, n), CHWS=rng.uniform(6, 8, n), CDWS=rng.uniform(24, 30, n), CHW=rng.uniform(20, 40, n), P_W=rng.uniform(1e5, 2e5, n), Q_W=rng.uniform(4e5, 9e5, n))
    coef = np.array(md.CAP_FT + md.EIR_FT + md.EIR_FPLR) * rng.uniform(.9, 1.1, (7, 15))
    lib = spark.createDataFrame([(f"L{i}", *map(float, c)) for i, c in enumerate(coef)] + [("gap", *([None] * 15))], "lib_id string, " + ", ".join(f"{x} double" for x in fit.EIR_NAMES))
    a = {r["lib_id"]: r["score"] for r in fit.library_screen(f, lib, chunk=3).collect()}
    t = f.toPandas()
    for i, c in enumerate(coef):
        p = {"cap": list(c[:6]), "eir": list(c[6:12]), "plr": list(c[12:]), "QEva_flow_nominal": 1e6, "COP_nominal": 5.0, "PLRMin": .1, "PLRMax": 1.15}
        o = md.chiller_eir(p, "CHWR", "CHWS", "CDWS", "CHW", "CHW")
        s = f.select(o["P_s"].alias("p"), o["Q_s"].alias("q"), "P_W", "Q_W").toPandas() if i == 2 else None
        if s is not None:
            want = 100 * np.sqrt(((s.p - s.P_W) ** 2).mean()) / t.P_W.mean() + 100 * np.sqrt(((s.q - s.Q_W) ** 2).mean()) / t.Q_W.mean()
            assert a["L2"] == pytest.approx(want)
    assert set(a) == {f"L{i}" for i in range(7)}


def test_grid_modes_and_start_values(spark):
    b = spark.createDataFrame([("S", "D", 10.0)], "site string, device_id string, base double")
    g = {"axes": [{"values": [1, 2], "apply": {"a": {"base": "base", "scale": "axis", "ceil": 15}}}, {"values": [5], "apply": {"b": {"value": "axis"}, "c": {"default": 2.0, "scale": "axis", "floor": 11}}}]}
    p = [r["params"] for r in fit.expand_grid(b, g).orderBy("grid_id").collect()]
    assert p == [{"a": 10.0, "b": 5.0, "c": 11.0}, {"a": 15.0, "b": 5.0, "c": 11.0}]
    assert [r["params"] for r in fit.expand_grid(b, {**g, "mode": "coordinate"}).orderBy("grid_id").collect()][2] == {"b": 5.0, "c": 11.0}
    assert [r["params"] for r in fit.expand_grid(b, None).collect()] == [{}]
    with pytest.raises(ValueError):
        fit.expand_grid(b, {"axes": [{"values": [1], "apply": {"a": {"nope": 1}}}]})
    d = b.withColumn("params", F.create_map(F.lit("x"), F.lit(1.0), F.lit("_h"), F.lit(2.0)))
    assert fit.start_values(d, {"x": {"const": 9}, "y": {"base": "base"}}).first()["start_values"] == {"y": 10.0, "x": 1.0}


def test_hx_direction_is_learned_from_heat(spark):
    n = 60
    f = frame(spark, n, family="heat_exchanger", tchws_C=12.0, tchwr_C=17.0, tcws_C=15.0, tcwr_C=10.0, chw_flow_m3_h=360.0, cw_flow_m3_h=360.0)
    d = ft.hx_direction(f)
    assert d.first()["direction"] == 1  # the condenser labels are swapped
    t = ft.hx_table(f, d).first()
    assert (t["T2In_C"], t["T2Out_C"]) == (10.0, 15.0) and t["Q_W"] == pytest.approx(100 * 4186 * 5)


def test_pump_flow_term_needs_half_the_record(spark):
    flow = np.where(np.arange(100) < 40, 50.0, np.nan)
    t = ft.pump_table(frame(spark, 100, power_W=10.0, speed_Hz=30.0, attributed_flow_m3_h=flow)).toPandas()
    assert len(t) == 100 and (t.m_flow_in == 1.0).all() and not t.flow_observed.any()
    t = ft.pump_table(frame(spark, 100, power_W=10.0, speed_Hz=30.0, attributed_flow_m3_h=np.where(np.arange(100) < 60, 50.0, np.nan))).toPandas()
    assert len(t) == 60 and t.flow_observed.all()


# ---- provenance ------------------------------------------------------------------------------------------------------
def test_config_fingerprint_ignores_order_and_private_keys(spark):
    a = spark.createDataFrame([("r1", "a", "1"), ("r1", "b", "2"), ("r2", "b", "2"), ("r2", "a", "1"), ("r2", "_root", "x"), ("r3", "a", "9")], "run_id string, key string, value string")
    h = {r["run_id"]: r["config_sha256"] for r in provenance.config_fingerprint(a).collect()}
    assert h["r1"] == h["r2"] != h["r3"]


def test_run_tables_append_and_latest(spark, tmp_path):
    for i, sha in enumerate(("x", "y")):
        d = spark.createDataFrame([("r", "p", sha, T0 + dt.timedelta(seconds=i))], "run_id string, path string, sha256 string, at timestamp")
        provenance.append(d, "run_artifact", str(tmp_path))
    assert provenance.latest(spark.read.parquet(f"{tmp_path}/run_artifact"), ["run_id", "path"]).first()["sha256"] == "y"


def test_params_json_round_trip_is_sorted(spark):
    d = spark.createDataFrame([({"b": 2.0, "a": 1.5},)], "params map<string,double>")
    j = rw.params_to_json(d)
    assert j.first()["parameters"] == '{"a":1.5,"b":2.0}'
    assert rw.params_from_json(j.select("parameters")).first()["params"] == {"a": 1.5, "b": 2.0}




def test_grid_search_uses_every_row_and_copies_none(spark):
    rows = [("s", d, i, float(i % 7), (2.0 if i < 300 else 3.0) * (i % 7) * k) for d, k in (("a", 1.0), ("b", 0.5)) for i in range(1000)]
    df = spark.createDataFrame(rows, "site string, device_id string, rn long, x double, y double")
    base = spark.createDataFrame([("s", "a", 1.0), ("s", "b", 0.5)], "site string, device_id string, slope double")
    grid = {"axes": [{"name": "k", "values": [2.0, 2.5, 2.75, 3.0], "apply": {"k": {"base": "slope", "scale": "axis"}}}]}
    out = fit.grid_search(df, base, grid, lambda p: {"e": F.avg((p["k"] * F.col("x") - F.col("y")) ** 2)}, lambda s: s["e"])
    want = {}
    for d, k in (("a", 1.0), ("b", 0.5)):
        mine = [r for r in rows if r[1] == d]
        err = [sum((g * k * r[3] - r[4]) ** 2 for r in mine) / len(mine) for g in (2.0, 2.5, 2.75, 3.0)]
        want[d] = (err.index(min(err)), min(err))
    got = {r["device_id"]: (r["grid_id"], r["score"], r["params"]["k"]) for r in out.collect()}
    assert {d: (g, pytest.approx(e)) for d, (g, e) in want.items()} == {d: (g, e) for d, (g, e, _) in got.items()}
    assert got["b"][2] == 2.75 * 0.5 and want["a"][0] == 2  # the first 300 rows alone would choose 2.0
    empty = fit.grid_search(df.where("false"), base, grid, lambda p: {"e": F.avg(p["k"] * F.col("x"))}, lambda s: s["e"])
    assert empty.count() == 0


def test_tower_is_fitted_on_late_training_rows(spark):
    def outlet(i, ratio):
        wat, air = m[i] / 10.0, max(0.05, y[i])
        ua = max(0.05, 0.1082 + 1.667 * wat - 0.7713 * wat * wat)
        return 20.0 + max(0.0, 5.0 / max(1.0, 1 + ua * air / max(0.05, wat * ratio)))
    n = 12000
    m, y = [10.0 + (i % 5 - 2) for i in range(n)], [(0.3, 0.6, 1.0)[i % 3] for i in range(n)]
    rows = []
    for i in range(n):
        t, fans = outlet(i, 0.8 if i < 200 else 1.8), 1.0 + i % 2
        rows.append(("s", "t", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=5 * i), 300.0 * i, t + 5.0, t, 20.0, 5.0, t - 20.0, m[i], y[i], 50 * y[i], fans, fans * m[i] * md.CP * 5.0, fans * 900.0 * y[i] ** 3))
    table = spark.createDataFrame(rows, "site string, device_id string, ts timestamp, time_s double, Tin_C double, Tout_meas_C double, Twb_C double, TRan_C double, TAppAct_C double, mdot_cell_kgps double, "
                                        "y_used double, fanHz double, fans_on_count double, Q_flow_W double, PFan_meas_W double")
    out = fit.ct_model_selection(table).collect()
    assert {r["stage"] for r in out} == {"selection", "test"}
    for r in out:
        assert fit.expand_grid(spark.range(1).selectExpr("'s' site", "'t' device_id"), fit.MERKEL_GRID).where(F.col("grid_id") == r["grid_id"]).first()["params"]["ratWatAir_nominal"] == 1.8
        assert r["alpha"] == 3.0 and r["P_N"] == r["N"] and r["T_RMSE_K"] < 1e-6 and abs(r["T_CVRMSE_pct"]) < 1e-4 and abs(r["Q_skill"]) < 1e-6


def test_screen_is_the_same_however_it_is_dealt_out(spark):
    """Blocks of points and chunks of curves only change the order of the sums; an empty library or table gives no rows."""
    rng = np.random.default_rng(12)
    n = 90
    f = frame(spark, n, family="chiller", QN=8e5, COPN=4.5, PLRMin=.1, PLRMax=1.15, CHWR=rng.uniform(11, 13, n), CHWS=rng.uniform(6, 8, n), CDWS=rng.uniform(24, 30, n), CHW=rng.uniform(20, 40, n), P_W=rng.uniform(1e5, 2e5, n), Q_W=rng.uniform(4e5, 9e5, n))
    coef = np.array(md.CAP_FT + md.EIR_FT + md.EIR_FPLR) * rng.uniform(.9, 1.1, (11, 15))
    lib = spark.createDataFrame([(f"L{i}", *map(float, c)) for i, c in enumerate(coef)], "lib_id string, " + ", ".join(f"{x} double" for x in fit.EIR_NAMES))
    whole = {r.lib_id: r.score for r in fit.library_screen(f, lib).collect()}
    dealt = {r.lib_id: r.score for r in fit.library_screen(f, lib, chunk=2, rows=7).collect()}
    assert set(whole) == set(dealt) == {f"L{i}" for i in range(11)}
    assert all(dealt[k] == pytest.approx(whole[k], rel=1e-12) for k in whole)
    assert fit.library_screen(f, lib.where("lib_id = ''")).count() == 0
    assert fit.library_screen(f.where("P_W < 0"), lib).count() == 0


def test_series_scan_equals_all_pairs_for_one_crowded_n(spark):
    """A thousand series of equal N: the scan finds what comparing every pair finds, ties and gaps included."""
    rng = np.random.default_rng(4)
    rmse, cv = rng.uniform(0, 50, 1000).round(2), rng.uniform(0, 30, 1000).round(2)
    s = pd.DataFrame({"series_id": [f"s{i:04d}" for i in range(1000)], "N": 77, "rmse": rmse, "cvrmse": cv})
    p = pd.DataFrame({"device_id": [f"d{i}" for i in range(60)], "N": 77, "kind": ["rmse", "cvrmse"] * 30, "expected": rng.uniform(-1, 52, 60).round(3)})
    extra = pd.DataFrame({"device_id": ["none", "other"], "N": [78, 77], "kind": ["rmse", "rmse"], "expected": [1.0, float("nan")]})
    got = {r.device_id: (r.series_id, r.gap) for r in ev.reconcile_series(spark.createDataFrame(s), spark.createDataFrame(pd.concat([p, extra]))).collect()}
    want = {}
    for r in p.itertuples():
        gap = (s[r.kind] - r.expected).abs()
        i = min(range(1000), key=lambda i: (round(gap[i], 9), s.series_id[i]))
        if gap[i] <= max(0.02 * abs(r.expected), 1e-3):
            want[r.device_id] = (s.series_id[i], pytest.approx(gap[i]))
    assert got == want and 20 < len(want) < 60


def test_config_fingerprint_streams_any_number_of_lines(spark):
    """Runs over many batches hash like their joined text; private and null keys are left out, a null value is empty."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        d = spark.range(3000).select(F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("run_id"), F.when(F.col("id") % 10 == 9, F.concat(F.lit("_"), F.col("id").cast("string"))).when(F.col("id") % 100 == 5, None)
                                     .otherwise(F.concat(F.lit("ké"), F.col("id").cast("string"))).alias("key"), F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("value"))
        got = {r.run_id: r.config_sha256 for r in provenance.config_fingerprint(d).collect()}
        rows = d.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for run in ("r0", "r1", "r2"):
        lines = sorted(f"{r.key}={r.value or ''}".encode() for r in rows if r.run_id == run and r.key is not None and not r.key.startswith("_"))
        want[run] = hashlib.sha256(b"\n".join(lines)).hexdigest()
    assert got == want
    assert provenance.config_fingerprint(d.where("run_id = ''")).count() == 0


def test_chiller_selection_uses_training_rows_only(spark):
    """Changing evaluation rows leaves the chosen curve alone; the electric chiller's score is that of its curve."""
    rng = np.random.default_rng(6)
    n = 200
    t = frame(spark, n, family="chiller", CHWR=rng.uniform(11, 13, n), CHWS=rng.uniform(6, 8, n), CDWS=rng.uniform(24, 30, n), CDWR=31.0, CHW=rng.uniform(20, 40, n), CDW=30.0, P_kW=rng.uniform(90, 190, n), Q_evap_kW=rng.uniform(400, 900, n))
    coef = np.array(md.CAP_FT + md.EIR_FT + md.EIR_FPLR) * rng.uniform(.9, 1.1, (6, 15))
    lib = spark.createDataFrame([(f"L{i}", *map(float, c)) for i, c in enumerate(coef)], "lib_id string, " + ", ".join(f"{x} double" for x in fit.EIR_NAMES))
    late = F.unix_seconds("ts") >= t.agg(F.min(F.unix_seconds("ts"))).first()[0] + STEP * 125
    pick = {}
    for name, d in (("a", t), ("b", t.withColumns({"P_kW": F.when(late, F.col("P_kW") * 3).otherwise(F.col("P_kW")), "Q_evap_kW": F.when(late, F.col("Q_evap_kW") * 2).otherwise(F.col("Q_evap_kW"))}))):
        r = {(x.candidate, x.stage): x for x in fit.chiller_model_selection(d, lib).collect()}
        assert set(r) == {(c, s) for c in ("ElectricEIR", "CarnotTA") for s in ("selection", "test")}
        assert r["CarnotTA", "test"].lib_id is None
        pick[name] = r["ElectricEIR", "test"].lib_id, r["ElectricEIR", "selection"].train_score
        train = fit.chiller_training(d)[1]
        assert pick[name][1] == pytest.approx(fit.library_screen(fit.chiller_points(train), lib).agg(F.min("score")).first()[0])
    assert pick["a"] == pick["b"]


def test_payload_hash_is_that_of_the_document(spark):
    docs = spark.createDataFrame([("a", "<Object/>"), ("b", "é")], "doc_id string, xml string")
    s = spark.createDataFrame([(i, "o", 1, 1, "ok", None) for i in ("a", "b")], "doc_id string, object_name string, record_count int, total_record_count int, flags string, ts timestamp")
    got = {r.doc_id: r.sha256 for r in tl.point_manifest(s, docs, "doc_id").collect()}
    assert got == {"a": hashlib.sha256(b"<Object/>").hexdigest(), "b": hashlib.sha256("é".encode()).hexdigest()}


def test_equal_curves_are_screened_once(spark):
    """Copies of curves and devices in shared blocks: every pair has its row, distinct curves are computed once, the best of all is the smallest id among equals."""
    rng = np.random.default_rng(21)
    n, parts = 30, []
    for i in range(5):
        parts.append(frame(spark, n, device=f"C{i}", family="chiller", QN=8e5, COPN=4.5, PLRMin=.1, PLRMax=1.15, CHWR=rng.uniform(11, 13, n), CHWS=rng.uniform(6, 8, n), CDWS=rng.uniform(24, 30, n), CHW=rng.uniform(20, 40, n), P_W=rng.uniform(1e5, 2e5, n), Q_W=rng.uniform(4e5, 9e5, n)))
    f = parts[0]
    for x in parts[1:]:
        f = f.unionByName(x)
    coef = np.array(md.CAP_FT + md.EIR_FT + md.EIR_FPLR) * rng.uniform(.9, 1.1, (4, 15))
    lib = spark.createDataFrame([(f"L{i:02d}", *map(float, coef[i % 4])) for i in range(23)] + [("gap", *([None] * 15))], "lib_id string, " + ", ".join(f"{x} double" for x in fit.EIR_NAMES))
    lead, members = fit.curve_classes(lib)
    assert sorted(r.lib_id for r in lead.collect()) == ["L00", "L01", "L02", "L03"] and members.count() == 23
    for rows in (7, 65536):
        assert fit.class_screen(f, lead, rows=rows).count() == 5 * 4
        every = fit.library_screen(f, lib, chunk=2, rows=rows)
        s = {(r.device_id, r.lib_id): r.score for r in every.collect()}
        assert len(s) == 5 * 23 and all(s[d, c] == s[d, f"L{int(c[1:]) % 4:02d}"] for d, c in s)
        want = {r.device_id: (r.lib_id, pytest.approx(r.score, rel=1e-9)) for r in fit.best_curve(every).collect()}
        for chunk in (1, 16384):
            assert {r.device_id: (r.lib_id, r.score) for r in fit.library_best(f, lib, chunk=chunk, rows=rows).collect()} == want


def test_library_screen_query_reads_every_row():
    from catalog import load
    sql = load().SQL
    assert "identification" not in sql["e16_library_screen"] and "identification" in sql["e16_best_curve"]


def test_records_of_one_chunk_are_fitted_in_their_task(spark, monkeypatch):
    """Short records take no reduction step, whatever their number; long ones beside them still do, and both find the same."""
    from fleetgauge.operators import dependency as dp
    rng = np.random.default_rng(30)
    x = rng.uniform(0, 50, 600)
    cols = {"power_W": 3 * x + 2 * (np.arange(600) % 40 == 0), "speed_Hz": x, "chw_flow_m3_h": x ** 2 + 1, "tchws_C": rng.normal(size=600)}
    roles = list(cols)
    short = frame(spark, 300, device="A", **{c: v[:300] for c, v in cols.items()})
    cells = ob.role_cells(short.withColumn("active", F.lit(True)), roles, ob.eligible_roles(short.withColumn("active", F.lit(True)), roles, 100))
    steps = []
    real = dp._reduced
    monkeypatch.setattr(dp, "_reduced", lambda *a: steps.append(1) or real(*a))
    key = lambda df: {(r.device_id, r.target, r.driver, r.form): (r.n, r.n_outlier_rows, pytest.approx(r.max_residual_pct_of_range, rel=1e-6, abs=1e-9)) for r in df.collect()}
    alone = key(ob.pair_forms(cells, roles, 100))
    assert alone and not steps
    long = frame(spark, 600, device="B", **cols)
    both = short.unionByName(long).withColumn("active", F.lit(True))
    cells = ob.role_cells(both, roles, ob.eligible_roles(both, roles, 100))
    mixed, whole = key(ob.pair_forms(cells, roles, 100, chunk_rows=300)), key(ob.pair_forms(cells, roles, 100))
    assert steps and mixed == whole and {k: v for k, v in mixed.items() if k[0] == "A"} == alone


def test_attribution_shuffles_targets_only(spark):
    """Rows without attribution pass by the joins; a null group is a group; the result is that of counting every running device."""
    rng = np.random.default_rng(41)
    f = frame(spark, 60, device="P0", family="pump", run_signal=rng.integers(0, 2, 60).astype(float), flow_m3_h=1.0)
    for i in range(1, 4):
        f = f.unionByName(frame(spark, 60, device=f"P{i}", family="pump", run_signal=np.where(rng.uniform(size=60) < .2, np.nan, rng.integers(0, 2, 60)), flow_m3_h=1.0))
    f = f.unionByName(frame(spark, 60, device="C0", family="chiller", run_signal=1.0, flow_m3_h=rng.uniform(1, 9, 60))).withColumn("grp", F.when(F.col("device_id") >= "P2", None).otherwise(F.col("grp")))
    got = at.attribute_solo(f, F.col("equipment_type") == "pump", "chiller", "flow_m3_h", "a")
    t = f.toPandas()
    t["g"], t["on"] = t.grp.fillna("-"), t.run_signal.fillna(0) > .5
    lone = t.groupby(["g", "ts"]).on.transform("sum") == 1
    flow = t[t.equipment_type == "chiller"].set_index("ts").flow_m3_h
    want = {(r.device_id, r.ts): flow[r.ts] if lone[r.Index] and r.on and r.equipment_type == "pump" else None for r in t.itertuples()}
    assert {(r.device_id, r.ts): r.a for r in got.collect()} == want and set(got.columns) == {*f.columns, "a"}
    spec = spark.createDataFrame([("S", "P0", ["C0"]), ("S", "P1", ["C0", "P2"])], "site string, device_id string, source_devices array<string>")
    named = at.attribute_named(f, spec, "flow_m3_h", "a").groupBy("device_id").agg(F.count("a").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    assert {r.device_id: (r.n, r.rows) for r in named} == {d: (60 if d in ("P0", "P1") else 0, 60) for d in ("P0", "P1", "P2", "P3", "C0")}
    plan = at.attribute_named(f, spec, "flow_m3_h", "a")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan


def test_eligible_roles_count_each_value_once(spark):
    """Same roles as profile and modal share apart, from one unfolding of the rows."""
    rng = np.random.default_rng(42)
    n = 300
    f = frame(spark, n, device="A", a=rng.normal(size=n), b=np.where(np.arange(n) % 40 == 0, 1.0, 5.0), c=0.0, d=np.where(np.arange(n) < 150, np.nan, rng.normal(size=n)), e=1e-9 * rng.normal(size=n), g=np.where(np.arange(n) % 2 == 0, np.nan, rng.normal(size=n)))
    f = f.unionByName(f.withColumn("device_id", F.lit("B"))).withColumn("active", (F.col("device_id") == "B") | (F.minute("ts") % 10 == 0))
    roles = list("abcdeg")
    prof = ob.channel_profile(f, roles).where((F.col("n_finite") >= 200) & (F.col("n_unique") > 1) & ~F.col("all_zero")).select(*KEYS, "role").join(ob.modal_share(f, roles), [*KEYS, "role"])
    want = {}
    for r in prof.collect():
        want.setdefault(r.device_id, (set(), set()))[0].add(r.role)
        if r.modal_share <= ob.MODAL_MAX:
            want[r.device_id][1].add(r.role)
    got = ob.eligible_roles(f, roles, 200)
    assert {r.device_id: (set(r.drivers), set(r.targets)) for r in got.collect()} == want and want["A"][0] == {"a", "b"}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
