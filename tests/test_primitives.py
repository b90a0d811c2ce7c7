"""Quantiles and ordered scans against numpy and pandas, across chunk borders and with a dominant key."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetgauge.operators import ordered
from fleetgauge.operators.quantiles import _with_digits, exact_quantiles, wide_quantiles
from helpers import frame


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    groups = {"hot": np.concatenate([rng.normal(0, 1, 4000), np.full(1500, 0.25), [1e9, -1e9]]), "ties": np.repeat([1.0, 2.0, 4.0, 9.0], [3, 1, 1, 5]), "one": np.array([7.0]), "two": np.array([1.0, 2.0])}
    pdf = pd.DataFrame([(k, float(v)) for k, a in groups.items() for v in a], columns=["k", "v"])
    probs = {"a": 0.0, "b": 0.05, "m": 0.5, "c": 0.95, "z": 1.0}
    got = exact_quantiles(spark.createDataFrame(pdf), ["k"], "v", probs).toPandas().set_index("k")
    for k, a in groups.items():
        assert got.loc[k, "q_n"] == len(a)
        for n, p in probs.items():
            assert got.loc[k, n] == pytest.approx(np.quantile(a, p), rel=1e-12, abs=1e-12)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=40), st.floats(0, 1))
def test_quantiles_property(spark, xs, p):
    df = spark.createDataFrame(pd.DataFrame({"k": "x", "v": xs}))
    got = exact_quantiles(df, ["k"], "v", {"q": p}, buckets=7).first()["q"]
    assert got == pytest.approx(np.quantile(xs, p), rel=1e-9, abs=1e-9)


def test_quantiles_of_null_and_empty(spark):
    df = spark.createDataFrame([("x", None), ("x", 2.0)], "k string, v double")
    assert exact_quantiles(df, ["k"], "v", {"m": 0.5}).collect()[0]["m"] == 2.0
    assert exact_quantiles(df.where("k = 'none'"), ["k"], "v", {"m": 0.5}).count() == 0
    w = wide_quantiles(df, ["k"], {"a": F.col("v"), "b": F.col("v") * 2}, {"m": 0.5}).first()
    assert (w["a_n"], w["a_m"], w["b_m"]) == (1, 2.0, 4.0)


def test_ordered_scans_cross_chunks(spark):
    rng = np.random.default_rng(1)
    n = 900  # three days at five minutes, so several chunks
    v = np.where(rng.random(n) < 0.8, np.nan, rng.normal(size=n))
    df = frame(spark, n, v=v).where((F.unix_seconds("ts") / 300).cast("long") % 7 != 3)
    p = df.toPandas().sort_values("ts").reset_index(drop=True)
    k, c = ["site", "device_id"], ordered.day_chunk()
    got = ordered.ordinal(df, k, ["ts"], c, "rn")
    got = ordered.previous(got, k, "ts", c, {"pv": F.col("v")})
    got = ordered.running_total(got, k, ["ts"], c, F.coalesce("v", F.lit(0.0)), "rt")
    got = ordered.carry_last(got, k, ["ts"], c, "v", "cl").toPandas().sort_values("ts").reset_index(drop=True)
    assert (got.rn == np.arange(len(p))).all()
    pd.testing.assert_series_equal(got.pv, p.v.shift(), check_names=False)
    pd.testing.assert_series_equal(got.cl, p.v.ffill(), check_names=False)
    assert np.allclose(got.rt, p.v.fillna(0).cumsum())
    assert got.has_previous.sum() == len(p) - 1


def test_rows_without_an_order_key_come_first(spark):
    d = spark.createDataFrame([("a", 5), ("a", None), ("a", 200000), ("b", None), ("b", 1)], "k string, i long")
    got = {(r.k, r.i): r.rn for r in ordered.ordinal(d, ["k"], ["i"], ordered.id_chunk("i")).collect()}
    assert got == {("a", None): 0, ("a", 5): 1, ("a", 200000): 2, ("b", None): 0, ("b", 1): 1}


def test_quantiles_of_every_scale(spark):
    """Powers of two, their neighbours, subnormals, both signs and spikes: the order of the digits is that of the doubles."""
    p = np.ldexp(1.0, np.arange(-1074, 1024))
    x = np.concatenate([p, np.nextafter(p, 0), np.nextafter(p, np.inf), [0.0, 1.7976931348623157e308]])
    x = np.unique(np.concatenate([x, -x])[np.isfinite(np.concatenate([x, -x]))])
    d = _with_digits(spark.createDataFrame(pd.DataFrame({"_v": np.random.default_rng(2).permutation(x)})), 1024).orderBy("_q1", "_q2", "_q3").toPandas()
    assert d["_v"].tolist() == x.tolist()
    assert not d.duplicated(["_q1", "_q2", "_q3"]).any()
    assert d["_q2"].max() < 1 << 22 and d["_q3"].max() < 1 << 21
    probs = {f"p{i}": i / 8 for i in range(9)}
    got = exact_quantiles(spark.createDataFrame(pd.DataFrame({"k": 1, "v": x[np.abs(x) < 1e300]})), ["k"], "v", probs).first()
    assert [got[n] for n in probs] == pytest.approx(np.quantile(x[np.abs(x) < 1e300], list(probs.values())).tolist(), rel=1e-12)


def test_a_spike_leaves_the_parts_fine(spark):
    """One value of 1e9 among values below 100: the busiest part holds 1/1024 of a power of two, not all of them."""
    d = spark.range(200_000).select(F.lit("hot").alias("k"), F.when(F.col("id") == 7, 1e9).otherwise(F.rand(5) * 100).alias("_v"))
    assert _with_digits(d, 1024).groupBy("k", "_q1").count().agg(F.max("count")).first()[0] < 1000


def test_quantiles_of_small_and_large_groups_are_the_same(spark):
    """Groups ordered whole, groups selected by digits and a mix of both; null keys, ties, NaN and infinities included."""
    rng = np.random.default_rng(40)
    odd = [float("inf"), float("-inf"), float("nan"), 0.0, -0.0, 5e-324, 1e308]
    rows = [("a", float(x)) for x in rng.normal(size=301)] + [("b", float(x)) for x in rng.integers(0, 4, 40)] + [(None, float(x)) for x in rng.uniform(0, 1e9, 50)] + [("c", x) for x in odd] + [("d", 7.0), ("e", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"q1": 0.01, "m": 0.5, "q99": 0.99}
    got = [{r.k: (r.q_n, repr([r.q1, r.m, r.q99])) for r in exact_quantiles(df, ["k"], "v", probs, whole=w).collect()} for w in (0, 45, 1 << 16)]
    assert got[0] == got[1] == got[2] and set(got[0]) == {"a", "b", None, "c", "d"}
    assert eval(got[2]["a"][1]) == pytest.approx(list(np.quantile([v for k, v in rows if k == "a"], list(probs.values()))))
