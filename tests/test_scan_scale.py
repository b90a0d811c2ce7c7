"""Roles of the dependency scan and channel profiles without unfolding every row."""

import datetime as dt
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from fleetgauge import KEYS
from fleetgauge.operators import dependency as dp
from fleetgauge.operators import observability as ob
from fleetgauge.operators import quality as ql

KIND = "site string, device_id string, ts timestamp, "


def _table(spark, columns, device="D", site="S"):
    n = len(next(iter(columns.values())))
    t0 = dt.datetime(2024, 5, 1)
    rows = [(site, device, t0 + dt.timedelta(minutes=i), *[None if v[i] is None else float(v[i]) for v in columns.values()]) for i in range(n)]
    return spark.createDataFrame(rows, KIND + ", ".join(f"{c} double" for c in columns))


def test_modal_shares_of_any_hash_class(spark):
    """Roles of few values on either side of the limit, whichever hash class their values fall in, against plain counts."""
    rng = np.random.default_rng(7)
    n, columns = 400, {}
    for k in range(12):
        often = (0.93, 0.95, 0.97)[k % 3]
        columns[f"r{k}"] = [float(k) if i < round(often * n) else float(100 + k) for i in range(n)]
    columns["wild"] = rng.normal(size=n).tolist()
    columns["held"] = [3.0] * n
    columns["signed"] = [0.0 if i % 2 else -0.0 for i in range(n)]
    columns["held while active"] = [5.0 if i % 4 else float(i) for i in range(n)]
    columns["never active"] = [None if i % 4 else float(i) for i in range(n)]
    columns["gaps"] = [None if i % 2 else float(i) for i in range(n)]
    columns = {c.replace(" ", "_"): v for c, v in columns.items()}
    roles, active = list(columns), [i % 4 > 0 for i in range(n)]
    f = _table(spark, columns).withColumn("active", F.minute("ts") % 4 > 0)
    drivers, targets = set(), set()
    for r, v in columns.items():
        known, on = [x for x in v if x is not None], [x for x, a in zip(v, active, strict=True) if a and x is not None]
        if len(known) >= 100 and len(set(known)) > 1 and max(map(abs, known)) > 1e-8 and on:
            drivers.add(r)
            if max(Counter(on).values()) / len(on) <= ob.MODAL_MAX:
                targets.add(r)
    got = ob.eligible_roles(f, roles, 100).first()
    assert (set(got.drivers), set(got.targets)) == (drivers, targets)
    assert len(got.drivers) == len(drivers) and len(got.targets) == len(targets) and {"wild", "gaps"} <= targets and "held_while_active" in drivers - targets


def test_cells_are_written_without_a_second_copy(spark):
    """A table of cells holds every value once; its pairs are those of a plain double loop."""
    columns = {"a": [1.0, None, 3.0, 4.0], "b": [1.0, 2.0, None, 8.0], "c": [9.0, 9.0, 9.0, 9.0]}
    f = _table(spark, columns).withColumn("active", F.lit(True))
    eligible = spark.createDataFrame([("S", "D", ["a", "b"], ["b"])], "site string, device_id string, drivers array<string>, targets array<string>")
    cells = ob.role_cells(f, list(columns), eligible)
    assert "cells" not in cells.columns
    assert sorted((r.t, r.d, r.y, r.x) for r in ob.role_pairs(cells).collect()) == [(1, 0, 1.0, 1.0), (1, 0, 8.0, 4.0)]


def test_dead_marks_need_no_distinct_counts(spark):
    nan = float("nan")
    f = _table(spark, {"wild": [1.0, 2.0, 2.0], "held": [4.0, None, 4.0], "none": [None] * 3, "signed": [0.0, -0.0, 0.0], "nan": [nan, nan, 1.0], "tiny": [1e-9, -1e-9, None]})
    f = f.unionByName(_table(spark, {c: [7.0] for c in f.columns if c not in (*KEYS, "ts")}, device=None))
    roles = [c for c in f.columns if c not in (*KEYS, "ts")]
    p = ql.channel_profile(f, roles)
    got = {r.role: (r.n_finite, r.n_total, r.n_unique, r.dead, r.all_zero, r.coverage_pct) for r in p.where("device_id = 'D'").collect()}
    assert got == {"wild": (3, 3, 2, False, False, 100.0), "held": (2, 3, 1, True, False, 200.0 / 3), "none": (0, 3, 0, True, False, 0.0), "signed": (3, 3, 1, True, True, 100.0),
                   "nan": (3, 3, 2, False, False, 100.0), "tiny": (2, 3, 2, False, True, 200.0 / 3)}
    assert all((r.n_finite, r.n_total, r.n_unique, r.dead) == (0, 1, 0, True) for r in p.where("device_id IS NULL").collect())
    assert "distinct" not in p.select(*KEYS, "role", "n_finite", "dead")._jdf.queryExecution().optimizedPlan().toString()


def test_a_task_packs_several_chunks(spark):
    """Short tasks cost more than the rows in them; all rows and their targets arrive, and missing values are NaN."""
    n = 3000
    a = np.arange(n, dtype=float)
    f = _table(spark, {"a": a, "b": [None if i % 7 else 2.0 * i for i in range(n)], "c": a}).withColumn("active", F.lit(True))
    eligible = spark.createDataFrame([("S", "D", ["a", "b"], ["b"])], "site string, device_id string, drivers array<string>, targets array<string>")
    packed = dp.pack_chunks(ob.role_cells(f, ["a", "b", "c"], eligible), 3, 60)
    rows = packed.collect()
    assert len({r.slot for r in rows}) == len(rows) > 40 and all(r.targets == [1] and r.slots == 50 for r in rows)
    assert len(packed.inputFiles()) <= max(spark.sparkContext.defaultParallelism, 13)
    m = np.concatenate([np.frombuffer(r.cells, float).reshape(-1, 3) for r in rows])
    m = m[np.argsort(m[:, 0])]
    assert np.array_equal(m[:, 0], a) and np.array_equal(m[:, 1], np.where(a % 7 > 0, np.nan, 2 * a), equal_nan=True) and np.isnan(m[:, 2]).all()
