"""Golden end-to-end run on three noise-free devices, and the streaming ingest."""

import time

import numpy as np
from pyspark.sql import functions as F

from fleetgauge.contracts import Thresholds
from fleetgauge.plans import stages
from fleetgauge.streaming import ingest as si
from helpers import frame

N = 300


def _fleet(spark):
    i = np.arange(N)
    dt = 4 + np.sin(i / 20)
    q = 1000 * 4186 * (300 / 3600) * dt
    ch = frame(spark, N, device="CH1", family="chiller", power_W=q / 5, chw_flow_m3_h=300.0 + np.cos(i / 9), cw_flow_m3_h=350.0, tchws_C=7.0, tchwr_C=7 + dt, tcws_C=24 + np.sin(i / 30), tcwr_C=29.0, run_signal=1.0)
    hz = 30 + 15 * np.sin(i / 17)
    pu = frame(spark, N, device="P1", family="pump", power_W=40000 * (hz / 50) ** 3, speed_Hz=hz, run_signal=1.0)
    hx = frame(spark, N, device="HX1", family="heat_exchanger", tchws_C=10.0, tchwr_C=15 + np.sin(i / 8), tcws_C=8.0, tcwr_C=12 + np.cos(i / 8))
    return ch.unionByName(pu, allowMissingColumns=True).unionByName(hx, allowMissingColumns=True).withColumn("fan1_Hz", F.lit(None).cast("double"))


def test_golden_levels_and_pump_recovery(spark):
    th = Thresholds(min_full_rows=50, min_nominal_rows=50, min_calibration_rows=50, block_synthetic=False)
    out = stages.run(_fleet(spark), [], th, ["power_W", "speed_Hz"], forms={"pump": {n: f for n, f in stages.fit.pump_forms().items() if n != "speed_flow_power"}})
    levels = {r["device_id"]: r["level"] for r in out["gate"].collect()}
    assert levels == {"CH1": "full_physical", "P1": "full_physical", "HX1": "nominal_only"}
    best = out["selected"].first()
    assert best["device_id"] == "P1" and best["MAPE_pct"] < 0.5 and 0 <= best["skill"] < 0.1
    v = {r["device_id"]: r for r in out["validation"].collect()}
    assert v["P1"]["status"] == "ok" and v["P1"]["rows_evaluated"] == N and v["HX1"]["status"] == "power_calibration_blocked"


def test_streaming_ingest_matches_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("S", "D", "2024-01-01T00:00:00Z", "1"), ("S", "D", "oops", "2"), ("S", "D", "2024-01-01T00:05:00Z", "x")]
    spark.createDataFrame(rows, "site string, device_id string, stamp string, kw string").write.parquet(src)
    s = spark.readStream.schema("site string, device_id string, stamp string, kw string").parquet(src)
    c = si.canonical_stream(s, {"power_W": {"source": "kw", "scale": 1000.0}}, "stamp")
    si.start_sink(c, out, str(tmp_path / "ck")).awaitTermination()
    got = sorted((r["power_W"] for r in spark.read.parquet(out).collect()), key=str)
    assert got == [1000.0, None]


def test_a_settled_table_leaves_no_shuffle_files(spark):
    from fleetgauge.functions.lineage import settle
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = {str(files.getAllFiles().apply(i).getName()) for i in range(files.getAllFiles().size())}
    out = settle(spark.range(20000).groupBy((F.col("id") % 500).alias("k")).count())
    left = None
    for _ in range(50):  # they are deleted in the background
        now = files.getAllFiles()
        left = {n for i in range(now.size()) if (n := str(now.apply(i).getName())).startswith("shuffle_")} - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and out.count() == 500
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
