"""Benchmark: the five stages on the whole fleet, then headline queries.

Prints one JSON line. Every query is run to completion into the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
# ingest, attribute (with the operating state), gate with the dependency scan, calibrate, validate, report
STAGES = ["a02_projected_scan", "e03_attribution_flags", "d02_stuck_status_flags", "l01_gate_device", "j05_calibrate_power_models", "k12_full_period_validation", "l03_level_counts"]
HEADLINE = ["c01_adapter_qa", "c11_driver_excitation", "d03_steady_mask", "d05_solo_run_mask", "d07_contiguous_runs", "e07_periodic_align", "e08_asof_backward", "f05_apportion_total",
            "h03_ct_attrition_rules", "i05_build_split", "i09_comparability", "j08_pump_model_selection", "j09_hx_grid_search", "j10_ct_grid_search", "j19_york_closed_loop", "e16_library_screen",
            "k01_regression_metrics", "l06_cross_site_summary", "l15_selection_vs_test", "l24_project_detail"]


def session():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master(f"local[{CPUS}]").appName("fleetgauge-bench")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
         .config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", str(2 * int(CPUS)))
         .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")  # keep all cores busy on small inputs
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    return s


def main():
    from catalog import load
    reg = load()
    spark = session()
    times, t_all = {}, time.time()
    for name in [*STAGES, *HEADLINE]:
        t = time.time()
        reg.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    five = round(sum(times[n] for n in STAGES), 3)
    rows = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    print(json.dumps({"metric": "fleet_stages_and_headline_queries", "value": round(time.time() - t_all, 3), "unit": "sec", "queries": times, "stages_sec": five, "raw_rows": rows,
                      "sf": os.path.basename(SF_DIR.rstrip("/")).replace("sf", "")}))
    spark.stop()


if __name__ == "__main__":
    main()
