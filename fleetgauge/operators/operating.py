"""Operating state: corroborated run mask, steady rows, solo runs, islands, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge import KEYS
from fleetgauge.contracts import Thresholds, per_family, role_or_null
from fleetgauge.functions.cols import dbl, is_true, ratio, share_pct
from fleetgauge.functions.lineage import settle
from fleetgauge.operators import ordered
from fleetgauge.operators.quantiles import exact_quantiles, wide_quantiles

LIVENESS_FLOOR = 0.02
STUCK_REPORT_PCT = 5.0


def liveness(df: DataFrame) -> Column:
    return per_family(lambda p: role_or_null(df, p["liveness"][0]) if p["liveness"] else None)


def run_state(df: DataFrame, th: Thresholds) -> DataFrame:
    """Per device: is the run bit present and ever set, and the liveness floor."""
    live, bit = liveness(df), is_true(F.col("run_signal") > th.run_on)
    base = df.groupBy(*KEYS).agg(F.max(F.col("run_signal").isNotNull()).alias("run_present"),
                                 F.max(bit).alias("run_seen"))
    q = wide_quantiles(df, KEYS, {"on": F.when(bit & (live > 0), live), "any": F.when(live > 0, live)}, {"p99": 0.99})
    out = base.join(q, list(KEYS), "left")
    usable = F.col("run_present") & F.col("run_seen")
    off = ~usable & F.col("run_present") & F.lit(th.dead_run_policy == "off")
    return out.select(*KEYS, "run_present", "run_seen",
                      F.when(~off, dbl(LIVENESS_FLOOR) * F.when(usable, F.col("on_p99")).otherwise(F.col("any_p99")))
                      .alias("live_floor"))


def operating_mask(df: DataFrame, th: Thresholds | None = None) -> DataFrame:
    """Adds ``bit``, ``denied`` and ``operating``.

    The run bit stands unless the family's liveness channel sits at or below
    2 % of its own 99th percentile; a NULL liveness value never convicts. The
    floor is below the largest reference value, so a device can never lose
    every row.
    """
    th = th or Thresholds()
    if th.dead_run_policy not in ("fallback", "off"):
        raise ValueError("dead_run_policy must be 'fallback' or 'off'")
    s = df.join(run_state(df, th), list(KEYS), "left")
    raw = is_true(F.col("run_signal") > th.run_on)
    dead = F.lit(th.dead_run_policy == "fallback")
    bit = F.when(~F.col("run_present"), True).when(~F.col("run_seen"), dead).otherwise(raw)
    s = s.withColumn("bit", bit).withColumn("ended", F.col("run_present") & ~F.col("run_seen") & ~dead)
    s = s.withColumn("denied", F.col("bit") & is_true(liveness(df) <= F.col("live_floor")))
    return s.withColumn("operating", F.col("bit") & ~F.col("denied"))


def mask_flags(masked: DataFrame) -> DataFrame:
    """One row per device: stuck share and the run-signal flags, in order."""
    a = masked.groupBy(*KEYS, "equipment_type").agg(
        F.max("run_present").alias("p"), F.max("run_seen").alias("s"), F.max("live_floor").alias("live_floor"),
        F.max("ended").alias("ended"), F.count(F.lit(1)).alias("rows"), F.count_if("bit").alias("bit_rows"), F.count_if("denied").alias("denied_rows"),
        F.count_if("operating").alias("on_rows"))
    stuck = F.coalesce(share_pct(F.col("denied_rows"), F.col("bit_rows")), dbl(0.0))
    channel = per_family(lambda p: p["liveness"][0] if p["liveness"] else None)
    flags = F.array(
        F.when(~F.col("p"), F.lit("run_signal_absent")),
        F.when(F.col("p") & ~F.col("s"), F.lit("run_signal_dead")),
        F.when(stuck >= STUCK_REPORT_PCT, F.concat(F.lit("run_signal_uncorroborated:"),
                                                   F.bround(stuck, 0).cast("int").cast("string"), F.lit("pct_by_"), channel)),
        F.when(channel.isNotNull() & F.col("live_floor").isNull() & ~F.col("ended"), F.lit("liveness_channel_absent")))
    return a.select(*KEYS, "equipment_type", "rows", "bit_rows", "on_rows", "denied_rows", "live_floor",
                    stuck.alias("stuck_pct"), F.array_compact(flags).alias("flags"))


def steady_mask(masked: DataFrame, power: str, load: str, min_load_frac: float = 0.2, max_change: float = 0.10) -> DataFrame:
    """Adds ``steady``: loaded rows whose load moved < 10 % from the previous raw row."""
    ok = F.col("operating") & is_true(F.col(power) > 0) & is_true(F.col(load) > 0)
    med = exact_quantiles(masked.where(ok), KEYS, power, {"p_median": 0.5}).select(*KEYS, "p_median")
    d = masked.join(med, list(KEYS), "left")
    base = ok & is_true(F.col(power) > dbl(min_load_frac) * F.col("p_median"))
    d = d.withColumn("_q", F.when(base, F.col(load)))
    d = ordered.previous(d, list(KEYS), "ts", ordered.day_chunk(), {"_q_prev": F.col("_q")})
    q_prev = F.when(F.col("has_previous"), F.col("_q_prev")).otherwise(F.col("_q"))
    change = ratio(F.abs(F.col("_q") - q_prev), F.abs(F.col("_q")))
    return (d.withColumn("steady", F.col("_q").isNotNull() & is_true(change < max_change))
            .drop("_q", "_q_prev", "has_previous", "p_median"))


def on_count(df: DataFrame, group=("site", "grp"), run_on: float = 0.5) -> DataFrame:
    """Adds ``on`` and the number of running devices of the group at that time.

    A missing device adds nothing, which equals aligning on the union of
    timestamps with "off" filled in. A (group, ts) set holds one row per device.
    """
    d = df.withColumn("on", is_true(F.col("run_signal") > run_on))
    w = Window.partitionBy(*group, "ts")
    return d.withColumn("on_devices", F.sum(F.col("on").cast("int")).over(w))


def solo_mask(df: DataFrame, group=("site", "grp"), run_on: float = 0.5) -> DataFrame:
    return on_count(df, group, run_on).withColumn("solo", F.col("on") & (F.col("on_devices") == 1))


def solo_counts(solo: DataFrame) -> DataFrame:
    return solo.groupBy(*KEYS).agg(F.count_if("solo").alias("solo_rows"))


def contiguous_runs(df: DataFrame, step_s: float, tol: float = 1e-6) -> DataFrame:
    """Adds ``island``: rows spaced exactly ``step_s`` apart share one number."""
    t = F.unix_micros("ts") / dbl(1e6)
    d = ordered.previous(df, list(KEYS), "ts", ordered.day_chunk(), {"_t_prev": t})
    brk = F.when(F.col("has_previous") & (F.abs(t - F.col("_t_prev") - dbl(step_s)) <= tol), 0).otherwise(1)
    d = d.withColumn("_brk", brk).drop("_t_prev", "has_previous")
    return ordered.running_total(d, list(KEYS), ["ts"], ordered.day_chunk(), F.col("_brk"), "island").drop("_brk")


def island_summary(islands: DataFrame) -> DataFrame:
    return islands.groupBy(*KEYS, "island").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"),
                                               F.count(F.lit(1)).alias("rows"))


TILE = 512  # sub-blocks per task-local tile of an island


def window_scores(islands: DataFrame, features, rows: int = 288, stride: int = 12) -> DataFrame:
    """Representativeness of each ``rows``-long window, starts ``stride`` apart in a run.

    Rows are packed into blocks of ``stride``; a window is ``rows/stride``
    consecutive blocks. Blocks are tiled with a halo, so a long uninterrupted
    run is spread over many tasks and every value is shuffled about once
    instead of once per window.
    """
    span = rows // stride
    d = ordered.ordinal(islands, list(KEYS), ["ts"], ordered.day_chunk(), "rn")
    d = ordered.ordinal(d, [*KEYS, "island"], ["ts"], ordered.day_chunk(), "pos")
    block = (F.col("pos") / F.lit(stride)).cast("long")
    blocks = (d.withColumn("block", block).groupBy(*KEYS, "island", "block")
              .agg(F.count(F.lit(1)).alias("len"), F.min("rn").alias("start"),
                   *[F.collect_list(f).alias(f) for f in features]))  # at most `stride` values each
    tile = (F.col("block") / F.lit(TILE)).cast("long")
    halo = F.when((F.col("block") % TILE < span - 1) & (F.col("block") >= TILE), F.array(tile, tile - 1)).otherwise(F.array(tile))
    w = Window.partitionBy(*KEYS, "island", "tile").orderBy("block")
    ahead = w.rowsBetween(0, span - 1)
    t = blocks.withColumn("tile", F.explode(halo))
    vals = {f: F.sort_array(F.flatten(F.collect_list(f).over(ahead))) for f in features}
    t = t.select(*KEYS, "block", "tile", "start", F.sum("len").over(ahead).alias("_n"), *[vals[f].alias(f) for f in features])
    t = t.where((F.col("_n") == rows) & (tile == F.col("tile")))

    def q(f, p):
        pos = p * (rows - 1)
        lo = int(pos)
        a, b = F.element_at(f, lo + 1), F.element_at(f, min(lo + 2, rows))
        return a + (b - a) * dbl(pos - lo)

    # the moments of a window against those of the whole record
    full = d.groupBy(*KEYS).agg(*[F.avg(f).alias(f"{f}_mu") for f in features], *[F.stddev_samp(f).alias(f"{f}_sd") for f in features])
    quart = wide_quantiles(d, KEYS, {f: F.col(f) for f in features}, {"q25": 0.25, "q75": 0.75})
    t = t.join(full, list(KEYS)).join(quart, list(KEYS))
    parts = []
    for f in features:
        iqr = F.nullif(F.col(f"{f}_q75") - F.col(f"{f}_q25"), dbl(0.0))
        s = F.coalesce(F.nullif(F.coalesce(iqr, F.col(f"{f}_sd")), dbl(0.0)), dbl(1.0))
        mean = F.aggregate(F.col(f), dbl(0.0), lambda acc, x: acc + x) / dbl(rows)
        parts.append((F.abs(mean - F.col(f"{f}_mu")) + dbl(0.5) * F.abs(q(f, 0.25) - F.col(f"{f}_q25"))
                      + dbl(0.5) * F.abs(q(f, 0.75) - F.col(f"{f}_q75"))) / s)
    score = sum(parts[1:], parts[0]) / dbl(len(features))
    return t.select(*KEYS, "start", (F.col("start") + rows - 1).alias("end"), score.alias("score"))


def select_windows(scores: DataFrame, n: int = 3, gap: int = 288) -> DataFrame:
    """Best ``n`` windows per device, kept at least one window apart; ties to the lower start.

    ``n`` greedy rounds; each is one pre-aggregating ``min_by``. The picks are a
    handful of numbers per device and ride along as an array.
    """
    scores = settle(scores, "window_scores")
    best = F.min_by(F.struct("start", "end", "score"), F.struct("score", "start"))
    picks = None
    for _ in range(n):
        left = scores
        if picks is not None:
            clash = F.exists("picks", lambda p: ~((F.col("end") < p["start"] - gap) | (F.col("start") > p["end"] + gap)))
            left = scores.join(picks, list(KEYS)).where(~clash).drop("picks")
        got = left.groupBy(*KEYS).agg(best.alias("w"))
        picks = (got.select(*KEYS, F.array("w").alias("picks")) if picks is None else
                 picks.join(got, list(KEYS), "left")
                 .select(*KEYS, F.when(F.col("w").isNull(), F.col("picks")).otherwise(F.array_append("picks", F.col("w"))).alias("picks")))
    out = picks.select(*KEYS, F.posexplode("picks").alias("pick", "w"))
    return out.select(*KEYS, (F.col("pick") + 1).alias("pick"), "w.start", "w.end", "w.score")


def record_span(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("rows"),
        ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / dbl(86400e6)).alias("span_days"))


def run_signal_usable(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEYS).agg(F.max(F.col("run_signal").isNotNull()).alias("run_usable"))


