"""Temporal splits: who may train, select and test on which rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge import KEYS
from fleetgauge.functions.cols import dbl
from fleetgauge.operators import ordered
from fleetgauge.operators.quantiles import exact_quantiles

SEGMENTS = ("identification", "selection", "test")
EPOCH_2000 = 946684800  # seconds


@dataclass(frozen=True)
class SplitSpec:
    """Block plan; the defaults suit five-minute records."""

    buffer_hours: float = 72.0
    n_blocks: int = 12
    pattern: tuple = ("identification", "test", "selection", "test")
    min_identification_rows: int = 288
    min_selection_rows: int = 288
    min_test_rows: int = 2016
    identification_months: tuple = (6, 11, 2)
    selection_months: tuple = (8, 12)
    block_days: int = 14


def _us(c="ts"):
    return F.unix_micros(c).cast("double")


def numbered(df: DataFrame, name: str = "rn") -> DataFrame:
    """Adds the retained-row index and the device's row count ``n``."""
    n = df.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    return ordered.ordinal(df, list(KEYS), ["ts"], ordered.day_chunk(), name).join(n, list(KEYS))


def chronological_split(df: DataFrame, train: float = 0.6, select: float = 0.2) -> DataFrame:
    """Contiguous train/selection/test by row count; fewer than 5 rows stay unassigned."""
    if not (0 < train < 1 and 0 < select < 1 and train + select < 1):
        raise ValueError("train and select fractions must be positive and sum to less than 1")
    d = numbered(df)
    a = F.greatest(F.lit(1), F.floor(F.col("n") * dbl(train)))
    b = F.least(F.greatest(a + 1, F.floor(F.col("n") * dbl(train + select))), F.col("n") - 1)
    seg = F.when(F.col("n") < 5, None).when(F.col("rn") < a, "identification").when(F.col("rn") < b, "selection").otherwise("test")
    return d.withColumn("segment", seg)


def proportional_blocks(df: DataFrame, spec: SplitSpec = SplitSpec()) -> DataFrame:
    """Equal-duration blocks over each device's own record, dealt out by the pattern."""
    n = max(len(spec.pattern), spec.n_blocks)
    g = df.groupBy(*KEYS).agg(F.min(_us()).alias("t0"), F.max(_us()).alias("t1")).where("t1 > t0")
    width = (F.col("t1") - F.col("t0")) / dbl(n)
    half = dbl(spec.buffer_hours * 3600e6 / 2)
    half = F.when(width <= half * 2, width * dbl(0.1)).otherwise(half)
    pattern = F.array(*[F.lit(spec.pattern[i % len(spec.pattern)]) for i in range(n)])
    b = g.select(*KEYS, "t0", width.alias("w"), half.alias("h"), F.posexplode(pattern).alias("block", "segment"))
    b = b.select(*KEYS, "block", "segment", (F.col("t0") + F.col("block") * F.col("w") + F.col("h")).alias("a_us"),
                 (F.col("t0") + (F.col("block") + 1) * F.col("w") - F.col("h")).alias("b_us"))
    return b.where("b_us > a_us")


def seasonal_blocks(df: DataFrame, spec: SplitSpec = SplitSpec()) -> DataFrame:
    """First row of each listed month plus a fixed width."""
    months = {**{m: "selection" for m in spec.selection_months}, **{m: "identification" for m in spec.identification_months}}
    seg = F.create_map(*[x for m, s in months.items() for x in (F.lit(m), F.lit(s))])
    first = df.groupBy(*KEYS, F.month("ts").alias("month")).agg(F.min(_us()).alias("a_us"), F.max(_us()).alias("z"))
    span = first.groupBy(*KEYS).agg((F.floor((F.max("z") - F.min("a_us")) / dbl(86400e6))).alias("days"))
    width = F.least(F.lit(spec.block_days), F.greatest(F.lit(1), F.floor(F.col("days") / F.lit(12)))) * dbl(86400e6)
    j = first.where(F.col("month").isin(*months)).join(span, list(KEYS))
    return j.select(*KEYS, F.col("month").alias("block"), seg[F.col("month")].alias("segment"), "a_us", (F.col("a_us") + width).alias("b_us"))


def declared_blocks(devices: DataFrame, blocks: dict[str, list[tuple]]) -> DataFrame:
    """Explicit ``[start, end)`` ranges per segment, the same for every device."""
    rows = [(s, a, b) for s, pairs in blocks.items() for a, b in pairs]
    items = F.array(*[F.struct(F.lit(s).alias("segment"), _us(F.lit(a).cast("timestamp")).alias("a_us"), _us(F.lit(b).cast("timestamp")).alias("b_us"))
                      for s, a, b in rows])
    return devices.select(*KEYS, F.posexplode(items).alias("block", "x")).select(*KEYS, "block", "x.*")


def build_split(df: DataFrame, blocks: DataFrame, buffer_hours: float = 72.0) -> DataFrame:
    """Adds ``segment`` and ``overlap``.

    The few blocks of a device ride along as one array, so a row is placed by a
    row-local test instead of a range join. Buffers are taken from the test
    segment only; identification wins over selection.
    """
    per = blocks.groupBy(*KEYS).agg(F.collect_list(F.struct("segment", "a_us", "b_us")).alias("blocks"))  # about a dozen entries
    d = df.join(per, list(KEYS), "left").withColumn("blocks", F.coalesce("blocks", F.array().cast("array<struct<segment:string,a_us:double,b_us:double>>")))
    t, pad = _us(), dbl(buffer_hours * 3600e6)

    def inside(seg, margin=None):
        m = dbl(0.0) if margin is None else margin
        return F.exists("blocks", lambda b: (b["segment"] == seg) & (t >= b["a_us"] - m) & (t < b["b_us"] + m))
    d = d.withColumns({"_i": inside("identification"), "_s": inside("selection"), "_t": inside("test"),
                       "_near": inside("identification", pad) | inside("selection", pad), "_any": F.exists("blocks", lambda b: b["segment"] == "test")})
    seg = (F.when(F.col("_i"), "identification").when(F.col("_s"), "selection").when(F.col("_near"), "buffer")
           .when(F.col("_t") | ~F.col("_any"), "test").otherwise("unused"))
    return d.withColumns({"segment": seg, "overlap": F.col("_i") & F.col("_s")}).drop("blocks", "_i", "_s", "_t", "_near", "_any")


def split_from_elapsed(df: DataFrame, seconds: str, spec: SplitSpec = SplitSpec()) -> DataFrame:
    """The proportional split on an elapsed-seconds axis anchored at an arbitrary epoch."""
    d = df.withColumnRenamed("ts", "_ts").withColumn("ts", F.timestamp_micros((F.lit(EPOCH_2000 * 1000000) + F.col(seconds) * 1e6).cast("long")))
    return build_split(d, proportional_blocks(d, spec), spec.buffer_hours).drop("ts").withColumnRenamed("_ts", "ts")


def split_counts(split: DataFrame, spec: SplitSpec = SplitSpec(), minimums: DataFrame | None = None) -> DataFrame:
    """Rows per segment, status and warnings per device.

    ``minimums`` optionally carries ``min_ident``, ``min_sel``, ``min_test`` per device.
    """
    aggs = [F.count(F.lit(1)).alias("rows")] + [F.count_if(F.col("segment") == s).alias(s) for s in (*SEGMENTS, "buffer", "unused")]
    g = split.groupBy(*KEYS).agg(*aggs, F.count_if("overlap").alias("overlap_rows"))
    if minimums is None:
        g = g.withColumns({"min_ident": F.lit(spec.min_identification_rows), "min_sel": F.lit(spec.min_selection_rows), "min_test": F.lit(spec.min_test_rows)})
    else:
        g = g.join(minimums, list(KEYS))
    status = (F.when(F.col("identification") < F.col("min_ident"), "blocked_insufficient_identification")
              .when((F.col("selection") < F.col("min_sel")) | (F.col("test") < F.col("min_test")), "identification_only").otherwise("full_split"))
    g = g.withColumn("status", status)

    def short(seg, floor):
        return F.when(F.col(seg) < F.col(floor), F.concat(F.lit(f"{seg} has "), F.col(seg).cast("string"), F.lit(" samples, below the "),
                                                          F.col(floor).cast("string"), F.lit(" required; status="), F.col("status")))
    warn = F.array_compact(F.array(
        F.when(F.col("overlap_rows") > 0, F.concat(F.col("overlap_rows").cast("string"), F.lit(" samples were claimed by both identification and selection; assigned to identification"))),
        short("identification", "min_ident"), short("selection", "min_sel"), short("test", "min_test")))
    return g.select(*KEYS, "rows", *SEGMENTS, "buffer", "unused", "status", (F.col("status") == "full_split").alias("usable"), F.array_join(warn, "; ").alias("warnings"))


def scaled_minimums(native: DataFrame, kept: DataFrame, spec: SplitSpec = SplitSpec()) -> DataFrame:
    """Minimum rows scaled by kept/native, never below 30, where rows were thinned."""
    a = native.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("native_rows"))
    b = kept.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("kept_rows"))
    j = b.join(a, list(KEYS))

    def scale(v):
        s = F.greatest(F.bround(dbl(v) * F.col("kept_rows") / F.col("native_rows"), 0).cast("int"), F.lit(30))
        return F.when(F.col("native_rows") > F.col("kept_rows"), s).otherwise(F.lit(v))
    return j.select(*KEYS, scale(spec.min_identification_rows).alias("min_ident"), scale(spec.min_selection_rows).alias("min_sel"), scale(spec.min_test_rows).alias("min_test"))


def resolve_split(df: DataFrame, spec: SplitSpec | None, train: float = 0.6, select: float = 0.2) -> DataFrame:
    """Buffered blocks where a spec is configured, else contiguous fractions."""
    if spec is None:
        return chronological_split(df, train, select).withColumn("overlap", F.lit(False))
    return build_split(df, proportional_blocks(df, spec), spec.buffer_hours)


def comparability(split: DataFrame, variables) -> DataFrame:
    """Ranges of the driving variables per segment: is the test segment an easier region?"""
    cells = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x")) for v in variables])
    long = split.where(F.col("segment").isin(*SEGMENTS)).select(*KEYS, "segment", F.explode(F.filter(cells, lambda c: c["x"].isNotNull())).alias("c"))
    q = exact_quantiles(long.select(*KEYS, "segment", "c.variable", "c.x"), [*KEYS, "segment", "variable"], "x",
                        {"minimum": 0.0, "p05": 0.05, "median": 0.5, "p95": 0.95, "maximum": 1.0})
    return q.withColumnRenamed("q_n", "n")


def fold_split(df: DataFrame, mode: str = "interleaved", fold: int = 3) -> DataFrame:
    """Adds ``holdout``: every ``fold``-th retained row, or the last 30 %."""
    d = numbered(df)
    if mode == "tail":
        hold = F.col("rn") >= F.greatest(F.lit(1), F.floor(F.col("n") * 0.7))
    else:
        hold = F.col("rn") % max(2, fold) == 0
    return d.withColumn("holdout", hold)


def split_table(split: DataFrame, spec: SplitSpec = SplitSpec()) -> DataFrame:
    """Counts, span, status and warnings of the whole fleet."""
    span = split.groupBy(*KEYS).agg(((F.max(_us()) - F.min(_us())) / dbl(86400e6)).alias("span_days"))
    return split_counts(split, spec).join(span, list(KEYS))


def segment_range_scaling(comp: DataFrame) -> DataFrame:
    """p05/median/p95 rescaled to the union range of the segments."""
    w = Window.partitionBy(*KEYS, "variable")  # three segments
    lo, hi = F.min("p05").over(w), F.max("p95").over(w)
    span = F.coalesce(F.nullif(hi - lo, dbl(0.0)), dbl(1.0))

    def s(c) -> Column:
        return ((F.col(c) - lo) / span).alias(f"{c}_scaled")
    return comp.select(*KEYS, "segment", "variable", s("p05"), s("median"), s("p95"))
