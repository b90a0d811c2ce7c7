"""Which channels are independent observations, and did the machine move at all?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge import KEYS
from fleetgauge.contracts import EVIDENCE_TIERS, PROFILES, SENSOR_SET, per_family, role_or_null
from fleetgauge.functions.cols import dbl, is_true, ratio, share_pct, unpivot
from fleetgauge.functions.lineage import settle
from fleetgauge.operators.dependency import CHUNK_ROWS, pair_fits
from fleetgauge.operators.quality import channel_profile, presence
from fleetgauge.operators.quantiles import wide_quantiles

FROZEN_SHARE, FROZEN_ROWS = 0.95, 200
COP_FLOOR, COP_CEILING, COP_SHARE_PCT = 1.0, 10.0, 1.0
MIN_SPAN, MIN_EXCITED_ROWS = 0.10, 100
MODAL_MAX, MIN_SAMPLES = 0.95, 200
RESIDUAL_PCT, INLIER_SHARE = 1e-6, 0.99
FORMS = {"proportional": 1, "affine": 2, "quadratic": 3, "cubic": 4}  # name -> coefficients
DRIVES = ("speed_Hz", "fan1_Hz", "y_used")


def plain(x: Column, decimals: int) -> Column:
    """Number text without trailing zeros."""
    return F.regexp_replace(F.format_string(f"%.{decimals}f", x), r"\.?0+$", "")


def frozen_channels(masked: DataFrame) -> DataFrame:
    """Flow and power roles stuck on one non-zero value while operating.

    Counted per value first, so the modal share needs no per-device collection.
    """
    roles = sorted({r for p in PROFILES.values() for r in p["required"] if r.endswith(("_m3_h", "_W"))})
    watched = per_family(lambda p: F.array(*[F.lit(r) for r in p["required"] if r.endswith(("_m3_h", "_W")) and r != p["target"]])
                         .cast("array<string>"))
    long = unpivot(masked.where("operating").withColumn("_w", watched), [*KEYS, "_w"], [r for r in roles if r in masked.columns], "channel")
    long = long.where(F.array_contains("_w", F.col("channel")) & (F.col("value") != 0))
    per_value = long.groupBy(*KEYS, "channel", F.bround("value", 6).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    g = per_value.groupBy(*KEYS, "channel").agg(F.sum("c").alias("rows"), F.max("c").alias("modal"),
                                                F.min_by("v", F.struct((-F.col("c")).alias("a"), F.col("v").alias("b"))).alias("held_value"))
    g = g.withColumn("modal_share", F.col("modal") / F.col("rows"))
    return g.select(*KEYS, "channel", "rows", "held_value", "modal_share")


def frozen_findings(shares: DataFrame, share: float = FROZEN_SHARE, min_rows: int = FROZEN_ROWS) -> DataFrame:
    return shares.where((F.col("rows") >= min_rows) & (F.col("modal_share") >= share))


def cop_rows(df: DataFrame, load: str = "load_W", power: str = "power_W") -> DataFrame:
    """Adds ``cop`` on usable operating rows and ``impossible`` where it is at or below one."""
    usable = F.col("operating") & is_true(F.col(load) > 0) & is_true(F.col(power) > 0)
    d = df.withColumn("cop", F.when(usable, ratio(load, power)))
    return d.withColumn("impossible", is_true(F.col("cop") <= COP_FLOOR))


def cop_envelope(with_cop: DataFrame) -> DataFrame:
    """Share of impossible rows, median COP of the others, and the two flags."""
    g = with_cop.groupBy(*KEYS).agg(F.count("cop").alias("usable_rows"), F.count_if("impossible").alias("impossible_rows"))
    q = wide_quantiles(with_cop, KEYS, {"cop": F.when(~F.col("impossible"), F.col("cop"))}, {"median": 0.5})
    j = g.join(q, list(KEYS), "left").withColumn("impossible_pct", share_pct(F.col("impossible_rows"), F.col("usable_rows")))
    med = F.bround("cop_median", 2)
    return j.select(
        *KEYS, "usable_rows", "impossible_rows", "impossible_pct", "cop_median",
        F.when(F.col("impossible_pct") >= COP_SHARE_PCT,
               F.concat(F.lit("cop_below_unity:reconstructed_COP="), plain(F.bround("impossible_pct", 1), 1))).alias("below_flag"),
        F.when(F.col("cop_median") > COP_CEILING, F.concat(F.lit("cop_above_envelope:reconstructed_COP="),
               F.when(med >= 100, plain(F.bround("cop_median", 1), 1)).otherwise(plain(med, 2)))).alias("above_flag"))


def excitation(df: DataFrame, channel: Column, min_span: float = MIN_SPAN, min_rows: int = MIN_EXCITED_ROWS) -> DataFrame:
    """How far a driving variable moved over positive operating rows."""
    d = df.withColumn("_x", F.when(F.col("operating") & (channel > 0), channel))
    q = wide_quantiles(d, KEYS, {"x": F.col("_x")}, {"p5": 0.05, "median": 0.5, "p95": 0.95})
    n = d.groupBy(*KEYS).agg(F.countDistinct(F.bround("_x", 6)).alias("distinct_values"))
    j = q.join(n, list(KEYS)).where(F.col("x_n") >= min_rows)
    span = ratio(F.col("x_p95") - F.col("x_p5"), F.abs("x_median"))
    return (j.select(*KEYS, F.col("x_n").alias("rows"), F.col("x_p5").alias("p5"), F.col("x_median").alias("median"), F.col("x_p95").alias("p95"),
                     span.alias("relative_span"), "distinct_values").withColumn("excited", F.col("relative_span") >= min_span))


def driver_value(df: DataFrame) -> Column:
    """The profile's driving variable; a chiller load is reconstructed where not metered."""
    return per_family(lambda p: None if not p["driver"] else
                      (F.col("load_W") if p["driver"] == "cooling_load_W" and "load_W" in df.columns else role_or_null(df, p["driver"])))


def driver_excitation(df: DataFrame, **kw) -> DataFrame:
    e = excitation(df, driver_value(df), **kw)
    fam = df.select(*KEYS, "equipment_type").distinct()
    j = e.join(fam, list(KEYS)).withColumn("driver", per_family(lambda p: p["driver"]))
    flag = F.when(~F.col("excited"), F.concat(F.lit("driver_not_excited:"), F.col("driver"), F.lit("="), F.format_string("%.3f", F.col("relative_span"))))
    return j.withColumn("driver_flag", flag)


def envelope_flags(frozen: DataFrame, envelope: DataFrame) -> DataFrame:
    """Plausibility findings per device; recorded, never blocking."""
    order = F.array_position(per_family(lambda p: F.array(*[F.lit(r) for r in p["required"]])), F.col("channel"))
    text = F.concat(F.lit("frozen_channel:"), F.col("channel"), F.lit("="), plain(F.bround(F.col("modal_share") * 100, 1), 1))
    fz = frozen.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))).alias("f"))  # one entry per channel
    j = fz.select(*KEYS, F.transform("f", lambda x: x["t"]).alias("fz")).join(
        envelope.select(*KEYS, "below_flag", "above_flag"), list(KEYS), "full")
    return j.select(*KEYS, F.concat(F.coalesce("fz", F.array().cast("array<string>")),
                                    F.array_compact(F.array("below_flag", "above_flag"))).alias("envelope_flags"))


def active_mask(df: DataFrame, roles) -> DataFrame:
    """Adds ``active``: running, or the first power/flow role positive; and the drive turning."""
    metered = [r for r in roles if "power" in r or "flow" in r]
    drives = [r for r in DRIVES if r in df.columns]
    # a row per device, written so that its size is known: where it is small no wide row is shuffled
    has = settle(df.groupBy(*KEYS).agg(*[(F.count(r) > 0).alias(f"_has_{r}") for r in ["run_signal", *metered, *drives]]), "signals")
    d = df.join(has, list(KEYS))

    def first_present(names):
        out = F.lit(True)
        for r in reversed(names):
            out = F.when(F.col(f"_has_{r}"), is_true(F.col(r) > 0)).otherwise(out)
        return out
    on = F.when(F.col("_has_run_signal"), is_true(F.col("run_signal") > 0)).otherwise(first_present(metered))
    return d.withColumn("active", on & first_present(drives)).drop(*[f"_has_{r}" for r in ["run_signal", *metered, *drives]])


def modal_share(active: DataFrame, roles) -> DataFrame:
    """Share of the commonest value of each role on active rows."""
    per_value = unpivot(active.where("active"), KEYS, roles).groupBy(*KEYS, "role", "value").agg(F.count(F.lit(1)).alias("c"))
    return per_value.groupBy(*KEYS, "role").agg(F.sum("c").alias("rows"), (F.max("c") / F.sum("c")).alias("modal_share"))


def eligible_roles(active: DataFrame, roles, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Per device: usable drivers and non-degenerate targets, as short role arrays.

    Drivers are judged on all rows, modal shares on active ones. One wide aggregation settles nearly every role: a role
    without spread has a modal share of one, and of two hash classes of values the larger holds the commonest value, so
    its share is a bound. Only the values of roles that the bound leaves open are unfolded and counted.
    """
    def value(i):
        return F.col(roles[i]).cast("double")

    def on(i):
        return F.when(F.col("active"), value(i))
    names = range(len(roles))
    g = active.groupBy(*KEYS).agg(*[e for i in names for e in (
        F.count(value(i)).alias(f"_n{i}"), F.min(value(i)).alias(f"_lo{i}"), F.max(value(i)).alias(f"_hi{i}"), F.count(on(i)).alias(f"_a{i}"),
        F.min(on(i)).alias(f"_alo{i}"), F.max(on(i)).alias(f"_ahi{i}"), F.count_if(on(i).isNotNull() & (F.xxhash64(on(i) + dbl(0.0)) >= 0)).alias(f"_h{i}"))])

    def c(name, i):
        return F.col(f"_{name}{i}")

    def share(i):
        return F.greatest(c("h", i), c("a", i) - c("h", i)) / F.nullif(c("a", i), F.lit(0))
    usable = [is_true((c("n", i) >= min_samples) & (c("lo", i) < c("hi", i)) & ~((F.abs(c("lo", i)) <= 1e-8) & (F.abs(c("hi", i)) <= 1e-8)) & (c("a", i) > 0)) for i in names]
    varied = [u & (c("alo", i) < c("ahi", i)) for i, u in enumerate(usable)]

    def picked(conds):
        return F.array_compact(F.array(*[F.when(x, F.lit(r)) for r, x in zip(roles, conds, strict=True)]))
    g = g.select(*KEYS, picked(usable).alias("drivers"), picked([v & (share(i) <= MODAL_MAX) for i, v in enumerate(varied)]).alias("targets"),
                 picked([v & (share(i) > MODAL_MAX) for i, v in enumerate(varied)]).alias("_open"))
    g = settle(g.where(F.size("drivers") > 0), "device_roles")
    rest = active.where("active").join(g.where(F.size("_open") > 0).select(*KEYS, "_open"), list(KEYS))
    rest = unpivot(rest.select(*KEYS, *[F.when(F.array_contains("_open", F.lit(r)), F.col(r).cast("double")).alias(r) for r in roles]), KEYS, roles)
    counts = rest.groupBy(*KEYS, "role", "value").agg(F.count(F.lit(1)).alias("c")).groupBy(*KEYS, "role").agg((F.max("c") / F.sum("c")).alias("modal_share"))
    more = counts.where(F.col("modal_share") <= MODAL_MAX).groupBy(*KEYS).agg(F.collect_set("role").alias("_more"))
    j = g.join(more, list(KEYS), "left")
    return j.select(*KEYS, "drivers", F.concat("targets", F.coalesce("_more", F.array().cast("array<string>"))).alias("targets"))


def role_cells(active: DataFrame, roles, eligible: DataFrame) -> DataFrame:
    """Active rows as ``(keys, ts, targets, values)`` with small integer role codes; ``values`` is NULL where a role has none or is no driver.

    Every pass over the pairs reads this narrow table; the pairs themselves are
    unfolded inside the scan and reduced map side, so they are never shuffled.
    """
    codes = F.array(*[F.lit(r) for r in roles])
    picked = settle(eligible.select(*KEYS, *[F.transform(c, lambda r: F.array_position(codes, r).cast("int") - 1).alias(c) for c in ("drivers", "targets")]), "eligible")
    values = F.array(*[F.when(F.array_contains("drivers", F.lit(i)), F.col(r).cast("double")) for i, r in enumerate(roles)])
    d = active.where("active").join(picked, list(KEYS)).select(*KEYS, "ts", "targets", values.alias("values"))
    return settle(d, "role_cells")


def role_pairs(cells: DataFrame) -> DataFrame:
    """Every (target, driver) pair of a row with both values."""
    known = F.filter(F.transform("values", lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda c: c["v"].isNotNull())
    pairs = F.flatten(F.transform(F.filter("cells", lambda t: F.array_contains("targets", t["i"])), lambda t: F.transform(
        F.filter("cells", lambda x: x["i"] != t["i"]),
        lambda x: F.struct(t["i"].alias("t"), x["i"].alias("d"), t["v"].alias("y"), x["v"].alias("x")))))
    return cells.select(*KEYS, "targets", known.alias("cells")).select(*KEYS, F.explode(pairs).alias("p")).select(*KEYS, "p.*")


PAIR = [*KEYS, "t", "d"]


def _named(df: DataFrame, roles) -> DataFrame:
    codes = F.array(*[F.lit(r) for r in roles])
    rest = [c for c in df.columns if c not in PAIR]
    return df.select(*KEYS, F.get(codes, F.col("t")).alias("target"), F.get(codes, F.col("d")).alias("driver"), *rest)


def duplicate_channels(cells: DataFrame, roles, min_samples: int = MIN_SAMPLES) -> DataFrame:
    g = role_pairs(cells).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"), F.min(F.col("x") == F.col("y")).alias("same"))
    return _named(g.where(F.col("same") & (F.col("n") >= min_samples)).select(*PAIR, "n"), roles)


def pair_forms(cells: DataFrame, roles, min_samples: int = MIN_SAMPLES, trim: float = 0.05, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Trimmed least-squares fit of every form for every pair, judged on all rows; one way for records of any length."""
    out = pair_fits(cells, len(roles), tuple(FORMS), min_samples, trim, RESIDUAL_PCT, chunk_rows)
    return _named(out.withColumn("inlier_fraction", dbl(1.0) - F.col("n_outlier_rows") / F.col("n")), roles)


def dependency_findings(forms: DataFrame) -> DataFrame:
    """Per pair the simplest exact form; a target with none keeps its single best fit."""
    exact = forms.where(F.col("same") | (F.col("inlier_fraction") >= INLIER_SHARE))
    pick = F.struct("form", "coefficients", "inlier_fraction", "n_outlier_rows", "max_residual_pct_of_range", "n", "same")
    per_pair = exact.groupBy(*KEYS, "target", "driver").agg(F.min_by(pick, F.col("form_ord")).alias("p"))
    found = exact.select(*KEYS, "target").distinct()
    rest = forms.join(found, [*KEYS, "target"], "left_anti")
    best = rest.groupBy(*KEYS, "target").agg(F.min_by(
        F.struct("driver", pick.alias("p")), F.struct((-F.col("inlier_fraction")).alias("a"), F.col("driver").alias("b"), F.col("form_ord").alias("c"))).alias("m"))
    best = best.select(*KEYS, "target", F.col("m.driver").alias("driver"), F.col("m.p").alias("p"))
    out = per_pair.unionByName(best).select(*KEYS, "target", "driver", "p.*")
    return out.select(*KEYS, "target", "driver", F.when(F.col("same"), "identity").otherwise(F.col("form")).alias("form"),
                      F.when(F.col("same"), F.array(dbl(1.0))).otherwise(F.col("coefficients")).alias("coefficients"),
                      F.when(F.col("same"), 1.0).otherwise(F.col("inlier_fraction")).alias("inlier_fraction"),
                      F.when(F.col("same"), 0).otherwise(F.col("n_outlier_rows")).alias("n_outlier_rows"),
                      F.when(F.col("same"), 0.0).otherwise(F.col("max_residual_pct_of_range")).alias("max_residual_pct_of_range"),
                      "n", F.col("same").alias("duplicate"),
                      (F.col("same") | (F.col("inlier_fraction") >= INLIER_SHARE)).alias("synthetic"))


def scan_cells(df: DataFrame, roles, min_samples: int = MIN_SAMPLES) -> DataFrame:
    a = active_mask(df, roles)
    return role_cells(a, roles, eligible_roles(a, roles, min_samples))


def dependency_scan(df: DataFrame, roles, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Channels that are exact functions of another channel, and the best fit of the others."""
    return dependency_findings(pair_forms(scan_cells(df, roles, min_samples), roles, min_samples))


def synthetic_roles(findings: DataFrame, fleet: DataFrame) -> DataFrame:
    """Targets and validation targets that only repeat another channel."""
    fam = fleet.select(*KEYS, "equipment_type").distinct()
    s = findings.where("synthetic").select(*KEYS, F.col("target").alias("role")).distinct().join(fam, list(KEYS))
    watched = per_family(lambda p: F.array(*[F.lit(r) for r in sorted({p["target"], *p["validation"]})]))
    s = s.where(F.array_contains(watched, F.col("role")))
    main = per_family(lambda p: p["target"])
    return s.groupBy(*KEYS).agg(F.array_sort(F.collect_set("role")).alias("synthetic"), F.max(F.col("role") == main).alias("target_synthetic"))


def independent_signals(profile: DataFrame, findings: DataFrame, roles) -> DataFrame:
    """Roles that carry information no earlier role carries.

    Exact pairs are edges between the few roles of a device; one relabelling
    sweep over the edges yields the connected components.
    """
    order = F.array(*[F.lit(r) for r in roles])
    alive = profile.where((F.col("n_finite") > 0) & ~F.col("dead")).groupBy(*KEYS).agg(F.collect_set("role").alias("alive"))
    e = findings.where("synthetic").select(*KEYS, F.struct(
        (F.array_position(order, F.col("target")) - 1).cast("int").alias("a"), (F.array_position(order, F.col("driver")) - 1).cast("int").alias("b"),
        F.col("target").alias("ta"), F.col("driver").alias("tb")).alias("e"))
    e = e.groupBy(*KEYS).agg(F.collect_set("e").alias("edges"))
    d = alive.join(e, list(KEYS), "left")
    edges = F.coalesce(F.filter("edges", lambda x: F.array_contains("alive", x["ta"]) & F.array_contains("alive", x["tb"])), F.array())
    edges = F.when(F.col("edges").isNotNull(), edges)

    def merge(lab, x):
        a, b = F.get(lab, x["a"]), F.get(lab, x["b"])
        return F.transform(lab, lambda v: F.when(v == F.greatest(a, b), F.least(a, b)).otherwise(v))
    start = F.array(*[F.lit(i) for i in range(len(roles))])
    lab = F.when(F.col("edges").isNotNull(), F.aggregate(edges, start, merge)).otherwise(start)
    d = d.withColumn("_lab", lab)
    rep = F.filter(F.transform(order, lambda r, i: F.when(F.array_contains("alive", r) & (F.get(F.col("_lab"), i) == i), r)), lambda r: r.isNotNull())
    return d.select(*KEYS, rep.alias("independent"))


def device_observability(df: DataFrame, roles, findings: DataFrame) -> DataFrame:
    prof = channel_profile(df, roles)
    mapped = prof.where("n_finite > 0").groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("mapped"), F.count_if("dead").alias("dead"),
        F.array_sort(F.collect_list(F.when(F.col("dead"), F.col("role")))).alias("dead_roles"))
    syn = findings.where("synthetic").groupBy(*KEYS).agg(F.array_sort(F.collect_set("target")).alias("synthetic_roles"))
    j = mapped.join(independent_signals(prof, findings, roles), list(KEYS), "left").join(syn, list(KEYS), "left")
    none = F.array().cast("array<string>")
    j = j.withColumns({"independent": F.coalesce("independent", none), "synthetic_roles": F.coalesce("synthetic_roles", none)})
    return j.select(*KEYS, "mapped", F.size("independent").alias("independent"), "dead", F.size("synthetic_roles").alias("synthetic"),
                    F.array_join("independent", ",").alias("independent_roles"), F.array_join("dead_roles", ",").alias("dead_roles"),
                    F.array_join("synthetic_roles", ",").alias("synthetic_roles"))


def six_digits(x: Column) -> Column:
    """Six significant digits without padding zeros."""
    t = F.regexp_replace(F.format_string("%.6g", x), r"(\.[0-9]*?)0+(e|$)", "$1$2")
    return F.regexp_replace(t, r"\.(e|$)", "$1")


def dependency_text(findings: DataFrame) -> DataFrame:
    """``y = b0 + b1*x + ...`` rendering."""
    c, x = F.col("coefficients"), F.col("driver")
    terms = F.transform(c, lambda b, i: F.when(i == 0, six_digits(b)).when(i == 1, F.concat(six_digits(b), F.lit("*"), x))
                        .otherwise(F.concat(six_digits(b), F.lit("*"), x, F.lit("^"), i.cast("string"))))
    body = F.when(F.col("form") == "proportional", F.concat(six_digits(c[0]), F.lit("*"), x)).otherwise(F.array_join(terms, " + "))
    return findings.withColumn("relation", F.when(F.col("duplicate"), F.concat(F.col("target"), F.lit(" is a copy of "), x))
                               .otherwise(F.concat(F.col("target"), F.lit(" = "), body)))


def tier_rank(c: str = "tier") -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in EVIDENCE_TIERS]), F.col(c))


def best_tier(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by("tier", tier_rank()).alias("tier"), F.min(tier_rank()).alias("rank"))


def sensor_readiness(df: DataFrame) -> DataFrame:
    """Per device and model type: are all required channels present, and which are not?"""
    roles = sorted({c for _, _, c, _ in SENSOR_SET})
    p = presence(df, roles)
    models = {}
    for fam, model, ch, need in SENSOR_SET:
        models.setdefault((fam, model), []).append((ch, need))
    items = F.array(*[F.struct(F.lit(f).alias("fam"), F.lit(m).alias("model_type"),
                               F.array(*[F.lit(c) for c, need in chs if need == "required"]).alias("required"),
                               F.lit(len(chs)).alias("channels")) for (f, m), chs in models.items()])
    d = p.select(*KEYS, "equipment_type", "present", F.explode(F.filter(items, lambda i: i["fam"] == F.col("equipment_type"))).alias("m"))
    missing = F.filter("m.required", lambda r: ~F.array_contains("present", r))
    return d.select(*KEYS, "equipment_type", "m.model_type", "m.channels", (F.size(missing) == 0).alias("ready"), F.array_join(missing, ",").alias("missing"))


