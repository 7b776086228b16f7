"""What book-event imbalance explains of price changes: regressions over bars of several widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import NS_PER_S
from ..sources.tape import written
from . import flow, regress

SECONDS = (1, 5, 10)
SPECS = ("lead1", "contemporaneous")


def paired(bars: DataFrame, keys: tuple[str, ...], xs: list[str]) -> DataFrame:
    """keys, spec, t, xs.., y: a bar's flow with its own change of mid and with the next bar's. A
    change spans two bars, so both have to be valid."""
    w = Window.partitionBy(*keys).orderBy("bar_start_ns")
    rows = bars.withColumns({"__back": F.lag("valid").over(w), "__on": F.lead("valid").over(w)})
    sides = (("lead1", "delta_mid_lead1", "__on"), ("contemporaneous", "delta_mid", "__back"))
    out = [rows.where(F.col("valid") & F.col(other)).select(*keys, F.lit(spec).alias("spec"), F.col("bar_start_ns").alias("t"), *xs, F.col(y).alias("y")) for spec, y, other in sides]
    return out[0].unionByName(out[1])


def _counts(bars: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    out = bars.groupBy(*keys).agg(F.count("*").alias("n_bars"), F.count_if("valid").alias("n_valid"))
    return out.withColumn("dropped_pct", F.lit(100.0) * (F.col("n_bars") - F.col("n_valid")) / F.col("n_bars"))


def _each_width(states: DataFrame, keys: tuple[str, ...], seconds: tuple[float, ...], levels: int | None) -> DataFrame:
    out = None
    for tau in seconds:
        bars = flow.time_bars(states, keys, int(tau * NS_PER_S), levels=levels).withColumn("tau_s", F.lit(float(tau)))
        out = bars if out is None else out.unionByName(bars)
    return written(out, "validation-bars")


def ofi_validation(states: DataFrame, keys: tuple[str, ...], seconds: tuple[float, ...] = SECONDS, least: int = regress.LEAST_ROWS) -> DataFrame:
    """keys, tau_s, spec, n_bars, n_valid, dropped_pct and the fit: n, alpha, beta, r2, se_beta,
    t_beta, hac_lags. All widths and both specs are one pass. Fewer than `least` pairs are not fitted."""
    bars = _each_width(states, keys, seconds, None)
    wide = (*keys, "tau_s")
    fits = regress.ols(paired(bars, wide, ["ofi"]), (*wide, "spec"), x="ofi", least=least)
    fits = fits.withColumn("hac_lags", regress.hac_lags(F.col("n")))
    grid = _counts(bars, wide).withColumn("spec", F.explode(F.array(*map(F.lit, SPECS))))
    return grid.join(fits, [*wide, "spec"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def features(levels: int) -> dict[str, list[int]]:
    """Levels (from 1) that make up each feature; `_sum` adds them up, `_multi` fits each one."""
    top = list(range(1, min(5, levels) + 1))
    every = list(range(1, levels + 1))
    return {"l1": [1], "m5_sum": top, "m10_sum": every, "m5_multi": top, "m10_multi": every}


def mlofi_validation(states: DataFrame, keys: tuple[str, ...], seconds: tuple[float, ...] = SECONDS, levels: int = 10, least: int = regress.LEAST_ROWS) -> DataFrame:
    """keys, tau_s, spec, feature, k, n_bars, n_valid, dropped_pct and the fit. Fits of several
    levels have n, r2 and hac_lags only. Fewer than `least` pairs are not fitted."""
    bars = _each_width(states, keys, seconds, levels)
    wide = (*keys, "tau_s")
    names = [f"ofi_{m}" for m in range(1, levels + 1)]
    rows = paired(bars, wide, names)
    own = features(levels)
    alone = [n for n in own if not n.endswith("_multi")]
    added = F.array(*(F.struct(F.lit(n).alias("feature"), sum((F.col(f"ofi_{m}") for m in own[n]), F.lit(0.0)).alias("x")) for n in alone))
    single = rows.select(*wide, "spec", "t", "y", F.explode(added).alias("f")).select(*wide, "spec", "t", "y", "f.*")
    fits = regress.ols(single, (*wide, "spec", "feature"), least=least).withColumn("k", F.lit(1).cast("long"))
    for n in (n for n in own if n.endswith("_multi")):
        xs = [f"ofi_{m}" for m in own[n]]
        several = regress.ols_multi(rows, (*wide, "spec"), xs, "y")
        if least < regress.LEAST_ROWS:
            few = regress.r2_of_few(rows, (*wide, "spec"), xs, "y").withColumnRenamed("r2", "__few")
            several = several.join(few, [*wide, "spec"], "left").withColumn("r2", F.when(F.col("n") >= least, F.coalesce("__few", "r2"))).drop("__few")
        fits = fits.unionByName(several.select(*wide, "spec", F.lit(n).alias("feature"), F.lit(len(own[n])).cast("long").alias("k"), "n", "r2"), allowMissingColumns=True)
    fits = fits.withColumn("hac_lags", regress.hac_lags(F.col("n")))
    grid = _counts(bars, wide).withColumn("spec", F.explode(F.array(*map(F.lit, SPECS)))).withColumn("feature", F.explode(F.array(*map(F.lit, own))))
    return grid.join(fits.drop("k"), [*wide, "spec", "feature"], "left").withColumns({
        "n": F.coalesce("n", F.lit(0)).cast("long"), "k": F.element_at(F.create_map(*(F.lit(x) for n in own for x in (n, len(own[n]) if n.endswith("_multi") else 1))), F.col("feature")).cast("long")})


#: Fixed limits of the verdicts, in R squared; seconds of a tape that make it more than a trial.
WEAK, STRONG, GAIN, LIFT, LONG_S = 0.05, 0.15, 0.01, 0.02, 1800.0


def ofi_conclusion(lead: Column | str, contemporaneous: Column | str) -> Column:
    """insufficient, contemporaneous, neither, predictive or weak, from both R squared."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (lead, contemporaneous))
    return (
        F.when(a.isNull() | b.isNull(), "insufficient").when((a < WEAK) & (b >= STRONG), "contemporaneous").when((a < WEAK) & (b < STRONG), "neither")
        .when(a >= STRONG, "predictive").otherwise("weak"))


def ofi_conclusions(rows: DataFrame, keys: tuple[str, ...], tau_s: float = 10.0) -> DataFrame:
    """keys, lead_r2, contemporaneous_r2, conclusion of `ofi_validation` rows at one width."""
    of = lambda spec: F.max(F.when(F.col("spec") == spec, F.col("r2")))
    out = rows.where(F.col("tau_s") == tau_s).groupBy(*keys).agg(of("lead1").alias("lead_r2"), of("contemporaneous").alias("contemporaneous_r2"))
    return out.withColumn("conclusion", ofi_conclusion("lead_r2", "contemporaneous_r2"))


def spans(states: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, span_s, insufficient: seconds from a capture's first state to its last, and whether it is too
    short for its figures to be more than a trial."""
    out = states.groupBy(*keys).agg(((F.max("ts_event_ns") - F.min("ts_event_ns")) / 1e9).alias("span_s"))
    return out.withColumn("insufficient", F.col("span_s") < LONG_S)


def qualified(conclusions: DataFrame, states: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Conclusions with the span that they rest on and whether it is insufficient; a key without states
    is."""
    out = conclusions.join(spans(states, keys), list(keys), "left")
    return out.withColumns({"span_s": F.coalesce("span_s", F.lit(0.0)), "insufficient": F.coalesce("insufficient", F.lit(True))})


def mlofi_conclusions(rows: DataFrame, keys: tuple[str, ...], tau_s: float = 10.0) -> DataFrame:
    """keys, sufficient, uni_gain, lead_gain, multi_lift and what follows from them at one width:
    whether no depth predicts, depth adds nothing, sums add something, several coefficients lift
    the fit (as more parameters always do)."""
    of = lambda spec, f: F.max(F.when((F.col("spec") == spec) & (F.col("feature") == f), F.col("r2")))
    names = list(features(10))
    out = rows.where(F.col("tau_s") == tau_s).groupBy(*keys).agg(*(of(s, f).alias(f"__{s}_{f}") for s in SPECS for f in names))
    at = lambda s, f: F.col(f"__{s}_{f}")
    sufficient = F.lit(True)
    for s in SPECS:
        for f in names:
            sufficient = sufficient & at(s, f).isNotNull()
    con, lead = (lambda f: at("contemporaneous", f)), (lambda f: at("lead1", f))
    out = out.withColumns({
        "sufficient": sufficient, "uni_gain": F.greatest(con("m5_sum"), con("m10_sum")) - con("l1"), "lead_gain": F.greatest(lead("m5_sum"), lead("m10_sum")) - lead("l1"),
        "multi_lift": F.greatest(con("m5_multi"), con("m10_multi")) - F.greatest(con("m5_sum"), con("m10_sum"), con("l1")),
        "none_predicts": (lead("l1") < WEAK) & (lead("m5_sum") < WEAK) & (lead("m10_sum") < WEAK)})
    out = out.withColumns({"depth_adds_nothing": (F.col("uni_gain") < GAIN) & (F.abs("lead_gain") < GAIN), "sums_add": F.col("uni_gain") >= GAIN, "several_lift": F.col("multi_lift") >= LIFT})
    return out.select(*keys, "sufficient", "uni_gain", "lead_gain", "multi_lift", "none_predicts", "depth_adds_nothing", "sums_add", "several_lift")
