"""Posterior summaries, convergence diagnostics and checks."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from effectforge.functions.expressions import normal_quantile, quantile_type8, student_p_value

_NORMAL = NormalDist()


def trace_summary(traces: DataFrame, keys: list[str], prob: float = 0.95, nburn: int = 0) -> DataFrame:
    """n, mean, sd, median, min, max and the type-8 interval of each quantity."""
    d = traces.filter(F.col("iteration") > nburn) if nburn else traces
    a = d.groupBy(*keys).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.sort_array(F.collect_list("value")).alias("v"),
    )
    low, high = (1 - prob) / 2, (1 + prob) / 2
    rounded = lambda c: F.round(c, 6)
    return a.select(
        *keys,
        "n",
        rounded(F.col("mean")).alias("mean"),
        rounded(F.col("sd")).alias("sd"),
        rounded(quantile_type8(F.col("v"), 0.5)).alias("median"),
        rounded(F.col("min")).alias("min"),
        rounded(F.col("max")).alias("max"),
        rounded(quantile_type8(F.col("v"), low)).alias("lower"),
        rounded(quantile_type8(F.col("v"), high)).alias("upper"),
    )


def rhat_basic(traces: DataFrame, keys: list[str]) -> DataFrame:
    """Split-chain R-hat of raw values: halves of each chain, sqrt((B/W + n - 1) / n)."""
    length = traces.groupBy(*keys, "chain").agg(F.count("*").alias("len"), F.min("iteration").alias("first"))
    d = traces.join(length, [*keys, "chain"]).withColumn("k", F.col("iteration") - F.col("first"))
    h = F.floor(F.col("len") / 2)
    half = F.when(F.col("k") < h, 0).when(F.col("k") >= F.col("len") - h, 1)
    parts = d.withColumn("half", half).filter("half is not null").groupBy(*keys, "chain", "half").agg(
        F.avg("value").alias("m"), F.var_samp("value").alias("w"), F.count("*").alias("n")
    )
    a = parts.groupBy(*keys).agg(F.var_samp("m").alias("bm"), F.avg("w").alias("w"), F.min("n").alias("n"))
    return a.select(*keys, F.round(F.sqrt((F.col("bm") * F.col("n") / F.col("w") + F.col("n") - 1) / F.col("n")), 6).alias("rhat"))


def _split(x: np.ndarray) -> np.ndarray:
    h = x.shape[0] // 2
    return np.concatenate([x[:h], x[x.shape[0] - h :]], axis=1)


def _normal_scores(x: np.ndarray) -> np.ndarray:
    flat = x.ravel()
    _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2.0)[inverse]
    z = [_NORMAL.inv_cdf((r - 0.375) / (flat.size + 0.25)) for r in ranks]
    return np.array(z).reshape(x.shape)


def _rhat(x: np.ndarray) -> float:
    n = x.shape[0]
    within = x.var(axis=0, ddof=1).mean()
    between = n * x.mean(axis=0).var(ddof=1)
    return float(np.sqrt((between / within + n - 1) / n)) if within > 0 else float("nan")


def _ess(x: np.ndarray) -> float:
    """Effective sample size: FFT autocovariances and initial monotone pairs."""
    n, chains = x.shape
    if n < 3 or x.var() == 0:
        return float("nan")
    centred = x - x.mean(axis=0)
    f = np.fft.rfft(centred, 2 * n, axis=0)
    cov = np.fft.irfft(f * np.conj(f), axis=0)[:n].real / n
    cov = cov.mean(axis=1)
    within = cov[0] * n / (n - 1.0)
    total = cov[0] + (x.mean(axis=0).var(ddof=1) if chains > 1 else 0.0)
    rho = 1 - (within - cov * n / (n - 1.0)) / total
    rho[0] = 1.0
    sums, low = 0.0, np.inf
    for k in range(0, n - 1, 2):
        pair = rho[k] + rho[k + 1]
        if pair <= 0:
            break
        low = min(low, pair)
        sums += low
    tau = max(-1.0 + 2.0 * sums, 1.0 / np.log10(n * chains))
    return float(n * chains / tau)


DIAGNOSTICS = (
    "status string, rhat double, rhat_rank double, rhat_folded double, ess_bulk double, ess_tail double, ess_mean double, "
    "mcse_mean double, rhat_flag boolean, ess_flag boolean, mcse_flag boolean"
)


def diagnose(draws: np.ndarray, rhat_limit: float = 1.01, ess_per_chain: float = 100.0, mcse_limit: float = 0.05) -> tuple:
    """Status and diagnostics of draws (iteration by chain)."""
    n, chains = draws.shape
    nan = float("nan")
    none = (nan,) * 7 + (False,) * 3
    if not np.isfinite(draws).all():
        return ("nonfinite", *none)
    if np.ptp(draws) == 0:
        return ("constant", *none)
    if chains < 2:
        return ("unavailable_single_chain", *none)
    if n < 4:
        return ("insufficient_draws", *none)
    still = (np.ptp(draws, axis=0) == 0).all()
    rank = _rhat(_normal_scores(_split(draws)))
    folded = _rhat(_normal_scores(_split(np.abs(draws - np.median(draws)))))
    rhat = max(rank, folded)
    bulk = tail = mean = mcse = nan
    if n >= 6:
        halves = _split(draws)
        cuts = np.quantile(draws, [0.05, 0.95])
        bulk, mean = _ess(_normal_scores(halves)), _ess(halves)
        tail = min(_ess(_split((draws <= c).astype(float))) for c in cuts)
        sd = draws.std(ddof=1)
        mcse = float(sd / np.sqrt(mean)) if np.isfinite(mean) else nan
    relative = mcse / draws.std(ddof=1)
    whole = all(np.isfinite(v) for v in (rhat, bulk, tail, mean, mcse))
    status = "constant_chain_mismatch" if still else "computed_partial" if not whole else "computed" if chains >= 4 else "computed_fewer_than_four_chains"
    flags = (still or rhat > rhat_limit, min(bulk, tail) / chains < ess_per_chain, relative > mcse_limit)
    return (status, rhat, rank, folded, bulk, tail, mean, mcse, *map(bool, flags))


def convergence(traces: DataFrame, keys: list[str], nburn: int = 0) -> DataFrame:
    """Diagnostics of each quantity: one task for the draws of one quantity."""
    d = traces.filter(F.col("iteration") > nburn) if nburn else traces
    types = dict(traces.dtypes)

    def task(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        wide = part.pivot_table(index="iteration", columns="chain", values="value", aggfunc="first", dropna=False)
        return pd.DataFrame([(*key, *diagnose(wide.to_numpy(float)))], columns=[*keys, *(c.split()[0] for c in DIAGNOSTICS.split(", "))])

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + DIAGNOSTICS
    return d.groupBy(*keys).applyInPandas(task, schema)


#: Slices of a group's range of values; they are ranked side by side.
SLICES = 1024


def _below(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, x, n, ...), one for each x of a group, with ``below``, the sum of n at lower x, and ``total``, that of the group.

    Every group's range is cut into slices of equal width, which are summed first, so no
    task holds a whole group unless nearly all its values fall into one slice.
    """
    spread = cells.groupBy(*keys).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.sum("n").alias("total"))
    wide = F.col("high") - F.col("low")
    place = F.when((wide > 0) & (wide < float("inf")), F.floor((F.col("x") - F.col("low")) / wide * SLICES)).otherwise(0)
    cells = cells.join(spread, keys).withColumn("slice", place).drop("low", "high")
    sums = cells.groupBy(*keys, "slice").agg(F.sum("n").alias("in_slice"))
    before = F.sum("in_slice").over(Window.partitionBy(*keys).orderBy("slice")) - F.col("in_slice")
    within = F.sum("n").over(Window.partitionBy(*keys, "slice").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    d = cells.join(sums.withColumn("before", before).drop("in_slice"), [*keys, "slice"])
    return d.withColumn("below", F.col("before") + within).drop("before", "slice")


def _medians(traces: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and the median of the values."""
    d = _below(traces.groupBy(*keys, F.col("value").alias("x")).agg(F.count("*").alias("n")), keys)
    at = lambda k: F.max(F.when(F.col("below") <= k, F.col("x")))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    return d.groupBy(*keys).agg((at(low) * 0.5 + at(high) * 0.5).alias("median"))


def rank_rhat(traces: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and R-hat of the draws' normal scores, raw (``rank``), folded at the median, and the larger.

    The halves of all chains are ranked together, ties by their mean rank; the
    middle draw of a chain of odd length is in neither half.  Equal draws are
    counted, and counts are ranked by slices of the range of the draws.
    """
    length = traces.groupBy(*keys, "chain").agg(F.count("*").alias("len"), F.min("iteration").alias("first"))
    d = traces.join(length, [*keys, "chain"]).withColumn("k", F.col("iteration") - F.col("first"))
    h = F.floor(F.col("len") / 2)
    d = d.withColumn("half", F.when(F.col("k") < h, 0).when(F.col("k") >= F.col("len") - h, 1)).filter("half is not null")
    d = d.groupBy(*keys, "value", "chain", "half").agg(F.count("*").alias("n")).join(_medians(traces, keys), keys)
    kinds = F.explode(F.array(F.struct(F.lit("rank").alias("kind"), F.col("value").alias("x")), F.struct(F.lit("folded").alias("kind"), F.abs(F.col("value") - F.col("median")).alias("x"))))
    d = d.select(*keys, "chain", "half", "n", kinds.alias("s")).select(*keys, "chain", "half", "n", "s.*")
    d = d.groupBy(*keys, "kind", "x", "chain", "half").agg(F.sum("n").alias("n"))
    held = d.groupBy(*keys, "kind", "x").agg(F.sum("n").alias("n"), F.collect_list(F.struct("chain", "half", "n")).alias("parts"))
    ranked = _below(held, [*keys, "kind"])
    mean_rank = F.col("below") + (F.col("n") + 1) / 2
    z = normal_quantile((mean_rank - 0.375) / (F.col("total") + 0.25))
    d = ranked.select(*keys, "kind", z.alias("z"), F.explode("parts").alias("p")).select(*keys, "kind", "z", "p.*")
    parts = d.groupBy(*keys, "kind", "chain", "half").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("z")).alias("s"), F.sum(F.col("n") * F.col("z") * F.col("z")).alias("q"), F.min("z").alias("least"), F.max("z").alias("most")
    )
    still = F.col("least") == F.col("most")
    mean = F.when(still, F.col("least")).otherwise(F.col("s") / F.col("n"))
    # Equal draws have no variance; rounding must not give them one.
    spread = F.when(F.col("n") > 1, F.when(still, 0.0).otherwise((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)))
    parts = parts.select(*keys, "kind", mean.alias("m"), spread.alias("w"), "n")
    a = parts.groupBy(*keys, "kind").agg(F.var_samp("m").alias("bm"), F.avg("w").alias("w"), F.min("n").alias("n"))
    value = F.sqrt((F.col("bm") * F.col("n") / F.col("w") + F.col("n") - 1) / F.col("n"))
    two = a.groupBy(*keys).pivot("kind", ["rank", "folded"]).agg(F.first(value))
    return two.select(*keys, F.round("rank", 6).alias("rhat_rank"), F.round("folded", 6).alias("rhat_folded"), F.round(F.greatest("rank", "folded"), 6).alias("rhat"))


def hpd(traces: DataFrame, keys: list[str], prob: float = 0.95) -> DataFrame:
    """Keys, lower and upper: the shortest interval between two draws with ``prob`` of them between; the first of equals."""
    d = traces.groupBy(*keys).agg(F.sort_array(F.collect_list("value")).alias("v")).withColumn("n", F.size("v"))
    gap = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.round(F.col("n") * prob).cast("int")))
    spans = F.transform(
        F.sequence(F.lit(1), F.col("n") - F.col("gap")),
        lambda k: F.struct(F.round(F.element_at("v", k + F.col("gap")) - F.element_at("v", k), 10).alias("w"), k.alias("k")),
    )
    best = d.withColumn("gap", gap).filter("n > 1").withColumn("k", F.array_min(spans)["k"])
    return best.select(*keys, F.round(F.element_at("v", F.col("k")), 6).alias("lower"), F.round(F.element_at("v", F.col("k") + F.col("gap")), 6).alias("upper"))


def lag_correlation(traces: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and the lag-1 autocorrelation: products of neighbours' deviations over the sum of squares."""
    mean = F.avg("value").over(Window.partitionBy(*keys))
    d = traces.withColumn("dev", F.col("value") - mean)
    d = d.withColumn("before", F.lag("dev").over(Window.partitionBy(*keys).orderBy("iteration")))
    return d.groupBy(*keys).agg(F.round(F.sum(F.col("dev") * F.col("before")) / F.sum(F.col("dev") * F.col("dev")), 6).alias("lag1"))


#: Statuses of a quantity that was looked at, and of one that need not be.
COMPUTED = ("computed", "computed_fewer_than_four_chains", "computed_partial", "constant_chain_mismatch")
EXCLUDED = ("not_updated", "not_applicable", "structural_zero")


def overview(diagnostics: DataFrame, quantity: str = "quantity") -> DataFrame:
    """One row on a table of :func:`convergence`: its status, counts by status, and the worst quantities.

    It is unavailable where nothing was computed, a warning where something is
    flagged, partial where something was computed in part or not at all, else ok.
    """
    status, q = F.col("status"), F.col(quantity).cast("string")
    computed, excluded = status.isin(*COMPUTED), status.isin(*EXCLUDED)
    flagged = F.col("rhat_flag") | F.col("ess_flag") | F.col("mcse_flag")
    known = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c), F.col(c))
    count = lambda c: F.count(F.when(c, 1))
    a = diagnostics.agg(
        F.count("*").alias("n_quantities"),
        count(computed).alias("n_computed"),
        count(status == "computed_partial").alias("n_partial"),
        count(~computed & ~excluded).alias("n_unavailable"),
        count(flagged).alias("n_flagged"),
        count(status == "constant_chain_mismatch").alias("n_constant_chain_mismatch"),
        F.max(known("rhat")).alias("max_rhat"),
        F.max_by(q, F.struct(known("rhat"), q)).alias("max_rhat_quantity"),
        F.min(known("ess_bulk")).alias("min_ess_bulk"),
        F.min(known("ess_tail")).alias("min_ess_tail"),
    )
    overall = F.when(F.col("n_computed") == 0, "unavailable").when(F.col("n_flagged") > 0, "warning")
    return a.withColumn("overall_status", overall.when(F.col("n_partial") + F.col("n_unavailable") > 0, "partial").otherwise("ok"))


def warnings(over: DataFrame, label: str = "fit") -> list[str]:
    """What a user should look at, as text; nothing where all is well."""
    r = over.first()
    if r["overall_status"] == "ok":
        return []
    if r["overall_status"] == "unavailable":
        return [f"{label}: convergence diagnostics are unavailable for all {r['n_quantities']} quantities"]
    worst = "" if r["max_rhat"] is None else f"; largest R-hat {r['max_rhat']:.3f} ({r['max_rhat_quantity']})"
    return [f"{label}: {r['overall_status']}, {r['n_flagged']} of {r['n_quantities']} quantities flagged{worst}"]


def strongest(markers: DataFrame, *, min_pip: float | None = None, top_n: int | None = None) -> DataFrame:
    """Rows of (trait, marker_idx, pip, ...) with a PIP of ``min_pip`` or more, and of them the ``top_n`` largest of each trait."""
    d = markers.filter(F.col("pip").isNotNull() & ~F.isnan("pip"))
    d = d if min_pip is None else d.filter(F.col("pip") >= min_pip)
    if top_n is None:
        return d
    w = Window.partitionBy("trait").orderBy(F.col("pip").desc(), "marker_idx")
    return d.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top_n).drop("place")


def component_summary(probabilities: DataFrame, thresholds: tuple[float, ...] = (0.001, 0.01, 0.05, 0.5, 0.95)) -> DataFrame:
    """trait, mean PIP, expected non-null markers and counts at PIP thresholds."""
    null = probabilities.filter("component = 0").select("trait", "marker_idx", (1 - F.col("prob")).alias("pip"))
    return null.groupBy("trait").agg(
        F.count("*").alias("m"),
        F.round(F.avg("pip"), 8).alias("mean_pip"),
        F.round(F.sum("pip"), 8).alias("expected_nonnull"),
        *[F.count(F.when(F.col("pip") >= t, 1)).alias(f"n_pip_{str(t).replace('.', '_')}") for t in thresholds],
    )


def architecture(markers: DataFrame, *, weight_by_pip: bool = True, epsilon: float = 1e-12, min_pip: float | None = None) -> DataFrame:
    """trait, slope, intercept, r2 of log signal on log heterozygosity."""
    d = markers.filter(F.col("pip") >= min_pip) if min_pip is not None else markers
    signal = F.col("effect") * F.col("effect") * (F.col("pip") if weight_by_pip else F.lit(1.0))
    y = F.log(signal + epsilon)
    x = F.log(F.greatest(2 * F.col("maf") * (1 - F.col("maf")), F.lit(1e-8)))
    return d.groupBy("trait").agg(
        F.count("*").alias("n"),
        F.round(F.regr_slope(y, x), 6).alias("slope"),
        F.round(F.regr_intercept(y, x), 6).alias("intercept"),
        F.round(F.regr_r2(y, x), 6).alias("r2"),
    )


def architecture_test(markers: DataFrame, *, weight_by_pip: bool = True, epsilon: float = 1e-12, min_pip: float | None = None) -> DataFrame:
    """trait, n, slope, se, t, p_value: :func:`architecture`'s slope against zero by Student's t.

    Null where there are fewer than five markers, or they share one heterozygosity.
    """
    d = markers.filter(F.col("pip") >= min_pip) if min_pip is not None else markers
    y = F.log(F.col("effect") * F.col("effect") * (F.col("pip") if weight_by_pip else F.lit(1.0)) + epsilon)
    x = F.log(F.greatest(2 * F.col("maf") * (1 - F.col("maf")), F.lit(1e-8)))
    a = d.groupBy("trait").agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy")
    )
    usable = (F.col("n") >= 5) & (F.col("sxx") > 0)
    df = F.col("n") - 2.0
    se = F.sqrt((F.col("syy") - F.col("slope") * F.col("sxy")) / df / F.col("sxx"))
    a = a.select("trait", "n", *[F.when(usable, c).alias(k) for k, c in (("slope", F.col("slope")), ("se", se))]).withColumn("t", F.col("slope") / F.col("se"))
    return a.withColumn("p_value", student_p_value(F.col("t"), F.col("n") - 2.0))


def component_stability(components: DataFrame, top: int = 20) -> tuple[DataFrame, DataFrame]:
    """How far chains agree on components (trait, chain, marker_idx, component, prob): a row for each trait, and its ``top`` least stable markers.

    A marker's range is that of its non-null probability over the chains; the mean absolute
    difference of two chains' probabilities over components and pairs of chains is its distance.
    """
    on = components.groupBy("trait", "chain", "marker_idx").agg(F.sum(F.when(F.col("component") > 0, F.col("prob")).otherwise(0.0)).alias("pip"))
    spread = on.groupBy("trait", "marker_idx").agg((F.max("pip") - F.min("pip")).alias("pip_range"), F.stddev_samp("pip").alias("pip_sd"), F.avg("pip").alias("pip_mean"))
    # The sum of |x - y| over pairs of sorted values is a weighted sum of them: no pairs are made.
    p = F.array_sort(F.collect_list("prob"))
    n = F.size("p")
    pairs = F.aggregate(F.transform("p", lambda x, k: x * (2 * k - n + 1)), F.lit(0.0), lambda s, x: s + x)
    apart = components.groupBy("trait", "marker_idx", "component").agg(p.alias("p")).withColumn("far", F.when(n > 1, 2 * pairs / (n * (n - 1))).otherwise(0.0))
    apart = apart.groupBy("trait", "marker_idx").agg(F.avg("far").alias("distance"))
    marker = spread.join(apart, ["trait", "marker_idx"])
    one = marker.groupBy("trait").agg(
        F.count("*").alias("m"), F.round(F.avg("distance"), 8).alias("mean_distance"), F.round(F.max("distance"), 8).alias("max_distance"),
        F.round(F.avg("pip_range"), 8).alias("mean_pip_range"), F.round(F.max("pip_range"), 8).alias("max_pip_range"),
    )
    w = Window.partitionBy("trait").orderBy(F.desc(F.round("pip_range", 8)), "marker_idx")
    worst = marker.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return one, worst.select("trait", "rank", "marker_idx", *[F.round(c, 8).alias(c) for c in ("pip_mean", "pip_range", "pip_sd", "distance")])


def fit_consistency(fit, markers: int) -> DataFrame:
    """check, ok, message of a fit's own rows: posterior, components, traces and their relations.

    Every check is one aggregate over the rows, whatever the fit's size.
    """
    c, nan = fit.controls, lambda x: x.isNull() | F.isnan(x)
    marker = fit.rows.filter("kind = 'marker'")
    wide = marker.groupBy("trait", "chain", "marker_idx").pivot("quantity", ["effect", "pip", "component_0", "state"]).agg(F.first("value"))
    total = marker.filter("quantity like 'component_%'").groupBy("trait", "chain", "marker_idx").agg(F.sum("value").alias("total"))
    per = wide.join(total, ["trait", "chain", "marker_idx"], "left").groupBy("trait", "chain").agg(
        F.count("*").alias("n"), F.min(~nan(F.col("effect"))).alias("finite"), F.min(F.col("pip").between(0, 1)).alias("range"),
        F.min(F.coalesce(F.abs(F.col("total") - 1) < 1e-8, F.lit(True))).alias("simplex"),
        F.min(F.coalesce(F.abs(1 - F.col("component_0") - F.col("pip")) < 1e-8, F.lit(True))).alias("pip_of_components"),
        F.min((F.col("pip") > 0) | (F.col("effect") == 0)).alias("null_effects"),
    )
    traces = fit.traces().groupBy("trait", "chain", "iteration").pivot("quantity", ["vb", "ve", "vg", "vle", "vld", "pi"]).agg(F.first("value"))
    traced = traces.groupBy("trait", "chain").agg(
        F.count("*").alias("iterations"), F.min((F.col("vb") > 0) & (F.col("ve") > 0)).alias("positive"), F.min(F.col("pi").between(0, 1)).alias("pi_range"),
        F.min(F.abs(F.col("vle") + F.col("vld") - F.col("vg")) <= 1e-8 * (1 + F.abs(F.col("vg")))).alias("parts"),
    )
    both = per.join(traced, ["trait", "chain"], "full").groupBy("trait").agg(
        F.min(F.col("n") == markers).alias("markers"), (F.count("*") == c.nchains).alias("chains"), F.min(F.col("iterations") == c.nburn + c.nit).alias("iterations"),
        *[F.min(F.coalesce(x, F.lit(False))).alias(x) for x in ("finite", "range", "simplex", "pip_of_components", "null_effects", "positive", "pi_range", "parts")],
    )
    names = {
        "markers": "a row for every marker", "chains": "every chain", "iterations": "a trace value for every iteration", "finite": "finite effects", "range": "PIPs between 0 and 1",
        "simplex": "component probabilities that add up to 1", "pip_of_components": "PIPs that are the non-null probability", "null_effects": "no effect without inclusion",
        "positive": "positive variances", "pi_range": "inclusion shares between 0 and 1", "parts": "genetic variance that is the sum of its parts",
    }
    all_ = both.agg(*[F.coalesce(F.min(F.coalesce(k, F.lit(False))), F.lit(False)).alias(k) for k in names])
    e = F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("ok"), F.when(F.col(k), "").otherwise(f"a fit has {v}").alias("message")) for k, v in names.items()])).alias("e")
    return all_.select(e).select("e.*")


def trace_states(traces: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, chain, half, n, mean, m2, first, last: what convergence needs of a trace, in one aggregate.

    Halves are those of each chain, without the middle draw of an odd one.  States of parts
    of a trace merge (see :func:`merge_states`), so a chain is never held whole.
    """
    length = traces.groupBy(*keys, "chain").agg(F.count("*").alias("len"), F.min("iteration").alias("from"))
    d = traces.join(length, [*keys, "chain"]).withColumn("k", F.col("iteration") - F.col("from"))
    h = F.floor(F.col("len") / 2)
    half = F.when(F.col("k") < h, 0).when(F.col("k") >= F.col("len") - h, 1)
    return d.withColumn("half", half).filter("half is not null").groupBy(*keys, "chain", "half").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value")).alias("m2"),
        F.min_by("value", "iteration").alias("first"), F.max_by("value", "iteration").alias("last"), F.min("iteration").alias("from"), F.max("iteration").alias("to"),
    )


def merge_states(states: DataFrame, keys: list[str]) -> DataFrame:
    """States of parts that follow each other as one: counts add up, means weigh, and squares gain what the means differ."""
    n = F.sum("n")
    mean = F.sum(F.col("n") * F.col("mean")) / n
    a = states.groupBy(*keys, "chain", "half").agg(
        n.alias("n"), mean.alias("mean"), F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")).alias("raw"),
        F.min_by("first", "from").alias("first"), F.max_by("last", "to").alias("last"), F.min("from").alias("from"), F.max("to").alias("to"),
    )
    return a.withColumn("m2", F.greatest(F.col("raw") - F.col("n") * F.col("mean") * F.col("mean"), F.lit(0.0))).drop("raw")


def extended_convergence(states: DataFrame, keys: list[str], rhat_limit: float = 1.01) -> DataFrame:
    """``keys``, chains, n, mean, sd, rhat, drift, status from the states of all halves.

    R-hat compares the halves of all chains; drift is the mean change from a chain's first
    half to its second over the pooled standard deviation.
    """
    w = F.col("m2") / (F.col("n") - 1)
    a = states.groupBy(*keys).agg(
        F.count_distinct("chain").alias("chains"), F.sum("n").alias("draws"), F.min("n").alias("n"), F.var_samp("mean").alias("b"), F.avg(w).alias("w"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"),
        (F.avg(F.when(F.col("half") == 1, F.col("mean"))) - F.avg(F.when(F.col("half") == 0, F.col("mean")))).alias("change"),
    )
    rhat = F.when(F.col("w") > 0, F.sqrt((F.col("b") * F.col("n") / F.col("w") + F.col("n") - 1) / F.col("n")))
    drift = F.when(F.col("w") > 0, F.col("change") / F.sqrt("w"))
    status = F.when(F.col("n") < 2, "too_short").when(F.col("w") == 0, "constant").when(rhat > rhat_limit, "not_converged").otherwise("converged")
    return a.select(*keys, "chains", F.col("draws").alias("n"), F.round("mean", 6).alias("mean"), F.round(F.sqrt("w"), 6).alias("sd"), F.round(rhat, 6).alias("rhat"), F.round(drift, 6).alias("drift"), status.alias("status"))


def consistency(posterior: DataFrame, markers: int) -> DataFrame:
    """check, ok, message of the structure of a fit's posterior table."""
    a = posterior.groupBy("trait").agg(
        F.count("*").alias("rows"),
        F.count_distinct("marker_idx").alias("ids"),
        F.min("pip").alias("low"),
        F.max("pip").alias("high"),
        F.count(F.when(F.col("effect").isNull() | F.isnan("effect"), 1)).alias("bad"),
    )
    checks = a.agg(
        F.min((F.col("rows") == markers) & (F.col("ids") == markers)).alias("markers"),
        F.min((F.col("low") >= 0) & (F.col("high") <= 1)).alias("pip_range"),
        F.min(F.col("bad") == 0).alias("finite_effects"),
    )
    return checks.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("check"), F.coalesce(F.col(c), F.lit(False)).alias("ok")) for c in ("markers", "pip_range", "finite_effects")])
        ).alias("c")
    ).select("c.check", "c.ok", F.when(F.col("c.ok"), "").otherwise(F.concat(F.lit("failed: "), "c.check")).alias("message"))
