"""The public functions, one for each task a user has.

Fits take tables (see ``operators.genotypes`` and ``operators.ld`` for their
columns) and return a ``Fit``; everything else takes and returns DataFrames.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectforge.operators import finemap as _finemap
from effectforge.operators import controls as _controls
from effectforge.operators import genotypes, ld, multitrait, priors, samplers, settests, simulate, summaries
from effectforge.operators.samplers import Fit, Model
from effectforge.sources import bed, csr

gsim, mtsim, mtsim_annotation = simulate.gsim, simulate.mtsim, simulate.mtsim_annotation
summarize_annotation_signal = simulate.annotation_signal
make_summary_stats, make_sparse_ld = genotypes.summary_stats, ld.ld_edges
summarise_components, summarise_architecture = summaries.component_summary, summaries.architecture
check_consistency, report_checks = summaries.consistency, _controls.report
estimate_set_covariances, estimate_annotation_variances, derive_marker_variances = settests.set_covariances, settests.annotation_variances, settests.marker_variances
estimate_memory, describe_operator, compare_operators = _controls.memory_estimate, _controls.operator_contract, _controls.reduction_policy
resolve_markers, resolve_effect_maf, validate_spec = _controls.resolve_markers, _controls.effect_maf, _controls.validate_spec
read_banded_ld, write_sparse_ld = csr.read_banded, csr.write_csr
make_alpha_init, marker_pi, marker_gamma_mean = priors.alpha_init, priors.marker_sticks, priors.sticks_gamma_mean

#: Component variances of the four-component mixture.
GAMMA = (0.0, 0.01, 0.1, 1.0)
METHODS = ("bayesc", "bayesr", "bayesrc")
ANNOTATION_MODELS = ("fixed_marker", "group", "learned_logistic", "annotation_probit_stick", "log_variance")


def _model(method: str, pi_init: float, annotations: np.ndarray | None, more: dict) -> Model:
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    if method == "bayesc":
        return Model(pi=(1 - pi_init, pi_init), **more)
    weights = [0.95, 0.04, 0.01]
    pi = (1 - pi_init, *(pi_init * w for w in weights))
    if method == "bayesr":
        return Model(gamma=GAMMA, pi=pi, **more)
    if annotations is None:
        raise ValueError("bayesrc needs annotations, the first column ones")
    extra = {"annotations": annotations, "alpha0": priors.alpha_init(list(GAMMA), pi_init, weights)} | more.pop("extra", {})
    return Model(gamma=GAMMA, pi=pi, policy="probit_stick", extra=extra, **more)


def read_bed(spark: SparkSession, path: str, n: int, **options) -> DataFrame:
    """marker_idx, dosages of a BED file."""
    bed.register(spark)
    return spark.read.format("plink_bed").options(n=n, **options).load(path)


def bed_panel(markers: DataFrame) -> DataFrame:
    """Sample-major rows of marker-major ones."""
    return genotypes.transposed(markers)


def read_sparse_ld(spark: SparkSession, prefix: str, one_based: bool = False) -> DataFrame:
    """i, j, r of CSR files."""
    csr.register(spark)
    return spark.read.format("ld_csr").option("one_based", str(one_based).lower()).load(prefix)


def bed_xtx_xty(spark: SparkSession, path: str, n: int, traits: DataFrame, scale: bool = True) -> DataFrame:
    """trait, marker_idx, wy, ww, yy, n of a BED file."""
    return genotypes.marker_major_stats(read_bed(spark, path, n), traits, scale)


def fit_bed(panel: DataFrame, traits: DataFrame, method: str = "bayesc", *, pi_init: float = 0.001, annotations: np.ndarray | None = None, controls: priors.ChainControls | None = None, **more) -> Fit:
    """Scalar-trait fit on genotypes."""
    return samplers.fit_genotypes(panel, traits, _model(method, pi_init, annotations, {"adj_e": 0.0} | more), controls or priors.ChainControls())


def fit_csr(stats: DataFrame, edges: DataFrame, method: str = "bayesc", *, pi_init: float = 0.001, annotations: np.ndarray | None = None, controls: priors.ChainControls | None = None, **more) -> Fit:
    """Scalar-trait fit on summary statistics and sparse LD."""
    return samplers.fit_summary(stats, edges, _model(method, pi_init, annotations, more), controls or priors.ChainControls())


def fit_csr_annotated(stats: DataFrame, edges: DataFrame, annotation_model: str, values, *, pi_init: float = 0.001, controls: priors.ChainControls | None = None, **more) -> Fit:
    """The five annotation policies; ``values`` is what the policy needs by marker.

    fixed_marker: inclusion probabilities, or (pi, multiplier); group: group
    numbers; the others: an annotation matrix.
    """
    if annotation_model not in ANNOTATION_MODELS:
        raise ValueError(f"annotation_model is one of {ANNOTATION_MODELS}")
    if annotation_model == "annotation_probit_stick":
        return fit_csr(stats, edges, "bayesrc", pi_init=pi_init, annotations=np.asarray(values), controls=controls, **more)
    if annotation_model == "fixed_marker":
        pi, mult = values if isinstance(values, tuple) else (values, None)
        extra = {"marker_pi": np.asarray(pi)} | ({} if mult is None else {"multiplier": np.asarray(mult)})
    else:
        extra = {"group" if annotation_model == "group" else "annotations": np.asarray(values)}
    model = Model(pi=(1 - pi_init, pi_init), policy=annotation_model, extra=extra | more.pop("extra", {}), **more)
    return samplers.fit_summary(stats, edges, model, controls or priors.ChainControls())


def fit_block_eigen(stats: DataFrame, edges: DataFrame, method: str = "bayesc", *, block_size: int = 256, eigen_prop: float = 0.995, block_filter: str | None = None, pi_init: float = 0.001, annotations: np.ndarray | None = None, controls: priors.ChainControls | None = None, **more) -> Fit:
    """Scalar-trait fit on low-rank LD blocks, or on dense ones through a filter (hard_truncate, ridge_fixed, ridge_lw).

    ``block_policy`` and ``block_mode`` say how low-rank blocks draw residual variances.
    """
    model = _model(method, pi_init, annotations, more)
    model.extra["eigen_prop"] = eigen_prop
    return samplers.fit_summary(stats, edges, model, controls or priors.ChainControls(), block_filter or "low_rank", block_size)


fit_joint_bed, fit_joint_providers = multitrait.fit_joint_genotypes, multitrait.fit_providers


def fit_joint_csr(stats: DataFrame, edges: DataFrame, controls: priors.ChainControls, **more) -> DataFrame:
    """Joint fit of traits that have all markers and the same LD; :func:`fit_joint_providers` takes markers and LD by provider."""
    return multitrait.fit_providers(*multitrait.same_ld(stats, edges), controls, **more)


def annotation_pi(alpha: dict[str, list[float]]) -> dict[str, list[float]]:
    """Stick-breaking component probabilities of each annotation alone."""
    phi = NormalDist().cdf
    out = {}
    for name, etas in alpha.items():
        left, probs = 1.0, []
        for eta in etas:
            p = min(max(phi(eta), 1e-12), 1 - 1e-12)
            probs.append(left * (1 - p))
            left *= p
        out[name] = [*probs, left]
    return out


def annotation_gamma_mean(alpha: dict[str, list[float]], gamma: tuple[float, ...] = GAMMA) -> dict[str, float]:
    """Expected variance multiplier of each annotation alone."""
    return {k: float(np.dot(v, gamma)) for k, v in annotation_pi(alpha).items()}


def make_credible_sets(fit: Fit, markers: DataFrame, edges: DataFrame, *, trait: str, sets: DataFrame | None = None, locus_pip_cutoff: float = 0.01, max_locus_distance: float = 1e6, **params) -> DataFrame:
    """Credible sets over automatic loci, or given (locus, marker_idx) sets."""
    pips = fit.posterior().filter(F.col("trait") == trait).select("marker_idx", "pip")
    if sets is None:
        loci = _finemap.define_loci(pips, markers, locus_pip_cutoff=locus_pip_cutoff, max_locus_distance=max_locus_distance)
        sets = loci.select("locus", F.explode("members").alias("marker_idx"))
    regions = sets.distinct().select(F.col("locus").alias("region"), "marker_idx")
    return _finemap.credible_sets(pips, regions, ld.region(edges, regions), **params)


make_credible_sets_from_ld = _finemap.credible_sets


def make_multisignal_credible_sets_from_ld(pips: DataFrame, regions: DataFrame, ld_pairs: DataFrame, **params) -> DataFrame:
    """Greedy multi-signal sets; the set that was found is removed, not its LD neighbourhood."""
    return _finemap.credible_sets(pips, regions, ld_pairs, **({"multi": True, "remove": "credible_set"} | params))


def extract_loci(fit: Fit, sets: DataFrame, markers: DataFrame, trait: str) -> DataFrame:
    """Locus table of a global fit, without refits."""
    pips = fit.posterior().filter(F.col("trait") == trait).select("marker_idx", "pip")
    where = _finemap.loci_from_sets(sets, pips, markers).drop("lead", "lead_pip")
    return _finemap.locus_table(sets.distinct(), pips).join(where, "locus")


def local_statistics(stats: DataFrame, edges: DataFrame, loci: DataFrame, effects: DataFrame | None = None, scale: str = "cross_product") -> DataFrame:
    """locus, marker_idx, wy, ww, yy, n of the loci's markers; with global effects wy less what those of the markers outside the locus explain."""
    one = stats.select("marker_idx", "wy", "ww", "yy", "n")
    if effects is not None:
        b = effects.select(F.col("marker_idx").alias("j"), F.col("effect").alias("b"))
        pairs = ld.cross_products(edges, one) if scale == "cross_product" else ld.symmetric(edges).withColumnRenamed("r", "xtx")
        inside = loci.select("locus", F.col("marker_idx").alias("j"), F.lit(1).alias("inside"))
        outer = loci.join(pairs.withColumnRenamed("i", "marker_idx"), "marker_idx").join(inside, ["locus", "j"], "left").filter("inside is null").join(b, "j")
        moved = outer.groupBy("locus", "marker_idx").agg(F.sum(F.col("xtx") * F.col("b")).alias("moved"))
        local = loci.join(one, "marker_idx").join(moved, ["locus", "marker_idx"], "left")
        return local.withColumn("wy", F.col("wy") - F.coalesce("moved", F.lit(0.0))).drop("moved")
    return loci.join(one, "marker_idx")


def finemap(stats: DataFrame, edges: DataFrame, sets: DataFrame, *, vb: float, ve: float, pi: float, effects: DataFrame | None = None, nruns: int = 8, seed: int = 1, nit: int = 2000, nburn: int = 200, scale: str = "cross_product") -> DataFrame:
    """Refit every locus ``nruns`` times with fixed variances and pi; PIPs and effects over runs.

    With global ``effects`` (marker_idx, effect) scores are residualised for the
    markers outside the locus: in cross-product units, or, with ``scale``
    "correlation", by R b alone.
    """
    loci = sets.distinct()
    local = local_statistics(stats, edges, loci, effects, scale)
    region = ld.region(edges, loci.select(F.col("locus").alias("region"), "marker_idx")).filter("i < j")
    runs = F.explode(F.sequence(F.lit(0), F.lit(nruns - 1)))
    left, right = local.withColumn("run", runs), region.withColumn("of_run", runs)
    controls = priors.ChainControls(nit=nit, nburn=nburn, seed=seed)
    model = Model(pi=(1 - pi, pi), vb=vb, ve=ve, update_vb=False, update_ve=False, update_pi=False, adj_e=0.0)

    def task(key: tuple, s: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        s = s.sort_values("marker_idx").reset_index(drop=True)
        at = {m: k for k, m in enumerate(s["marker_idx"])}
        i, j = (e[c].map(at).to_numpy(int) if len(e) else np.zeros(0, int) for c in ("i", "j"))
        op = samplers.CsrOperator(s["wy"].to_numpy(float), s["ww"].to_numpy(float), i, j, e["r"].to_numpy(float))
        out = samplers.sample(op, float(s["yy"].iloc[0]), float(s["n"].iloc[0]), model, controls, priors.task_seed(controls, "finemap", str(key[0]), int(key[1])))
        return pd.DataFrame({"locus": s["locus"], "run": key[1], "marker_idx": s["marker_idx"], "pip": out["pip"], "effect": out["effect"]})

    kind = dict(sets.dtypes)["locus"]
    rows = left.groupBy("locus", "run").cogroup(right.groupBy("region", "of_run")).applyInPandas(task, f"locus {kind}, run int, marker_idx int, pip double, effect double")
    return _finemap.aggregate_runs(rows)


def finemap_fit(fit: Fit, stats: DataFrame, edges: DataFrame, sets: DataFrame, *, trait: str, overrides: dict[str, float] | None = None, **more) -> DataFrame:
    """:func:`finemap` with the variances and pi of a global fit: given ones, else its traces' means after burn-in."""
    traces = fit.traces().filter(F.col("trait") == trait)
    values = {}
    for quantity in ("vb", "ve", "pi"):
        given = None if quantity not in (overrides or {}) else {trait: overrides[quantity]}
        values[quantity] = float(_finemap.global_parameter(traces, quantity, fit.controls.nburn, given).first()["value"])
    return finemap(stats.filter(F.col("trait") == trait), edges, sets, **values, **more)


def extract_posterior(fit: Fit, quantity: str, *, markers: list[int] | None = None, traits: list[str] | None = None, chains: list[int] | None = None) -> DataFrame:
    """A stored quantity of a fit, selected on its axes; an unknown one is an error."""
    known = set(samplers.TRACES) | {"effect", "pip", "state", "final_effect"} | {f"component_{k}" for k in range(len(GAMMA))}
    # Selected markers, components and annotations have traces by number, where the model asks for them.
    if quantity not in known and quantity.split(":")[0] not in ("effect", "inclusion", "component", "probability", "annotation"):
        raise ValueError(f"quantity is one of {sorted(known)}, or a trace such as effect:7")
    d = fit.rows.filter(F.col("quantity") == quantity)
    for column, chosen in (("marker_idx", markers), ("trait", traits), ("chain", chains)):
        if chosen is not None:
            d = d.filter(F.col(column).isin(list(chosen)))
    return d.drop("quantity", "kind")


def extract_diagnostics(fit: Fit) -> dict[str, object]:
    """Convergence table, its overview and warnings, convergence from compact states of all traces, execution controls and provenance."""
    table = summaries.convergence(fit.traces(), ["trait", "quantity"], fit.controls.nburn)
    over = summaries.overview(table.withColumn("name", F.concat_ws(":", "trait", "quantity")), "name")
    kept = fit.traces().filter(F.col("iteration") > fit.controls.nburn)
    extended = summaries.extended_convergence(summaries.trace_states(kept, ["trait", "quantity"]), ["trait", "quantity"])
    return {"convergence": table, "overview": over, "extended": extended, "execution": fit.controls, "provenance": fit.provenance}


def summarise_posterior(fit: Fit, prob: float = 0.95, nburn: int | None = None, derived: bool = True) -> DataFrame:
    """Mean, sd, median, interval, shortest interval and lag-1 correlation of each trace of each trait.

    ``derived`` adds h2, the genetic share of the variance in every draw.
    """
    burn, t = fit.controls.nburn if nburn is None else nburn, fit.traces()
    if derived:
        two = t.filter("quantity in ('vg', 've')").groupBy("trait", "chain", "iteration").pivot("quantity", ["vg", "ve"]).agg(F.first("value"))
        t = t.unionByName(two.select("trait", "chain", "iteration", F.lit("h2").alias("quantity"), (F.col("vg") / (F.col("vg") + F.col("ve"))).alias("value")))
    keys, kept = ["trait", "quantity"], t.filter(F.col("iteration") > burn)
    short = summaries.hpd(kept, keys, prob).withColumnsRenamed({"lower": "hpd_lower", "upper": "hpd_upper"})
    lag = summaries.lag_correlation(kept, [*keys, "chain"]).groupBy(*keys).agg(F.round(F.avg("lag1"), 6).alias("lag1"))
    return summaries.trace_summary(kept, keys, prob).join(short, keys, "left").join(lag, keys, "left")


def plot_data(summary: DataFrame, parameters: list[str] | None = None, traits: list[str] | None = None) -> DataFrame:
    """The rows of a posterior summary that a plot would show."""
    d = summary.filter(F.col("quantity").isin(parameters)) if parameters else summary
    return d.filter(F.col("trait").isin(traits)) if traits else d


def joint_block_eigen(edges: DataFrame, stats: DataFrame, block_size: int = 256, eigen_prop: float = 0.995) -> DataFrame:
    """LD edges as their low-rank blocks reconstruct them: i, j, r for the joint CSR fit.

    Blocks are independent tasks; correlations across blocks are left out.
    """
    inside = edges.filter(F.floor(F.col("i") / block_size) == F.floor(F.col("j") / block_size))

    def task(part: pd.DataFrame) -> pd.DataFrame:
        start = int(part["i"].iloc[0]) // block_size * block_size
        size = int(part["j"].max()) - start + 1
        corr = np.eye(size)
        i, j = part["i"].to_numpy(int) - start, part["j"].to_numpy(int) - start
        corr[i, j] = corr[j, i] = part["r"].to_numpy(float)
        q, _ = samplers.low_rank_block(corr, np.zeros(size), np.ones(size), eigen_prop)
        a, (x, y) = q.T @ q, np.triu_indices(size, 1)
        d = np.sqrt(np.diag(a))
        return pd.DataFrame({"i": x + start, "j": y + start, "r": a[x, y] / (d[x] * d[y])}).astype({"i": "int32", "j": "int32"})

    return inside.groupBy(F.floor(F.col("i") / block_size)).applyInPandas(task, "i int, j int, r double")


def fit_joint_block_eigen(stats: DataFrame, edges: DataFrame, controls: priors.ChainControls, *, block_size: int = 256, eigen_prop: float = 0.995, **more) -> DataFrame:
    """Joint fit of traits on LD blocks of reduced rank."""
    return fit_joint_csr(stats, joint_block_eigen(edges, stats, block_size, eigen_prop), controls, **more)


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "NormalDist", "DataFrame", "SparkSession", "F", "np", "pd")]
