"""Prior calibration, annotation priors, seeds, chains and retention."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from effectforge.functions.expressions import logistic, stick_probabilities

_M64 = (1 << 64) - 1


@dataclass(frozen=True)
class ChainControls:
    """Iterations, thinning, seed and chains of a fit; checked when made."""

    nit: int = 1000
    nburn: int = 500
    nthin: int = 1
    seed: int = 1
    nchains: int = 1
    chain_seeds: tuple[int, ...] | None = None

    def __post_init__(self) -> None:
        if self.nit < 1 or self.nburn < 0 or self.nthin < 1 or self.nchains < 1:
            raise ValueError("nit, nthin and nchains are at least 1, nburn at least 0")
        if not 0 <= self.seed < 1 << 32:
            raise ValueError("seed is in [0, 2^32)")
        if self.chain_seeds is not None and len(self.chain_seeds) != self.nchains:
            raise ValueError("chain_seeds names a seed for each chain")

    def retained(self) -> list[int]:
        """Sampling iterations (1-based, after burn-in) that are kept."""
        return [k for k in range(1, self.nit + 1) if k % self.nthin == 0]


def _scramble(x: int) -> int:
    """The splitmix64 output function."""
    x = (x + 0x9E3779B97F4A7C15) & _M64
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _M64
    return x ^ (x >> 31)


def fnv1a(text: str) -> int:
    """64-bit FNV-1a of the UTF-8 bytes."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = ((h ^ b) * 0x100000001B3) & _M64
    return h


def task_seed(controls: ChainControls, mode: str, trait: str, chain: int) -> int:
    """A 32-bit seed for one task, from the user's seed and the task's identity."""
    if controls.chain_seeds is not None:
        return controls.chain_seeds[chain]
    state = _scramble(controls.seed)
    for part in (fnv1a(mode), fnv1a(trait), chain + 1):
        state = _scramble(state ^ part)
    return (state ^ (state >> 32)) & 0xFFFFFFFF


def calibrate_prior(vy: float, h2: float, weight: float, nub: float = 4.0, nue: float = 4.0) -> dict[str, float]:
    """vb, ve and the scales of their inverse chi-square priors for a heritability.

    ``weight`` is the sum over markers of inclusion probability times expected
    variance multiplier.
    """
    vb, ve = vy * h2 / weight, vy * (1 - h2)
    return {"vb": vb, "ve": ve, "ssb_prior": (nub - 2) / nub * vb, "sse_prior": (nue - 2) / nue * ve}


def pi_prior(mean: float = 0.001, strength: float = 5e5) -> tuple[float, float]:
    """Beta shapes of the inclusion probability."""
    return mean * strength, (1 - mean) * strength


def maf_scale(maf: Column, s: float) -> Column:
    """Prior variance multiplier h^(s + 1), h = 2p(1-p) but 1e-8 at least."""
    return F.pow(F.greatest(2 * maf * (1 - maf), F.lit(1e-8)), s + 1)


def fixed_marker_prior(
    annotations: DataFrame,
    beta_pi: dict[str, float],
    beta_vb: dict[str, float],
    *,
    pi_base: float = 0.001,
    pi_min: float = 1e-8,
    pi_max: float = 0.05,
    vb_min: float = 0.25,
    vb_max: float = 4.0,
) -> DataFrame:
    """marker_idx, pi, vb_multiplier from (marker_idx, annotation, value) and coefficients.

    Both linear predictors are centred over markers, then clipped.
    """
    weight = lambda b: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in b.items() for x in kv]), F.col("annotation")), F.lit(0.0)) if b else F.lit(0.0)
    eta = annotations.groupBy("marker_idx").agg(
        F.sum(F.col("value") * weight(beta_pi)).alias("a"), F.sum(F.col("value") * weight(beta_vb)).alias("v")
    )
    mean = eta.agg(F.avg("a").alias("ma"), F.avg("v").alias("mv"))
    base = float(np.log(pi_base / (1 - pi_base)))
    d = eta.crossJoin(F.broadcast(mean))
    pi = logistic(base + F.col("a") - F.col("ma"))
    vb = F.exp(F.col("v") - F.col("mv"))
    clip = lambda x, a, b: F.least(F.greatest(x, F.lit(a)), F.lit(b))
    return d.select("marker_idx", F.round(clip(pi, pi_min, pi_max), 10).alias("pi"), F.round(clip(vb, vb_min, vb_max), 10).alias("vb_multiplier"))


def marker_sticks(annotations: DataFrame, alpha: dict[str, list[float]]) -> DataFrame:
    """marker_idx, component, pi from annotations and stick coefficients by annotation."""
    sticks = len(next(iter(alpha.values())))
    table = F.create_map(*[x for a, v in alpha.items() for x in (F.lit(a), F.array(*[F.lit(float(c)) for c in v]))])
    d = annotations.withColumn("c", F.try_element_at(table, F.col("annotation"))).filter("c is not null")
    etas = d.groupBy("marker_idx").agg(*[F.sum(F.col("value") * F.col("c")[k]).alias(f"e{k}") for k in range(sticks)])
    probs = stick_probabilities([F.col(f"e{k}") for k in range(sticks)])
    return etas.select("marker_idx", F.posexplode(F.array(*probs)).alias("component", "pi"))


def sticks_gamma_mean(probabilities: DataFrame, gamma: list[float], key: str = "marker_idx") -> DataFrame:
    """Expected variance multiplier of each marker or annotation."""
    g = F.array(*[F.lit(float(x)) for x in gamma])
    return probabilities.groupBy(key).agg(F.sum(F.col("pi") * F.element_at(g, F.col("component") + 1)).alias("gamma_mean"))


def alpha_init(gamma: list[float], pi_init: float = 0.001, weights: list[float] | None = None) -> list[float]:
    """Stick intercepts that reproduce a mixture with ``pi_init`` outside the null."""
    from statistics import NormalDist

    active = np.array(weights or [1.0] * (len(gamma) - 1), float)
    pi = np.concatenate([[1 - pi_init], pi_init * active / active.sum()])
    tail = 1 - np.concatenate([[0.0], np.cumsum(pi)[:-1]])
    going = np.clip(1 - pi[:-1] / tail[:-1], 1e-12, 1 - 1e-12)
    return [NormalDist().inv_cdf(float(p)) for p in going]


def annotation_matrix(annotations: DataFrame, standardize: bool = True) -> DataFrame:
    """(marker_idx, annotation, value) with continuous columns as z-scores; binary ones stay.

    Constant columns and nulls are refused.
    """
    s = annotations.groupBy("annotation").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.max(F.when(F.col("value").isin(0.0, 1.0), 0).otherwise(1)).alias("continuous"),
        F.count(F.when(F.col("value").isNull(), 1)).alias("missing"),
    )
    bad = [r["annotation"] for r in s.filter("missing > 0 or coalesce(sd, 0) = 0").select("annotation").take(5)]
    if bad:
        raise ValueError(f"annotations without variation or with nulls: {bad}")
    z = F.when((F.col("continuous") == 1) & F.lit(standardize), (F.col("value") - F.col("mean")) / F.col("sd")).otherwise(F.col("value"))
    return annotations.join(F.broadcast(s), "annotation").select("marker_idx", "annotation", z.alias("value"))


def align_annotations(annotations: DataFrame, markers: DataFrame, *, add_intercept: bool = True, standardize: bool = True, center_binary: bool = False) -> DataFrame:
    """marker_idx, a: the annotations (marker_id, annotation, value) of the fitted markers (marker_idx, marker_id), by name and in one order.

    Annotations go by name, the intercept first; continuous ones are z-scores over the fitted
    markers, binary ones stay or are centred.  Rows of other markers are left out.  An empty, null or
    repeated name on either side, a marker without one of the annotations, and one without
    variation among the fitted markers are errors.
    """
    empty = F.col("marker_id").isNull() | (F.col("marker_id") == "")
    for d, keys, what in ((markers, ["marker_id"], "fitted markers"), (annotations, ["marker_id", "annotation"], "annotations")):
        bad = d.groupBy(*keys).agg(F.count("*").alias("n")).filter(empty | (F.col("n") > 1)).take(5)
        if bad:
            raise ValueError(f"names of {what} are given once each: {[r['marker_id'] for r in bad]}")
    d = annotations.join(markers.select("marker_idx", "marker_id"), "marker_id").select("marker_idx", "annotation", F.col("value").cast("double").alias("value"))
    names = sorted(r[0] for r in annotations.select("annotation").distinct().collect())
    held = d.filter("value is not null").groupBy("marker_idx").agg(F.count("*").alias("n"))
    short = markers.join(held, "marker_idx", "left").filter(F.coalesce("n", F.lit(0)) < len(names)).select("marker_id").take(5)
    if short:
        raise ValueError(f"markers without an annotation: {[r[0] for r in short]}")
    s = d.groupBy("annotation").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.max(F.when(F.col("value").isin(0.0, 1.0), 0).otherwise(1)).alias("continuous"))
    flat = [r[0] for r in s.filter("coalesce(sd, 0) = 0").select("annotation").take(5)]
    if flat:
        raise ValueError(f"annotations without variation among the fitted markers: {flat}")
    z = F.when((F.col("continuous") == 1) & F.lit(standardize), (F.col("value") - F.col("mean")) / F.col("sd"))
    z = z.when((F.col("continuous") == 0) & F.lit(center_binary), F.col("value") - F.col("mean")).otherwise(F.col("value"))
    rows = d.join(F.broadcast(s), "annotation").groupBy("marker_idx").agg(F.array_sort(F.collect_list(F.struct("annotation", z.alias("z")))).alias("e"))
    one = F.array(F.lit(1.0)) if add_intercept else F.array().cast("array<double>")
    return rows.select("marker_idx", F.concat(one, F.col("e.z")).alias("a"))


def intercepts(gamma: list[float], pi: list[float], form: str = "calibrated", variance: float = 1.0) -> tuple[list[float], list[float]]:
    """Mean and precision of the stick intercepts' prior, in one of its forms.

    calibrated is centred where the sticks give ``pi``; standard at zero; flat has no precision.
    """
    if len(pi) != len(gamma) or abs(sum(pi) - 1) > 1e-8 or variance <= 0:
        raise ValueError("a probability for each component, and a positive variance")
    sticks = len(gamma) - 1
    if form == "calibrated":
        return alpha_init(gamma, 1 - pi[0], list(pi[1:])), [1 / variance] * sticks
    if form in ("standard", "flat"):
        return [0.0] * sticks, [1 / variance if form == "standard" else 0.0] * sticks
    raise ValueError("form is calibrated, standard or flat")


def centred_annotations(annotations: DataFrame) -> DataFrame:
    """(marker_idx, annotation, value) for log-variance models: all centred, continuous ones scaled too.

    A null, a constant (an intercept above all) or columns that determine each other are
    refused; annotations are few, so their cross products are looked at on the driver.
    """
    s = annotations.groupBy("annotation").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.max(F.when(F.col("value").isin(0.0, 1.0), 0).otherwise(1)).alias("continuous"),
        F.count(F.when(F.col("value").isNull() | F.isnan("value"), 1)).alias("missing"),
    )
    bad = [r["annotation"] for r in s.filter("missing > 0 or coalesce(sd, 0) = 0").select("annotation").take(5)]
    if bad:
        raise ValueError(f"annotations that are constant or have nulls: {bad}")
    scale = F.when(F.col("continuous") == 1, F.col("sd")).otherwise(1.0)
    d = annotations.join(F.broadcast(s), "annotation").select("marker_idx", "annotation", ((F.col("value") - F.col("mean")) / scale).alias("value"))
    two = d.join(d.select("marker_idx", F.col("annotation").alias("other"), F.col("value").alias("value2")), "marker_idx")
    cross = two.groupBy("annotation", "other").agg(F.sum(F.col("value") * F.col("value2")).alias("x")).toPandas()
    table = cross.pivot(index="annotation", columns="other", values="x").to_numpy(float)
    unit = np.sqrt(np.diag(table))
    if np.linalg.matrix_rank(np.nan_to_num(table) / np.outer(unit, unit), tol=1e-8, hermitian=True) < len(table):
        raise ValueError("annotations determine each other")
    return d


def group_index(labels: DataFrame, declared: list[str] | None = None) -> DataFrame:
    """marker_idx, group: labels (marker_idx, label) as numbers from 0, as declared or in the order in which they first come.

    A null label, one that is not declared, or a declared group without markers is an error.
    """
    firsts = labels.groupBy("label").agg(F.min("marker_idx").alias("first"))
    found = [r["label"] for r in firsts.orderBy("first").collect()]
    names = declared or found
    if None in found or set(found) != set(names) or len(set(names)) != len(names):
        raise ValueError(f"labels {found} are not the groups {names}, each with a marker")
    table = labels.sparkSession.createDataFrame([(n, k) for k, n in enumerate(names)], "label string, `group` int")
    return labels.join(F.broadcast(table), "label").select("marker_idx", "group")


def group_variance_means(groups: DataFrame, multipliers: DataFrame) -> DataFrame:
    """group, multiplier: group multipliers (group, multiplier) scaled to a mean of 1 over markers (marker_idx, group)."""
    size = groups.groupBy("group").agg(F.count("*").alias("size"))
    d = size.join(F.broadcast(multipliers), "group")
    mean = d.agg((F.sum(F.col("multiplier") * F.col("size")) / F.sum("size")).alias("mean"))
    return d.crossJoin(F.broadcast(mean)).select("group", F.round(F.col("multiplier") / F.col("mean"), 10).alias("multiplier"))


def sticks_of_components(components: DataFrame) -> DataFrame:
    """key, stick, p: the probability to go on beyond each component but the last, from (key, component, prob).

    What is left beyond a component over what is left from it on; 0.5 where nothing is.
    """
    back = Window.partitionBy("key").orderBy(F.col("component").desc())
    left = F.sum("prob").over(back.rowsBetween(Window.unboundedPreceding, 0))
    beyond = F.sum("prob").over(back.rowsBetween(Window.unboundedPreceding, -1))
    p = F.when(F.col("left") > 0, F.col("beyond") / F.col("left")).otherwise(0.5)
    eps = 2.220446049250313e-16
    return (
        components.withColumn("left", left)
        .withColumn("beyond", beyond)
        .filter("beyond is not null")
        .select("key", F.col("component").alias("stick"), F.round(F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps)), 10).alias("p"))
    )


def calibrate_joint(traits: DataFrame, states: DataFrame, h2: float, markers: int, nub: float = 4.0, nue: float = 4.0) -> DataFrame:
    """trait, weight, vb, ve, ssb_prior, sse_prior of a joint model, from (trait, vy) and (state, trait, active, prob, gamma).

    A trait's weight is the markers' expected variance multiplier: probability times
    scale over the states in which it is active.  One without any weight is an error.
    """
    w = states.filter("active").groupBy("trait").agg((F.sum(F.col("prob") * F.col("gamma")) * markers).alias("weight"))
    d = traits.join(w, "trait", "left")
    none = [r["trait"] for r in d.filter("coalesce(weight, 0) <= 0").select("trait").take(5)]
    if none:
        raise ValueError(f"traits without prior weight: {none}")
    target, ve = F.col("vy") * h2, F.col("vy") * (1 - h2)
    return d.select(
        "trait",
        F.round("weight", 8).alias("weight"),
        F.round(target / F.col("weight"), 10).alias("vb"),
        F.round(ve, 10).alias("ve"),
        F.round((nub - 2) / nub * target / F.col("weight"), 10).alias("ssb_prior"),
        F.round((nue - 2) / nue * ve, 10).alias("sse_prior"),
    )


def enriched_priors(annotations: DataFrame, traits: list[str], enriched: dict[str, tuple[float, float]], *, only: list[str] | None = None, base_pi: float = 0.001, **clips) -> DataFrame:
    """trait, marker_idx, pi, vb_multiplier where ``enriched`` annotations multiply the odds and the variance.

    ``enriched`` gives (multiplier of pi, multiplier of vb) by annotation, for the traits
    in ``only`` or all; the others keep the base.
    """
    hit = fixed_marker_prior(annotations, {k: float(np.log(v[0])) for k, v in enriched.items()}, {k: float(np.log(v[1])) for k, v in enriched.items()}, pi_base=base_pi, **clips)
    none = fixed_marker_prior(annotations, {}, {}, pi_base=base_pi, **clips)
    parts = [(hit if only is None or t in only else none).withColumn("trait", F.lit(t)) for t in traits]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("trait", "marker_idx", "pi", "vb_multiplier")
