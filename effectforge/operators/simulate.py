"""Simulators of genotypes, effects and phenotypes.

Genotypes are generated where they live: each row of ``spark.range`` seeds its
own generator, so the panel does not depend on partitioning.  Effects are a
vector of one number a marker, drawn once on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectforge.operators.genotypes import allele_freq

from effectforge.functions.expressions import logistic

#: Mixtures of the named architectures (probabilities, variances).
ARCHITECTURES = {
    "bayesc": ((0.99, 0.01), (0.0, 1.0)),
    "bayesr": ((0.95, 0.03, 0.015, 0.005), (0.0, 0.01, 0.1, 1.0)),
    "major_polygenic": ((0.9, 0.099, 0.001), (0.0, 0.01, 1.0)),
    "maf_dependent": ((0.99, 0.01), (0.0, 1.0)),
    "clustered": ((0.99, 0.01), (0.0, 1.0)),
    "fixed": ((0.99, 0.01), (0.0, 1.0)),
}


@dataclass
class Simulation:
    """A panel, its phenotypes and the truth behind them."""

    panel: DataFrame
    phenotypes: DataFrame
    effects: np.ndarray
    component: np.ndarray
    maf: np.ndarray

    def __repr__(self) -> str:
        return f"Simulation({len(self.effects)} markers, {self.effects.shape[1]} traits, {int((self.component > 0).sum())} causal)"


def panel(spark: SparkSession, n: int, maf: np.ndarray, seed: int) -> DataFrame:
    """sample_idx, dosages drawn from Binomial(2, maf), a generator for each sample."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            rows = [np.random.default_rng((seed, i)).binomial(2, maf).astype(np.int32) for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(rows), pa.list_(pa.int32()))], names=["sample_idx", "dosages"])

    return spark.range(n).mapInArrow(draw, "sample_idx bigint, dosages array<int>")


def draw_effects(
    rng: np.random.Generator,
    maf: np.ndarray,
    architecture: str,
    nt: int,
    rg: float,
    n_causal: int | None = None,
    maf_exponent: float = -0.5,
    weights: np.ndarray | None = None,
    blocks: np.ndarray | None = None,
    enrichment: float = 20.0,
) -> tuple[np.ndarray, np.ndarray]:
    """Effects (marker by trait) and the mixture component of each marker."""
    pi, variance = (np.array(x) for x in ARCHITECTURES[architecture])
    m = len(maf)
    active = np.tile(1 - pi[0], m)
    if architecture == "clustered":
        blocks = np.arange(m) // max(1, m // 20) if blocks is None else blocks
        names = np.unique(blocks)
        hot = rng.choice(names, max(1, len(names) // 10), replace=False)
        odds = active / (1 - active) * np.where(np.isin(blocks, hot), enrichment, 1.0)
        active = odds / (1 + odds)
    if weights is not None:
        odds = active / (1 - active) * weights
        active = odds / (1 + odds)
    if n_causal is None:
        on = rng.random(m) < active
    else:
        on = np.zeros(m, bool)
        on[rng.choice(m, n_causal, replace=False, p=active / active.sum())] = True
    component = np.where(on, rng.choice(np.arange(1, len(pi)), m, p=pi[1:] / pi[1:].sum()), 0)
    root = np.linalg.cholesky(np.full((nt, nt), rg) + (1 - rg) * np.eye(nt))
    scale = np.sqrt(variance[component])
    if architecture == "maf_dependent":
        h = np.maximum(2 * maf * (1 - maf), 1e-8) ** maf_exponent
        scale = scale * h / np.sqrt(np.mean(h**2))
    return scale[:, None] * (rng.standard_normal((m, nt)) @ root.T), component


def phenotypes(panel_: DataFrame, maf: np.ndarray, effects: np.ndarray, h2: float, re: float, seed: int) -> DataFrame:
    """sample_idx, trait, y, g, e with variance 1 of g over the whole panel and (1-h2)/h2 of e."""
    nt, sd = effects.shape[1], np.sqrt(2 * maf * (1 - maf))
    coded = np.where(sd[:, None] > 0, effects / np.where(sd > 0, sd, 1)[:, None], 0.0)
    root = np.linalg.cholesky(np.full((nt, nt), re) + (1 - re) * np.eye(nt)) * np.sqrt((1 - h2) / h2)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            if not ids:
                continue
            g = np.asarray(b.column(1).flatten()).reshape(len(ids), -1) - 2 * maf
            value = g @ coded
            noise = np.array([root @ np.random.default_rng((seed, 1, i)).standard_normal(nt) for i in ids])
            names = [f"T{t + 1}" for t in range(nt)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, nt)), pa.array(names * len(ids)), pa.array(value.ravel()), pa.array(noise.ravel())],
                names=["sample_idx", "trait", "g", "e"],
            )

    d = panel_.mapInArrow(score, "sample_idx bigint, trait string, g double, e double")
    s = d.groupBy("trait").agg(F.avg("g").alias("mean"), F.stddev_samp("g").alias("sd"))
    g = F.when(F.col("sd") > 0, (F.col("g") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    return d.join(F.broadcast(s), "trait").select("sample_idx", "trait", (g + F.col("e")).alias("y"), g.alias("g"), "e")


def gsim(spark: SparkSession, *, n: int = 1000, m: int = 1000, nt: int = 1, architecture: str = "bayesc", h2: float = 0.5, rg: float = 0.0, re: float = 0.0, n_causal: int | None = None, beta: np.ndarray | None = None, maf_min: float = 0.05, maf_max: float = 0.5, seed: int = 1, **effects) -> Simulation:
    """Genotypes and phenotypes of one of the architectures; ``beta`` fixes the effects."""
    rng = np.random.default_rng(seed)
    maf = rng.uniform(maf_min, maf_max, m)
    if beta is not None:
        b = np.asarray(beta, float).reshape(m, -1)
        component = (b != 0).any(1).astype(int)
    else:
        b, component = draw_effects(rng, maf, architecture, nt, rg, n_causal, **effects)
    p = panel(spark, n, maf, seed)
    return Simulation(p, phenotypes(p, maf, b, h2, re, seed), b, component, maf)


def simulate_on(panel_: DataFrame, *, architecture: str = "bayesc", nt: int = 1, h2: float = 0.5, rg: float = 0.0, re: float = 0.0, n_causal: int | None = None, seed: int = 1, **effects) -> tuple[DataFrame, np.ndarray]:
    """Phenotypes (sample_idx, trait, y, g, e) of given genotypes without missing dosages, and the effects drawn for their markers."""
    af = allele_freq(panel_).orderBy("marker_idx").toPandas()["af"].to_numpy(float)
    b, _ = draw_effects(np.random.default_rng(seed), np.minimum(af, 1 - af), architecture, nt, rg, n_causal, **effects)
    return phenotypes(panel_.select("sample_idx", "dosages"), af, b, h2, re, seed), b


def mtsim(spark: SparkSession, *, n: int = 1000, m: int = 1000, nt: int = 2, n_shared: int = 10, n_specific: int = 10, h2: float = 0.5, rg: float = 0.5, re: float = 0.0, seed: int = 1, weights: np.ndarray | None = None, maf_min: float = 0.05, maf_max: float = 0.5) -> Simulation:
    """Shared causal markers with correlated effects, and specific ones for each trait."""
    rng = np.random.default_rng(seed)
    maf = rng.uniform(maf_min, maf_max, m)
    p = None if weights is None else weights / weights.sum()
    chosen = rng.choice(m, n_shared + nt * n_specific, replace=False, p=p)
    b = np.zeros((m, nt))
    root = np.linalg.cholesky(np.full((nt, nt), rg) + (1 - rg) * np.eye(nt))
    b[chosen[:n_shared]] = rng.standard_normal((n_shared, nt)) @ root.T
    for t in range(nt):
        own = chosen[n_shared + t * n_specific : n_shared + (t + 1) * n_specific]
        b[own, t] = rng.standard_normal(n_specific)
    d = panel(spark, n, maf, seed)
    return Simulation(d, phenotypes(d, maf, b, h2, re, seed), b, (b != 0).any(1).astype(int), maf)


def annotations(m: int, n_annotations: int = 5, prob: float = 0.05, seed: int = 1) -> np.ndarray:
    """Overlapping Bernoulli annotation sets, marker by annotation."""
    return np.random.default_rng(seed).random((m, n_annotations)) < prob


def mtsim_annotation(spark: SparkSession, *, m: int = 1000, n_annotations: int = 5, annotation_prob: float = 0.05, enriched: tuple[int, ...] = (0,), enrichment: float = 5.0, seed: int = 1, **more) -> tuple[Simulation, np.ndarray]:
    """``mtsim`` with causal markers enriched in annotations."""
    a = annotations(m, n_annotations, annotation_prob, seed)
    weights = np.where(a[:, list(enriched)].any(1), enrichment, 1.0)
    return mtsim(spark, m=m, seed=seed, weights=weights, **more), a


def annotation_signal(truth: DataFrame, sets: DataFrame) -> DataFrame:
    """annotation, size, causal rate, mean PIP and mean absolute effect."""
    return sets.join(truth, "marker_idx").groupBy("annotation").agg(
        F.count("*").alias("size"),
        F.avg(F.col("causal").cast("double")).alias("causal_rate"),
        F.avg("pip").alias("mean_pip"),
        F.avg(F.abs("effect")).alias("mean_abs_effect"),
    )


def probability_surface(markers: DataFrame, pi: list[float], variances: list[float], alpha: dict[str, list[float]] | None = None) -> DataFrame:
    """marker_idx, component, prob: logistic sticks, the largest variance first and the null last.

    ``markers`` (marker_idx, annotation, value) are centred; ``alpha`` shifts the sticks
    of an annotation, one number for each of them in that order.  Component 0 is the null.
    """
    order = [*sorted(range(1, len(pi)), key=lambda k: -variances[k]), 0]
    base = [pi[k] / sum(pi[j] for j in order[n:]) for n, k in enumerate(order[:-1])]
    table = F.create_map(*[x for a, v in (alpha or {"": [0.0] * len(base)}).items() for x in (F.lit(a), F.array(*[F.lit(float(c)) for c in v]))])
    shift = F.coalesce(F.try_element_at(table, F.col("annotation")), F.array(*[F.lit(0.0)] * len(base)))
    d = markers.withColumn("c", shift).groupBy("marker_idx").agg(*[F.sum(F.col("value") * F.col("c")[k]).alias(f"e{k}") for k in range(len(base))])
    left, probs = F.lit(1.0), {}
    for n, k in enumerate(order[:-1]):
        going = logistic(float(np.log(base[n] / (1 - base[n]))) + F.col(f"e{n}"))
        probs[k], left = left * going, left * (1 - going)
    probs[0] = left
    total = sum((probs[k] for k in range(1, len(pi))), probs[0])
    return d.select("marker_idx", F.posexplode(F.array(*[F.round(probs[k] / total, 10) for k in range(len(pi))])).alias("component", "prob"))


def exactness(values: DataFrame, h2_target: float) -> DataFrame:
    """trait, the largest |y - (g + e)|, the share of variance in g and the target, from trait, sample_idx, g, e, y."""
    return values.groupBy("trait").agg(
        F.round(F.max(F.abs(F.col("y") - (F.col("g") + F.col("e")))), 8).alias("max_gap"),
        F.round(F.var_samp("g") / F.var_samp("y"), 8).alias("h2_observed"),
        F.lit(float(h2_target)).alias("h2_target"),
    )


def force_correlation(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Columns of ``x`` scaled, whitened and coloured to have exactly the ``target`` correlation."""
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    roots = []
    for corr, power in ((np.corrcoef(z, rowvar=False), -0.5), (np.asarray(target, float), 0.5)):
        values, vectors = np.linalg.eigh(corr)
        if values.min() <= 1e-8:
            raise ValueError("a correlation matrix is not positive definite")
        roots.append((vectors * values**power) @ vectors.T)
    return z @ roots[0] @ roots[1]


def recolour(table: DataFrame, columns: list[str], target: np.ndarray) -> DataFrame:
    """``table`` with the columns given the ``target`` correlation: their means and cross products decide a small matrix, rows change alone."""
    k = len(columns)
    stats = table.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns)], *[F.corr(a, b).alias(f"r{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns)]).first()
    roots = []
    for corr, power in ((np.array([[stats[f"r{i}_{j}"] if i != j else 1.0 for j in range(k)] for i in range(k)]), -0.5), (np.asarray(target, float), 0.5)):
        values, vectors = np.linalg.eigh(corr)
        if values.min() <= 1e-8:
            raise ValueError("a correlation matrix is not positive definite")
        roots.append((vectors * values**power) @ vectors.T)
    mix = roots[0] @ roots[1]
    z = [(F.col(c) - stats[f"m{i}"]) / stats[f"s{i}"] for i, c in enumerate(columns)]
    return table.withColumns({c: sum((z[i] * float(mix[i, j]) for i in range(1, k)), z[0] * float(mix[0, j])) for j, c in enumerate(columns)})
