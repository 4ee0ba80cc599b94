"""Annotations of marker priors: selection by spike and slab, and coefficients by Monte Carlo EM.

Component k of a marker is reached by sticks: stick k goes on with probability
Phi(a' alpha_k) from the markers that reached it.  Given latent values of the sticks, all that
annotations need to know of the markers are Gram matrices, small sums that every task adds up
over its own markers; markers never meet in one task.  Annotation 0 is the intercept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectforge.operators.samplers import Model, _phi, _truncated, fit_summary, selection_sweep

SUMS = "stick int, row int, col int, value double"
#: Annotations whose subsets are enumerated, and those of a sweep, at most.
MOST_ENUMERATED, MOST = 12, 512


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def _sums(grams: dict[int, np.ndarray]) -> pa.RecordBatch:
    rows = [(k, i, j, float(x)) for k, g in grams.items() for (i, j), x in np.ndenumerate(g)]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.float64()))], names=["stick", "row", "col", "value"])


def _collect(sums: DataFrame, sticks: int, shape: tuple[int, int]) -> np.ndarray:
    """Matrices of all sticks: annotations squared numbers each, whatever the markers."""
    out = np.zeros((sticks, *shape))
    for r in sums.groupBy("stick", "row", "col").agg(F.sum("value").alias("value")).collect():
        out[r["stick"], r["row"], r["col"]] = r["value"]
    return out


def stick_moments(markers: DataFrame, sticks: int, alpha: np.ndarray | None = None, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'z of each stick over the markers that reach it.

    ``markers`` has marker_idx, component and a (annotations, the intercept first), and z (a latent value by
    stick), or with ``alpha`` latents are drawn, fixed by seed and marker.
    """
    width = len(markers.select(F.col("a")).first()["a"])
    if width - 1 > MOST:
        raise ValueError(f"more than {MOST} annotations")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = {k: np.zeros((width, width + 1)) for k in range(sticks)}
        for b in batches:
            a, comp = _matrix(b.column("a")), np.asarray(b.column("component"), int)
            ids = np.asarray(b.column("marker_idx"), np.int64)
            for k in range(sticks):
                at = np.flatnonzero(comp >= k)
                if not len(at):
                    continue
                x = a[at]
                if alpha is None:
                    z = _matrix(b.column("z"))[at, k]
                else:
                    # One generator a marker would be slow: one for each run of 1024, by number.
                    z = np.empty(len(at))
                    for part in np.unique(ids[at] >> 10):
                        here = np.flatnonzero(ids[at] >> 10 == part)
                        rng = np.random.default_rng([seed, k, int(part), len(here), int(ids[at][here].min())])
                        z[here] = _truncated(rng, x[here] @ alpha[:, k], comp[at][here] > k)
                grams[k][:, :width] += x.T @ x
                grams[k][:, width] += x.T @ z
        yield _sums(grams)

    columns = ["marker_idx", "component", F.col("a").cast("array<double>").alias("a")] + ([] if alpha is not None else [F.col("z").cast("array<double>").alias("z")])
    found = _collect(markers.select(*columns).mapInArrow(run, SUMS), sticks, (width, width + 1))
    return found[:, :, :width], found[:, :, width]


def subset_weights(xx: np.ndarray, xz: np.ndarray, intercept: np.ndarray, tau2: np.ndarray, pi_a: float) -> dict[tuple[int, ...], float]:
    """Posterior probability of every subset of the annotations, coefficients integrated out, at given latents."""
    j = xx.shape[1] - 1
    if j > MOST_ENUMERATED:
        raise ValueError(f"more than {MOST_ENUMERATED} annotations have too many subsets")
    logs = {}
    for size in range(j + 1):
        for s in combinations(range(j), size):
            at = np.array(s, int) + 1
            lw = size * np.log(pi_a) + (j - size) * np.log1p(-pi_a)
            for k in range(len(xx)):
                if size:
                    t = xz[k, at] - xx[k, at, 0] * intercept[k]
                    p = xx[k][np.ix_(at, at)] + np.eye(size) / tau2[k]
                    lw += 0.5 * t @ np.linalg.solve(p, t) - 0.5 * np.linalg.slogdet(p * tau2[k])[1]
            logs[s] = lw
    top = max(logs.values())
    total = sum(np.exp(x - top) for x in logs.values())
    return {s: float(np.exp(x - top) / total) for s, x in logs.items()}


def inclusion_table(markers: DataFrame, sticks: int, *, intercept: list[float], tau2: list[float], pi_a: float = 0.5) -> DataFrame:
    """annotation (from 1), prob: inclusion probabilities at the latent values of ``markers`` (see :func:`stick_moments`)."""
    weights = subset_weights(*stick_moments(markers, sticks), np.array(intercept), np.array(tau2), pi_a)
    j = max((max(s, default=-1) for s in weights), default=-1) + 1
    rows = [(k + 1, sum(w for s, w in weights.items() if k in s)) for k in range(j)]
    return markers.sparkSession.createDataFrame(rows, "annotation int, prob double")


def select_annotations(markers: DataFrame, sticks: int, *, sweeps: int = 200, burn: int = 50, seed: int = 1, pi_a: float = 0.5, tau2: float = 1.0, beta: tuple[float, float] = (1.0, 1.0), slab: tuple[float, float] = (3.0, 1.6), fixed: bool = False) -> dict:
    """Inclusion probabilities and mean coefficients of annotations by Gibbs sweeps, components of the markers given.

    A sweep is one Spark job that draws latents where the markers are and brings back Gram
    matrices.  ``fixed`` keeps pi_a and tau2.
    """
    width = len(markers.select("a").first()["a"])
    rng, alpha, delta = np.random.default_rng(seed), np.zeros((width, sticks)), np.ones(width - 1, bool)
    state = {"pi_a": pi_a, "tau2": np.full(sticks, tau2)}
    included, coefficients = np.zeros(width - 1), np.zeros_like(alpha)
    for it in range(sweeps):
        xx, xz = stick_moments(markers, sticks, alpha, seed * 1_000_003 + it)
        selection_sweep(rng, xx, xz, alpha, delta, state, beta, slab, fixed=fixed)
        if it >= burn:
            included += delta
            coefficients += alpha
    kept = max(sweeps - burn, 1)
    return {"inclusion": included / kept, "alpha": coefficients / kept} | state


def newton_terms(markers: DataFrame, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected log likelihood of each stick at ``alpha``, its gradient and the negative Hessian.

    ``markers`` has a and probs, the expected components of a marker: stick k counts it as often as it
    is expected to reach it.
    """
    width, sticks = alpha.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = {k: np.zeros((width, width + 2)) for k in range(sticks)}
        for b in batches:
            a, p = _matrix(b.column("a")), _matrix(b.column("probs"))
            for k in range(sticks):
                on, off = p[:, k + 1 :].sum(1), p[:, k]
                eta = a @ alpha[:, k]
                up, down = _phi(eta), _phi(-eta)
                density = np.exp(-0.5 * eta * eta) / np.sqrt(2 * np.pi)
                one, zero = density / up, density / down
                slope = on * one - off * zero
                bend = on * one * (one + eta) + off * zero * (zero - eta)
                terms[k][:, :width] += (a * bend[:, None]).T @ a
                terms[k][:, width] += a.T @ slope
                terms[k][0, width + 1] += on @ np.log(up) + off @ np.log(down)
        yield _sums(terms)

    columns = [F.col(c).cast("array<double>").alias(c) for c in ("a", "probs")]
    found = _collect(markers.select(*columns).mapInArrow(run, SUMS), sticks, (width, width + 2))
    return found[:, 0, width + 1], found[:, :, width], found[:, :, :width]


def m_step(markers: DataFrame, alpha: np.ndarray, *, sigma2: float = 1.0, intercept: tuple[float, float] = (0.0, 1.0), steps: int = 25, tol: float = 1e-8) -> tuple[np.ndarray, list[float]]:
    """Coefficients that maximise the expected log posterior, and its value at each step, by damped Newton.

    Coefficients have N(0, ``sigma2``) priors and the intercept N(mean, variance); a step that would not ascend is halved.
    """
    mean, precision = np.zeros(len(alpha)), np.full(len(alpha), 1.0 / sigma2)
    mean[0], precision[0] = intercept[0], 1.0 / intercept[1]

    def at(x: np.ndarray):
        value, slope, bend = newton_terms(markers, x)
        off = x - mean[:, None]
        return value.sum() - 0.5 * float((precision[:, None] * off * off).sum()), slope.T - precision[:, None] * off, bend + np.diag(precision)

    value, slope, bend = at(alpha)
    values = [value]
    for _ in range(steps):
        move = np.column_stack([np.linalg.solve(bend[k], slope[:, k]) for k in range(alpha.shape[1])])
        size = 1.0
        while True:
            new = at(alpha + size * move)
            if new[0] >= value - 1e-12 or size < 1e-6:
                break
            size /= 2
        alpha, (value, slope, bend) = alpha + size * move, new
        values.append(value)
        if np.abs(size * move).max() < tol:
            break
    return alpha, values


def stick_rows(a: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Component probabilities of markers by their annotations."""
    going = _phi(a @ alpha)
    left = np.cumprod(np.column_stack([np.ones(len(a)), going]), 1)
    rows = np.maximum(np.column_stack([left[:, :-1] * (1 - going), left[:, -1]]), 1e-12)
    return rows / rows.sum(1, keepdims=True)


def fit_mcem(stats: DataFrame, edges: DataFrame, annotations: np.ndarray, model: Model, controls, *, alpha: np.ndarray, sigma2: float = 1.0, damping: float = 0.5, outer: int = 10, least_outer: int = 3, tol: float = 0.01) -> dict:
    """Annotation coefficients at their posterior mode, effects integrated out by Monte Carlo.

    Every outer step runs a chain at the present coefficients for the expected components, then
    :func:`m_step`, and goes ``damping`` of the way.  The coefficients of the later half of the
    steps are averaged, and a last chain runs at them.
    """
    spark, history, converged = stats.sparkSession, [alpha], False
    trait = stats.select("trait").distinct().collect()
    if len(trait) != 1:
        raise ValueError("coefficients are fitted for one trait at a time")

    def chain(now: np.ndarray):
        policy = Model(**{**model.__dict__, "policy": "fixed_marker", "extra": {"marker_pi": stick_rows(annotations, now)}})
        return fit_summary(stats, edges, policy, controls)

    table = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(annotations)], "marker_idx int, a array<double>")
    for step in range(outer):
        probs = chain(alpha).components().groupBy("marker_idx").agg(F.array_sort(F.collect_list(F.struct("component", "prob"))).alias("p"))
        markers = table.join(probs.select("marker_idx", F.col("p.prob").alias("probs")), "marker_idx").cache()
        target, _ = m_step(markers, alpha, sigma2=sigma2, steps=8, tol=1e-4)
        markers.unpersist()
        new = alpha + damping * (target - alpha)
        change = float(np.abs(new - alpha).max())
        alpha = new
        history.append(alpha)
        if step + 1 >= least_outer and change < tol:
            converged = True
            break
    mean = np.mean(history[1 + (len(history) - 1) // 2 :], axis=0)
    return {"alpha": mean, "history": history, "converged": converged, "fit": chain(mean)}
