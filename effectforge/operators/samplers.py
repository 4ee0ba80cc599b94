"""Scalar-trait Gibbs samplers: one kernel, one task for each (trait, chain).

The kernel is written once for spike-and-slab (two components) and scale
mixtures (more), over any likelihood operator, and with the prior on components
left to a policy: one mixture for all, fixed per marker, per group, learned
logistic, or probit sticks on annotations.
"""

from __future__ import annotations


from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from effectforge.operators.genotypes import dosage_matrix
from effectforge.operators.priors import ChainControls, calibrate_prior, pi_prior, task_seed

TRACES = ("vb", "vg", "ve", "pi", "vle", "vld")
OUTPUT = "trait string, chain int, kind string, iteration int, marker_idx int, quantity string, value double"


class CsrOperator:
    """X'X from LD edges: r = wy - X'X b, kept current by sparse rows."""

    def __init__(self, wy: np.ndarray, ww: np.ndarray, i: np.ndarray, j: np.ndarray, r: np.ndarray) -> None:
        if not (ww > 0).all():
            raise ValueError("every marker needs ww > 0")
        self.wy, self.ww, self.r = wy, ww, wy.copy()
        a, b, x = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([r, r])
        order = np.lexsort((b, a))
        a, self.col = a[order], b[order]
        self.val = (x[order] * np.sqrt(ww[a] * ww[self.col])).astype(np.float32).astype(float)
        self.corr = x[order]
        self.ptr = np.searchsorted(a, np.arange(len(wy) + 1))

    def segments(self, order: np.ndarray) -> list[np.ndarray]:
        """The sweep order in parts whose scores :meth:`scores` gives together."""
        return [order]

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """X'e of some markers of one segment."""
        return self.r[ids]

    def score(self, k: int, b: float) -> float:
        """X'e of one marker with its own effect added back."""
        return float(self.scores(np.array([k]))[0]) + self.ww[k] * b

    def move(self, k: int, change: float) -> None:
        s = slice(self.ptr[k], self.ptr[k + 1])
        self.r[self.col[s]] -= self.val[s] * change
        self.r[k] -= self.ww[k] * change

    def residual(self) -> np.ndarray:
        return self.r

    def friends(self, k: int, min_r2: float, most: int) -> np.ndarray:
        s = slice(self.ptr[k], self.ptr[k + 1])
        r2 = self.corr[s] ** 2
        near = np.flatnonzero(r2 >= min_r2)
        return self.col[s][near[np.argsort(-r2[near], kind="stable")[:most]]]

    def set_effects(self, b: np.ndarray) -> None:
        """Put the residual where these effects leave it."""
        self.rebuild(b)

    def rebuild(self, b: np.ndarray) -> float:
        """Recompute the residual; the largest drift that was mended."""
        rows = np.repeat(np.arange(len(b)), np.diff(self.ptr))
        fresh = self.wy - self.ww * b - np.bincount(rows, self.val * b[self.col], minlength=len(b))
        drift = float(np.abs(fresh - self.r).max(initial=0.0))
        self.r = fresh
        return drift


def _rows(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of a matrix, without a copy where they follow each other."""
    return x[at[0] : at[-1] + 1] if at[-1] - at[0] + 1 == len(at) else x[at]


class GenotypeOperator(CsrOperator):
    """Standardised genotypes: the residual lives on samples, X'e gives scores."""

    def __init__(self, z: np.ndarray, y: np.ndarray) -> None:
        self.z, self.e = np.ascontiguousarray(z.T), y.astype(float).copy()
        self.y, self.at = self.e.copy(), np.arange(z.shape[1])
        self.wy, self.ww = z.T @ y, np.square(z).sum(0)
        if not (self.ww > 0).all():
            raise ValueError("every marker needs variation")

    def segments(self, order: np.ndarray) -> list[np.ndarray]:
        """Rows of ``z`` are put in the sweep's order, so that a part of it is one piece of memory."""
        self.z = self.z[self.at[order]]
        self.at[order] = np.arange(len(order))
        return [order]

    def scores(self, ids: np.ndarray) -> np.ndarray:
        return _rows(self.z, self.at[ids]) @ self.e

    def move(self, k: int, change: float) -> None:
        self.e -= self.z[self.at[k]] * change

    def residual(self) -> np.ndarray:
        return (self.z @ self.e)[self.at]

    def friends(self, k: int, min_r2: float, most: int) -> np.ndarray:
        r2 = np.square(self.z @ self.z[self.at[k]])[self.at] / (self.ww * self.ww[k])
        r2[k] = -1
        near = np.flatnonzero(r2 >= min_r2)
        return near[np.argsort(-r2[near], kind="stable")[:most]]

    def set_effects(self, b: np.ndarray) -> None:
        sweep = np.empty(len(b))
        sweep[self.at] = b
        self.e = self.y - sweep @ self.z

    def rebuild(self, b: np.ndarray) -> float:
        return 0.0


class BlockOperator(CsrOperator):
    """Dense blocks of X'X, as filters leave them; correlations across blocks are 0."""

    def __init__(self, blocks: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """``blocks`` gives the first marker, the correlations, X'y and diag X'X of each."""
        self.start = [s for s, *_ in blocks]
        self.block = np.repeat(np.arange(len(blocks)), [len(c) for _, c, *_ in blocks])
        self.a = [c * np.sqrt(np.outer(w, w)) for _, c, _, w in blocks]
        self.wy = np.concatenate([wy for _, _, wy, _ in blocks])
        self.ww = np.concatenate([np.diag(a) for a in self.a])
        if not (self.ww > 0).all():
            raise ValueError("a filter left a marker without variance")
        self.r = self.wy.copy()

    def _part(self, n: int) -> slice:
        return slice(self.start[n], self.start[n] + len(self.a[n]))

    def move(self, k: int, change: float) -> None:
        n = self.block[k]
        self.r[self._part(n)] -= self.a[n][:, k - self.start[n]] * change

    def friends(self, k: int, min_r2: float, most: int) -> np.ndarray:
        n = self.block[k]
        at, d = k - self.start[n], np.diag(self.a[n])
        r2 = np.square(self.a[n][:, at]) / (d * d[at])
        r2[at] = -1
        near = np.flatnonzero(r2 >= min_r2)
        return near[np.argsort(-r2[near], kind="stable")[:most]] + self.start[n]

    def rebuild(self, b: np.ndarray) -> float:
        fresh = self.wy - np.concatenate([a @ b[self._part(n)] for n, a in enumerate(self.a)])
        drift = float(np.abs(fresh - self.r).max(initial=0.0))
        self.r = fresh
        return drift


class LowRankOperator(CsrOperator):
    """Blocks with A = Q'Q of reduced rank; the residual lives in rank space."""

    def __init__(self, blocks: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        self.q, self.res, self.start = [], [], []
        sizes = [q.shape[1] for _, q, _ in blocks]
        self.block = np.repeat(np.arange(len(sizes)), sizes)
        for start, q, w in blocks:
            self.start.append(start)
            self.q.append(np.ascontiguousarray(q.T))
            self.res.append(w.astype(float).copy())
        self.w = [r.copy() for r in self.res]
        #: The row of each marker in its block's matrix.
        self.at = np.concatenate([np.arange(n) for n in sizes])
        self.w2 = sum(float(w @ w) for w in self.res)
        self.wy = np.concatenate([q @ w for q, w in zip(self.q, self.res, strict=True)])
        self.ww = np.concatenate([np.square(q).sum(1) for q in self.q])

    def segments(self, order: np.ndarray) -> list[np.ndarray]:
        """Block by block: blocks share no residual, so their markers need not take turns."""
        of = self.block[order]
        parts = [order[of == n] for n in range(len(self.q))]
        for n, part in enumerate(parts):
            self.q[n] = self.q[n][self.at[part]]
            self.at[part] = np.arange(len(part))
        return parts

    def scores(self, ids: np.ndarray) -> np.ndarray:
        n = self.block[ids[0]]
        return _rows(self.q[n], self.at[ids]) @ self.res[n]

    def move(self, k: int, change: float) -> None:
        n = self.block[k]
        self.res[n] -= self.q[n][self.at[k]] * change

    def residual(self) -> np.ndarray:
        parts = [q @ r for q, r in zip(self.q, self.res, strict=True)]
        return np.concatenate([x[self.at[s : s + len(x)]] for s, x in zip(self.start, parts, strict=True)])

    def set_effects(self, b: np.ndarray) -> None:
        for n, (q, w) in enumerate(zip(self.q, self.w, strict=True)):
            sweep, here = np.empty(len(q)), slice(self.start[n], self.start[n] + len(q))
            sweep[self.at[here]] = b[here]
            self.res[n] = w - sweep @ q

    def block_terms(self, b: np.ndarray, n: float) -> list[tuple[float, float, float, int]]:
        """Genetic variance, sum of squared effects, squared residual and rank of every block."""
        ends = np.append(self.start, len(b))[1:]
        return [
            (float(np.square(w - r).sum()) / n, float(np.square(b[s:e]).sum()), float(r @ r), len(w))
            for w, r, s, e in zip(self.w, self.res, self.start, ends, strict=True)
        ]

    def rebuild(self, b: np.ndarray) -> float:
        return 0.0


def quadratic_terms(values: DataFrame) -> DataFrame:
    """sse, vg, vle, vld of (effect, wy, ww, r, yy, n): residual sum of squares, genetic variance, its equilibrium part and the rest."""
    b, n = F.col("effect"), F.max("n")
    vg, vle = F.sum(b * (F.col("wy") - F.col("r"))) / n, F.sum(F.col("ww") * b * b) / n
    sse = F.max("yy") - F.sum(b * (F.col("r") + F.col("wy")))
    return values.agg(F.round(sse, 4).alias("sse"), F.round(vg, 6).alias("vg"), F.round(vle, 6).alias("vle"), F.round(vg - vle, 6).alias("vld"))


def sweep_order(stats: DataFrame) -> DataFrame:
    """marker_idx and its place in a sweep, by the largest squared marginal effect over traits, ties by index."""
    s = F.col("wy") / F.col("ww")
    strongest = stats.groupBy("marker_idx").agg(F.max(F.round(s * s, 10)).alias("s"))
    # One number a marker, and one order of all of them.
    return strongest.select("marker_idx", F.row_number().over(Window.orderBy(F.col("s").desc(), "marker_idx")).alias("place"))


def group_counts(states: DataFrame, groups: DataFrame) -> DataFrame:
    """group, size, active, mean_pip from (marker_idx, pip, active) and (marker_idx, group)."""
    return states.join(groups, "marker_idx").groupBy("group").agg(
        F.count("*").alias("size"), F.count(F.when(F.col("active"), 1)).alias("active"), F.round(F.avg("pip"), 8).alias("mean_pip")
    )


def low_rank_block(corr: np.ndarray, wy: np.ndarray, ww: np.ndarray, prop: float = 0.995) -> tuple[np.ndarray, np.ndarray]:
    """Factor and projected score of one LD block: leading eigenvectors past ``prop`` of the positive mass."""
    values, vectors = np.linalg.eigh(corr)
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order]
    positive = values > 1e-10
    share = np.cumsum(values[positive]) / values[positive].sum()
    rank = min(int(np.searchsorted(share, prop, side="right")) + 1, int(positive.sum()))
    lam, v = values[:rank], vectors[:, :rank]
    d = np.sqrt(ww)
    return (np.sqrt(lam)[:, None] * v.T) * d, (v.T @ (wy / d)) / np.sqrt(lam)


def shrinkage(z: np.ndarray) -> float:
    """Ledoit-Wolf weight of the identity for standardised columns ``z``."""
    n, m = z.shape
    s = z.T @ z / n
    spread = float(np.square(s - np.trace(s) / m * np.eye(m)).sum())
    noise = float((np.square(np.square(z).sum(1)).sum() / n - np.square(s).sum()) / n)
    return min(1.0, max(0.0, noise / spread)) if spread > 0 else 1.0


def filtered_block(corr: np.ndarray, mode: str, *, tau: float = 0.01, eta: float = 0.0, weight: float | None = None) -> np.ndarray:
    """A dense LD block made well-conditioned.

    hard_truncate keeps eigenvalues of at least max(tau, 0.01); ridge_fixed
    mixes in eta / (1 + eta) of the identity; ridge_lw the given ``weight``.
    """
    if mode == "hard_truncate":
        values, vectors = np.linalg.eigh(corr)
        kept = values >= max(tau, 0.01)
        return (vectors[:, kept] * values[kept]) @ vectors[:, kept].T
    if mode not in ("ridge_fixed", "ridge_lw"):
        raise ValueError("mode is hard_truncate, ridge_fixed or ridge_lw")
    a = eta / (1 + eta) if mode == "ridge_fixed" else float(weight or 0.0)
    return (1 - a) * corr + a * np.eye(len(corr))


#: Inclusion probabilities below which a null marker sits out more sweeps, and how many times the base.
SKIP_BELOW, SKIP_TIMES = (1e-6, 1e-5, 1e-4, 1e-3), (4.0, 2.0, 1.0, 0.5, 0.0)


def skip_length(p: np.ndarray, base: int, most: int) -> np.ndarray:
    """Sweeps that null markers sit out, by their last inclusion probabilities."""
    times = np.array(SKIP_TIMES)[np.searchsorted(SKIP_BELOW, p, side="right")]
    return np.minimum(most, (base * times).astype(int))


def block_selected(mode: str, iteration: int, vg: float, effect_ss: float, threshold: float, permanent: bool) -> tuple[bool, bool]:
    """Whether a block's residual variance is drawn in an iteration (from 0), and whether it is from now on.

    fixVe never, samVe always, allMixVe where squared effects exceed the genetic variance
    by the threshold, mixVe where they did in iteration 50.
    """
    eligible = vg >= 1e-8 and effect_ss >= 1e-8 and effect_ss / vg > threshold
    if mode == "mixVe":
        permanent = eligible if iteration == 50 else permanent and iteration > 50
        return permanent, permanent
    if mode not in ("fixVe", "samVe", "allMixVe"):
        raise ValueError("block_mode is fixVe, samVe, allMixVe or mixVe")
    return mode == "samVe" or mode == "allMixVe" and eligible, permanent


def slice_draw(rng: np.random.Generator, density, x: float, width: float = 1.0) -> float:
    """One slice-sampling step of a log density, stepping out and shrinking."""
    level = density(x) + np.log(rng.random())
    low = x - width * rng.random()
    high = low + width
    while density(low) > level:
        low -= width
    while density(high) > level:
        high += width
    while True:
        new = rng.uniform(low, high)
        if density(new) > level:
            return float(new)
        low, high = (new, high) if new < x else (low, new)


@dataclass
class Model:
    """Priors and switches of a scalar fit."""

    gamma: tuple[float, ...] = (0.0, 1.0)
    policy: str = "global"
    pi: tuple[float, ...] = (0.999, 0.001)
    pi_strength: float = 5e5
    h2: float = 0.3
    adj_e: float = 0.9
    nub: float = 4.0
    nue: float = 4.0
    update_vb: bool = True
    update_ve: bool = True
    update_pi: bool = True
    maf_s: float | None = None
    estimate_s: bool = False
    swap: bool = False
    swap_prob: float = 0.05
    swap_r2: float = 0.8
    swap_friends: int = 50
    #: How often two correlated markers are drawn together after a sweep, and at which r squared.
    pair_prob: float = 0.0
    pair_r2: float = 0.5
    vb: float | None = None
    ve: float | None = None
    rebuild_every: int = 100
    skip_nulls: int = 0
    skip_most: int = 64
    full_every: int = 10
    log_cpo: bool = False
    #: Markers whose effect and inclusion are traced; component shares and annotation coefficients are traced with them.
    trace_markers: tuple[int, ...] = ()
    #: Residual variances of low-rank blocks: one for all, the phenotype's for each block, or drawn by block.
    block_policy: str = "global"
    block_mode: str = "allMixVe"
    block_threshold: float = 1.1
    block_least_ratio: float = 0.7
    extra: dict = field(default_factory=dict)


def _inverse_chi2(rng: np.random.Generator, total: float, df: float) -> float:
    return max(total / rng.chisquare(df), 1e-12)


def _phi(x: np.ndarray) -> np.ndarray:
    from math import erf

    return np.clip(0.5 * (1 + np.vectorize(erf)(x / np.sqrt(2.0))), 1e-12, 1 - 1e-12)


def _truncated(rng: np.random.Generator, mu: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """N(mu, 1) above zero where ``positive``, else below, by inversion on the tail side."""
    from statistics import NormalDist

    sign = np.where(positive, 1.0, -1.0)
    tail = _phi(sign * mu)
    u = rng.random(len(mu)) * tail
    inv = NormalDist().inv_cdf
    z = np.array([inv(float(min(max(x, 1e-300), 1 - 1e-16))) for x in u])
    return mu - sign * z


def selection_sweep(rng: np.random.Generator, xx: np.ndarray, xz: np.ndarray, alpha: np.ndarray, delta: np.ndarray, state: dict, beta: tuple[float, float] = (1.0, 1.0), slab: tuple[float, float] = (3.0, 1.6), intercept: tuple[np.ndarray, float] | None = None, fixed: bool = False) -> None:
    """Draw intercepts, which annotations are in (all sticks together, coefficients integrated out), and their coefficients, from Gram matrices.

    ``xx`` (sticks, J + 1, J + 1) and ``xz`` (sticks, J + 1) are sums over the markers that reach each
    stick, the intercept first; ``alpha`` (J + 1, sticks), ``delta`` (J) and ``state`` (pi_a, tau2) change in place.
    """
    sticks = len(xx)
    mean0, precision0 = intercept or (np.zeros(sticks), 1.0)
    for k in range(sticks):
        info = xx[k, 0, 0] + precision0
        t = xz[k, 0] - xx[k, 0, 1:] @ alpha[1:, k] + precision0 * mean0[k]
        alpha[0, k] = t / info + rng.standard_normal() / np.sqrt(info)
    tau2 = state["tau2"]
    for j in range(1, len(alpha)):
        s = xx[:, j, j]
        t = xz[:, j] - np.array([xx[k, j] @ alpha[:, k] for k in range(sticks)]) + s * alpha[j]
        variance = tau2 / (1 + tau2 * s)
        log_odds = np.log(state["pi_a"]) - np.log1p(-state["pi_a"]) + float((-0.5 * np.log1p(tau2 * s) + 0.5 * variance * t * t).sum())
        delta[j - 1] = rng.random() < 1 / (1 + np.exp(-min(log_odds, 700.0))) if log_odds > -700 else False
        alpha[j] = variance * t + np.sqrt(variance) * rng.standard_normal(sticks) if delta[j - 1] else 0.0
    if not fixed:
        state["pi_a"] = float(np.clip(rng.beta(beta[0] + delta.sum(), beta[1] + (~delta).sum()), 1e-12, 1 - 1e-12))
        squares = np.square(alpha[1:][delta]).sum(0)
        state["tau2"] = (slab[1] + 0.5 * squares) / rng.gamma(slab[0] + 0.5 * delta.sum(), 1.0, sticks)


class Prior:
    """Component probabilities of each marker and multipliers of its variance."""

    def __init__(self, model: Model, m: int) -> None:
        self.model, self.m, self.extra = model, m, model.extra
        self.k = len(model.gamma)
        self.pi = np.array(model.pi, float)
        self.rows = np.tile(self.pi, (m, 1))
        self.scale = np.asarray(self.extra.get("multiplier", np.ones(m)), float).copy()
        kind = model.policy
        if kind == "fixed_marker":
            p = np.asarray(self.extra["marker_pi"], float)
            self.rows = np.column_stack([1 - p, p]) if p.ndim == 1 else p
        elif kind == "group":
            self.group = np.asarray(self.extra["group"], int)
            self.groups = int(self.group.max()) + 1
            if "group_pi" in self.extra:
                p = np.asarray(self.extra["group_pi"], float)[self.group]
                self.rows = np.column_stack([1 - p, p])
        elif kind == "custom":
            # A user's prior: start(m) and update(rng, components, effects, vb) give component probabilities and variance multipliers.
            self.hook = self.extra["prior"]
            self.rows, self.scale = self._checked(self.hook.start(m))
        elif kind in ("learned_logistic", "probit_stick", "log_variance"):
            self.a = np.asarray(self.extra["annotations"], float)
            self.coef = np.zeros((self.a.shape[1], self.k - 1 if kind == "probit_stick" else 1))
            if "coefficients" in self.extra:
                self.coef = np.asarray(self.extra["coefficients"], float).reshape(self.coef.shape).copy()
            self.base, self.eta_vb = float(np.log((1 - model.pi[0]) / model.pi[0])), np.zeros(self.a.shape[1])
            if kind == "learned_logistic":
                self._logistic()
            elif kind == "log_variance":
                self._log_variance()
            elif kind == "probit_stick":
                if "coefficients" not in self.extra:
                    self.coef[0] = self.extra.get("alpha0", np.zeros(self.k - 1))
                self.sigma = np.ones(self.k - 1)
                self.coupling, self.baseline = float(self.extra.get("coupling", 1.0)), np.asarray(self.extra.get("alpha0", np.zeros(self.k - 1)), float)
                self.delta = np.ones(self.a.shape[1] - 1, bool)
                self.selection = {"pi_a": 0.5, "tau2": np.ones(self.k - 1)}
                self._sticks()

    def _checked(self, given: tuple) -> tuple[np.ndarray, np.ndarray]:
        rows, scale = (np.asarray(x, float) for x in given)
        if rows.shape != (self.m, self.k) or scale.shape != (self.m,) or not (rows > 0).all() or not np.allclose(rows.sum(1), 1) or not (scale > 0).all():
            raise ValueError("a prior gives positive probabilities of every component that add up to 1, and a positive multiplier, for each marker")
        return rows, scale

    def _logistic(self) -> None:
        p = np.clip(1 / (1 + np.exp(-(self.base + self.a @ self.coef[:, 0]))), 1e-8, 0.5)
        self.rows = np.column_stack([1 - p, p])

    def _log_variance(self) -> None:
        eta = self.a @ self.coef[:, 0]
        if not np.isfinite(eta).all() or np.abs(eta).max(initial=0.0) > 700:
            raise ValueError("a log variance left the range of the numbers")
        self.scale = np.exp(np.clip(eta, -20, 20))

    def _sticks(self) -> None:
        # With a coupling below one the annotations count for so much, and the baseline for the rest.
        going = _phi(self.coupling * (self.a @ self.coef) + (1 - self.coupling) * self.baseline)
        left = np.ones(self.m)
        rows = []
        for k in range(self.k - 1):
            rows.append(left * (1 - going[:, k]))
            left = left * going[:, k]
        rows = np.maximum(np.column_stack([*rows, left]), 1e-12)
        self.rows = rows / rows.sum(1, keepdims=True)

    def update(self, rng: np.random.Generator, comp: np.ndarray, b: np.ndarray, vb: float) -> None:
        kind, model = self.model.policy, self.model
        if kind == "global" and model.update_pi:
            counts = np.bincount(comp, minlength=self.k)
            self.pi = rng.dirichlet(np.array(model.pi) * model.pi_strength + counts)
            self.pi = np.maximum(self.pi, 1e-300)
            self.rows = np.broadcast_to(self.pi, (self.m, self.k))
        elif kind == "custom":
            self.rows, self.scale = self._checked(self.hook.update(rng, comp, b, vb))
        elif kind == "group":
            a, c = pi_prior(1 - model.pi[0], self.extra.get("group_strength", 100.0))
            active = np.bincount(self.group, comp > 0, self.groups)
            size = np.bincount(self.group, minlength=self.groups)
            p = np.clip(rng.beta(a + active, c + size - active), 1e-12, 1 - 1e-12)
            self.rows = np.column_stack([1 - p[self.group], p[self.group]])
            if self.extra.get("group_vb"):
                sums = np.bincount(self.group, (b * b) * (comp > 0) / vb, self.groups)
                mult = np.array([_inverse_chi2(rng, s + 4.0, n + 4.0) for s, n in zip(sums, active, strict=True)])
                mult /= (mult * size).sum() / size.sum()
                self.scale = mult[self.group]
        elif kind == "learned_logistic":
            sd, sigma2, active = self.extra.get("rw_sd", 0.1), self.extra.get("sigma2", 1.0), comp > 0
            low, high = np.log(self.extra.get("vb_clip", (0.25, 4.0)))

            def walk(now: np.ndarray, loglik) -> np.ndarray:
                new = now + rng.normal(0, sd, len(now))
                gain = loglik(new) - loglik(now) - 0.5 * (new @ new - now @ now) / sigma2
                return new if np.log(rng.random()) < gain else now

            def inclusion(eta: np.ndarray, base: float) -> float:
                x = base + self.a @ eta
                return float(x[active].sum() - np.logaddexp(0, x).sum())

            def log_scale(eta: np.ndarray) -> np.ndarray:
                z = self.a @ eta
                return np.clip(z - z.mean(), low, high)

            def variance(eta: np.ndarray) -> float:
                z = log_scale(eta)[active]
                return float(-0.5 * (z + np.square(b[active]) / (vb * np.exp(z))).sum())

            self.coef[:, 0] = walk(self.coef[:, 0], lambda eta: inclusion(eta, self.base))
            if self.extra.get("learn_vb"):
                self.eta_vb = walk(self.eta_vb, variance)
                self.scale = np.exp(log_scale(self.eta_vb))
            if model.update_pi:
                first, second = pi_prior(1 - model.pi[0], model.pi_strength)
                if not self.coef[:, 0].any():
                    p = np.clip(rng.beta(first + active.sum(), second + (~active).sum()), 1e-12, 1 - 1e-12)
                    self.base = float(np.log(p / (1 - p)))
                else:
                    # The prior of the logit is that of the probability times p (1 - p).
                    prior = lambda x: first * x - (first + second) * np.logaddexp(0, x)
                    self.base = slice_draw(rng, lambda x: inclusion(self.coef[:, 0], x) + prior(x), self.base)
            self._logistic()
        elif kind == "log_variance":
            active = comp > 0

            def fit(theta: np.ndarray) -> float:
                x = (self.a @ theta)[active]
                return float(-0.5 * (x + b[active] ** 2 / (vb * np.exp(x))).sum())

            sd = self.extra.get("theta_sd", 0.7)
            now, nu = self.coef[:, 0], rng.normal(0, sd, self.coef.shape[0])
            level = fit(now) + np.log(rng.random())
            angle = rng.uniform(0, 2 * np.pi)
            low, high = angle - 2 * np.pi, angle
            for _ in range(200):
                new = now * np.cos(angle) + nu * np.sin(angle)
                if fit(new) > level:
                    self.coef[:, 0] = new
                    break
                low, high = (angle, high) if angle < 0 else (low, angle)
                angle = rng.uniform(low, high)
            self._log_variance()
            if model.update_pi:
                counts = np.bincount(comp, minlength=self.k)
                self.pi = np.maximum(rng.dirichlet(np.array(model.pi) * model.pi_strength + counts), 1e-300)
                self.rows = np.broadcast_to(self.pi, (self.m, self.k))
        elif kind == "probit_stick" and self.extra.get("select"):
            xx, xz = [], []
            for k in range(self.k - 1):
                at = np.flatnonzero(comp >= k)
                x = self.a[at]
                xx.append(x.T @ x)
                xz.append(x.T @ _truncated(rng, x @ self.coef[:, k], comp[at] > k) if len(at) else np.zeros(x.shape[1]))
            mean0 = np.asarray(self.extra.get("alpha0", np.zeros(self.k - 1)), float)
            selection_sweep(rng, np.array(xx), np.array(xz), self.coef, self.delta, self.selection, intercept=(mean0, 1.0))
            self._sticks()
        elif kind == "probit_stick" and not self.extra.get("fixed"):
            for k in range(self.k - 1):
                at = np.flatnonzero(comp >= k)
                x, offset = self.coupling * self.a[at], (1 - self.coupling) * self.baseline[k]
                z = _truncated(rng, x @ self.coef[:, k] + offset, comp[at] > k) - offset if len(at) else np.zeros(0)
                rest = z - x @ self.coef[:, k]
                for c in range(x.shape[1]):
                    xc = x[:, c]
                    prior = 1.0 if c == 0 else 1.0 / self.sigma[k]
                    mean0 = self.extra.get("alpha0", np.zeros(self.k - 1))[k] if c == 0 else 0.0
                    rest += xc * self.coef[c, k]
                    info = xc @ xc + prior
                    new = (xc @ rest + prior * mean0) / info + rng.normal() / np.sqrt(info)
                    rest -= xc * new
                    self.coef[c, k] = new
                if x.shape[1] > 1:
                    tail = self.coef[1:, k]
                    self.sigma[k] = _inverse_chi2(rng, float(tail @ tail) + 4.0 * 0.5, len(tail) + 4.0)
            self._sticks()


def swap_options(op: CsrOperator, state: np.ndarray, min_r2: float, most: int) -> list[tuple[int, np.ndarray]]:
    """Every active marker that has excluded friends, with them."""
    near = [(int(k), op.friends(int(k), min_r2, most)) for k in np.flatnonzero(state > 0)]
    return [(k, f[state[f] == 0]) for k, f in near if (state[f] == 0).any()]


def _swap(op: CsrOperator, model: Model, rng: np.random.Generator, b: np.ndarray, comp: np.ndarray, log_prior: np.ndarray, yy: float, vei: float, scale: np.ndarray) -> None:
    """Move an effect to an excluded friend and back, with a Hastings correction."""
    active = np.flatnonzero(comp > 0)
    if not len(active):
        return

    options = lambda state: swap_options(op, state, model.swap_r2, model.swap_friends)

    def sse() -> float:
        return yy - float(b @ (op.residual() + op.wy))

    forward = options(comp)
    if not forward:
        return
    k, f = forward[rng.integers(len(forward))]
    j = int(f[rng.integers(len(f))])
    before, value, c = sse(), b[k], comp[k]
    other = comp.copy()
    other[k], other[j] = 0, c
    back = options(other)
    sizes = {a: len(x) for a, x in back}
    if j not in sizes:
        return
    op.move(k, -value)
    op.move(j, value)
    b[k], b[j] = 0.0, value
    ratio = -0.5 * (sse() - before) / vei + np.log(len(forward) * len(f)) - np.log(len(back) * sizes[j])
    ratio += log_prior[j, c] + log_prior[k, 0] - log_prior[k, c] - log_prior[j, 0]
    if scale[k] != scale[j]:
        ratio += 0.5 * (np.log(scale[k]) - np.log(scale[j])) - 0.5 * value**2 * (1 / scale[j] - 1 / scale[k])
    if np.log(rng.random()) < ratio:
        comp[k], comp[j] = 0, c
    else:
        op.move(j, -value)
        op.move(k, value)
        b[k], b[j] = value, 0.0


def pair_states(h: np.ndarray, diagonal: np.ndarray, cross: float, v: np.ndarray, log_prior: np.ndarray, noise: float) -> np.ndarray:
    """Log weights of all component pairs of two markers, both effects integrated out.

    ``h`` are their scores without either effect, ``diagonal`` and ``cross`` their X'X, ``v`` (2, components - 1)
    prior variances and ``log_prior`` (2, components).
    """
    h, info, link = h / noise, diagonal / noise, cross / noise
    p = info[:, None] + 1 / v
    out = log_prior[0][:, None] + log_prior[1][None, :]
    out[1:, 0] += 0.5 * h[0] ** 2 / p[0] - 0.5 * np.log(v[0] * p[0])
    out[0, 1:] += 0.5 * h[1] ** 2 / p[1] - 0.5 * np.log(v[1] * p[1])
    a, c = p[0][:, None], p[1][None, :]
    det = a * c - link * link
    out[1:, 1:] += 0.5 * (c * h[0] ** 2 - 2 * link * h[0] * h[1] + a * h[1] ** 2) / det - 0.5 * np.log(v[0][:, None] * v[1][None, :] * det)
    return out


def _pair(op: CsrOperator, model: Model, rng: np.random.Generator, b: np.ndarray, comp: np.ndarray, log_prior: np.ndarray, v: np.ndarray, noise: np.ndarray) -> None:
    """Draw the components and effects of a marker and one of its friends together."""
    k = int(rng.integers(len(b)))
    near = op.friends(k, model.pair_r2, model.swap_friends)
    if not len(near) or noise[k] != noise[near[0]]:
        return
    j = int(near[rng.integers(len(near))])
    # The pair is chosen without regard to the state, so drawing it from its conditional keeps the posterior.
    op.move(k, -b[k])
    op.move(j, -b[j])
    ids = np.array([k, j])
    h = np.array([op.score(k, 0.0), op.score(j, 0.0)])
    op.move(k, 1.0)
    cross = h[1] - op.score(j, 0.0)
    op.move(k, -1.0)
    lw = pair_states(h, op.ww[ids], cross, v[ids], log_prior[ids], noise[k])
    w = np.exp(lw - lw.max()).ravel()
    a, c = divmod(min(int(np.searchsorted(np.cumsum(w), rng.random() * w.sum(), side="right")), len(w) - 1), lw.shape[1])
    b[ids], comp[ids] = 0.0, (a, c)
    on = [n for n, x in enumerate((a, c)) if x]
    if on:
        at = ids[on]
        p = np.array([[op.ww[k], cross], [cross, op.ww[j]]])[np.ix_(on, on)] / noise[k] + np.diag([1 / v[i, comp[i] - 1] for i in at])
        root = np.linalg.cholesky(p)
        b[at] = np.linalg.solve(p, h[on] / noise[k]) + np.linalg.solve(root.T, rng.standard_normal(len(on)))
    for i in ids:
        op.move(int(i), b[i])


#: Markers that are looked at together: so many after one that moved, and four times as many after each look without any, up to the second.
WIDTH, MOST_WIDTH = 32, 4096


def choose(base: np.ndarray, slope: np.ndarray, score: np.ndarray, uniforms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The component of each marker by its uniform, and the probability of the null.

    Log weights are ``base``, and for the components but the null ``slope`` times the
    squared score more.
    """
    gain = slope * (score * score)[:, None]
    if base.shape[1] == 2:
        null = 1 / (1 + np.exp(np.minimum(base[:, 1] - base[:, 0] + gain[:, 0], 700.0)))
        return (null <= uniforms).astype(int), null
    logw = base.copy()
    logw[:, 1:] += gain
    p = np.exp(logw - logw.max(1, keepdims=True))
    cumulative = np.cumsum(p, 1)
    total = cumulative[:, -1]
    chosen = (cumulative[:, :-1] <= (uniforms * total)[:, None]).sum(1)
    return chosen, p[:, 0] / total


def weights_of(log_prior: np.ndarray, v: np.ndarray, ww: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`choose` needs: log weights at score 0, and slopes in half the squared score."""
    total = noise[:, None] + ww[:, None] * v
    base = log_prior.copy()
    base[:, 1:] += 0.5 * np.log(noise[:, None] / total)
    return base, 0.5 * v / (noise[:, None] * total)


def conditionals(op: CsrOperator, b: np.ndarray, *, vb: float, noise: float, gamma: tuple[float, ...], rows: np.ndarray, scale: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Component probabilities of every marker, given all other effects, and the mean of its effect.

    ``rows`` are prior probabilities by marker, or one row for all.
    """
    op.set_effects(b)
    m = len(b)
    v = vb * np.broadcast_to(scale, m)[:, None] * np.array(gamma)[1:]
    noise_of = np.full(m, float(noise))
    base, slope = weights_of(np.log(np.broadcast_to(rows, (m, len(gamma)))), v, op.ww, noise_of)
    score = op.residual() + op.ww * b
    base[:, 1:] += slope * np.square(score)[:, None]
    p = np.exp(base - base.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    return p, (p[:, 1:] * score[:, None] / (op.ww[:, None] + noise_of[:, None] / v)).sum(1)


def sample(op: CsrOperator, yy: float, n: float, model: Model, controls: ChainControls, seed: int, log_h: np.ndarray | None = None) -> dict:
    """One chain: posterior means, PIPs, component probabilities, traces, final state."""
    rng = np.random.default_rng(seed)
    m, gamma = len(op.wy), np.array(model.gamma)
    prior = Prior(model, m)
    weight = m * float((np.array(model.pi) * gamma).sum())
    cal = calibrate_prior(yy / n, model.h2, weight, model.nub, model.nue)
    vb, ve = model.vb or cal["vb"], model.ve or cal["ve"]
    s = 0.0 if model.maf_s is None else model.maf_s
    b, comp = np.zeros(m), np.zeros(m, int)
    if model.block_policy not in ("global", "fixed_block", "gctb_block") or model.block_policy != "global" and not isinstance(op, LowRankOperator):
        raise ValueError("block_policy is global, or with low-rank blocks fixed_block or gctb_block")
    block_ve = None if model.block_policy == "global" else np.full(len(op.q), yy / n)
    permanent = np.zeros(0 if block_ve is None else len(block_ve), bool)
    segments = op.segments(np.argsort(-np.square(op.wy / op.ww), kind="stable"))
    keep = set(controls.retained())
    sums, pips, comps, drawn = np.zeros(m), np.zeros(m), np.zeros((m, len(gamma))), 0
    traces: dict[str, list[float]] = {t: [] for t in TRACES}
    vg, drift = 0.0, 0.0
    due = np.zeros(m, int)
    inverse_cpo = np.full(len(op.e), -np.inf) if model.log_cpo and isinstance(op, GenotypeOperator) else None
    for it in range(1, controls.nburn + controls.nit + 1):
        vei = ve + model.adj_e * vg
        noise = np.full(m, vei) if block_ve is None else block_ve[op.block]
        mafq = np.exp((s + 1) * log_h) if log_h is not None else np.ones(m)
        q = prior.scale * mafq
        log_prior = np.log(prior.rows)
        uniforms, normals = rng.random(m), rng.standard_normal(m)
        ww = op.ww
        full = not model.skip_nulls or it % model.full_every == 1 or model.full_every == 1
        v = vb * q[:, None] * gamma[1:]
        base, slope = weights_of(log_prior, v, ww, noise)
        for part in segments:
            at, width = 0, WIDTH
            while at < len(part):
                ids = part[at : at + width]
                if not full:
                    ids = ids[(comp[ids] > 0) | (due[ids] <= it)]
                    if not len(ids):
                        at += width
                        continue
                # All of these at once, as the markers before the first that moves leave the residual as it is.
                score = op.scores(ids) + ww[ids] * b[ids]
                chosen, null = choose(base[ids], slope[ids], score, uniforms[ids])
                moving = np.flatnonzero((chosen > 0) | (comp[ids] > 0))
                quiet = ids[: moving[0]] if len(moving) else ids
                if model.skip_nulls:
                    skip = skip_length(1 - null[: len(quiet)], model.skip_nulls, model.skip_most)
                    due[quiet] = it + 1 + skip + rng.integers(0, skip + 1)
                if not len(moving):
                    at, width = at + width, min(4 * width, MOST_WIDTH)
                    continue
                first = int(moving[0])
                k, c, new = int(ids[first]), int(chosen[first]), 0.0
                if c:
                    info = ww[k] + noise[k] / v[k, c - 1]
                    new = score[first] / info + normals[k] * np.sqrt(noise[k] / info)
                elif model.skip_nulls:
                    skip = int(skip_length(1 - null[first : first + 1], model.skip_nulls, model.skip_most)[0])
                    due[k] = it + 1 + skip + int(rng.integers(0, skip + 1))
                op.move(k, new - b[k])
                b[k] = new
                if model.skip_nulls and (comp[k] == 0) != (c == 0):
                    due[op.friends(k, 0.01, m)] = 0
                comp[k] = c
                gone = int(np.flatnonzero(part[at : at + width] == k)[0]) + 1 if not full else first + 1
                at, width = at + gone, max(WIDTH, min(2 * gone, MOST_WIDTH))
        if model.swap and rng.random() < model.swap_prob:
            _swap(op, model, rng, b, comp, log_prior, yy, vei, vb * q)
        if model.pair_prob and rng.random() < model.pair_prob:
            _pair(op, model, rng, b, comp, log_prior, v, noise)
        if model.rebuild_every and it % model.rebuild_every == 0:
            drift = max(drift, op.rebuild(b))
        active = comp > 0
        if model.update_vb:
            ss = float((b[active] ** 2 / (gamma[comp[active]] * q[active])).sum())
            vb = _inverse_chi2(rng, ss + model.nub * cal["ssb_prior"], active.sum() + model.nub)
        if model.estimate_s and log_h is not None:
            def density(x: float) -> float:
                return float(-0.5 * ((x + 1) * log_h[active] + b[active] ** 2 / (vb * gamma[comp[active]] * np.exp((x + 1) * log_h[active]))).sum())

            new = s + rng.normal(0, 0.35)
            if -3 < new < 2 and np.log(rng.random()) < density(new) - density(s):
                s = new
        r = op.residual()
        sse = yy - float(b @ (r + op.wy))
        if model.update_ve:
            if sse + model.nue * cal["sse_prior"] <= 0:
                raise ValueError("the residual sum of squares is not positive: the LD and the statistics disagree")
            ve = (sse + model.nue * cal["sse_prior"]) / rng.chisquare(n + model.nue)
        if model.block_policy == "gctb_block":
            scale0 = (model.nue - 2) / model.nue * yy / n
            for k, (part_vg, effect_ss, residual_ss, rank) in enumerate(op.block_terms(b, n)):
                chosen, permanent[k] = block_selected(model.block_mode, it - 1, part_vg, effect_ss, model.block_threshold, bool(permanent[k]))
                draw = (residual_ss + model.nue * scale0) / rng.chisquare(model.nue + rank) if chosen else yy / n
                block_ve[k] = draw if draw / (yy / n) > model.block_least_ratio else yy / n
        if full:
            prior.update(rng, comp, b, vb)
        vg = float(b @ (op.wy - r)) / n
        vle = float(op.ww @ (b * b)) / n
        pi = float(1 - prior.rows[:, 0].mean())
        for t, x in zip(TRACES, (vb, vg, ve, pi, vle, vg - vle), strict=True):
            traces[t].append(x)
        if model.trace_markers:
            shares = np.bincount(comp, minlength=len(gamma)) / m
            more = {f"component:{k}": x for k, x in enumerate(shares)} | {f"probability:{k}": x for k, x in enumerate(np.broadcast_to(prior.rows, (m, len(gamma))).mean(0))}
            more |= {f"{name}:{k}": x for k in model.trace_markers for name, x in (("effect", b[k]), ("inclusion", float(comp[k] > 0)))}
            more |= {f"annotation:{i}:{k}": x for (i, k), x in np.ndenumerate(getattr(prior, "coef", np.zeros((0, 0))))}
            for t, x in more.items():
                traces.setdefault(t, []).append(float(x))
        if it > controls.nburn and it - controls.nburn in keep:
            sums += b
            pips += active
            comps[np.arange(m), comp] += 1
            drawn += 1
            if inverse_cpo is not None:
                density = -0.5 * (np.log(2 * np.pi * ve) + np.square(op.e) / ve)
                inverse_cpo = np.logaddexp(inverse_cpo, -density)
    drawn = max(drawn, 1)
    return {"effect": sums / drawn, "pip": pips / drawn, "component": comps / drawn, "traces": traces, "b": b, "state": comp, "s": s, "drift": drift, "prior": prior,
        "log_cpo": None if inverse_cpo is None else float((np.log(drawn) - inverse_cpo).sum())}


def fit_rows(key: tuple, out: dict) -> pd.DataFrame:
    """A chain's output as rows of ``OUTPUT``."""
    trait, chain = str(key[0]), int(key[1])
    m = len(out["effect"])
    ids = np.arange(m)
    parts = [("marker", 0, ids, q, out[q]) for q in ("effect", "pip")] + [("marker", 0, ids, "final_effect", out["b"]), ("marker", 0, ids, "state", out["state"])]
    parts += [("marker", 0, ids, f"component_{k}", out["component"][:, k]) for k in range(out["component"].shape[1])]
    frames = [pd.DataFrame({"kind": k, "iteration": i, "marker_idx": x, "quantity": q, "value": np.asarray(v, float)}) for k, i, x, q, v in parts]
    frames += [
        pd.DataFrame({"kind": "trace", "iteration": np.arange(1, len(v) + 1), "marker_idx": -1, "quantity": t, "value": v})
        for t, v in out["traces"].items()
    ]
    d = pd.concat(frames, ignore_index=True)
    d.insert(0, "chain", chain)
    d.insert(0, "trait", trait)
    return d.astype({"chain": "int32", "iteration": "int32", "marker_idx": "int32"})


@dataclass
class Fit:
    """Draws of a fit in long form and the tables read from it."""

    rows: DataFrame
    controls: ChainControls
    provenance: dict = field(default_factory=dict)

    def posterior(self) -> DataFrame:
        """trait, marker_idx, effect, pip: unweighted means over chains."""
        d = self.rows.filter("kind = 'marker' and quantity in ('effect', 'pip')")
        return d.groupBy("trait", "marker_idx").pivot("quantity", ["effect", "pip"]).agg(F.avg("value"))

    def components(self) -> DataFrame:
        """trait, marker_idx, component, prob."""
        d = self.rows.filter("kind = 'marker' and quantity like 'component_%'")
        return d.groupBy("trait", "marker_idx", F.substring_index("quantity", "_", -1).cast("int").alias("component")).agg(F.avg("value").alias("prob"))

    def traces(self) -> DataFrame:
        """trait, chain, iteration, quantity, value."""
        return self.rows.filter("kind = 'trace'").select("trait", "chain", "iteration", "quantity", "value")

    def final_state(self) -> DataFrame:
        """The last state of chain 0."""
        return self.rows.filter("kind = 'marker' and chain = 0 and quantity in ('final_effect', 'state')").select("trait", "marker_idx", "quantity", "value")


def chain_tasks(traits: DataFrame, controls: ChainControls, mode: str) -> DataFrame:
    """trait, chain, seed of every task; the traits of a fit are few."""
    names = [r[0] for r in traits.select("trait").distinct().orderBy("trait").collect()]
    rows = [(t, c, task_seed(controls, mode, t, c)) for t in names for c in range(controls.nchains)]
    return traits.sparkSession.createDataFrame(rows, "trait string, chain int, seed bigint")


def build_operator(kind: str, wy: np.ndarray, ww: np.ndarray, i: np.ndarray, j: np.ndarray, r: np.ndarray, block_size: int = 256, extra: dict | None = None) -> CsrOperator:
    """The likelihood of summary statistics by LD edges: csr, low_rank, or dense blocks through a filter."""
    if kind == "csr":
        return CsrOperator(wy, ww, i, j, r)
    extra, low, dense = extra or {}, [], []
    for start in range(0, len(wy), block_size):
        end = min(start + block_size, len(wy))
        corr, inside = np.eye(end - start), (np.minimum(i, j) >= start) & (np.maximum(i, j) < end)
        corr[i[inside] - start, j[inside] - start] = corr[j[inside] - start, i[inside] - start] = r[inside]
        part = slice(start, end)
        if kind == "low_rank":
            low.append((start, *low_rank_block(corr, wy[part], ww[part], extra.get("eigen_prop", 0.995))))
        else:
            options = {k: extra[k] for k in ("tau", "eta", "weight") if k in extra}
            dense.append((start, filtered_block(corr, kind, **options), wy[part], ww[part]))
    return LowRankOperator(low) if kind == "low_rank" else BlockOperator(dense)


def fit_summary(stats: DataFrame, edges: DataFrame, model: Model, controls: ChainControls, operator: str = "csr", block_size: int = 256, log_h: np.ndarray | None = None) -> Fit:
    """Fit from trait, marker_idx (dense from 0), wy, ww, yy, n and LD edges.

    ``operator`` is csr; low_rank, LD blocks of ``block_size`` markers by their leading
    eigenvectors; or a filter of :func:`filtered_block` on dense blocks.
    """
    tasks = chain_tasks(stats, controls, "summary")
    left = stats.join(F.broadcast(tasks), "trait")
    right = edges.select("i", "j", "r").crossJoin(F.broadcast(tasks.select(F.col("trait").alias("of_trait"), F.col("chain").alias("of_chain"))))

    def task(key: tuple, s: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        s = s.sort_values("marker_idx")
        i, j, r = e["i"].to_numpy(int), e["j"].to_numpy(int), e["r"].to_numpy(float)
        op = build_operator(operator, s["wy"].to_numpy(float), s["ww"].to_numpy(float), i, j, r, block_size, model.extra)
        return fit_rows(key, sample(op, float(s["yy"].iloc[0]), float(s["n"].iloc[0]), model, controls, int(s["seed"].iloc[0]), log_h))

    rows = left.groupBy("trait", "chain").cogroup(right.groupBy("of_trait", "of_chain")).applyInPandas(task, OUTPUT)
    return Fit(rows, controls, {"operator": operator, "policy": model.policy, "gamma": model.gamma})


def at_effects(stats: DataFrame, edges: DataFrame, effects: DataFrame, table, schema: str, operator: str = "csr", block_size: int = 256, extra: dict | None = None) -> DataFrame:
    """A table about each trait's likelihood operator at fixed effects (marker_idx, effect): ``table(op, b, yy, n)`` in one task a trait."""
    left = stats.join(effects, "marker_idx")
    right = edges.select("i", "j", "r").crossJoin(F.broadcast(stats.select(F.col("trait").alias("of_trait")).distinct()))

    def task(key: tuple, s: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        s = s.sort_values("marker_idx")
        op = build_operator(operator, s["wy"].to_numpy(float), s["ww"].to_numpy(float), e["i"].to_numpy(int), e["j"].to_numpy(int), e["r"].to_numpy(float), block_size, extra)
        out = table(op, s["effect"].to_numpy(float), float(s["yy"].iloc[0]), float(s["n"].iloc[0]))
        out.insert(0, "trait", str(key[0]))
        return out

    return left.groupBy("trait").cogroup(right.groupBy("of_trait")).applyInPandas(task, "trait string, " + schema)


def conditional_table(model: Model, vb: float, ve_share: float):
    """For :func:`at_effects`: marker_idx, component, prob, mean at a residual variance of ``ve_share`` of the phenotype's."""

    def table(op: CsrOperator, b: np.ndarray, yy: float, n: float) -> pd.DataFrame:
        prior = Prior(model, len(b))
        p, mean = conditionals(op, b, vb=vb, noise=ve_share * yy / n, gamma=model.gamma, rows=prior.rows, scale=prior.scale)
        m, k = p.shape
        return pd.DataFrame({"marker_idx": np.repeat(np.arange(m), k), "component": np.tile(np.arange(k), m), "prob": p.ravel(), "mean": np.repeat(mean, k)})

    return table


CONDITIONALS = "marker_idx int, component int, prob double, mean double"


def dosage_array(rows: pd.Series) -> np.ndarray:
    """Dosages of a column of arrays as one matrix, nan for missing ones."""
    g, seen = dosage_matrix(pa.array(rows, pa.list_(pa.float64())))
    return np.where(seen > 0, g, np.nan)


def standardise(g: np.ndarray) -> np.ndarray:
    """(g - 2p) / sqrt(2p(1-p)), 0 for missing (nan) and monomorphic markers."""
    p = np.nan_to_num(np.nanmean(g, axis=0) / 2)
    s = np.sqrt(2 * p * (1 - p))
    return np.nan_to_num(np.where(s > 0, (g - 2 * p) / np.where(s > 0, s, 1), 0.0))


def fit_genotypes(panel: DataFrame, traits: DataFrame, model: Model, controls: ChainControls, log_h: np.ndarray | None = None) -> Fit:
    """Fit from individual genotypes: one task holds the samples of its trait."""
    tasks = chain_tasks(traits, controls, "genotypes")
    d = panel.join(traits.filter("y is not null"), "sample_idx").join(F.broadcast(tasks), "trait")

    def task(key: tuple, s: pd.DataFrame) -> pd.DataFrame:
        s = s.sort_values("sample_idx")
        g = dosage_array(s["dosages"])
        y = s["y"].to_numpy(float)
        op = GenotypeOperator(standardise(g), y)
        return fit_rows(key, sample(op, float(y @ y), float(len(y)), model, controls, int(s["seed"].iloc[0]), log_h))

    return Fit(d.groupBy("trait", "chain").applyInPandas(task, OUTPUT), controls, {"operator": "genotypes", "policy": model.policy, "gamma": model.gamma})


def genotype_conditionals(panel: DataFrame, traits: DataFrame, effects: np.ndarray, model: Model, vb: float, ve_share: float) -> DataFrame:
    """trait, marker_idx, component, prob, mean at fixed effects, from the samples themselves."""
    table = conditional_table(model, vb, ve_share)

    def task(key: tuple, s: pd.DataFrame) -> pd.DataFrame:
        s = s.sort_values("sample_idx")
        y = s["y"].to_numpy(float)
        g = dosage_array(s["dosages"])
        out = table(GenotypeOperator(standardise(g), y), effects, float(y @ y), float(len(y)))
        out.insert(0, "trait", str(key[0]))
        return out

    d = panel.join(traits.filter("y is not null"), "sample_idx")
    return d.groupBy("trait").applyInPandas(task, "trait string, " + CONDITIONALS)


def brute_force_pips(wy: np.ndarray, ww: np.ndarray, xtx: np.ndarray, vb: float, ve: float, pi: float) -> np.ndarray:
    """Exact PIPs of a small spike-and-slab model by enumeration, for tests."""
    m = len(wy)
    total, pips = 0.0, np.zeros(m)
    logs, states = [], []
    for state in range(1 << m):
        a = [k for k in range(m) if state >> k & 1]
        lp = len(a) * np.log(pi) + (m - len(a)) * np.log1p(-pi)
        if a:
            p = xtx[np.ix_(a, a)] / ve + np.eye(len(a)) / vb
            u = wy[a] / ve
            lp += 0.5 * u @ np.linalg.solve(p, u) - 0.5 * np.linalg.slogdet(p)[1] - 0.5 * len(a) * np.log(vb)
        logs.append(lp)
        states.append(a)
    w = np.exp(np.array(logs) - max(logs))
    total = w.sum()
    for x, a in zip(w, states, strict=True):
        pips[a] += x / total
    return pips


