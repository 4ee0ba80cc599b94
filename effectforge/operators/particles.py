"""Sequential Monte Carlo over the markers of an LD block, and Metropolis moves on its estimates.

Effects are integrated out: a particle is the components of the markers so far, with the exact
Gaussian posterior of their effects, which takes one marker more by a rank-one update.  The
product of mean weights is an unbiased estimate of the block's evidence, the prior's sum
over all component states, so a chain that accepts on the ratio of two estimates has the
exact posterior.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Block:
    """X'y, X'X and the residual variance of one block of markers."""

    wy: np.ndarray
    xtx: np.ndarray
    noise: float


@dataclass
class Cloud:
    """Particles after all markers: log evidence, components (particles, markers), mean effects, and their log weights."""

    log_evidence: float
    states: np.ndarray
    means: np.ndarray
    log_weights: np.ndarray
    resampled: int

    def draw(self, rng: np.random.Generator) -> np.ndarray:
        """The components of one particle by weight."""
        w = np.exp(self.log_weights - self.log_weights.max())
        return self.states[rng.choice(len(w), p=w / w.sum())]

    def inclusion(self) -> np.ndarray:
        """Weighted inclusion probabilities."""
        w = np.exp(self.log_weights - self.log_weights.max())
        return (w / w.sum()) @ (self.states > 0)


def run_particles(block: Block, v: np.ndarray, log_prior: np.ndarray, rng: np.random.Generator, particles: int = 256, least_ess: float = 0.5, bold: float = 0.3) -> Cloud:
    """Take the markers one by one, the strongest first, so that the others are judged on what it leaves; ``v`` are variances of the components but the null, ``log_prior`` (markers, components).

    A particle draws a marker's component from its exact conditional given the components before,
    but for a share ``bold`` of the probability that all components have alike: without it no
    particle would pass by the first of two correlated markers that the later one explains.
    Where fewer than ``least_ess`` of the particles count, they are drawn anew, systematically; doing
    so at every marker would lose, of correlated markers, all but the first.
    """
    m, p = len(block.wy), particles
    states, mean, cov = np.zeros((p, m), int), np.zeros((p, m)), np.zeros((p, m, m))
    lw, evidence, resampled = np.zeros(p), 0.0, 0
    order = np.argsort(-np.square(block.wy) / np.diag(block.xtx), kind="stable")
    for place, t in enumerate(order):
        link = block.xtx[t] / block.noise
        spread = cov @ link
        info = link[t] - spread @ link
        h = block.wy[t] / block.noise - mean @ link
        gain = 1 + info[:, None] * v
        logs = np.column_stack([np.full(p, log_prior[t, 0]), log_prior[t, 1:] + 0.5 * (h * h)[:, None] * v / gain - 0.5 * np.log(gain)])
        top = logs.max(1, keepdims=True)
        q = np.exp(logs - top)
        q = (1 - bold) * q / q.sum(1, keepdims=True) + bold / q.shape[1]
        states[:, t] = (np.cumsum(q, 1)[:, :-1] <= rng.random(p)[:, None]).sum(1)
        lw = lw + logs[np.arange(p), states[:, t]] - np.log(q[np.arange(p), states[:, t]])
        on = np.flatnonzero(states[:, t])
        if len(on):
            var = v[states[on, t] - 1] / gain[on, states[on, t] - 1]
            step = -spread[on]
            step[:, t] = 1.0
            cov[on] += var[:, None, None] * step[:, :, None] * step[:, None, :]
            mean[on] += step * (var * h[on])[:, None]
        w = np.exp(lw - lw.max())
        if place < m - 1 and w.sum() ** 2 < least_ess * p * (w * w).sum():
            evidence += lw.max() + np.log(w.mean())
            at = np.minimum(np.searchsorted(np.cumsum(w) / w.sum(), (np.arange(p) + rng.random()) / p, side="right"), p - 1)
            states, mean, cov, lw, resampled = states[at], mean[at], cov[at], np.zeros(p), resampled + 1
    return Cloud(float(evidence + lw.max() + np.log(np.exp(lw - lw.max()).mean())), states, mean, lw, resampled)


def exact_evidence(block: Block, v: np.ndarray, log_prior: np.ndarray) -> float:
    """The log evidence by enumeration of all component states; for few markers."""
    m, k = log_prior.shape
    if k**m > 1 << 20:
        raise ValueError("too many states to enumerate")
    logs = []
    for state in np.ndindex(*(k,) * m):
        a = np.flatnonzero(state)
        lw = float(log_prior[np.arange(m), state].sum())
        if len(a):
            var = v[np.array(state)[a] - 1]
            p = block.xtx[np.ix_(a, a)] / block.noise + np.diag(1 / var)
            u = block.wy[a] / block.noise
            lw += 0.5 * float(u @ np.linalg.solve(p, u)) - 0.5 * np.linalg.slogdet(p)[1] - 0.5 * float(np.log(var).sum())
        logs.append(lw)
    return float(np.logaddexp.reduce(logs))


def block_step(block: Block, v: np.ndarray, log_prior: np.ndarray, now: Cloud, state: np.ndarray, rng: np.random.Generator, particles: int = 256) -> tuple[Cloud, np.ndarray, bool]:
    """A particle independence move of a block's components: a fresh cloud, accepted on the ratio of the evidences."""
    new = run_particles(block, v, log_prior, rng, particles)
    if np.log(rng.random()) < new.log_evidence - now.log_evidence:
        return new, new.draw(rng), True
    return now, state, False


def over_blocks(stats: DataFrame, edges: DataFrame, size: int, ve_share: float, table, schema: str) -> DataFrame:
    """``table(block, first marker, key)`` of every block of ``size`` markers and trait, a task each; correlations across blocks are left out."""
    of = lambda c: F.floor(F.col(c) / size).cast("int")
    left = stats.withColumn("block", of("marker_idx"))
    names = stats.select(F.col("trait").alias("of_trait")).distinct()
    right = edges.filter(of("i") == of("j")).select(of("i").alias("of_block"), "i", "j", "r").crossJoin(F.broadcast(names))

    def task(key: tuple, s: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(s):
            return pd.DataFrame()
        s = s.sort_values("marker_idx")
        start, ww = int(s["marker_idx"].iloc[0]), s["ww"].to_numpy(float)
        corr = np.eye(len(s))
        i, j = e["i"].to_numpy(int) - start, e["j"].to_numpy(int) - start
        corr[i, j] = corr[j, i] = e["r"].to_numpy(float)
        noise = ve_share * float(s["yy"].iloc[0]) / float(s["n"].iloc[0])
        out = table(Block(s["wy"].to_numpy(float), corr * np.sqrt(np.outer(ww, ww)), noise), start, key)
        out.insert(0, "block", key[1])
        out.insert(0, "trait", key[0])
        return out

    return left.groupBy("trait", "block").cogroup(right.groupBy("of_trait", "of_block")).applyInPandas(task, "trait string, block int, " + schema)


def _rng(key: tuple, *more: int) -> np.random.Generator:
    return np.random.default_rng([*map(ord, str(key[0])), int(key[1]), *more])


def block_evidence(stats: DataFrame, edges: DataFrame, *, size: int, vb: float, ve_share: float, gamma: tuple[float, ...], pi: tuple[float, ...], particles: int = 256, seed: int = 1) -> DataFrame:
    """trait, block, log_evidence, resampled of every LD block by its particles."""

    def table(block: Block, start: int, key: tuple) -> pd.DataFrame:
        cloud = run_particles(block, vb * np.array(gamma)[1:], np.tile(np.log(pi), (len(block.wy), 1)), _rng(key, seed), particles)
        return pd.DataFrame([{"log_evidence": cloud.log_evidence, "resampled": cloud.resampled}])

    return over_blocks(stats, edges, size, ve_share, table, "log_evidence double, resampled int")


def particle_inclusion(stats: DataFrame, edges: DataFrame, *, size: int, vb: float, ve_share: float, gamma: tuple[float, ...], pi: tuple[float, ...], moves: int = 100, particles: int = 128, seed: int = 1) -> DataFrame:
    """trait, block, marker_idx, pip, accepted by particle independence moves in every block."""

    def table(block: Block, start: int, key: tuple) -> pd.DataFrame:
        rng, v, prior = _rng(key, seed, 1), vb * np.array(gamma)[1:], np.tile(np.log(pi), (len(block.wy), 1))
        now = run_particles(block, v, prior, rng, particles)
        state, pips, accepted = now.draw(rng), np.zeros(len(block.wy)), 0
        for _ in range(moves):
            now, state, new = block_step(block, v, prior, now, state, rng, particles)
            # The weighted particles of the cloud that stands say more than the one drawn.
            pips += now.inclusion()
            accepted += new
        m = len(pips)
        return pd.DataFrame({"marker_idx": np.arange(start, start + m), "pip": pips / moves, "accepted": accepted / moves})

    return over_blocks(stats, edges, size, ve_share, table, "marker_idx int, pip double, accepted double")


def marginal_moves(stats: DataFrame, edges: DataFrame, *, size: int, vb: float, ve_share: float, pi: float = 0.05, prior: tuple[float, float] = (1.0, 19.0), steps: int = 50, walk: float = 0.5, particles: int = 128, seed: int = 1) -> pd.DataFrame:
    """step, pi, log_evidence, accepted: a particle-marginal chain of the inclusion probability of one trait.

    Each step is one Spark job over the blocks at the proposed value; the sum of their log
    evidences, one number, comes back.  The prior is Beta, the walk on the logit.
    """
    rng, rows = np.random.default_rng(seed), []

    def evidence(p: float, step: int) -> float:
        out = block_evidence(stats, edges, size=size, vb=vb, ve_share=ve_share, gamma=(0.0, 1.0), pi=(1 - p, p), particles=particles, seed=seed * 100_003 + step)
        return float(out.agg(F.sum("log_evidence")).first()[0])

    # The prior of the logit is that of the probability times p (1 - p).
    log_prior = lambda p: prior[0] * np.log(p) + prior[1] * np.log1p(-p)
    now = evidence(pi, 0)
    for step in range(1, steps + 1):
        x = np.log(pi / (1 - pi)) + rng.normal(0, walk)
        new = float(np.clip(1 / (1 + np.exp(-x)), 1e-9, 1 - 1e-9))
        found = evidence(new, step)
        accepted = bool(np.log(rng.random()) < found - now + log_prior(new) - log_prior(pi))
        if accepted:
            pi, now = new, found
        rows.append((step, pi, now, accepted))
    return pd.DataFrame(rows, columns=["step", "pi", "log_evidence", "accepted"])
