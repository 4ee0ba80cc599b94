"""Joint multi-trait sampler over activity patterns and variance scales."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectforge.operators.genotypes import allele_freq, dosage_matrix
from effectforge.operators.priors import ChainControls, task_seed
from effectforge.operators.samplers import CsrOperator, dosage_array, standardise

OUTPUT = "chain int, kind string, iteration int, marker_idx int, trait string, quantity string, value double"
MAX_TRAITS = 12


def patterns(traits: int) -> np.ndarray:
    """All 2^T activity patterns as rows of booleans, the first trait least significant."""
    if not 2 <= traits <= MAX_TRAITS:
        raise ValueError(f"between 2 and {MAX_TRAITS} traits")
    return (np.arange(1 << traits)[:, None] >> np.arange(traits)) & 1 == 1


def pattern_log_weights(u: np.ndarray, info: np.ndarray, v: np.ndarray, log_pi: np.ndarray, active: np.ndarray) -> np.ndarray:
    """log pi - log|V_aa| / 2 - log|P| / 2 + u'm / 2 with P = V_aa^-1 + info_aa, m = P^-1 u."""
    out = log_pi.copy()
    for k, a in enumerate(active):
        if a.any():
            va = v[np.ix_(a, a)]
            p = np.linalg.inv(va) + info[np.ix_(a, a)]
            out[k] += 0.5 * u[a] @ np.linalg.solve(p, u[a]) - 0.5 * np.linalg.slogdet(p)[1] - 0.5 * np.linalg.slogdet(va)[1]
    return out


def inverse_wishart(rng: np.random.Generator, df: float, scale: np.ndarray) -> np.ndarray:
    """A draw by Bartlett's decomposition of the inverse."""
    t = len(scale)
    a = np.tril(rng.standard_normal((t, t)), -1)
    a[np.diag_indices(t)] = np.sqrt(rng.chisquare(df - np.arange(t)))
    root = np.linalg.cholesky(np.linalg.inv(scale)) @ a
    return np.linalg.inv(root @ root.T)


def complete(rng: np.random.Generator, active: np.ndarray, value: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Latent effects of the inactive traits from their conditional normal."""
    out = value.copy()
    off = ~active
    if off.any():
        mean, cov = np.zeros(off.sum()), v[np.ix_(off, off)]
        if active.any():
            w = np.linalg.solve(v[np.ix_(active, active)], v[np.ix_(active, off)]).T
            mean, cov = w @ value[active], cov - w @ v[np.ix_(active, off)]
        out[off] = mean + np.linalg.cholesky(cov + 1e-12 * np.eye(off.sum())) @ rng.standard_normal(off.sum())
    return out


def sample_joint(
    scores,
    move,
    information,
    m: int,
    traits: int,
    controls: ChainControls,
    seed: int,
    *,
    vb: np.ndarray,
    vb_df: float,
    vb_scale: np.ndarray,
    gamma: tuple[float, ...] = (1.0,),
    pattern_pi: np.ndarray | None = None,
    pattern_strength: float = 1.0,
    after=None,
) -> dict:
    """One chain; ``scores(k, b)`` and ``information(k)`` give a marker's likelihood."""
    rng = np.random.default_rng(seed)
    active = patterns(traits)
    states = [(0, 0)] + [(p, g) for p in range(1, len(active)) for g in range(len(gamma))]
    pi = np.full(len(active), 1 / len(active)) if pattern_pi is None else np.asarray(pattern_pi, float)
    omega = np.full(len(gamma), 1 / len(gamma))
    prior_pi = pi * pattern_strength * len(active)
    b, latent = np.zeros((m, traits)), np.zeros((m, traits))
    state = np.zeros(m, int)
    scale = np.zeros(m, int)
    effect, pip, drawn = np.zeros((m, traits)), np.zeros((m, traits)), 0
    keep, traces = set(controls.retained()), []
    for it in range(1, controls.nburn + controls.nit + 1):
        log_pi = np.log(np.maximum(pi, 1e-300))
        for k in range(m):
            u, info = scores(k, b[k]), information(k)
            logw = np.empty(len(states))
            per = [pattern_log_weights(u, info, vb * g, log_pi, active) + np.log(omega[n]) for n, g in enumerate(gamma)]
            for n, (p, g) in enumerate(states):
                logw[n] = per[g][p] if p else log_pi[0]
            w = np.exp(logw - logw.max())
            n = min(int(np.searchsorted(np.cumsum(w), rng.random() * w.sum(), side="right")), len(states) - 1)
            p, g = states[n]
            a, new = active[p], np.zeros(traits)
            if p:
                v = vb[np.ix_(a, a)] * gamma[g]
                prec = np.linalg.inv(v) + info[np.ix_(a, a)]
                root = np.linalg.cholesky(prec)
                new[a] = np.linalg.solve(prec, u[a]) + np.linalg.solve(root.T, rng.standard_normal(a.sum()))
            if (new != b[k]).any():
                move(k, new - b[k])
                b[k] = new
            latent[k] = complete(rng, a, new / np.sqrt(gamma[g]), vb) if p else np.nan
            state[k], scale[k] = p, g
        on = state > 0
        x = latent[on]
        vb = inverse_wishart(rng, vb_df + on.sum(), vb_scale + x.T @ x)
        pi = rng.dirichlet(prior_pi + np.bincount(state, minlength=len(active)))
        omega = rng.dirichlet(1.0 + np.bincount(scale[on], minlength=len(gamma)))
        if after is not None:
            after(rng, b)
        traces.append(vb[np.tril_indices(traits)])
        if it > controls.nburn and it - controls.nburn in keep:
            effect += b
            pip += active[state]
            drawn += 1
    drawn = max(drawn, 1)
    return {"effect": effect / drawn, "pip": pip / drawn, "vb": np.array(traces), "pattern_pi": pi, "b": b}


def _rows(chain: int, traits: list[str], out: dict) -> pd.DataFrame:
    m = len(out["effect"])
    frames = [
        pd.DataFrame({"kind": "marker", "iteration": 0, "marker_idx": np.arange(m), "trait": t, "quantity": q, "value": out[q][:, k]})
        for q in ("effect", "pip")
        for k, t in enumerate(traits)
    ]
    for c, (a, b) in enumerate(zip(*np.tril_indices(len(traits)), strict=True)):
        v = out["vb"][:, c]
        frames.append(
            pd.DataFrame({"kind": "trace", "iteration": np.arange(1, len(v) + 1), "marker_idx": -1, "trait": f"{traits[a]}:{traits[b]}", "quantity": "vb", "value": v})
        )
    d = pd.concat(frames, ignore_index=True)
    d.insert(0, "chain", chain)
    return d.astype({"chain": "int32", "iteration": "int32", "marker_idx": "int32"})


class ProviderSet:
    """The joint likelihood of providers that each know some of the markers, by LD of their own.

    A provider has one trait, a residual scale by which its scores are divided, and an
    operator over its own markers; ``at`` maps a global marker to its place there, -1 where
    the provider does not have it.  Scores and information of a trait add up over its
    providers; a trait without one at a marker has none there, and its effect follows the prior.
    """

    def __init__(self, m: int, traits: int) -> None:
        self.m, self.traits = m, traits
        self.members: list[tuple[int, float, np.ndarray, CsrOperator]] = []

    def add(self, trait: int, scale: float, ids: np.ndarray, wy: np.ndarray, ww: np.ndarray, i: np.ndarray, j: np.ndarray, r: np.ndarray) -> None:
        """A provider of the global markers ``ids``; edges (i, j, r) are in global numbers, and those of markers it does not have fall out."""
        at = np.full(self.m, -1)
        at[ids] = np.arange(len(ids))
        i, j = at[i], at[j]
        both = (i >= 0) & (j >= 0)
        self.members.append((trait, scale, at, CsrOperator(wy, ww, i[both], j[both], r[both])))

    def scores(self, k: int, b: np.ndarray) -> np.ndarray:
        """X'e of one marker by trait over the residual scales, its own effects added back."""
        u = np.zeros(self.traits)
        for trait, scale, at, op in self.members:
            if at[k] >= 0:
                u[trait] += op.score(at[k], b[trait]) / scale
        return u

    def information(self, k: int) -> np.ndarray:
        info = np.zeros(self.traits)
        for trait, scale, at, op in self.members:
            if at[k] >= 0:
                info[trait] += op.ww[at[k]] / scale
        return np.diag(info)

    def move(self, k: int, change: np.ndarray) -> None:
        for trait, _, at, op in self.members:
            if at[k] >= 0:
                op.move(at[k], change[trait])

    def set_effects(self, b: np.ndarray) -> None:
        for trait, _, at, op in self.members:
            own = np.zeros(len(op.wy))
            own[at[at >= 0]] = b[at >= 0, trait]
            op.set_effects(own)


def _provider_set(local: pd.DataFrame, edges: pd.DataFrame, m: int, names: list[str]) -> ProviderSet:
    """Providers in the order of their names, from rows of provider_id, trait, residual_scale, global_idx, score, ww and of provider_id, i, j, r."""
    found = ProviderSet(m, len(names))
    linked = dict(tuple(edges.groupby("of_provider")))
    none = edges.iloc[:0]
    for name, part in local.sort_values(["provider_id", "global_idx"]).groupby("provider_id"):
        e = linked.get(name, none)
        found.add(
            names.index(part["trait"].iloc[0]), float(part["residual_scale"].iloc[0]), part["global_idx"].to_numpy(int), part["score"].to_numpy(float), part["ww"].to_numpy(float),
            e["i"].to_numpy(int), e["j"].to_numpy(int), e["r"].to_numpy(float),
        )
    return found


def _by_chain(local: DataFrame, edges: DataFrame, providers: DataFrame, tasks: DataFrame):
    """Providers' statistics and edges with every chain, cogrouped by it."""
    scales = providers.select("provider_id", "trait", F.col("residual_scale").cast("double").alias("residual_scale"))
    left = local.select("provider_id", "global_idx", "score", "ww").join(scales, "provider_id").crossJoin(F.broadcast(tasks))
    right = edges.select(F.col("provider_id").alias("of_provider"), "i", "j", "r").crossJoin(F.broadcast(tasks.select(F.col("chain").alias("of_chain"))))
    return left.groupBy("chain").cogroup(right.groupBy("of_chain"))


def fit_providers(local: DataFrame, edges: DataFrame, providers: DataFrame, markers: DataFrame, controls: ChainControls, *, vb: np.ndarray, vb_df: float, vb_scale: np.ndarray, gamma: tuple[float, ...] = (1.0,)) -> DataFrame:
    """Joint fit of independent providers, each with its own markers and LD.

    ``local`` has provider_id, global_idx, score (X'y) and ww of each provider's markers,
    ``edges`` provider_id, i, j, r in global numbers, ``providers`` provider_id, trait and
    residual_scale, ``markers`` every global_idx, dense from 0.  Several providers may serve
    a trait.  A task holds all providers of a chain.
    """
    names = [r[0] for r in providers.select("trait").distinct().orderBy("trait").collect()]
    m = markers.count()
    tasks = local.sparkSession.createDataFrame([(c, task_seed(controls, "joint", "", c)) for c in range(controls.nchains)], "chain int, seed bigint")

    def task(key: tuple, s: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        found = _provider_set(s, e, m, names)
        out = sample_joint(found.scores, found.move, found.information, m, len(names), controls, int(s["seed"].iloc[0]), vb=vb, vb_df=vb_df, vb_scale=vb_scale, gamma=gamma)
        return _rows(int(key[0]), names, out)

    return _by_chain(local, edges, providers, tasks).applyInPandas(task, OUTPUT)


def provider_patterns(local: DataFrame, edges: DataFrame, providers: DataFrame, effects: DataFrame, markers: DataFrame, v: np.ndarray, pi: np.ndarray) -> DataFrame:
    """marker_idx, pattern, prob of the activity patterns at each global marker, given all other effects (trait, global_idx, effect).

    These are the conditional probabilities of :func:`fit_providers` at fixed effects.
    """
    names = [r[0] for r in providers.select("trait").distinct().orderBy("trait").collect()]
    m, active = markers.count(), patterns(len(names))
    fixed = effects.select("trait", "global_idx", "effect").join(F.broadcast(providers.select("trait").distinct()), "trait").select(
        F.lit(None).cast("string").alias("provider_id"), "global_idx", F.col("effect").alias("score"), F.lit(0.0).alias("ww"), "trait", F.lit(0.0).alias("residual_scale"), F.lit(0).alias("chain"), F.lit(0).cast("bigint").alias("seed")
    )
    tasks = local.sparkSession.createDataFrame([(0, 0)], "chain int, seed bigint")
    scales = providers.select("provider_id", "trait", F.col("residual_scale").cast("double").alias("residual_scale"))
    left = local.select("provider_id", "global_idx", F.col("score").cast("double").alias("score"), F.col("ww").cast("double").alias("ww")).join(scales, "provider_id").crossJoin(F.broadcast(tasks))
    right = edges.select(F.col("provider_id").alias("of_provider"), "i", "j", "r").withColumn("of_chain", F.lit(0))

    def task(key: tuple, s: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        given = s["provider_id"].isna()
        found, b = _provider_set(s[~given], e, m, names), np.zeros((m, len(names)))
        b[s["global_idx"][given].to_numpy(int), [names.index(t) for t in s["trait"][given]]] = s["score"][given]
        found.set_effects(b)
        logw = np.array([pattern_log_weights(found.scores(k, b[k]), found.information(k), v, np.log(pi), active) for k in range(m)])
        w = np.exp(logw - logw.max(1, keepdims=True))
        w /= w.sum(1, keepdims=True)
        return pd.DataFrame({"marker_idx": np.repeat(np.arange(m), len(active)), "pattern": np.tile(np.arange(len(active)), m), "prob": w.ravel()})

    both = left.unionByName(fixed)
    return both.groupBy("chain").cogroup(right.groupBy("of_chain")).applyInPandas(task, "marker_idx int, pattern int, prob double")


def same_ld(stats: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """local, edges, providers and markers for :func:`fit_providers` where each trait is one provider of all markers and LD is the same for all.

    A provider's residual scale is yy / n.
    """
    providers = stats.groupBy("trait").agg((F.first("yy") / F.first("n")).alias("residual_scale")).select(F.col("trait").alias("provider_id"), "trait", "residual_scale")
    local = stats.select(F.col("trait").alias("provider_id"), F.col("marker_idx").alias("global_idx"), F.col("wy").alias("score"), "ww")
    each = edges.select("i", "j", "r").crossJoin(F.broadcast(providers.select("provider_id")))
    return local, each, providers, stats.select(F.col("marker_idx").alias("global_idx")).distinct()


def fit_joint_genotypes(panel: DataFrame, traits: DataFrame, controls: ChainControls, *, ve: np.ndarray, vb: np.ndarray, vb_df: float, vb_scale: np.ndarray, ve_df: float | None = None, gamma: tuple[float, ...] = (1.0,)) -> DataFrame:
    """Joint fit on genotypes with a full residual covariance, sampled if ``ve_df`` is given."""
    names = [r[0] for r in traits.select("trait").distinct().orderBy("trait").collect()]
    wide = traits.groupBy("sample_idx").pivot("trait", names).agg(F.first("y")).dropna()
    tasks = traits.sparkSession.createDataFrame([(c, task_seed(controls, "joint", "", c)) for c in range(controls.nchains)], "chain int, seed bigint")
    d = panel.join(wide, "sample_idx").crossJoin(F.broadcast(tasks))

    def task(key: tuple, s: pd.DataFrame) -> pd.DataFrame:
        s = s.sort_values("sample_idx")
        z = standardise(dosage_array(s["dosages"]))
        e = s[names].to_numpy(float).copy()
        xx = np.square(z).sum(0)
        box = {"ve": ve, "inv": np.linalg.inv(ve)}

        def move(k: int, change: np.ndarray) -> None:
            e[:] -= np.outer(z[:, k], change)

        def after(rng: np.random.Generator, b: np.ndarray) -> None:
            if ve_df is not None:
                box["ve"] = inverse_wishart(rng, ve_df + len(e), ve * max(ve_df - len(names) - 1, 1e-3) + e.T @ e)
                box["inv"] = np.linalg.inv(box["ve"])

        out = sample_joint(
            lambda k, b: box["inv"] @ (z[:, k] @ e + xx[k] * b), move, lambda k: xx[k] * box["inv"],
            z.shape[1], len(names), controls, int(s["seed"].iloc[0]), vb=vb, vb_df=vb_df, vb_scale=vb_scale, gamma=gamma, after=after,
        )
        return _rows(int(key[0]), names, out)

    return d.groupBy("chain").applyInPandas(task, OUTPUT)


def genotype_patterns(panel: DataFrame, traits: DataFrame, effects: np.ndarray, ve: np.ndarray, v: np.ndarray, pi: np.ndarray) -> DataFrame:
    """marker_idx, pattern, prob of the activity patterns at each marker, at fixed effects (markers, traits) and residual covariance.

    These are the conditional probabilities of :func:`fit_joint_genotypes`.  Every batch of samples
    gives its sums of genotypes times residuals, so no task holds the samples of all.
    """
    names = [r[0] for r in traits.select("trait").distinct().orderBy("trait").collect()]
    af = {r["marker_idx"]: r["af"] for r in allele_freq(panel).collect()}
    p = np.array([af[k] for k in range(len(af))])
    sd = np.sqrt(2 * p * (1 - p))
    wide = traits.groupBy("sample_idx").pivot("trait", names).agg(F.first("y")).dropna()
    inverse, active = np.linalg.inv(ve), patterns(len(names))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(p), len(names) + 1))
        for b in batches:
            g, seen = dosage_matrix(b.column("dosages"))
            if len(g):
                z = np.where((seen > 0) & (sd > 0), (g - 2 * p) / np.where(sd > 0, sd, 1), 0.0)
                y = np.column_stack([np.asarray(b.column(n), float) for n in names])
                total[:, :-1] += z.T @ (y - z @ effects)
                total[:, -1] += np.square(z).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(p)), pa.int32()), *[pa.array(x.copy()) for x in total.T]], names=["marker_idx", *[f"s{k}" for k in range(len(names))], "xx"])

    columns = [f"s{k}" for k in range(len(names))]
    d = panel.join(wide, "sample_idx").select("dosages", *[F.col(f"`{n}`").cast("double").alias(n) for n in names])
    d = d.mapInArrow(sums, "marker_idx int, " + ", ".join(f"{c} double" for c in [*columns, "xx"])).groupBy("marker_idx").agg(*[F.sum(c).alias(c) for c in [*columns, "xx"]])

    def table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples(index=False):
                u = inverse @ (np.array([getattr(r, c) for c in columns]) + r.xx * effects[r.marker_idx])
                logw = pattern_log_weights(u, r.xx * inverse, v, np.log(pi), active)
                w = np.exp(logw - logw.max())
                yield pd.DataFrame({"marker_idx": r.marker_idx, "pattern": np.arange(len(w)), "prob": w / w.sum()})

    return d.mapInPandas(table, "marker_idx int, pattern int, prob double")


def provider_scores(provider_map: DataFrame, providers: DataFrame, markers: DataFrame) -> DataFrame:
    """trait, global_idx, score over its providers' residual scales; unmapped markers are 0."""
    scored = provider_map.join(providers, "provider_id").groupBy("trait", "global_idx").agg(
        F.sum(F.col("score") / F.col("residual_scale")).alias("score")
    )
    grid = providers.select("trait").distinct().crossJoin(markers.select("global_idx"))
    return grid.join(scored, ["trait", "global_idx"], "left").select("trait", "global_idx", F.round(F.coalesce("score", F.lit(0.0)), 8).alias("score"))


def alignment_errors(local: DataFrame, markers: DataFrame) -> DataFrame:
    """Rows of (provider_id, marker_id, effect, other, coding) that do not fit the global map."""
    g = markers.select("marker_id", F.col("effect").alias("g_effect"), F.col("other").alias("g_other"), F.col("coding").alias("g_coding"))
    d = local.join(g, "marker_id", "left")
    twice = local.groupBy("provider_id", "marker_id").count().filter("count > 1").select("provider_id", "marker_id", F.lit("duplicate").alias("problem"))
    problem = (
        F.when(F.col("g_effect").isNull(), "unknown_marker")
        .when((F.col("effect") != F.col("g_effect")) | (F.col("other") != F.col("g_other")), "alleles")
        .when(F.col("coding") != F.col("g_coding"), "coding")
    )
    return d.withColumn("problem", problem).filter("problem is not null").select("provider_id", "marker_id", "problem").unionByName(twice)


def provider_residuals(local: DataFrame, edges: DataFrame, effects: DataFrame) -> DataFrame:
    """provider_id, trait, global_idx, residual: a provider's score less its X'X times the effects.

    ``local`` has provider_id, trait, global_idx, score, ww; ``edges`` (provider_id, i, j, r) are
    each provider's LD; ``effects`` (trait, global_idx, effect).  Effects of markers that a
    provider does not have do not reach it.
    """
    here = local.join(effects, ["trait", "global_idx"], "left").withColumn("b", F.coalesce("effect", F.lit(0.0)))
    both = edges.select("provider_id", "i", "j", "r").unionByName(edges.select("provider_id", F.col("j").alias("i"), F.col("i").alias("j"), "r"))
    left = here.select("provider_id", "trait", F.col("global_idx").alias("i"), F.col("ww").alias("wi"))
    right = here.select("provider_id", "trait", F.col("global_idx").alias("j"), F.col("ww").alias("wj"), "b")
    xb = both.join(left, ["provider_id", "i"]).join(right, ["provider_id", "trait", "j"])
    xb = xb.groupBy("provider_id", "trait", F.col("i").alias("global_idx")).agg(F.sum(F.round(F.col("r") * F.sqrt(F.col("wi") * F.col("wj")), 6) * F.col("b")).alias("xb"))
    d = here.join(xb, ["provider_id", "trait", "global_idx"], "left")
    return d.select("provider_id", "trait", "global_idx", F.round(F.col("score") - F.col("ww") * F.col("b") - F.coalesce("xb", F.lit(0.0)), 6).alias("residual"))


def pattern_table(scores: DataFrame, v: np.ndarray, pi: np.ndarray) -> DataFrame:
    """marker_idx, pattern, prob of the activity patterns at each marker, given all other effects.

    ``scores`` has trait, marker_idx, u and info, both over the residual variance; a marker
    is one group of as many rows as there are traits.
    """
    active = patterns(len(v))

    def task(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("trait")
        logw = pattern_log_weights(part["u"].to_numpy(float), np.diag(part["info"].to_numpy(float)), v, np.log(pi), active)
        w = np.exp(logw - logw.max())
        return pd.DataFrame({"marker_idx": key[0], "pattern": np.arange(len(w)), "prob": w / w.sum()})

    return scores.groupBy("marker_idx").applyInPandas(task, "marker_idx int, pattern int, prob double")
