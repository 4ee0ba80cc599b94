"""Replica exchange between annotation couplings.

Replicas of a chain differ in how much annotations count for the prior: at coupling 1 it is
the model's, at 0 all markers have the baseline's probabilities, and effects move freely between
annotated and other markers.  Neighbouring replicas exchange their whole states where the
components fit the other's prior well enough, so the replica at coupling 1 keeps its
posterior and visits what it would not reach alone.
"""

from __future__ import annotations

import copy
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectforge.functions.expressions import normal_cdf
from effectforge.operators.blocks import sweep_markers
from effectforge.operators.priors import ChainControls, calibrate_prior
from effectforge.operators.samplers import CsrOperator, GenotypeOperator, Model, Prior, chain_tasks, dosage_array, standardise, weights_of

COUPLINGS = (0.0, 0.5, 1.0)
OUTPUT = "trait string, chain int, kind string, iteration int, marker_idx int, quantity string, value double"


def _fork(op: CsrOperator) -> CsrOperator:
    """An operator of the same data with a residual of its own."""
    other = copy.copy(op)
    for name in ("r", "e"):
        if hasattr(other, name):
            setattr(other, name, getattr(op, name).copy())
    return other


class _Marker(CsrOperator):
    """Genotypes as :func:`sweep_markers` reads them: scores of all markers from the residual of the samples."""

    def __init__(self, op: GenotypeOperator) -> None:
        self.op, self.wy, self.ww = op, op.wy, op.ww

    @property
    def r(self) -> np.ndarray:
        return self.op.residual()

    def move(self, k: int, change: float) -> None:
        self.op.move(k, change)


def log_target(prior: Prior, comp: np.ndarray) -> float:
    """Log probability of components under a prior's coupling and coefficients."""
    return float(np.log(prior.rows[np.arange(len(comp)), comp]).sum())


def sample_tempered(op: CsrOperator, yy: float, n: float, model: Model, controls: ChainControls, seed: int, couplings: tuple[float, ...] = COUPLINGS, swap_every: int = 5) -> dict:
    """One chain of replicas, coldest last: means of the last replica, and a row for each proposed exchange.

    ``model`` has the probit-stick policy; every ``swap_every`` sweeps one pair of neighbours, in turn, proposes.
    """
    if model.policy != "probit_stick" or couplings[-1] != 1.0 or len(couplings) < 2 or swap_every < 1:
        raise ValueError("couplings end at 1 and take probit sticks")
    m, gamma = len(op.wy), np.array(model.gamma)
    cal = calibrate_prior(yy / n, model.h2, m * float((np.array(model.pi) * gamma).sum()), model.nub, model.nue)
    replicas = []
    for slot, c in enumerate(couplings):
        own = _fork(op)
        replicas.append({
            "id": slot, "op": own, "view": _Marker(own) if isinstance(own, GenotypeOperator) else own, "b": np.zeros(m), "comp": np.zeros(m, int), "vb": model.vb or cal["vb"], "ve": model.ve or cal["ve"],
            "vg": 0.0, "prior": Prior(replace(model, extra=model.extra | {"coupling": c}), m), "rng": np.random.default_rng([seed, slot]),
        })
    swapper, swaps, drawn = np.random.default_rng([seed, len(couplings)]), [], 0
    sums, pips, keep = np.zeros(m), np.zeros(m), set(controls.retained())
    for it in range(1, controls.nburn + controls.nit + 1):
        for x in replicas:
            rng, noise = x["rng"], np.full(m, x["ve"] + model.adj_e * x["vg"])
            v = x["vb"] * np.tile(gamma[1:], (m, 1))
            base, slope = weights_of(np.log(x["prior"].rows), v, op.ww, noise)
            sweep_markers(x["view"], x["b"], x["comp"], base, slope, v, noise, rng.random(m), rng.standard_normal(m))
            on, r = x["comp"] > 0, x["op"].residual()
            if model.update_vb:
                x["vb"] = max((float((x["b"][on] ** 2 / gamma[x["comp"][on]]).sum()) + model.nub * cal["ssb_prior"]) / rng.chisquare(on.sum() + model.nub), 1e-12)
            if model.update_ve:
                x["ve"] = (yy - float(x["b"] @ (r + op.wy)) + model.nue * cal["sse_prior"]) / rng.chisquare(n + model.nue)
            x["vg"] = float(x["b"] @ (op.wy - r)) / n
            x["prior"].update(rng, x["comp"], x["b"], x["vb"])
        if it % swap_every == 0:
            low = (it // swap_every - 1) % (len(couplings) - 1)
            one, two = replicas[low], replicas[low + 1]
            before = log_target(one["prior"], one["comp"]) + log_target(two["prior"], two["comp"])
            for x, c in ((one, couplings[low + 1]), (two, couplings[low])):
                x["prior"].coupling = c
                x["prior"]._sticks()
            ratio = log_target(one["prior"], one["comp"]) + log_target(two["prior"], two["comp"]) - before
            accepted = bool(np.log(swapper.random()) < ratio)
            swaps.append((it, low, one["id"], two["id"], ratio, accepted))
            if accepted:
                replicas[low], replicas[low + 1] = two, one
            else:
                for x, c in ((one, couplings[low]), (two, couplings[low + 1])):
                    x["prior"].coupling = c
                    x["prior"]._sticks()
        if it > controls.nburn and it - controls.nburn in keep:
            sums += replicas[-1]["b"]
            pips += replicas[-1]["comp"] > 0
            drawn += 1
    return {"effect": sums / max(drawn, 1), "pip": pips / max(drawn, 1), "swaps": swaps, "replicas": replicas}


def fit_tempered(panel: DataFrame, traits: DataFrame, model: Model, controls: ChainControls, couplings: tuple[float, ...] = COUPLINGS, swap_every: int = 5) -> DataFrame:
    """Rows of effects and PIPs by marker, and of exchanges (lower slot, log ratio, accepted), of every trait and chain.

    A task holds the samples of its trait and all replicas of a chain, which share the genotypes.
    """
    d = panel.join(traits.filter("y is not null"), "sample_idx").join(F.broadcast(chain_tasks(traits, controls, "tempered")), "trait")

    def task(key: tuple, s: pd.DataFrame) -> pd.DataFrame:
        s = s.sort_values("sample_idx")
        y = s["y"].to_numpy(float)
        out = sample_tempered(GenotypeOperator(standardise(dosage_array(s["dosages"])), y), float(y @ y), float(len(y)), model, controls, int(s["seed"].iloc[0]), couplings, swap_every)
        rows = [("marker", 0, k, q, float(x)) for q in ("effect", "pip") for k, x in enumerate(out[q])]
        for it, low, _, _, ratio, accepted in out["swaps"]:
            rows += [("swap", it, -1, q, float(x)) for q, x in (("lower", low), ("log_ratio", ratio), ("accepted", accepted))]
        rows = [(str(key[0]), int(key[1]), *r) for r in rows]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")]).astype({"chain": "int32", "iteration": "int32", "marker_idx": "int32"})

    return d.groupBy("trait", "chain").applyInPandas(task, OUTPUT)


def exchange_terms(components: DataFrame, annotations: DataFrame, alpha: list[np.ndarray], couplings: tuple[float, ...] = COUPLINGS, baseline: tuple[float, ...] | None = None) -> DataFrame:
    """lower, log_ratio of exchanging neighbouring replicas' states (replica, marker_idx, component) with ``annotations`` (marker_idx, a).

    One sum over the markers for each state at its own coupling and at its neighbours'.
    """
    sticks = alpha[0].shape[1]
    base = baseline or (0.0,) * sticks
    slots = [
        (replica, slot, [[float(couplings[slot] * x) for x in own[:, k]] for k in range(sticks)], [float((1 - couplings[slot]) * x) for x in base])
        for replica, own in enumerate(alpha)
        for slot in range(max(replica - 1, 0), min(replica + 2, len(couplings)))
    ]
    # A row for each replica and neighbour: a few, whatever the markers.
    table = components.sparkSession.createDataFrame(slots, "replica int, slot int, coef array<array<double>>, base array<double>")
    d = components.join(annotations, "marker_idx").join(F.broadcast(table), "replica")
    etas = F.zip_with("coef", "base", lambda c, b: F.aggregate(F.zip_with("a", c, lambda x, y: x * y), b, lambda s, x: s + x))
    d = d.select("replica", "slot", "component", F.transform(etas, normal_cdf).alias("going"))
    left = F.aggregate("going", F.array(F.lit(1.0)), lambda s, g: F.concat(s, F.array(F.element_at(s, -1) * g)))
    d = d.select("replica", "slot", "component", "going", left.alias("left"))
    # Those that stop at each stick, and those that pass the last.
    p = F.transform(F.zip_with("left", F.concat("going", F.array(F.lit(0.0))), lambda x, g: x * (1 - g)), lambda x: F.greatest(x, F.lit(1e-12)))
    d = d.select("replica", "slot", "component", p.alias("p"))
    table = d.groupBy("replica", "slot").agg(F.sum(F.log(F.element_at("p", F.col("component") + 1) / F.aggregate("p", F.lit(0.0), lambda s, x: s + x))).alias("x"))
    sign = F.when(F.col("replica") == F.col("slot"), -F.col("x")).otherwise(F.col("x"))
    near = F.explode(F.when(F.col("replica") != F.col("slot"), F.array(F.least("replica", "slot"))).otherwise(F.filter(F.array(F.col("slot") - 1, F.col("slot")), lambda s: (s >= 0) & (s < len(couplings) - 1))))
    return table.withColumn("lower", near).groupBy("lower").agg(F.sum(sign).alias("log_ratio"))
