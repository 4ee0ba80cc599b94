"""Gibbs sweeps over LD blocks in parallel.

Markers lie in blocks of a fixed size, and two blocks touch where an LD edge joins
them.  Edges reach a bounded number of blocks, so block number modulo reach + 1 is
a proper colouring, and blocks of one colour share no edge: their sweeps, side by side,
are the sweep of all their markers one after the other.  A step takes the blocks of one
colour, a task each; it reads a block's edges, written once, and its state (statistics,
effects, components, residual), and gives the new state and, for markers of other blocks,
what the moves take from their residuals.  Only these messages and the states are
shuffled.  The state is a table in the shared folder, written anew by every step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectforge.operators.ld import symmetric
from effectforge.operators.priors import ChainControls, calibrate_prior
from effectforge.operators.samplers import OUTPUT, CsrOperator, Fit, Model, chain_tasks, choose, weights_of
from effectforge.sources.files import discard, materialize

BLOCK = 512
KEY = ["trait", "chain", "block"]
STATE = (
    "trait string, chain int, block int, colour int, wy array<double>, ww array<double>, b array<double>, comp array<int>, res array<double>, sum_b array<double>, sum_on array<double>"
)
STEP = "trait string, chain int, block int, b array<double>, comp array<int>, res array<double>, out array<struct<j:int,x:double>>"


@dataclass
class Layout:
    """Edges by block, written once: own, other and r of every edge of a block's markers."""

    edges: DataFrame
    size: int
    colours: int
    markers: int


def block_layout(edges: DataFrame, markers: int, size: int = BLOCK) -> Layout:
    """Group LD edges (i, j, r) by the blocks of both ends, and colour the blocks.

    A block has at most ``size`` markers times the edges of one.
    """
    both = symmetric(edges).select(F.floor(F.col("i") / size).cast("int").alias("block"), "i", "j", F.col("r").cast("double").alias("r"))
    e = F.array_sort(F.collect_list(F.struct("i", "j", "r")))
    rows = both.groupBy("block").agg(e.alias("e")).select("block", F.col("e.i").alias("own"), F.col("e.j").alias("other"), F.col("e.r").alias("r"))
    rows = materialize(rows, "block-edges")
    far = rows.select(F.max(F.greatest(F.col("block") - F.floor(F.array_min("other") / size), F.floor(F.array_max("other") / size) - F.col("block")))).first()[0]
    return Layout(rows, size, int(far or 0) + 1, markers)


def block_states(stats: DataFrame, tasks: DataFrame, layout: Layout) -> DataFrame:
    """The state before the first sweep: no effects, and X'y as the residual."""
    size = layout.size
    one = F.array_sort(F.collect_list(F.struct("marker_idx", "wy", "ww")))
    rows = stats.groupBy("trait", F.floor(F.col("marker_idx") / size).cast("int").alias("block")).agg(one.alias("e"))
    rows = rows.join(F.broadcast(tasks.select("trait", "chain")), "trait")
    none = F.array_repeat(F.lit(0.0), F.size("e"))
    return rows.select(
        "trait", "chain", "block", F.pmod("block", F.lit(layout.colours)).alias("colour"), F.col("e.wy").alias("wy"), F.col("e.ww").alias("ww"),
        none.alias("b"), F.array_repeat(F.lit(0), F.size("e")).alias("comp"), F.col("e.wy").alias("res"), none.alias("sum_b"), none.alias("sum_on"),
    )


def sweep_markers(op: CsrOperator, b: np.ndarray, comp: np.ndarray, base: np.ndarray, slope: np.ndarray, v: np.ndarray, noise: np.ndarray, uniforms: np.ndarray, normals: np.ndarray) -> None:
    """Draw every marker of an operator in turn, largest squared effect first.

    Those before the first that moves leave the residual as it is, so they are looked at together.
    """
    order = np.argsort(-np.square(op.wy / op.ww), kind="stable")
    at = 0
    while at < len(order):
        ids = order[at:]
        score = op.r[ids] + op.ww[ids] * b[ids]
        chosen, _ = choose(base[ids], slope[ids], score, uniforms[ids])
        moving = np.flatnonzero((chosen > 0) | (comp[ids] > 0))
        if not len(moving):
            return
        first = int(moving[0])
        k, c, new = int(ids[first]), int(chosen[first]), 0.0
        if c:
            info = op.ww[k] + noise[k] / v[k, c - 1]
            new = score[first] / info + normals[k] * np.sqrt(noise[k] / info)
        op.move(k, new - b[k])
        b[k], comp[k] = new, c
        at += first + 1


def _step(layout: Layout, visit) -> object:
    """States with their edges to ``STEP``: ``visit(row, op, b, comp)`` changes effects of one block."""
    size = layout.size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.itertuples(index=False):
                start, n = row.block * size, len(row.wy)
                none = row.own is None
                own, other = (np.zeros(0, int) if none else np.asarray(x, int) for x in (row.own, row.other))
                r = np.zeros(0) if none else np.asarray(row.r, float)
                inside = (other >= start) & (other < start + n)
                half = inside & (own < other)
                op = CsrOperator(np.asarray(row.wy, float), np.asarray(row.ww, float), own[half] - start, other[half] - start, r[half])
                op.r = np.array(row.res, float)
                b, comp = np.array(row.b, float), np.array(row.comp, int)
                before = b.copy()
                visit(row, op, b, comp)
                change = (b - before) * np.sqrt(op.ww)
                far = np.flatnonzero(~inside & (change[own - start] != 0)) if len(own) else np.zeros(0, int)
                to, where = np.unique(other[far], return_inverse=True)
                x = np.bincount(where, r[far] * change[own[far] - start], len(to))
                out = [{"j": int(j), "x": float(s)} for j, s in zip(to, x, strict=True)]
                yield pd.DataFrame([[row.trait, row.chain, row.block, b.tolist(), comp.tolist(), op.r.tolist(), out]], columns=["trait", "chain", "block", "b", "comp", "res", "out"])

    return run


def _received(ww: Column, res: Column, inbox: Column) -> Column:
    """Residuals less what the messages of other blocks take."""
    taken = F.map_from_entries(inbox)
    return F.when(inbox.isNull(), res).otherwise(F.transform(res, lambda x, k: x - F.sqrt(F.get(ww, k)) * F.coalesce(F.element_at(taken, k), F.lit(0.0))))


def colour_step(state: DataFrame, layout: Layout, colour: int, visit, given: DataFrame | None = None, count: bool = False) -> DataFrame:
    """The state after the blocks of one colour; ``given`` (trait, chain, ...) are columns that ``visit`` needs, ``count`` adds to the sums of draws."""
    rows = state.filter(F.col("colour") == colour).join(layout.edges, "block", "left")
    if given is not None:
        rows = rows.join(F.broadcast(given), ["trait", "chain"])
    moved = materialize(rows.mapInPandas(_step(layout, visit), STEP), "block-step")
    sent = moved.select("trait", "chain", F.explode("out").alias("m")).select("trait", "chain", "m.j", "m.x")
    sent = sent.groupBy("trait", "chain", F.floor(F.col("j") / layout.size).cast("int").alias("block"), F.pmod("j", F.lit(layout.size)).alias("k")).agg(F.sum("x").alias("x"))
    inbox = sent.groupBy(*KEY).agg(F.collect_list(F.struct("k", "x")).alias("inbox"))
    new = moved.select(*KEY, *[F.col(c).alias(f"new_{c}") for c in ("b", "comp", "res")])
    out = state.join(new, KEY, "left").join(inbox, KEY, "left")
    cols = {c: F.coalesce(f"new_{c}", c) for c in ("b", "comp", "res")}
    cols["res"] = _received(F.col("ww"), cols["res"], F.col("inbox"))
    if count:
        cols["sum_b"] = F.zip_with("sum_b", cols["b"], lambda s, x: s + x)
        cols["sum_on"] = F.zip_with("sum_on", cols["comp"], lambda s, x: s + F.when(x > 0, 1.0).otherwise(0.0))
    names = [f.split()[0] for f in STATE.split(", ")]
    after = materialize(out.select(*[cols[c].alias(c) if c in cols else F.col(c) for c in names]), "block-state")
    discard(moved)
    return after


def set_effects(state: DataFrame, layout: Layout, effects: DataFrame) -> DataFrame:
    """The state with effects (marker_idx, effect) in place, block by block, each telling its neighbours."""
    one = F.array_sort(F.collect_list(F.struct("marker_idx", F.col("effect").cast("double").alias("effect"))))
    wanted = effects.groupBy(F.floor(F.col("marker_idx") / layout.size).cast("int").alias("block")).agg(one.alias("e")).select("block", F.col("e.effect").alias("wanted"))
    names = state.columns

    def visit(row, op: CsrOperator, b: np.ndarray, comp: np.ndarray) -> None:
        for k in np.flatnonzero(np.asarray(row.wanted) != b):
            op.move(int(k), row.wanted[k] - b[k])
            b[k] = row.wanted[k]

    for colour in range(layout.colours):
        state = colour_step(state.select(*names).join(wanted, "block"), layout, colour, visit)
    return state


def block_conditionals(stats: DataFrame, edges: DataFrame, effects: DataFrame, model: Model, vb: float, ve_share: float, markers: int, size: int = BLOCK) -> DataFrame:
    """trait, marker_idx, component, prob, mean given all other effects, at a residual variance of ``ve_share`` of the phenotype's.

    The residuals are those that the blocks' messages leave, so these are the probabilities that
    a sweep of blocks draws from; priors are the same for all markers.
    """
    layout = block_layout(edges, markers, size)
    tasks = stats.select("trait").distinct().withColumn("chain", F.lit(0))
    state = set_effects(block_states(stats, tasks, layout), layout, effects)
    noise = stats.groupBy("trait").agg((ve_share * F.first("yy") / F.first("n")).alias("noise"))
    gamma, pi = np.array(model.gamma), np.array(model.pi)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.itertuples(index=False):
                ww, b, res = (np.asarray(x, float) for x in (row.ww, row.b, row.res))
                m, noise = len(ww), np.full(len(ww), row.noise)
                v = np.tile(vb * gamma[1:], (m, 1))
                base, slope = weights_of(np.tile(np.log(pi), (m, 1)), v, ww, noise)
                score = res + ww * b
                base[:, 1:] += slope * np.square(score)[:, None]
                p = np.exp(base - base.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                mean = (p[:, 1:] * score[:, None] / (ww[:, None] + noise[:, None] / v)).sum(1)
                k = p.shape[1]
                yield pd.DataFrame({"trait": row.trait, "marker_idx": np.repeat(row.block * size + np.arange(m), k), "component": np.tile(np.arange(k), m), "prob": p.ravel(), "mean": np.repeat(mean, k)})

    return state.join(F.broadcast(noise), "trait").mapInPandas(run, "trait string, marker_idx int, component int, prob double, mean double")


def fit_blocks(stats: DataFrame, edges: DataFrame, model: Model, controls: ChainControls, size: int = BLOCK) -> Fit:
    """Fit from trait, marker_idx (dense from 0), wy, ww, yy, n and LD edges, a task for each block of markers.

    Takes spike-and-slab and scale mixtures with one prior for all markers.  Variances and the
    mixture are drawn on the driver from sums over the markers, a row for each trait and
    chain.  No task holds more than a block and its edges, however many markers there are.
    """
    if model.policy != "global" or model.swap or model.skip_nulls or model.maf_s is not None or model.block_policy != "global":
        raise ValueError("blocks in parallel take one prior for all markers and plain sweeps")
    tasks = chain_tasks(stats, controls, "blocks")
    spark, gamma = stats.sparkSession, np.array(model.gamma)
    totals = {r["trait"]: r for r in stats.groupBy("trait").agg(F.first("yy").alias("yy"), F.first("n").alias("n"), F.max("marker_idx").alias("last")).collect()}
    m = max((r["last"] for r in totals.values()), default=-1) + 1
    layout = block_layout(edges, m, size)
    state = materialize(block_states(stats, tasks, layout), "block-state")
    now = {}
    for t, c, seed in [tuple(r) for r in tasks.collect()]:
        vy = totals[t]["yy"] / totals[t]["n"]
        cal = calibrate_prior(vy, model.h2, m * float(np.array(model.pi) @ gamma), model.nub, model.nue)
        now[t, c] = {"cal": cal, "vb": model.vb or cal["vb"], "ve": model.ve or cal["ve"], "vg": 0.0, "pi": np.array(model.pi, float), "seed": seed, "rng": np.random.default_rng(seed)}

    def visit(row, op: CsrOperator, b: np.ndarray, comp: np.ndarray) -> None:
        rng, n = np.random.default_rng([row.seed, row.sweep, row.block]), len(b)
        noise = np.full(n, row.noise)
        v = np.tile(row.vb * gamma[1:], (n, 1))
        base, slope = weights_of(np.tile(np.log(np.asarray(row.pi, float)), (n, 1)), v, op.ww, noise)
        sweep_markers(op, b, comp, base, slope, v, noise, rng.random(n), rng.standard_normal(n))

    keep, traces, drawn = set(controls.retained()), [], 0
    for it in range(1, controls.nburn + controls.nit + 1):
        rows = [(t, c, x["seed"], it, float(x["vb"]), float(x["ve"] + model.adj_e * x["vg"]), x["pi"].tolist()) for (t, c), x in now.items()]
        given = spark.createDataFrame(rows, "trait string, chain int, seed bigint, sweep int, vb double, noise double, pi array<double>")
        kept = it > controls.nburn and it - controls.nburn in keep
        for colour in range(layout.colours):
            before, state = state, colour_step(state, layout, colour, visit, given, kept and colour == layout.colours - 1)
            discard(before)
        drawn += kept
        flat = state.select("trait", "chain", F.explode(F.arrays_zip("b", "comp", "wy", "ww", "res")).alias("x")).select("trait", "chain", "x.*")
        b, scaled = F.col("b"), F.element_at(F.array(*[F.lit(float(g)) for g in gamma]), F.col("comp") + 1)
        on = [F.sum((F.col("comp") == k).cast("bigint")).alias(f"n{k}") for k in range(len(gamma))]
        ss = F.sum(F.when(F.col("comp") > 0, b * b / scaled).otherwise(0.0)).alias("ss")
        sums = flat.groupBy("trait", "chain").agg(ss, F.sum(b * (F.col("res") + F.col("wy"))).alias("fit"), F.sum(b * (F.col("wy") - F.col("res"))).alias("g"), F.sum(F.col("ww") * b * b).alias("le"), *on)
        for r in sums.collect():
            x, yy, n = now[r["trait"], r["chain"]], float(totals[r["trait"]]["yy"]), float(totals[r["trait"]]["n"])
            counts = np.array([r[f"n{k}"] for k in range(len(gamma))], float)
            rng, cal = x["rng"], x["cal"]
            if model.update_vb:
                x["vb"] = max((r["ss"] + model.nub * cal["ssb_prior"]) / rng.chisquare(counts[1:].sum() + model.nub), 1e-12)
            if model.update_ve:
                sse = yy - r["fit"] + model.nue * cal["sse_prior"]
                if sse <= 0:
                    raise ValueError("the residual sum of squares is not positive: the LD and the statistics disagree")
                x["ve"] = sse / rng.chisquare(n + model.nue)
            if model.update_pi:
                x["pi"] = np.maximum(rng.dirichlet(np.array(model.pi) * model.pi_strength + counts), 1e-300)
            x["vg"], vle = r["g"] / n, r["le"] / n
            values = {"vb": x["vb"], "vg": x["vg"], "ve": x["ve"], "pi": 1 - x["pi"][0], "vle": vle, "vld": x["vg"] - vle}
            traces += [(r["trait"], r["chain"], "trace", it, -1, q, float(value)) for q, value in values.items()]
    each = state.select("trait", "chain", "block", F.posexplode(F.arrays_zip("sum_b", "sum_on", "b", "comp")).alias("k", "x"))
    share = F.lit(float(max(drawn, 1)))
    values = {"effect": F.col("x.sum_b") / share, "pip": F.col("x.sum_on") / share, "final_effect": F.col("x.b"), "state": F.col("x.comp").cast("double")}
    values = F.explode(F.array(*[F.struct(F.lit(q).alias("quantity"), x.alias("value")) for q, x in values.items()]))
    marker = each.select("trait", "chain", F.lit("marker").alias("kind"), F.lit(0).alias("iteration"), (F.col("block") * size + F.col("k")).alias("marker_idx"), values.alias("v"))
    rows = marker.select("trait", "chain", "kind", "iteration", "marker_idx", "v.quantity", "v.value").unionByName(spark.createDataFrame(traces, OUTPUT))
    return Fit(rows, controls, {"operator": "blocks", "policy": model.policy, "gamma": model.gamma, "colours": layout.colours})
