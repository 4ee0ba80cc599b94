"""Loci and credible sets.

A locus, or a region with its dense LD, is a bounded unit of work that is greedy
by nature, so each runs in one task of ``applyInPandas``; everything around it
is relational.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MEMBERS = "region string, cs int, marker_idx int, pip double, r2_to_lead double, rank int"
SUMMARY_COLUMNS = ("lead_marker", "lead_pip", "cs_pip", "n_markers", "min_r2_to_lead", "mean_r2_to_lead")


def define_loci(
    pips: DataFrame, markers: DataFrame, *, locus_pip_cutoff: float = 0.01, max_locus_distance: float = 1e6, max_loci: float = math.inf
) -> DataFrame:
    """locus, chr, lead, start, end and members from the highest PIP down.

    The highest unclaimed PIP at the cutoff or above leads; every marker of its
    chromosome within the distance belongs to the locus, claimed or not; then
    all of them are claimed.  Chromosomes are independent tasks; loci are
    numbered over all of them by PIP.
    """
    d = pips.join(markers, "marker_idx").select("chr", "marker_idx", F.col("pos").cast("double").alias("pos"), "pip")

    def clump(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["pip", "marker_idx"], ascending=[False, True])
        free = part["pip"].to_numpy() >= locus_pip_cutoff
        pos, ids, pip = part["pos"].to_numpy(), part["marker_idx"].to_numpy(), part["pip"].to_numpy()
        rows, at = [], 0
        while at < len(part):
            if free[at]:
                near = np.abs(pos - pos[at]) <= max_locus_distance
                free &= ~near
                rows.append((part["chr"].iloc[0], ids[at], pip[at], pos[near].min(), pos[near].max(), sorted(ids[near].tolist())))
            at += 1
        return pd.DataFrame(rows, columns=["chr", "lead", "lead_pip", "start", "end", "members"])

    schema = f"chr {dict(d.dtypes)['chr']}, lead int, lead_pip double, start double, end double, members array<int>"
    loci = d.groupBy("chr").applyInPandas(clump, schema)
    numbered = loci.withColumn("locus", F.row_number().over(Window.orderBy(F.col("lead_pip").desc(), "lead")))
    return numbered.filter(F.col("locus") <= max_loci) if math.isfinite(max_loci) else numbered


def loci_from_sets(sets: DataFrame, pips: DataFrame, markers: DataFrame) -> DataFrame:
    """locus, chr (null if mixed), start, end, lead and lead_pip of given (locus, marker_idx)."""
    d = sets.distinct().join(pips, "marker_idx").join(markers, "marker_idx")
    lead = F.max_by("marker_idx", F.struct("pip", -F.col("marker_idx")))
    return d.groupBy("locus").agg(
        F.when(F.count_distinct("chr") == 1, F.min("chr")).alias("chr"),
        F.min("pos").alias("start"),
        F.max("pos").alias("end"),
        lead.alias("lead"),
        F.max("pip").alias("lead_pip"),
    )


def locus_table(members: DataFrame, pips: DataFrame) -> DataFrame:
    """locus, lead, lead_pip, secondary_pip, total_pip, n_markers of (locus, marker_idx)."""
    d = members.join(pips, "marker_idx")
    w = Window.partitionBy("locus").orderBy(F.col("pip").desc(), "marker_idx")
    d = d.withColumn("rank", F.row_number().over(w))
    return d.groupBy("locus").agg(
        F.max(F.when(F.col("rank") == 1, F.col("marker_idx"))).alias("lead"),
        F.max(F.when(F.col("rank") == 1, F.col("pip"))).alias("lead_pip"),
        F.max(F.when(F.col("rank") == 2, F.col("pip"))).alias("secondary_pip"),
        F.round(F.sum("pip"), 8).alias("total_pip"),
        F.count("*").alias("n_markers"),
    )


def region_sets(
    pip: np.ndarray,
    r: np.ndarray,
    *,
    coverage: float = 0.95,
    min_r2: float = 0.5,
    pip_cutoff: float = 0.001,
    method: str = "pip",
    max_sets: float = math.inf,
    allow_incomplete: bool = False,
    remove: str = "ld_neighborhood",
    multi: bool = False,
    signal_coverage: float = 0.95,
    min_signal_pip: float = 0.05,
) -> list[list[tuple[int, float, float, int]]]:
    """Greedy credible sets of one region: (marker, pip, r2 to lead, rank) lists.

    ``multi`` is the multi-signal rule: it stops when the PIP that is left or
    the lead's falls short, and an incomplete lead is dropped alone; otherwise
    an incomplete candidate set is dropped whole.  ``ld_pip`` picks the lead by
    the LD-weighted sum of PIPs, all of them or, with ``multi``, those left.
    """
    r2 = np.square(r)
    np.fill_diagonal(r2, 1.0)
    base = np.where(pip >= pip_cutoff, pip, 0.0)
    left, found = base.copy(), []
    while len(found) < max_sets and left.max(initial=0.0) > 0:
        if multi and left.sum() < signal_coverage:
            break
        score = left if method == "pip" else np.where(left > 0, r2 @ (left if multi else base), 0.0)
        lead = int(np.argmax(score))
        if multi and left[lead] < min_signal_pip:
            break
        near = np.flatnonzero((left > 0) & (r2[lead] >= min_r2))
        order = near[np.argsort(-left[near], kind="stable")]
        total = np.cumsum(left[order])
        size = int(np.searchsorted(total, coverage - 1e-12)) + 1
        if size > len(order):
            if not allow_incomplete:
                left[[lead] if multi else near] = 0.0
                continue
            size = len(order)
        members = order[:size]
        found.append([(int(k), float(pip[k]), float(r2[lead, k]), n + 1) for n, k in enumerate(members)])
        left[near if remove == "ld_neighborhood" else members] = 0.0
    return found


def credible_sets(pips: DataFrame, regions: DataFrame, ld: DataFrame, **params) -> DataFrame:
    """Members of the credible sets of every region.

    ``regions`` (region, marker_idx), ``ld`` (region, i, j, r) dense or sparse;
    pairs that are not listed are uncorrelated.
    """
    rows = regions.join(pips, "marker_idx").select(F.col("region").cast("string").alias("region"), "marker_idx", "pip")
    pairs = ld.select(F.col("region").cast("string").alias("region"), "i", "j", "r")

    def task(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("marker_idx").reset_index(drop=True)
        ids, r = left["marker_idx"].to_numpy(), np.eye(len(left))
        i, j, x = (right[c].to_numpy() for c in ("i", "j", "r"))
        known = np.isin(i, ids) & np.isin(j, ids)
        a, b = np.searchsorted(ids, i[known]), np.searchsorted(ids, j[known])
        r[a, b] = r[b, a] = x[known]
        out = [
            (key[0], n + 1, int(left["marker_idx"][k]), p, round(x, 10), rank)
            for n, members in enumerate(region_sets(left["pip"].to_numpy(), r, **params))
            for k, p, x, rank in members
        ]
        return pd.DataFrame(out, columns=["region", "cs", "marker_idx", "pip", "r2_to_lead", "rank"])

    return rows.groupBy("region").cogroup(pairs.groupBy("region")).applyInPandas(task, MEMBERS)


def credible_set_summary(members: DataFrame) -> DataFrame:
    """One row for each credible set: lead, sums, sizes and LD to the lead."""
    return members.groupBy("region", "cs").agg(
        F.max(F.when(F.col("r2_to_lead") == 1, F.col("marker_idx"))).alias("lead_marker"),
        F.max(F.when(F.col("r2_to_lead") == 1, F.col("pip"))).alias("lead_pip"),
        F.round(F.sum("pip"), 8).alias("cs_pip"),
        F.count("*").alias("n_markers"),
        F.round(F.min("r2_to_lead"), 8).alias("min_r2_to_lead"),
        F.round(F.avg("r2_to_lead"), 8).alias("mean_r2_to_lead"),
    )


def first_credible_set(pips: DataFrame, edges: DataFrame, *, coverage: float, min_r2: float, pip_cutoff: float) -> DataFrame:
    """The leading credible set over all markers, without a task for the region.

    The lead is one row; its neighbours come by a join; the prefix is a running
    sum over the candidates of one lead, a set of LD neighbours.
    """
    kept = pips.filter(F.col("pip") >= pip_cutoff)
    lead = kept.orderBy(F.col("pip").desc(), "marker_idx").limit(1).select(F.col("marker_idx").alias("lead"))
    near = edges.select("i", "j", "r").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "r"))
    near = near.join(F.broadcast(lead), near["i"] == lead["lead"]).select(F.col("j").alias("marker_idx"), F.round(F.col("r") * F.col("r"), 10).alias("r2"))
    own = lead.select(F.col("lead").alias("marker_idx"), F.lit(1.0).alias("r2"))
    c = kept.join(near.unionByName(own), "marker_idx").filter(F.col("r2") >= min_r2)
    w = Window.orderBy(F.col("pip").desc(), "marker_idx")
    c = c.withColumn("rank", F.row_number().over(w)).withColumn("cumulative", F.sum("pip").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return c.filter(F.col("cumulative") - F.col("pip") < coverage).select("marker_idx", "pip", "r2", "rank")


def aggregate_runs(runs: DataFrame, keys: Iterable[str] = ("locus", "marker_idx")) -> DataFrame:
    """Mean, sd, min and max of PIP and effect over the refits of a locus."""
    out = []
    for c in ("pip", "effect"):
        out += [
            F.round(F.avg(c), 8).alias(f"{c}_mean"),
            F.round(F.stddev_samp(c), 8).alias(f"{c}_sd"),
            F.round(F.min(c), 8).alias(f"{c}_min"),
            F.round(F.max(c), 8).alias(f"{c}_max"),
        ]
    return runs.groupBy(*keys).agg(*out)


def set_tests(values: DataFrame, sets: DataFrame, n: float) -> DataFrame:
    """set, size, Vg, PIP-weighted Vg, enrichment and annotation pi.

    ``values`` has marker_idx, effect, wy, r, pip; ``sets`` (set, marker_idx).
    Enrichment is the mean PIP in the set over that outside.
    """
    whole = values.agg(F.sum("pip").alias("all_pip"), F.count("*").alias("m"))
    g = F.col("effect") * (F.col("wy") - F.col("r")) / n
    d = sets.distinct().join(values, "marker_idx").groupBy("set").agg(
        F.count("*").alias("size"), F.sum(g).alias("vg"), F.sum(g * F.col("pip")).alias("wvg"), F.sum("pip").alias("pip")
    )
    inside, outside = F.col("pip") / F.col("size"), (F.col("all_pip") - F.col("pip")) / (F.col("m") - F.col("size"))
    return d.crossJoin(F.broadcast(whole)).select(
        "set",
        "size",
        F.round("vg", 8).alias("vg"),
        F.round("wvg", 8).alias("weighted_vg"),
        F.round(inside / outside, 8).alias("enrichment"),
        F.round((1 + F.col("pip")) / (2 + F.col("size")), 8).alias("annotation_pi"),
    )


def clean_sets(sets: DataFrame, pips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(locus, marker_idx) without repeats and unknown markers; and the loci that none is left of."""
    known = sets.distinct().join(pips.select("marker_idx"), "marker_idx", "left_semi")
    return known, sets.select("locus").distinct().join(known.select("locus"), "locus", "left_anti")


def global_parameter(traces: DataFrame, quantity: str, nburn: int = 0, overrides: dict[str, float] | None = None) -> DataFrame:
    """trait, value: the given one, else the mean of the quantity's draws after burn-in over all chains.

    ``traces`` has trait, chain, iteration, quantity, value; a trait with neither is an error.
    """
    means = traces.filter((F.col("quantity") == quantity) & (F.col("iteration") > nburn)).groupBy("trait").agg(F.avg("value").alias("mean"))
    d = traces.select("trait").distinct().join(means, "trait", "left")
    given = F.create_map(*[F.lit(x) for kv in (overrides or {"": 0.0}).items() for x in kv])
    d = d.select("trait", F.round(F.coalesce(F.try_element_at(given, F.col("trait")), F.col("mean")), 8).alias("value"))
    none = [r["trait"] for r in d.filter("value is null or isnan(value)").select("trait").take(5)]
    if none:
        raise ValueError(f"no {quantity} for {none}: give it")
    return d
