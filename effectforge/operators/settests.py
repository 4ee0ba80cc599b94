"""Set and annotation tests on the effects of a fit, by set and trait."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def set_covariances(values: DataFrame, sets: DataFrame, n: float) -> DataFrame:
    """set, trait, trait2, g: half the sum of b1'q2 and b2'q1 over n, with q = wy - r.

    ``values`` has trait, marker_idx, effect, wy, r; every pair of traits comes once,
    trait <= trait2, a trait with itself included.
    """
    v = values.select("trait", "marker_idx", F.col("effect").alias("b"), (F.col("wy") - F.col("r")).alias("q"))
    other = v.select("marker_idx", *[F.col(c).alias(f"{c}2") for c in ("trait", "b", "q")])
    pairs = sets.distinct().join(v, "marker_idx").join(other, "marker_idx").filter("trait <= trait2")
    g = 0.5 * (F.sum(F.col("b") * F.col("q2")) + F.sum(F.col("b2") * F.col("q"))) / n
    return pairs.groupBy("set", "trait", "trait2").agg(F.round(g, 8).alias("g"))


def annotation_variances(values: DataFrame, sets: DataFrame, n: float, *, min_eff: float = 1.0, shrink: float = 0.5) -> DataFrame:
    """set, trait, vg, meff, vb: genetic variance over expected active markers, shrunk to the trait's mean.

    The mean over sets is that of the unshrunk values, which are 1e-12 at least.
    """
    d = sets.distinct().join(values, "marker_idx").groupBy("set", "trait").agg(
        F.greatest(F.sum(F.col("effect") * (F.col("wy") - F.col("r"))) / n, F.lit(0.0)).alias("vg"), F.sum("pip").alias("meff")
    )
    d = d.withColumn("own", F.greatest(F.col("vg") / F.greatest(F.col("meff"), F.lit(float(min_eff))), F.lit(1e-12)))
    mean = d.groupBy("trait").agg(F.avg("own").alias("mean"))
    vb = shrink * F.col("own") + (1 - shrink) * F.col("mean")
    return d.join(F.broadcast(mean), "trait").select("set", "trait", F.round("vg", 8).alias("vg"), F.round("meff", 8).alias("meff"), F.round(vb, 10).alias("vb"))


def marker_variances(annotations: DataFrame, coefficients: DataFrame, global_vb: DataFrame, cap: tuple[float, float] = (0.1, 10.0)) -> DataFrame:
    """trait, marker_idx, vb: the trait's variance times exp of the annotations' sum, within ``cap``.

    ``annotations`` (marker_idx, annotation, value), ``coefficients`` (annotation, trait,
    gamma) and ``global_vb`` (trait, vb) are catalogues.
    """
    eta = annotations.join(F.broadcast(coefficients), "annotation").groupBy("trait", "marker_idx").agg(F.sum(F.col("value") * F.col("gamma")).alias("eta"))
    return eta.join(F.broadcast(global_vb), "trait").select("trait", "marker_idx", F.round(F.col("vb") * _clip(F.exp("eta"), *cap), 10).alias("vb"))
