"""Joint allocation of two correlated markers: exact probabilities of their component pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectforge.operators.ld import symmetric


def marker_scores(stats: DataFrame, edges: DataFrame, effects: DataFrame) -> DataFrame:
    """trait, marker_idx, ww, yy, n, b and s = X'e with the marker's own effect (marker_idx, effect) added back."""
    st = stats.join(effects.select("marker_idx", F.col("effect").alias("b")), "marker_idx")
    left = st.select("trait", F.col("marker_idx").alias("i"), F.col("ww").alias("wi"))
    right = st.select("trait", F.col("marker_idx").alias("j"), F.col("ww").alias("wj"), F.col("b").alias("bj"))
    xb = symmetric(edges).join(left, "i").join(right, ["trait", "j"]).groupBy("trait", F.col("i").alias("marker_idx"))
    xb = xb.agg(F.sum(F.col("r") * F.sqrt(F.col("wi") * F.col("wj")) * F.col("bj")).alias("xb"))
    return st.join(xb, ["trait", "marker_idx"], "left").withColumn("s", F.col("wy") - F.coalesce("xb", F.lit(0.0))).drop("xb", "wy")


def pair_conditionals(stats: DataFrame, edges: DataFrame, effects: DataFrame, *, vb: float, ve_share: float, gamma: tuple[float, ...], pi: tuple[float, ...]) -> DataFrame:
    """trait, i, j, component_i, component_j, prob for both markers of every LD edge, given all other effects.

    Both effects are integrated out; the residual variance is ``ve_share`` of the phenotype's.
    A pair's states are worked out in its row, without a shuffle after the edge is joined.
    """
    s = marker_scores(stats, edges, effects)
    side = lambda k: [F.col(c).alias(f"{c}_{k}") for c in ("ww", "b", "s")]
    left = s.select("trait", F.col("marker_idx").alias("i"), (ve_share * F.col("yy") / F.col("n")).alias("noise"), *side("i"))
    right = s.select("trait", F.col("marker_idx").alias("j"), *side("j"))
    d = edges.select("i", "j", "r").join(left, "i").join(right, ["trait", "j"])
    d = d.withColumn("cross", F.col("r") * F.sqrt(F.col("ww_i") * F.col("ww_j")))
    # Each marker's score without either effect.
    d = d.withColumns({"h_i": (F.col("s_i") + F.col("cross") * F.col("b_j")) / F.col("noise"), "h_j": (F.col("s_j") + F.col("cross") * F.col("b_i")) / F.col("noise")})
    states = [(a, c) for a in range(len(gamma)) for c in range(len(gamma))]
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(c).alias("c"), *[F.lit(float(x)).alias(n) for n, x in (("va", vb * gamma[a] or 1.0), ("vc", vb * gamma[c] or 1.0), ("prior", np.log(pi[a]) + np.log(pi[c])))]) for a, c in states])

    def weight(x: Column) -> Column:
        h_i, h_j = F.col("h_i"), F.col("h_j")
        p_i, p_j = F.col("ww_i") / F.col("noise") + 1 / x["va"], F.col("ww_j") / F.col("noise") + 1 / x["vc"]
        p_ij = F.col("cross") / F.col("noise")
        det = p_i * p_j - p_ij * p_ij
        one = lambda v, p, h: h * h / p / 2 - F.log(v * p) / 2
        both = (p_j * h_i * h_i - 2 * p_ij * h_i * h_j + p_i * h_j * h_j) / det / 2 - F.log(x["va"] * x["vc"] * det) / 2
        gain = F.when((x["a"] > 0) & (x["c"] > 0), both).when(x["a"] > 0, one(x["va"], p_i, h_i)).when(x["c"] > 0, one(x["vc"], p_j, h_j))
        return F.struct(x["a"].alias("a"), x["c"].alias("c"), (x["prior"] + F.coalesce(gain, F.lit(0.0))).alias("lw"))

    d = d.withColumn("w", F.transform(table, weight))
    d = d.withColumn("top", F.array_max(F.transform("w", lambda x: x["lw"])))
    d = d.withColumn("total", F.aggregate("w", F.lit(0.0), lambda t, x: t + F.exp(x["lw"] - F.col("top"))))
    d = d.select("trait", "i", "j", "top", "total", F.explode("w").alias("x"))
    return d.select("trait", "i", "j", F.col("x.a").alias("component_i"), F.col("x.c").alias("component_j"), (F.exp(F.col("x.lw") - F.col("top")) / F.col("total")).alias("prob"))
