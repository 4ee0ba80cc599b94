"""Registered queries of models at fixed states, fine-mapping, diagnostics, files and plans, with their SQL.

They extend those of ``queries``, on the same bindings.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectforge.functions.expressions import CENTRAL, NEAR
from effectforge.operators import blocks, controls, finemap, genotypes, ld, multitrait, pairwise, particles, priors, samplers, selection, settests, simulate, summaries, tempering
from effectforge.queries import _EDGES, _PANEL, _PIPS, _VALUES, MARKERS, MIXTURE, ORACLE_SQL, PI, QUERIES, R2, VB, WINDOW, _chains, _edges, _markers, _panel, _pips, _scan, _sets, _stats, _values, _vector, query
from effectforge.sources import bed, csr
from effectforge.sources.files import shared_path

__all__ = ["ORACLE_SQL", "QUERIES"]

SHARE = 0.8
#: Scores of every marker and trait at the fixed effects x / 100; single precision as the sparse operator keeps it.
_SCORES = (
    _EDGES
    + f""", st AS (SELECT stats.*, x / 100 AS b FROM stats JOIN vec USING (marker_idx)), xb AS (
        SELECT a.trait AS trait, i AS marker_idx, sum((r * sqrt(a.ww * c.ww))::FLOAT::DOUBLE * c.b) AS xb
        FROM sym JOIN st a ON a.marker_idx = i JOIN st c ON c.marker_idx = sym.j AND c.trait = a.trait GROUP BY 1, 2
    ), sc AS (
        SELECT trait, marker_idx, ww, wy, b, yy, n, wy - coalesce(xb, 0) AS s, {SHARE}e0 * yy / n AS noise
        FROM st LEFT JOIN xb USING (trait, marker_idx)
    )"""
)


def _weights(source: str, prior: str, scale: str = "1.0e0", gamma: tuple[float, ...] = (0.0, 1.0), digits: int = 8) -> str:
    """SQL of component probabilities and mean effect from rows of s, ww, noise; ``prior`` gives a list of probabilities."""
    g = ", ".join(f"{x}e0" for x in gamma)
    return f""", k AS (
        SELECT trait, marker_idx, s, ww, noise, generate_subscripts(pi, 1) - 1 AS component, unnest(pi) AS pi, unnest([{g}]) * {VB}e0 * scale AS v
        FROM (SELECT *, {prior} AS pi, {scale} AS scale FROM {source})
    ), w AS (
        SELECT *, ln(pi) + 0.5e0 * ln(noise / (noise + ww * v)) + 0.5e0 * s * s * v / (noise * (noise + ww * v)) AS lw FROM k
    ), p AS (
        SELECT *, exp(lw - max(lw) OVER (PARTITION BY trait, marker_idx)) AS e FROM w
    ), q AS (SELECT *, e / sum(e) OVER (PARTITION BY trait, marker_idx) AS prob FROM p)
    SELECT trait, marker_idx, component::INT AS component, round(prob, {digits}) AS prob,
        round(sum(CASE WHEN component > 0 THEN prob * s / (ww + noise / v) ELSE 0 END) OVER (PARTITION BY trait, marker_idx), {digits}) AS mean FROM q"""


def _rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in ("prob", "mean")})


def _effects(spark: SparkSession) -> DataFrame:
    return _vector(spark).select("marker_idx", (F.col("x") / 100).alias("effect"))


def _conditional(spark: SparkSession, d: str, model: samplers.Model, operator: str = "csr", digits: int = 8, **more) -> DataFrame:
    table = samplers.conditional_table(model, VB, SHARE)
    out = samplers.at_effects(_stats(spark, d), _edges(spark, d), _effects(spark), table, samplers.CONDITIONALS, operator, 16, more)
    return _rounded(out, digits)


_SPIKE = f"[{1 - PI}e0, {PI}e0]"
_ODD = (np.arange(MARKERS) % 2 - 0.5)[:, None]


@query("q47_bayesc_conditional", f"WITH {_SCORES}" + _weights("sc", _SPIKE))
def q47(spark: SparkSession, d: str) -> DataFrame:
    return _conditional(spark, d, samplers.Model(pi=(1 - PI, PI)))


@query("q48_bayesr_conditional", f"WITH {_SCORES}" + _weights("sc", "[0.85e0, 0.05e0, 0.05e0, 0.05e0]", gamma=MIXTURE))
def q48(spark: SparkSession, d: str) -> DataFrame:
    return _conditional(spark, d, samplers.Model(gamma=MIXTURE, pi=(0.85, 0.05, 0.05, 0.05)))


@query(
    "q49_group_conditional",
    f"WITH {_SCORES}"
    + _weights("(SELECT *, ([0.05e0, 0.1e0, 0.2e0, 0.4e0])[marker_idx % 4 + 1] AS g FROM sc)", "[1 - g, g]", "([0.5e0, 1.0e0, 1.5e0, 2.0e0])[marker_idx % 4 + 1]"),
)
def q49(spark: SparkSession, d: str) -> DataFrame:
    group = np.arange(MARKERS) % 4
    extra = {"group": group, "group_pi": [0.05, 0.1, 0.2, 0.4], "multiplier": np.array([0.5, 1.0, 1.5, 2.0])[group]}
    return _conditional(spark, d, samplers.Model(pi=(1 - PI, PI), policy="group", extra=extra))


@query(
    "q50_logistic_conditional",
    f"WITH {_SCORES}" + _weights(f"(SELECT *, 1 / (1 + exp(-(ln({PI}e0 / {1 - PI}e0) + 0.7e0 * (marker_idx % 2 - 0.5e0)))) AS g FROM sc)", "[1 - g, g]"),
)
def q50(spark: SparkSession, d: str) -> DataFrame:
    return _conditional(spark, d, samplers.Model(pi=(1 - PI, PI), policy="learned_logistic", extra={"annotations": _ODD, "coefficients": [0.7]}))


@query(
    "q51_stick_conditional",
    f"""WITH {_SCORES}, e AS (SELECT o, unnest([0, 1, 2]) AS k, unnest([-1.0e0 + 0.5e0 * o, -0.5e0 + 0.2e0 * o, -0.3e0 * o + 0.1e0]) AS x FROM (SELECT unnest([0, 1]) AS o)), phi AS (
        SELECT o, k, 0.5e0 + sign(x) * sum(exp((2 * t + 1) * ln(abs(x)) - (t + 1) * ln(2) - lgamma(t + 1.5) + 0.5 * ln(pi())))
            * exp(-x * x / 2) / sqrt(2 * pi()) AS p
        FROM e, range(0, 121) r(t) GROUP BY o, k, x
    ), f AS (SELECT o, max(p) FILTER (k = 0) AS a, max(p) FILTER (k = 1) AS c, max(p) FILTER (k = 2) AS f FROM phi GROUP BY o)"""
    + _weights("(SELECT * FROM sc JOIN f ON f.o = sc.marker_idx % 2)", "[1 - a, a * (1 - c), a * c * (1 - f), a * c * f]", gamma=MIXTURE, digits=7),
)
def q51(spark: SparkSession, d: str) -> DataFrame:
    a = np.column_stack([np.ones(MARKERS), np.arange(MARKERS) % 2])
    extra = {"annotations": a, "coefficients": [[-1.0, -0.5, 0.1], [0.5, 0.2, -0.3]]}
    return _conditional(spark, d, samplers.Model(gamma=MIXTURE, pi=(0.85, 0.05, 0.05, 0.05), policy="probit_stick", extra=extra), digits=7)


@query("q52_log_variance_conditional", f"WITH {_SCORES}" + _weights("sc", _SPIKE, "exp(0.8e0 * (marker_idx % 2 - 0.5e0))"))
def q52(spark: SparkSession, d: str) -> DataFrame:
    return _conditional(spark, d, samplers.Model(pi=(1 - PI, PI), policy="log_variance", extra={"annotations": _ODD, "coefficients": [0.8]}))


_BLOCK_SCORES = (
    _EDGES
    + f""", st AS (SELECT stats.*, x / 100 AS b FROM stats JOIN vec USING (marker_idx)), xb AS (
        SELECT a.trait AS trait, i AS marker_idx, sum(r * sqrt(a.ww * c.ww) * c.b) AS xb
        FROM sym JOIN st a ON a.marker_idx = i JOIN st c ON c.marker_idx = sym.j AND c.trait = a.trait WHERE i // 16 = sym.j // 16 GROUP BY 1, 2
    ), sc AS (
        SELECT trait, marker_idx, ww, wy, b, yy, n, coalesce(xb, 0) AS off, wy - coalesce(xb, 0) AS s, {SHARE}e0 * yy / n AS noise
        FROM st LEFT JOIN xb USING (trait, marker_idx)
    )"""
)


@query("q53_low_rank_conditional", f"WITH {_BLOCK_SCORES}" + _weights("sc", _SPIKE, digits=6))
def q53(spark: SparkSession, d: str) -> DataFrame:
    """Blocks with all of their eigenvectors score as the blocks themselves."""
    return _conditional(spark, d, samplers.Model(pi=(1 - PI, PI)), "low_rank", 6, eigen_prop=1.0)


@query(
    "q54_ridge_conditional",
    f"WITH {_BLOCK_SCORES}" + _weights("(SELECT * REPLACE (wy - off / 1.25e0 AS s) FROM sc)", _SPIKE, digits=6),
)
def q54(spark: SparkSession, d: str) -> DataFrame:
    """Dense blocks with a fifth of the identity mixed in: correlations shrink by 1 / 1.25."""
    return _conditional(spark, d, samplers.Model(pi=(1 - PI, PI)), "ridge_fixed", 6, eta=0.25)


@query(
    "q55_genotype_conditional",
    f"""WITH {_EDGES}, z AS (SELECT s, j, (g - 2 * p) / sqrt(2 * p * (1 - p)) AS z FROM g JOIN m USING (j)),
    f AS (SELECT z.s AS s, sum(z * x / 100) AS f FROM z JOIN vec ON vec.marker_idx = z.j GROUP BY z.s),
    own AS (SELECT j, sum(z * z) AS ww FROM z GROUP BY j),
    sx AS (SELECT trait, z.j AS marker_idx, sum(z * (y - f)) AS e FROM z JOIN t USING (s) JOIN f USING (s) GROUP BY 1, 2),
    sc AS (SELECT sx.trait AS trait, marker_idx, ww, e + ww * x / 100 AS s, {SHARE}e0 * yy / ny AS noise
        FROM sx JOIN own ON own.j = marker_idx JOIN vec USING (marker_idx) JOIN tot USING (trait))"""
    + _weights("sc", _SPIKE, digits=6),
)
def q55(spark: SparkSession, d: str) -> DataFrame:
    panel, traits = _panel(spark, d)
    effects = (np.arange(MARKERS) % 7 - 3) / 100.0
    return _rounded(samplers.genotype_conditionals(panel, traits, effects, samplers.Model(pi=(1 - PI, PI)), VB, SHARE), 6)


JOINT = ((0.02, 0.01), (0.01, 0.03))
_DET = JOINT[0][0] * JOINT[1][1] - JOINT[0][1] ** 2


#: Probabilities of the four activity patterns from scores u1, u2 and informations i1, i2 of table u.
_PATTERNS = f""", lw AS (
        SELECT marker_idx, [ln(0.25e0),
            ln(0.25e0) + 0.5e0 * u1 * u1 / (1 / {JOINT[0][0]}e0 + i1) - 0.5e0 * ln(1 / {JOINT[0][0]}e0 + i1) - 0.5e0 * ln({JOINT[0][0]}e0),
            ln(0.25e0) + 0.5e0 * u2 * u2 / (1 / {JOINT[1][1]}e0 + i2) - 0.5e0 * ln(1 / {JOINT[1][1]}e0 + i2) - 0.5e0 * ln({JOINT[1][1]}e0),
            ln(0.25e0) + 0.5e0 * (u1 * u1 * p2 - 2 * u1 * u2 * p12 + u2 * u2 * p1) / (p1 * p2 - p12 * p12) - 0.5e0 * ln(p1 * p2 - p12 * p12) - 0.5e0 * ln({_DET}::DOUBLE)] AS lw
        FROM (SELECT *, {JOINT[1][1]}e0 / {_DET}::DOUBLE + i1 AS p1, {JOINT[0][0]}e0 / {_DET}::DOUBLE + i2 AS p2, -{JOINT[0][1]}e0 / {_DET}::DOUBLE AS p12 FROM u)
    ), e AS (SELECT marker_idx, list_transform(lw, lambda z: exp(z - list_max(lw))) AS e FROM lw)
    SELECT marker_idx, (generate_subscripts(e, 1) - 1)::INT AS pattern, round(unnest(e) / list_sum(e), 7) AS prob FROM e"""


@query(
    "q56_joint_conditional",
    f"""WITH {_SCORES}, u AS (
        SELECT a.marker_idx AS marker_idx, a.s / a.noise AS u1, c.s / c.noise AS u2, a.ww / a.noise AS i1, c.ww / c.noise AS i2
        FROM sc a JOIN sc c USING (marker_idx) WHERE a.trait = 'T1' AND c.trait = 'T2'
    )"""
    + _PATTERNS,
)
def q56(spark: SparkSession, d: str) -> DataFrame:
    """Probabilities of the activity patterns of two traits at each marker, by the joint kernel's weights."""

    def score(op: samplers.CsrOperator, b: np.ndarray, yy: float, n: float) -> pd.DataFrame:
        op.set_effects(b)
        noise = SHARE * yy / n
        return pd.DataFrame({"marker_idx": np.arange(len(b)), "u": (op.residual() + op.ww * b) / noise, "info": op.ww / noise})

    s = samplers.at_effects(_stats(spark, d), _edges(spark, d), _effects(spark), score, "marker_idx int, u double, info double")
    return multitrait.pattern_table(s, np.array(JOINT), np.full(4, 0.25)).withColumn("prob", F.round("prob", 7))


@query(
    "q57_skip_lengths",
    f"""WITH {_PIPS}, f AS (SELECT marker_idx, pip / 1000 AS p FROM p1) SELECT marker_idx, least(20, floor(6 * CASE WHEN p < 1e-6 THEN 4 WHEN p < 1e-5 THEN 2
        WHEN p < 1e-4 THEN 1 WHEN p < 1e-3 THEN 0.5 ELSE 0 END))::INT AS skip FROM f""",
)
def q57(spark: SparkSession, d: str) -> DataFrame:
    def skips(parts):
        for p in parts:
            yield pd.DataFrame({"marker_idx": p["marker_idx"], "skip": samplers.skip_length(p["pip"].to_numpy() / 1000, 6, 20).astype("int32")})

    return _pips(spark, d).mapInPandas(skips, "marker_idx int, skip int")


@query(
    "q58_swap_options",
    f"""WITH {_EDGES}, a AS (SELECT marker_idx FROM vec WHERE x > 1)
    SELECT trait, i AS marker_idx, count(*)::INT AS options FROM sym, (SELECT DISTINCT trait FROM stats)
    WHERE r * r >= {2 * R2} AND i IN (SELECT marker_idx FROM a) AND j NOT IN (SELECT marker_idx FROM a) GROUP BY 1, 2""",
)
def q58(spark: SparkSession, d: str) -> DataFrame:
    """How many excluded friends each active marker may swap with; active are effects above 0.01."""

    def options(op: samplers.CsrOperator, b: np.ndarray, yy: float, n: float) -> pd.DataFrame:
        found = samplers.swap_options(op, (b > 0.015).astype(int), 2 * R2, MARKERS)
        return pd.DataFrame({"marker_idx": [k for k, _ in found], "options": [len(f) for _, f in found]})

    return samplers.at_effects(_stats(spark, d), _edges(spark, d), _effects(spark), options, "marker_idx int, options int")


@query(
    "q59_block_residuals",
    f"""WITH {_BLOCK_SCORES}, t1 AS (SELECT trait, marker_idx // 16 AS block, sum(b * (ww * b + off)) / max(n) AS vg, sum(b * b) AS ss FROM sc GROUP BY 1, 2)
    SELECT trait, block::INT AS block, round(vg, 8) AS vg, round(ss, 8) AS effect_ss, ss / vg > 0.9e0 AS drawn FROM t1""",
)
def q59(spark: SparkSession, d: str) -> DataFrame:
    """Genetic variance and squared effects of low-rank blocks, and whether their residual variance is drawn."""

    def terms(op: samplers.LowRankOperator, b: np.ndarray, yy: float, n: float) -> pd.DataFrame:
        op.set_effects(b)
        rows = [(k, round(vg, 8), round(ss, 8), samplers.block_selected("allMixVe", 0, vg, ss, 0.9, False)[0]) for k, (vg, ss, _, _) in enumerate(op.block_terms(b, n))]
        return pd.DataFrame(rows, columns=["block", "vg", "effect_ss", "drawn"])

    schema = "block int, vg double, effect_ss double, drawn boolean"
    return samplers.at_effects(_stats(spark, d), _edges(spark, d), _effects(spark), terms, schema, "low_rank", 16, {"eigen_prop": 1.0})


ORACLE_SQL["q15_credible_sets_all"] = f"""WITH RECURSIVE {_PIPS}, near_to AS (
        SELECT i AS lead, list(j) AS js FROM (SELECT i, j FROM sym WHERE i // 16 = j // 16 AND r * r >= {R2} UNION ALL SELECT marker_idx, marker_idx FROM p1) GROUP BY i
    ), start AS (
        SELECT chr AS region, list({{'m': marker_idx, 'p': pip}} ORDER BY pip DESC, marker_idx) AS rem FROM p1 JOIN map USING (marker_idx) WHERE pip >= 0.001 GROUP BY chr
    ), walk AS (
        SELECT region, 0 AS step, NULL::BIGINT AS lead, list_filter(rem, lambda z: false) AS near, rem FROM start
        UNION ALL
        SELECT region, step + 1, rem[1].m, list_filter(rem, lambda z: list_contains(js, z.m)), list_filter(rem, lambda z: NOT list_contains(js, z.m))
        FROM walk JOIN near_to ON near_to.lead = rem[1].m WHERE len(rem) > 0
    ), n AS (SELECT region, step, lead, unnest(near) AS z, generate_subscripts(near, 1) AS rank FROM walk),
    c AS (
        SELECT region, step, lead, z.m AS marker_idx, z.p AS pip, rank, sum(z.p) OVER (PARTITION BY region, step ORDER BY rank) AS cum,
            sum(z.p) OVER (PARTITION BY region, step) AS total FROM n
    ), k AS (SELECT *, dense_rank() OVER (PARTITION BY region ORDER BY step) AS cs FROM c WHERE total >= 0.25 - 1e-12)
    SELECT region::VARCHAR AS region, cs::INT AS cs, marker_idx, pip, round(CASE WHEN marker_idx = lead THEN 1 ELSE r * r END, 10) AS r2_to_lead, rank::INT AS rank
    FROM k LEFT JOIN sym ON i = lead AND j = marker_idx WHERE cum - pip < 0.25 - 1e-12"""

ORACLE_SQL["q16_multisignal"] = f"""WITH RECURSIVE {_PIPS}, grid AS (
        SELECT list(coalesce(r * r, CASE WHEN a = b THEN 1.0e0 ELSE 0.0e0 END) ORDER BY a, b) AS rl
        FROM range({MARKERS}) x(a) CROSS JOIN range({MARKERS}) y(b) LEFT JOIN sym ON i = a AND j = b AND i // 16 = j // 16
    ), start AS (
        SELECT chr AS region, list({{'m': marker_idx, 'p': pip}} ORDER BY marker_idx) AS rem FROM p1 JOIN map USING (marker_idx) WHERE pip >= 0.001 GROUP BY chr
    ), walk AS (
        SELECT region, 0 AS step, NULL::BIGINT AS lead, list_transform(list_filter(rem, lambda z: false), lambda z: {{'q': -z.p, 'm': z.m, 'p': z.p}}) AS members, rem FROM start
        UNION ALL
        SELECT region, step + 1, lead2, CASE WHEN size <= len(near) THEN near[1:size] ELSE near[1:0] END,
            CASE WHEN size <= len(near) THEN list_filter(rem, lambda z: NOT list_contains(list_transform(near[1:size], lambda y: y.m), z.m))
                ELSE list_filter(rem, lambda z: z.m <> lead2) END
        FROM (SELECT *, len(list_filter(cums, lambda x: x < 0.25 - 1e-12)) + 1 AS size
        FROM (SELECT *, list_transform(range(1, len(near) + 1), lambda i: list_sum(list_transform(near[1:i], lambda z: z.p))) AS cums
        FROM (SELECT *, list_sort(list_transform(list_filter(rem, lambda z: rl[lead2 * {MARKERS} + z.m + 1] >= {R2}), lambda z: {{'q': -z.p, 'm': z.m, 'p': z.p}})) AS near
        FROM (SELECT *, rem[list_position(scores, list_max(scores))].m AS lead2, rem[list_position(scores, list_max(scores))].p AS lp
        FROM (SELECT *, list_transform(rem, lambda c: list_sum(list_transform(rem, lambda z: z.p * rl[c.m * {MARKERS} + z.m + 1]))) AS scores
        FROM walk, grid WHERE len(rem) > 0 AND list_sum(list_transform(rem, lambda z: z.p)) >= 0.3))))) WHERE lp >= 0.02
    ), n AS (SELECT region, step, lead, unnest(members) AS z, generate_subscripts(members, 1) AS rank FROM walk),
    k AS (SELECT region, dense_rank() OVER (PARTITION BY region ORDER BY step) AS cs, lead, z.m AS marker_idx, z.p AS pip, rank FROM n)
    SELECT region::VARCHAR AS region, cs::INT AS cs, marker_idx, pip, round(CASE WHEN marker_idx = lead THEN 1 ELSE r * r END, 10) AS r2_to_lead, rank::INT AS rank
    FROM k LEFT JOIN sym ON i = lead AND j = marker_idx"""


@query(
    "q60_set_summary",
    f"""WITH members AS ({ORACLE_SQL['q15_credible_sets_all']}) SELECT region, cs, max(marker_idx) FILTER (r2_to_lead = 1) AS lead_marker,
        max(pip) FILTER (r2_to_lead = 1) AS lead_pip, round(sum(pip), 8) AS cs_pip, count(*) AS n_markers,
        round(min(r2_to_lead), 8) AS min_r2_to_lead, round(avg(r2_to_lead), 8) AS mean_r2_to_lead FROM members GROUP BY 1, 2""",
)
def q60(spark: SparkSession, d: str) -> DataFrame:
    return finemap.credible_set_summary(_sets(spark, d))


@query("q61_region_ld", f"WITH {_EDGES} SELECT i // 16 AS region, i, j, r FROM sym WHERE i // 16 = j // 16 UNION ALL SELECT j // 16, j, j, 1.0 FROM m")
def q61(spark: SparkSession, d: str) -> DataFrame:
    return ld.region(_edges(spark, d), _markers(spark).select(F.col("chr").alias("region"), "marker_idx"))


@query("q62_genetic_score", f"WITH {_EDGES} SELECT s AS sample_idx, round(sum(g * x / 100), 8) + 0.0 AS score FROM g JOIN vec ON vec.marker_idx = g.j GROUP BY s")
def q62(spark: SparkSession, d: str) -> DataFrame:
    return genotypes.genetic_score(_panel(spark, d)[0], _effects(spark)).withColumn("score", F.round("score", 8) + 0.0)


@query(
    "q63_ld_window_bp",
    f"""WITH {_PANEL}, xx AS (SELECT *, sgg - 4 * p * sg + 4 * n * p * p AS xx FROM m), pairs AS (
        SELECT a.j AS i, b.j AS j, sum(a.g * b.g)::BIGINT AS gg FROM g a JOIN g b ON a.s = b.s AND b.j > a.j AND b.j - a.j <= 12
            AND b.j * 1000 - a.j * 1000 <= 5000 AND a.j // 16 = b.j // 16 GROUP BY 1, 2
    ) SELECT * FROM (SELECT i, pairs.j AS j, round((gg - 2 * b.p * a.sg - 2 * a.p * b.sg + 4 * a.n * a.p * b.p) / sqrt(a.xx * b.xx), 8) AS r
        FROM pairs JOIN xx a ON a.j = i JOIN xx b ON b.j = pairs.j) WHERE r * r >= {R2}""",
)
def q63(spark: SparkSession, d: str) -> DataFrame:
    return ld.ld_edges(_panel(spark, d)[0], max_distance_variants=12, r2_threshold=R2, positions=_markers(spark), max_distance_bp=5000, same_chr=True, tile=24)


_ALL_PAIRS = f"""{_PANEL}, xx AS (SELECT *, sgg - 4 * p * sg + 4 * n * p * p AS xx FROM m), pairs AS (
        SELECT a.j AS i, b.j AS j, sum(a.g * b.g)::BIGINT AS gg FROM g a JOIN g b ON a.s = b.s AND b.j > a.j GROUP BY 1, 2
    ), c AS (SELECT i, pairs.j AS j, gg - 2 * b.p * a.sg - 2 * a.p * b.sg + 4 * a.n * a.p * b.p AS c, sqrt(a.xx * b.xx) AS size,
        sqrt(2 * a.p * (1 - a.p)) * sqrt(2 * b.p * (1 - b.p)) AS sd FROM pairs JOIN xx a ON a.j = i JOIN xx b ON b.j = pairs.j)"""


@query("q64_ld_all_pairs", f"WITH {_ALL_PAIRS} SELECT i, j, r FROM (SELECT i, j, round(c / size, 8) AS r FROM c) WHERE r * r >= {R2}")
def q64(spark: SparkSession, d: str) -> DataFrame:
    return ld.ld_edges(_panel(spark, d)[0], max_distance_variants=0, allow_full=True, r2_threshold=R2, tile=16)


@query("q65_pair_check", f"WITH {_ALL_PAIRS} SELECT i, j, round(c / size, 8) AS r, round(c / sd, 6) AS xtx FROM c WHERE i % 5 = 0 AND j = i + 7")
def q65(spark: SparkSession, d: str) -> DataFrame:
    pairs = _markers(spark).filter("marker_idx % 5 = 0 and marker_idx + 7 < 64").select(F.col("marker_idx").alias("i"), (F.col("marker_idx") + 7).alias("j"))
    return ld.pair_check(_panel(spark, d)[0], pairs)


@query(
    "q66_blocks_in_reach",
    f"""WITH {_PANEL}, e AS (SELECT j // 8 AS k, min(j) AS f, max(j) AS l FROM m GROUP BY 1)
    SELECT x.k AS a, y.k AS b FROM e x JOIN e y ON x.k <= y.k AND y.f - x.l <= 9 AND y.f * 1000 - x.l * 1000 <= 5000""",
)
def q66(spark: SparkSession, d: str) -> DataFrame:
    return ld.blocks_in_reach(_markers(spark), 8, max_distance_variants=9, max_distance_bp=5000)


_BOTH_VALUES = (
    _EDGES
    + """, vb AS (SELECT stats.*, x / 100 * (CASE WHEN trait = 'T2' THEN 0.5e0 ELSE 1.0e0 END) AS effect FROM stats JOIN vec USING (marker_idx)),
    vx AS (SELECT a.trait AS trait, i AS marker_idx, sum(round(r * sqrt(a.ww * c.ww), 6) * c.effect) AS xb
        FROM sym JOIN vb a ON a.marker_idx = i JOIN vb c ON c.marker_idx = sym.j AND c.trait = a.trait GROUP BY 1, 2),
    bv AS (SELECT trait, marker_idx, effect, wy, n, ww * effect + coalesce(xb, 0) AS q FROM vb LEFT JOIN vx USING (trait, marker_idx))"""
)


def _both_values(spark: SparkSession, d: str) -> DataFrame:
    """trait, marker_idx, effect, wy, r, pip, n of both traits."""
    s, e = _stats(spark, d), _edges(spark, d)
    half = F.when(F.col("trait") == "T2", 0.5).otherwise(1.0)
    v = s.join(_vector(spark), "marker_idx").withColumn("effect", F.col("x") / 100 * half)
    local = v.select(F.lit("P").alias("provider_id"), "trait", F.col("marker_idx").alias("global_idx"), F.col("wy").alias("score"), "ww")
    effects = v.select("trait", F.col("marker_idx").alias("global_idx"), "effect")
    left = multitrait.provider_residuals(local, e.withColumn("provider_id", F.lit("P")), effects)
    r = left.select("trait", F.col("global_idx").alias("marker_idx"), F.col("residual").alias("r"))
    pips = _scan(spark, d).select("trait", "marker_idx", F.round("pip", 8).alias("pip"))
    return v.join(r, ["trait", "marker_idx"]).join(pips, ["trait", "marker_idx"])


def _quarters(spark: SparkSession) -> DataFrame:
    return _markers(spark).select((F.col("marker_idx") % 4).alias("set"), "marker_idx")


@query(
    "q67_set_covariances",
    f"""WITH {_BOTH_VALUES}, w AS (SELECT trait, marker_idx, effect AS b, wy - round(wy - q, 6) AS q, n FROM bv)
    SELECT a.marker_idx % 4 AS "set", a.trait AS trait, c.trait AS trait2, round(0.5e0 * (sum(a.b * c.q) + sum(c.b * a.q)) / max(a.n), 8) AS g
    FROM w a JOIN w c USING (marker_idx) WHERE a.trait <= c.trait GROUP BY 1, 2, 3""",
)
def q67(spark: SparkSession, d: str) -> DataFrame:
    v = _both_values(spark, d)
    return settests.set_covariances(v, _quarters(spark), v.agg(F.max("n")).first()[0])


@query("q68_annotation_variances")
def q68(spark: SparkSession, d: str) -> DataFrame:
    v = _both_values(spark, d)
    return settests.annotation_variances(v, _quarters(spark), v.agg(F.max("n")).first()[0])


ORACLE_SQL["q68_annotation_variances"] = f"""WITH {_PIPS}{_BOTH_VALUES[len(_EDGES):]}, per AS (
        SELECT marker_idx % 4 AS "set", trait, greatest(sum(effect * (wy - round(wy - q, 6))) / max(bv.n), 0) AS vg, sum(pip) AS meff
        FROM bv JOIN pips USING (trait, marker_idx) GROUP BY 1, 2
    ), own AS (SELECT *, greatest(vg / greatest(meff, 1), 1e-12) AS own FROM per)
    SELECT "set", trait, round(vg, 8) AS vg, round(meff, 8) AS meff, round(0.5e0 * own + 0.5e0 * avg(own) OVER (PARTITION BY trait), 10) AS vb FROM own"""


@query(
    "q69_marker_variances",
    f"""WITH {_PANEL} SELECT unnest(['T1', 'T2']) AS trait, j AS marker_idx, round(unnest([0.02e0, 0.03e0]) *
        unnest([least(greatest(exp(0.8e0 * (j % 2) + 3.0e0 * p), 0.1), 10.0), least(greatest(exp(-4.0e0 * (j % 2) + 0.5e0 * p), 0.1), 10.0)]), 10) AS vb
    FROM (SELECT j, round(p, 8) AS p FROM m)""",
)
def q69(spark: SparkSession, d: str) -> DataFrame:
    gamma = spark.createDataFrame([("odd", "T1", 0.8), ("af", "T1", 3.0), ("odd", "T2", -4.0), ("af", "T2", 0.5)], "annotation string, trait string, gamma double")
    return settests.marker_variances(_annotations(spark, d), gamma, spark.createDataFrame([("T1", 0.02), ("T2", 0.03)], "trait string, vb double"))


def _annotations(spark: SparkSession, d: str) -> DataFrame:
    af = genotypes.allele_freq(_panel(spark, d)[0]).select("marker_idx", F.lit("af").alias("annotation"), F.col("af").alias("value"))
    odd = _markers(spark).select("marker_idx", F.lit("odd").alias("annotation"), (F.col("marker_idx") % 2).cast("double").alias("value"))
    return af.unionByName(odd)


_ANNOTATED = f"""{_PANEL}, a AS (SELECT j AS marker_idx, 'af' AS annotation, round(p, 8) AS value FROM m UNION ALL SELECT j, 'odd', (j % 2)::DOUBLE FROM m),
    s AS (SELECT annotation, avg(value) AS mean, stddev_samp(value) AS sd FROM a GROUP BY 1)"""


@query("q70_annotation_scores", f"WITH {_ANNOTATED} SELECT marker_idx, annotation, round(CASE WHEN annotation = 'af' THEN (value - mean) / sd ELSE value END, 6) AS value FROM a JOIN s USING (annotation)")
def q70(spark: SparkSession, d: str) -> DataFrame:
    return priors.annotation_matrix(_annotations(spark, d)).withColumn("value", F.round("value", 6))


@query("q71_centred_annotations", f"WITH {_ANNOTATED} SELECT marker_idx, annotation, round((value - mean) / CASE WHEN annotation = 'af' THEN sd ELSE 1 END, 6) AS value FROM a JOIN s USING (annotation)")
def q71(spark: SparkSession, d: str) -> DataFrame:
    return priors.centred_annotations(_annotations(spark, d)).withColumn("value", F.round("value", 6))


@query(
    "q72_group_index",
    """WITH f AS (SELECT p_brand, min(p_partkey) AS f FROM part GROUP BY 1), k AS (SELECT p_brand, row_number() OVER (ORDER BY f) - 1 AS k FROM f)
    SELECT p_partkey AS marker_idx, k::INT AS "group" FROM part JOIN k USING (p_brand)""",
)
def q72(spark: SparkSession, d: str) -> DataFrame:
    return priors.group_index(spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("marker_idx"), F.col("p_brand").alias("label")))


@query(
    "q73_group_multipliers",
    """WITH g AS (SELECT p_size % 5 AS "group", count(*) AS size FROM part GROUP BY 1), m AS (SELECT *, 0.5e0 + 0.3e0 * "group" AS x FROM g)
    SELECT "group", round(x / (sum(x * size) OVER () / sum(size) OVER ()), 10) AS multiplier FROM m""",
)
def q73(spark: SparkSession, d: str) -> DataFrame:
    groups = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("marker_idx"), (F.col("p_size") % 5).alias("group"))
    five = groups.select("group").distinct().withColumn("multiplier", F.lit(0.5) + F.lit(0.3) * F.col("group"))
    return priors.group_variance_means(groups, five)


@query(
    "q74_sticks_of_components",
    f"""WITH {_PIPS}, k AS (SELECT trait, marker_idx, unnest([0, 1, 2]) AS component, unnest([1 - pip, pip * 0.75e0, pip * 0.25e0]) AS prob FROM pips),
    l AS (SELECT *, sum(prob) OVER (PARTITION BY trait, marker_idx ORDER BY component DESC) AS l FROM k)
    SELECT trait || ':' || marker_idx AS key, component AS stick, round(least(greatest(CASE WHEN l > 0 THEN (l - prob) / l ELSE 0.5 END, 2.220446049250313e-16), 1 - 2.220446049250313e-16), 10) AS p
    FROM l WHERE component < 2""",
)
def q74(spark: SparkSession, d: str) -> DataFrame:
    p = _scan(spark, d).select(F.concat_ws(":", "trait", F.col("marker_idx").cast("string")).alias("key"), F.round("pip", 8).alias("pip"))
    parts = F.posexplode(F.array(1 - F.col("pip"), F.col("pip") * 0.75, F.col("pip") * 0.25)).alias("component", "prob")
    return priors.sticks_of_components(p.select("key", parts))


@query(
    "q75_joint_calibration",
    f"""WITH {_PANEL}, w AS (SELECT 'T1' AS trait, 64 * (0.05e0 * 1.0e0 + 0.02e0 * 0.5e0) AS weight UNION ALL SELECT 'T2', 64 * (0.03e0 * 2.0e0 + 0.02e0 * 0.5e0))
    SELECT trait, round(weight, 8) AS weight, round(vy * 0.4e0 / weight, 10) AS vb, round(vy * 0.6e0, 10) AS ve, round(0.5e0 * vy * 0.4e0 / weight, 10) AS ssb_prior,
        round(0.5e0 * vy * 0.6e0, 10) AS sse_prior FROM (SELECT trait, yy / ny::DOUBLE AS vy FROM tot) JOIN w USING (trait)""",
)
def q75(spark: SparkSession, d: str) -> DataFrame:
    t = _panel(spark, d)[1].groupBy("trait").agg((F.sum(F.col("y") * F.col("y")) / F.count("*")).alias("vy"))
    states = [(0, "T1", False, 0.9, 1.0), (0, "T2", False, 0.9, 1.0), (1, "T1", True, 0.05, 1.0), (1, "T2", False, 0.05, 1.0), (2, "T1", False, 0.03, 2.0), (2, "T2", True, 0.03, 2.0), (3, "T1", True, 0.02, 0.5), (3, "T2", True, 0.02, 0.5)]
    return priors.calibrate_joint(t, spark.createDataFrame(states, "state int, trait string, active boolean, prob double, gamma double"), 0.4, MARKERS)


@query(
    "q76_enriched_priors",
    f"""WITH {_PANEL}, e AS (SELECT j, ln(5.0e0) * (j % 2) AS a, ln(2.0e0) * (j % 2) AS v FROM m), c AS (SELECT j, a - avg(a) OVER () AS a, v - avg(v) OVER () AS v FROM e)
    SELECT trait, j AS marker_idx, round(least(greatest(1 / (1 + exp(-(ln(0.001e0 / 0.999e0) + a * o))), 1e-8), 0.05), 10) AS pi, round(least(greatest(exp(v * o), 0.25), 4.0), 10) AS vb_multiplier
    FROM c, (SELECT unnest(['T1', 'T2']) AS trait, unnest([1, 0]) AS o)""",
)
def q76(spark: SparkSession, d: str) -> DataFrame:
    return priors.enriched_priors(_annotations(spark, d), ["T1", "T2"], {"odd": (5.0, 2.0)}, only=["T1"])


@query(
    "q77_probability_surface",
    f"""WITH {_PANEL}, e AS (SELECT j, round(p, 8) - avg(round(p, 8)) OVER () AS a FROM m), s AS (
        SELECT j, 1 / (1 + exp(-(ln(0.02e0 / 0.98e0) + 3.0e0 * a))) AS c1, 1 / (1 + exp(-(ln((0.08e0 / 0.98e0) / (1 - 0.08e0 / 0.98e0)) - 2.0e0 * a))) AS c2 FROM e)
    SELECT j AS marker_idx, unnest([0, 1, 2]) AS component, unnest([round((1 - c1) * (1 - c2), 10), round((1 - c1) * c2, 10), round(c1, 10)]) AS prob FROM s""",
)
def q77(spark: SparkSession, d: str) -> DataFrame:
    af = _annotations(spark, d).filter("annotation = 'af'")
    centred = af.crossJoin(F.broadcast(af.agg(F.avg("value").alias("mean")))).select("marker_idx", "annotation", (F.col("value") - F.col("mean")).alias("value"))
    return simulate.probability_surface(centred, [0.9, 0.08, 0.02], [0.0, 0.1, 1.0], {"af": [3.0, -2.0]})


@query(
    "q78_exactness",
    """SELECT event_type AS trait, 0.0 AS max_gap, round(var_samp(g) / var_samp(g + e), 8) AS h2_observed, 0.4 AS h2_target
    FROM (SELECT event_type, round(value, 4) AS g, (user_id % 7)::DOUBLE AS e FROM events WHERE value IS NOT NULL) GROUP BY 1""",
)
def q78(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").filter("value is not null")
    v = e.select(F.col("event_type").alias("trait"), F.round("value", 4).alias("g"), (F.col("user_id") % 7).cast("double").alias("e"))
    return simulate.exactness(v.withColumn("y", F.col("g") + F.col("e")), 0.4)


@query("q79_forced_correlation", "SELECT 'a' AS one, 'b' AS other, 0.3 AS r UNION ALL SELECT 'a', 'c', -0.2 UNION ALL SELECT 'b', 'c', 0.1")
def q79(spark: SparkSession, d: str) -> DataFrame:
    """Correlations of three columns after recolouring: exactly those asked for."""
    e = spark.read.parquet(f"{d}/events.parquet").filter("value is not null")
    t = e.select(F.col("value").alias("a"), (F.col("user_id") + F.col("value")).cast("double").alias("b"), (F.col("event_id") % 11).cast("double").alias("c"))
    t = simulate.recolour(t, ["a", "b", "c"], np.array([[1, 0.3, -0.2], [0.3, 1, 0.1], [-0.2, 0.1, 1]]))
    r = t.agg(*[F.round(F.corr(x, y), 6).alias(x + y) for x, y in (("a", "b"), ("a", "c"), ("b", "c"))])
    return r.select(F.explode(F.array(*[F.struct(F.lit(x).alias("one"), F.lit(y).alias("other"), F.col(x + y).alias("r")) for x, y in (("a", "b"), ("a", "c"), ("b", "c"))])).alias("k")).select("k.*")


_TRACES = """t AS (SELECT event_type, event_id % 4 AS chain, event_id // 4 AS it, round(value, 4) AS value FROM events WHERE value IS NOT NULL),
    l AS (SELECT event_type, chain, count(*) AS len, min(it) AS first FROM t GROUP BY 1, 2)"""


def _poly(table: tuple, x: str) -> str:
    out = []
    for terms in table:
        text = f"{terms[-1]!r}::DOUBLE"
        for t in reversed(terms[:-1]):
            text = f"({text} * {x} + {t!r}::DOUBLE)"
        out.append(text)
    return f"({out[0]} / {out[1]})"


@query(
    "q80_rank_rhat",
    f"""WITH {_TRACES}, md AS (SELECT event_type, quantile_cont(value, 0.5) AS median FROM t GROUP BY 1), h AS (
        SELECT event_type, chain, CASE WHEN it - first < len // 2 THEN 0 WHEN it - first >= len - len // 2 THEN 1 END AS half, value, abs(value - median) AS fold
        FROM t JOIN l USING (event_type, chain) JOIN md USING (event_type)
    ), b AS (SELECT event_type, chain, half, 'rank' AS kind, value AS x FROM h WHERE half IS NOT NULL UNION ALL SELECT event_type, chain, half, 'folded', fold FROM h WHERE half IS NOT NULL),
    r AS (SELECT *, (rank() OVER (PARTITION BY event_type, kind ORDER BY x) + (count(*) OVER (PARTITION BY event_type, kind, x) - 1) / 2.0e0 - 0.375e0)
        / (count(*) OVER (PARTITION BY event_type, kind) + 0.25e0) AS p FROM b),
    z AS (SELECT *, CASE WHEN abs(p - 0.5e0) <= 0.425e0 THEN (p - 0.5e0) * {_poly(CENTRAL, '(0.180625e0 - (p - 0.5e0) * (p - 0.5e0))')}
        ELSE sign(p - 0.5e0) * {_poly(NEAR, '(sqrt(-ln(least(p, 1 - p))) - 1.6e0)')} END AS z FROM r),
    q AS (SELECT event_type, kind, chain, half, avg(z) AS m, var_samp(z) AS w, count(*) AS n FROM z GROUP BY 1, 2, 3, 4),
    a AS (SELECT event_type, kind, var_samp(m) AS bm, avg(w) AS w, min(n) AS n FROM q GROUP BY 1, 2),
    o AS (SELECT event_type, kind, sqrt((bm * n / w + n - 1) / n) AS v FROM a)
    SELECT event_type, round(max(v) FILTER (kind = 'rank'), 6) AS rhat_rank, round(max(v) FILTER (kind = 'folded'), 6) AS rhat_folded, round(max(v), 6) AS rhat FROM o GROUP BY 1""",
)
def q80(spark: SparkSession, d: str) -> DataFrame:
    return summaries.rank_rhat(_chains(spark, d), ["event_type"])


@query(
    "q81_hpd",
    f"""WITH {_TRACES}, v AS (SELECT event_type, chain, list_sort(list(value)) AS v, count(*) AS n FROM t GROUP BY 1, 2),
    g AS (SELECT *, greatest(1, least(n - 1, round(n * 0.95)))::BIGINT AS gap FROM v WHERE n > 1),
    k AS (SELECT *, list_sort(list_transform(range(1, n - gap + 1), lambda k: {{'w': round(v[k + gap] - v[k], 10), 'k': k}}))[1].k AS k FROM g)
    SELECT event_type, chain, round(v[k], 6) AS lower, round(v[k + gap], 6) AS upper FROM k""",
)
def q81(spark: SparkSession, d: str) -> DataFrame:
    return summaries.hpd(_chains(spark, d), ["event_type", "chain"])


@query(
    "q82_lag_correlation",
    f"""WITH {_TRACES}, v AS (SELECT *, value - avg(value) OVER (PARTITION BY event_type, chain) AS dev FROM t),
    g AS (SELECT *, lag(dev) OVER (PARTITION BY event_type, chain ORDER BY it) AS before FROM v)
    SELECT event_type, chain, round(sum(dev * before) / sum(dev * dev), 6) AS lag1 FROM g GROUP BY 1, 2""",
)
def q82(spark: SparkSession, d: str) -> DataFrame:
    return summaries.lag_correlation(_chains(spark, d), ["event_type", "chain"])


@query(
    "q83_overview",
    f"""WITH x AS (SELECT event_type AS quantity, rhat FROM ({ORACLE_SQL['q27_rhat_basic']})), f AS (SELECT quantity, rhat, rhat > 1.001 AS flag FROM x)
    SELECT count(*) AS n_quantities, count(*) AS n_computed, 0 AS n_partial, 0 AS n_unavailable, count(*) FILTER (flag) AS n_flagged, 0 AS n_constant_chain_mismatch,
        max(rhat) AS max_rhat, max_by(quantity, struct_pack(r := rhat, q := quantity)) AS max_rhat_quantity, min(rhat * 100) AS min_ess_bulk, min(rhat * 50) AS min_ess_tail,
        CASE WHEN count(*) FILTER (flag) > 0 THEN 'warning' ELSE 'ok' END AS overall_status FROM f""",
)
def q83(spark: SparkSession, d: str) -> DataFrame:
    x = summaries.rhat_basic(_chains(spark, d), ["event_type"]).withColumnRenamed("event_type", "quantity")
    table = x.withColumns({"status": F.lit("computed"), "ess_bulk": F.col("rhat") * 100, "ess_tail": F.col("rhat") * 50, "rhat_flag": F.col("rhat") > 1.001, "ess_flag": F.lit(False), "mcse_flag": F.lit(False)})
    return summaries.overview(table)


@query(
    "q84_strongest",
    f"WITH {_PIPS}, k AS (SELECT trait, marker_idx, pip, row_number() OVER (PARTITION BY trait ORDER BY pip DESC, marker_idx) AS k FROM pips WHERE pip >= 0.02) SELECT trait, marker_idx, pip FROM k WHERE k <= 5",
)
def q84(spark: SparkSession, d: str) -> DataFrame:
    return summaries.strongest(_scan(spark, d).select("trait", "marker_idx", F.round("pip", 8).alias("pip")), min_pip=0.02, top_n=5)


@query("q85_global_parameter", "SELECT event_type AS trait, round(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 0.5 ELSE avg(round(value, 4)) END, 8) AS value FROM events WHERE value IS NOT NULL AND event_id // 4 > 10 GROUP BY event_type")
def q85(spark: SparkSession, d: str) -> DataFrame:
    t = _chains(spark, d).select(F.col("event_type").alias("trait"), "chain", "iteration", F.lit("vb").alias("quantity"), "value")
    first = t.agg(F.min("trait")).first()[0]
    return finemap.global_parameter(t, "vb", nburn=10, overrides={first: 0.5})


@query("q86_clean_sets", "SELECT DISTINCT ps AS locus, k AS marker_idx FROM (SELECT p_size % 6 AS ps, p_partkey % 90 AS k FROM part) WHERE k < 64")
def q86(spark: SparkSession, d: str) -> DataFrame:
    sets = spark.read.parquet(f"{d}/part.parquet").select((F.col("p_size") % 6).alias("locus"), (F.col("p_partkey") % 90).cast("int").alias("marker_idx"))
    return finemap.clean_sets(sets, _pips(spark, d))[0]


@query(
    "q87_loci_from_sets",
    f"""WITH {_PIPS}, s AS (SELECT DISTINCT j % 5 AS locus, j AS marker_idx FROM m UNION SELECT 9, j FROM m WHERE j < 10),
    k AS (SELECT locus, marker_idx, pip, chr, pos FROM s JOIN p1 USING (marker_idx) JOIN map USING (marker_idx))
    SELECT locus, CASE WHEN count(DISTINCT chr) = 1 THEN min(chr) END AS chr, min(pos) AS start, max(pos) AS "end", arg_max(marker_idx, struct_pack(p := pip, m := -marker_idx)) AS lead, max(pip) AS lead_pip FROM k GROUP BY 1""",
)
def q87(spark: SparkSession, d: str) -> DataFrame:
    m = _markers(spark)
    sets = m.select((F.col("marker_idx") % 5).alias("locus"), "marker_idx").unionByName(m.filter("marker_idx < 10").select(F.lit(9).alias("locus"), "marker_idx"))
    return finemap.loci_from_sets(sets, _pips(spark, d), m)


@query("q88_task_plan", "SELECT (t * 3 + c)::INT AS task_index, 'scalar:' || name || ':' || (c + 1) AS task_id, name AS trait, c::INT AS chain FROM (SELECT DISTINCT event_type AS name, dense_rank() OVER (ORDER BY event_type) - 1 AS t FROM events), range(3) r(c)")
def q88(spark: SparkSession, d: str) -> DataFrame:
    traits = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("trait"))
    return controls.task_plan(traits, priors.ChainControls(nchains=3)).drop("seed")


@query("q89_legacy_seeds", "SELECT n_nationkey AS trait_index, n_regionkey AS chain, 17 + 1000003 * (n_nationkey + 1) + 9176 * (n_regionkey + 1) AS seed FROM nation")
def q89(spark: SparkSession, d: str) -> DataFrame:
    tasks = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("trait_index"), F.col("n_regionkey").alias("chain"))
    return controls.legacy_seeds(tasks, 17)


@query(
    "q90_memory_estimate",
    """WITH s AS (SELECT n_nationkey AS m, n_regionkey + 1 AS nt, n_regionkey + 2 AS nchains, 2 AS ncores, 100 AS nit, 50 AS ntrace, n_nationkey % 3 AS quantities, 1000 AS operator_bytes,
        500 AS samples, n_nationkey % 2 = 0 AS keep_chains, n_nationkey % 5 = 0 AS keep_traces FROM nation), p AS (
        SELECT *, least(nchains, ncores) AS workers, 8.0e0 * (4 * m * nt + 3 * nt * nt + samples * nt) AS private_bytes, 8.0e0 * (4 * m * nt + 5 * ntrace * nt + 6 * nt * nt) AS result_bytes,
            8.0e0 * nchains * nit * quantities AS capture_bytes FROM s)
    SELECT *, operator_bytes + workers * private_bytes + nchains * result_bytes + capture_bytes + CASE WHEN quantities > 0 THEN 8.0e0 * nchains * nit * 12 ELSE 0 END
        + CASE WHEN keep_chains THEN result_bytes * nchains ELSE 0 END + CASE WHEN keep_traces THEN capture_bytes ELSE 0 END + result_bytes AS total_bytes FROM p""",
)
def q90(spark: SparkSession, d: str) -> DataFrame:
    n = spark.read.parquet(f"{d}/nation.parquet")
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    specs = n.select(k.alias("m"), (r + 1).alias("nt"), (r + 2).alias("nchains"), F.lit(2).alias("ncores"), F.lit(100).alias("nit"), F.lit(50).alias("ntrace"), (k % 3).alias("quantities"),
        F.lit(1000).alias("operator_bytes"), F.lit(500).alias("samples"), (k % 2 == 0).alias("keep_chains"), (k % 5 == 0).alias("keep_traces"))
    return controls.memory_estimate(specs)


@query(
    "q91_operator_contract",
    f"""WITH s AS (SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'ld_edges' WHEN 1 THEN 'other' END AS source, CASE WHEN n_nationkey % 4 <> 3 THEN 0.001e0 * (n_nationkey % 2) END AS r2_threshold,
        0 AS max_distance_variants, 0 AS max_distance_bp FROM nation), k AS (SELECT *, r2_threshold IS NOT NULL AND r2_threshold > 0 AS limited, r2_threshold = 0 AND source = 'ld_edges' AS complete FROM s)
    SELECT n_nationkey, source, r2_threshold, max_distance_variants, max_distance_bp, CASE WHEN complete THEN '{controls.EXACT}' WHEN limited THEN '{controls.SPARSE}' ELSE '{controls.SUPPLIED}' END AS contract,
        CASE WHEN complete THEN false WHEN limited THEN true END AS approximate FROM k""",
)
def q91(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    m = spark.read.parquet(f"{d}/nation.parquet").select(
        "n_nationkey", F.when(k % 3 == 0, "ld_edges").when(k % 3 == 1, "other").alias("source"), F.when(k % 4 != 3, 0.001 * (k % 2)).alias("r2_threshold"), F.lit(0).alias("max_distance_variants"), F.lit(0).alias("max_distance_bp")
    )
    return controls.operator_contract(m)


@query(
    "q92_reduction_policy",
    """WITH p AS (SELECT a.n_nationkey AS one, b.n_nationkey AS other, (['scalar', 'joint'])[a.n_regionkey % 2 + 1] AS family, (['csr', 'block_eigen', 'packed_bed'])[a.n_nationkey % 3 + 1] AS operator_a,
        (['csr', 'block_eigen', 'packed_bed'])[b.n_nationkey % 3 + 1] AS operator_b, a.n_nationkey % 2 = 0 AS filtered, (['diagonal', 'full'])[b.n_nationkey % 2 + 1] AS residual FROM nation a JOIN nation b USING (n_regionkey))
    SELECT *, CASE WHEN list_sort([operator_a, operator_b]) = ['block_eigen', 'csr'] THEN CASE WHEN filtered THEN 'approximate_filtered_operator' ELSE 'floating_point_equivalent' END
        WHEN list_sort([operator_a, operator_b]) = ['csr', 'packed_bed'] THEN CASE WHEN family = 'joint' AND residual = 'full' THEN 'not_comparable_residual_covariance'
            ELSE 'comparable_when_likelihood_contracts_match' END ELSE 'not_comparable_operator_contract' END AS policy FROM p""",
)
def q92(spark: SparkSession, d: str) -> DataFrame:
    """Policies of pairs of fits, one for two nations of a region."""
    pick = lambda c, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (c % len(values)).cast("int") + 1)
    n = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_regionkey")
    a, b = n.withColumnRenamed("n_nationkey", "one"), n.withColumnRenamed("n_nationkey", "other")
    one, other = F.col("one"), F.col("other")
    kinds = ("csr", "block_eigen", "packed_bed")
    p = a.join(b, "n_regionkey").select(
        "one", "other", pick(F.col("n_regionkey"), "scalar", "joint").alias("family"), pick(one, *kinds).alias("operator_a"), pick(other, *kinds).alias("operator_b"),
        (one % 2 == 0).alias("filtered"), pick(other, "diagonal", "full").alias("residual"),
    )
    return controls.reduction_policy(p)


@query(
    "q93_effect_maf",
    f"WITH {_PANEL} SELECT j AS marker_idx, round(least(p, 1 - p), 8) AS maf, 'gwas_summary' AS source FROM (SELECT j, round(p, 8) AS p FROM m)",
)
def q93(spark: SparkSession, d: str) -> DataFrame:
    """The given frequencies miss a marker, so those of the GWAS are taken."""
    af = genotypes.allele_freq(_panel(spark, d)[0])
    m = af.select("marker_idx", F.when(F.col("marker_idx") != 5, 0.2).alias("explicit_maf"), F.col("af").alias("gwas_af"), F.col("maf").alias("analysis_maf"), F.lit(0.1).alias("reference_maf"))
    return controls.effect_maf(m).withColumn("maf", F.round("maf", 8))


@query("q94_resolved_markers", "SELECT DISTINCT p_size AS chr, 'rs' || p_partkey AS marker_id, p_partkey AS marker_idx, p_partkey * 2 AS bed_column FROM part WHERE p_partkey % 3 = 0")
def q94(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    catalog = p.select(F.col("p_size").alias("chr"), F.concat(F.lit("rs"), "p_partkey").alias("marker_id"), F.col("p_partkey").alias("marker_idx"), (F.col("p_partkey") * 2).alias("bed_column"))
    return controls.resolve_markers(catalog.filter("marker_idx % 3 = 0").select("marker_id"), catalog)


@query(
    "q95_catalogue_differences",
    """WITH a AS (SELECT 'rs' || p_partkey AS marker_id, CASE WHEN p_size % 2 = 0 THEN 'AG' ELSE 'CT' END AS al FROM part WHERE p_partkey % 5 <> 0),
    b AS (SELECT 'rs' || p_partkey AS marker_id, CASE WHEN p_size % 3 = 0 THEN 'AG' ELSE 'CT' END AS al FROM part WHERE p_partkey % 7 <> 0)
    SELECT marker_id, 'first_only' AS problem FROM a ANTI JOIN b USING (marker_id) UNION ALL SELECT marker_id, 'second_only' FROM b ANTI JOIN a USING (marker_id)
    UNION ALL SELECT marker_id, 'alleles' FROM a JOIN b USING (marker_id) WHERE a.al <> b.al""",
)
def q95(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat(F.lit("rs"), "p_partkey").alias("marker_id"), "p_size")
    of = lambda keep, by: p.filter(keep).select("marker_id", F.when(F.col("p_size") % by == 0, "AG").otherwise("CT").alias("alleles"))
    return controls.frequencies_differ(of("p_partkey % 5 <> 0", 2), of("p_partkey % 7 <> 0", 3))


@query(
    "q96_valid_components",
    f"WITH {_PIPS} SELECT trait, count(*) AS markers, 2 AS components, count(*) FILTER (marker_idx = 3 AND trait = 'T2') = 0 AS ok FROM pips GROUP BY trait",
)
def q96(spark: SparkSession, d: str) -> DataFrame:
    """Two components of every marker; one of the second trait does not add up."""
    p = _scan(spark, d).select("trait", "marker_idx", F.round("pip", 8).alias("pip"))
    off = F.when((F.col("trait") == "T2") & (F.col("marker_idx") == 3), 0.1).otherwise(0.0)
    return controls.validate_components(p.select("trait", "marker_idx", F.posexplode(F.array(1 - F.col("pip") + off, F.col("pip"))).alias("component", "prob")))


@query(
    "q97_bed_round_trip",
    f"""WITH {_PANEL} SELECT j AS marker_idx, count(*) FILTER (g = 0) AS n0, count(*) FILTER (g = 1) AS n1, count(*) FILTER (g = 2) AS n2, 0 AS missing, sum(g * (s % 11))::BIGINT AS placed FROM g GROUP BY j""",
)
def q97(spark: SparkSession, d: str) -> DataFrame:
    """The panel written marker by marker as a BED file and scanned again, in blocks."""
    panel, _ = _panel(spark, d)
    # Samples of a BED file have no names: the panel's are numbered in their order.
    by_marker = panel.select("sample_idx", F.posexplode("dosages").alias("marker_idx", "g")).groupBy("marker_idx").agg(F.array_sort(F.collect_list(F.struct("sample_idx", "g"))).alias("e"))
    ids = [r[0] for r in panel.select("sample_idx").orderBy("sample_idx").collect()]
    path = shared_path(spark, "panel") + ".bed"
    bed.write_bed(by_marker.select("marker_idx", F.col("e.g").alias("dosages")), path)
    bed.register(spark)
    back = spark.read.format("plink_bed").options(n=len(ids), block=7).load(path)
    weights = F.array(*[F.lit(int(i % 11)) for i in ids])
    long = back.select("marker_idx", F.explode(F.arrays_zip(F.col("dosages").alias("g"), weights.alias("w"))).alias("e")).select("marker_idx", "e.g", "e.w")
    count = lambda c: F.count(F.when(c, 1))
    g = F.col("g")
    return long.groupBy("marker_idx").agg(count(g == 0).alias("n0"), count(g == 1).alias("n1"), count(g == 2).alias("n2"), count(g.isNull()).alias("missing"), F.sum(g * F.col("w")).alias("placed"))


def _marker_major(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The panel's marker-major rows and its traits by sample number."""
    panel, traits = _panel(spark, d)
    order = F.row_number().over(samplers.Window.orderBy("sample_idx")) - 1
    numbers = panel.select("sample_idx", order.cast("bigint").alias("at"))
    by_marker = panel.join(F.broadcast(numbers), "sample_idx").select("at", F.posexplode("dosages").alias("marker_idx", "g"))
    rows = by_marker.groupBy("marker_idx").agg(F.array_sort(F.collect_list(F.struct("at", "g"))).alias("e")).select("marker_idx", F.col("e.g").alias("dosages"))
    at = traits.join(F.broadcast(numbers), "sample_idx").select(F.col("at").alias("sample_idx"), "trait", "y")
    return rows, at


@query("q98_marker_major_stats", f"WITH {_PANEL} SELECT trait, marker_idx, wy, ww, yy, n FROM stats")
def q98(spark: SparkSession, d: str) -> DataFrame:
    """Sufficient statistics straight from marker-major rows."""
    return genotypes.marker_major_stats(*_marker_major(spark, d))


@query("q114_streamed_gwas", ORACLE_SQL["q03_marginal_gwas"])
def q114(spark: SparkSession, d: str) -> DataFrame:
    """Marginal regressions straight from marker-major rows, by stripes of samples."""
    return genotypes.marker_major_gwas(*_marker_major(spark, d))


@query("q99_csr_round_trip", f"WITH {_EDGES} SELECT i, j, r::FLOAT AS r FROM edges")
def q99(spark: SparkSession, d: str) -> DataFrame:
    """Edges written as CSR files and read again, in ranges of rows."""
    prefix = shared_path(spark, "ld")
    csr.write_csr(_edges(spark, d), _markers(spark), prefix)
    csr.register(spark)
    return spark.read.format("ld_csr").option("block", "10").load(prefix)


@query("q100_banded_round_trip", f"WITH {_EDGES} SELECT i, j, r::FLOAT AS r FROM edges WHERE j - i <= 4 AND abs(r::FLOAT) > 0.04::FLOAT")
def q100(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "band") + ".bin"
    csr.write_banded(_edges(spark, d), _markers(spark), path, 4)
    return csr.read_banded(spark, path, 4, 0.04)


@query("q101_csr_subset", f"WITH {_EDGES} SELECT least(a.k, b.k) AS i, greatest(a.k, b.k) AS j, r FROM edges JOIN (SELECT j AS m, 40 - j // 2 AS k FROM m WHERE j % 2 = 0) a ON a.m = i JOIN (SELECT j AS m, 40 - j // 2 AS k FROM m WHERE j % 2 = 0) b ON b.m = edges.j")
def q101(spark: SparkSession, d: str) -> DataFrame:
    local = _markers(spark).filter("marker_idx % 2 = 0").select("marker_idx", (40 - F.floor(F.col("marker_idx") / 2)).alias("local_idx"))
    return csr.subset(_edges(spark, d), local)


@query(
    "q102_provider_residuals",
    f"""WITH {_BOTH_VALUES} SELECT 'P' AS provider_id, trait, marker_idx AS global_idx, round(wy - q, 6) AS residual FROM bv""",
)
def q102(spark: SparkSession, d: str) -> DataFrame:
    s, e = _stats(spark, d), _edges(spark, d)
    half = F.when(F.col("trait") == "T2", 0.5).otherwise(1.0)
    v = s.join(_vector(spark), "marker_idx").withColumn("effect", F.col("x") / 100 * half)
    local = v.select(F.lit("P").alias("provider_id"), "trait", F.col("marker_idx").alias("global_idx"), F.col("wy").alias("score"), "ww")
    return multitrait.provider_residuals(local, e.withColumn("provider_id", F.lit("P")), v.select("trait", F.col("marker_idx").alias("global_idx"), "effect"))


@query("q103_maf_scale", f"WITH {_PANEL} SELECT j AS marker_idx, round(power(greatest(2 * mf * (1 - mf), 1e-8), -0.5 + 1), 8) AS scale FROM (SELECT j, round(least(p, 1 - p), 8) AS mf FROM m)")
def q103(spark: SparkSession, d: str) -> DataFrame:
    return genotypes.allele_freq(_panel(spark, d)[0]).select("marker_idx", F.round(priors.maf_scale(F.col("maf"), -0.5), 8).alias("scale"))


@query("q104_gamma_means", f"WITH x AS ({ORACLE_SQL['q23_stick_probabilities']}) SELECT marker_idx, round(sum(pi * ([0.0e0, 0.01e0, 0.1e0, 1.0e0])[component + 1]), 7) AS gamma_mean FROM x GROUP BY 1")
def q104(spark: SparkSession, d: str) -> DataFrame:
    return priors.sticks_gamma_mean(QUERIES["q23_stick_probabilities"](spark, d), list(MIXTURE)).withColumn("gamma_mean", F.round("gamma_mean", 7))


@query("q105_consistency", "SELECT unnest(['markers', 'pip_range', 'finite_effects']) AS \"check\", unnest([true, true, true]) AS ok, '' AS message")
def q105(spark: SparkSession, d: str) -> DataFrame:
    s = _stats(spark, d).select("trait", "marker_idx", (F.col("wy") / F.col("ww")).alias("effect"))
    return summaries.consistency(s.join(_scan(spark, d).select("trait", "marker_idx", "pip"), ["trait", "marker_idx"]), MARKERS)


#: Three providers: trait 1 without every fifth marker, trait 2 without every third and LD of its own, and trait 1 again on even markers, half the samples and a narrow band.
_PROVIDERS = (
    _EDGES
    + f""", pv AS (
        SELECT 'A' AS p, trait, marker_idx, wy, ww, {SHARE}e0 * yy / n AS phi FROM stats WHERE trait = 'T1' AND marker_idx % 5 <> 0
        UNION ALL SELECT 'B', trait, marker_idx, wy, ww, {SHARE}e0 * yy / n FROM stats WHERE trait = 'T2' AND marker_idx % 3 <> 0
        UNION ALL SELECT 'C', trait, marker_idx, wy / 2, ww / 2, {SHARE}e0 * yy / n FROM stats WHERE trait = 'T1' AND marker_idx % 2 = 0
    ), pe AS (
        SELECT 'A' AS p, i, j, r FROM sym UNION ALL SELECT 'B', i, j, r / 2 FROM sym UNION ALL SELECT 'C', i, j, r FROM sym WHERE abs(i - j) <= 6
    ), pb AS (
        SELECT p, trait, marker_idx, wy, ww, phi, x / 100 * CASE trait WHEN 'T2' THEN 0.5e0 ELSE 1 END AS b FROM pv JOIN vec USING (marker_idx)
    ), px AS (
        SELECT pe.p, i AS marker_idx, sum((r * sqrt(a.ww * c.ww))::FLOAT::DOUBLE * c.b) AS xb
        FROM pe JOIN pb a ON a.p = pe.p AND a.marker_idx = i JOIN pb c ON c.p = pe.p AND c.marker_idx = pe.j GROUP BY 1, 2
    ), ps AS (
        SELECT trait, marker_idx, sum((wy - coalesce(xb, 0)) / phi) AS u, sum(ww / phi) AS info FROM pb LEFT JOIN px USING (p, marker_idx) GROUP BY 1, 2
    ), u AS (
        SELECT m.j AS marker_idx, coalesce(a.u, 0) AS u1, coalesce(c.u, 0) AS u2, coalesce(a.info, 0) AS i1, coalesce(c.info, 0) AS i2
        FROM m LEFT JOIN ps a ON a.marker_idx = m.j AND a.trait = 'T1' LEFT JOIN ps c ON c.marker_idx = m.j AND c.trait = 'T2'
    )"""
)


@query("q106_provider_conditionals", f"WITH {_PROVIDERS}" + _PATTERNS)
def q106(spark: SparkSession, d: str) -> DataFrame:
    """Activity patterns of two traits at each marker by three providers with markers and LD of their own."""
    s, e = _stats(spark, d), _edges(spark, d)
    rows = [("A", "T1", F.col("marker_idx") % 5 != 0, 1.0, 1.0, 64), ("B", "T2", F.col("marker_idx") % 3 != 0, 1.0, 0.5, 64), ("C", "T1", F.col("marker_idx") % 2 == 0, 0.5, 1.0, 6)]
    local, edges, scales = [], [], []
    for name, trait, has, size, weak, band in rows:
        mine = s.filter(F.col("trait") == trait)
        local.append(mine.filter(has).select(F.lit(name).alias("provider_id"), F.col("marker_idx").alias("global_idx"), (F.col("wy") * size).alias("score"), (F.col("ww") * size).alias("ww")))
        edges.append(e.filter(F.col("j") - F.col("i") <= band).select(F.lit(name).alias("provider_id"), "i", "j", (F.col("r") * weak).alias("r")))
        scales.append(mine.select(F.lit(name).alias("provider_id"), "trait", (SHARE * F.col("yy") / F.col("n")).alias("residual_scale")).distinct())
    local, edges, scales = (x[0].unionByName(x[1]).unionByName(x[2]) for x in (local, edges, scales))
    half = F.when(F.col("trait") == "T2", 0.5).otherwise(1.0)
    effects = s.join(_vector(spark), "marker_idx").select("trait", F.col("marker_idx").alias("global_idx"), (F.col("x") / 100 * half).alias("effect"))
    markers = _markers(spark).select(F.col("marker_idx").alias("global_idx"))
    out = multitrait.provider_patterns(local, edges, scales, effects, markers, np.array(JOINT), np.full(4, 0.25))
    return out.withColumn("prob", F.round("prob", 7))


#: As _SCORES, in double precision throughout.
_EXACT = _SCORES.replace("::FLOAT::DOUBLE", "")


@query("q107_block_sweep_conditional", f"WITH {_EXACT}" + _weights("sc", "[0.85e0, 0.05e0, 0.05e0, 0.05e0]", gamma=MIXTURE, digits=6))
def q107(spark: SparkSession, d: str) -> DataFrame:
    """Component probabilities from the residuals that blocks of ten markers leave when they tell each other their effects."""
    model = samplers.Model(gamma=MIXTURE, pi=(0.85, 0.05, 0.05, 0.05))
    return _rounded(blocks.block_conditionals(_stats(spark, d), _edges(spark, d), _effects(spark), model, VB, SHARE, MARKERS, 10), 6)


_MIX_PI = (0.85, 0.05, 0.05, 0.05)


@query(
    "q108_pair_conditionals",
    f"""WITH {_EXACT}, mix AS (SELECT unnest([0, 1, 2, 3]) AS c, unnest({list(_MIX_PI)}::DOUBLE[]) AS pi, unnest({[VB * x for x in MIXTURE]}::DOUBLE[]) AS v), h AS (
        SELECT a.trait AS trait, i, j, a.noise AS noise, a.ww / a.noise AS da, b.ww / b.noise AS db, r * sqrt(a.ww * b.ww) / a.noise AS x,
            (a.s + r * sqrt(a.ww * b.ww) * b.b) / a.noise AS ha, (b.s + r * sqrt(a.ww * b.ww) * a.b) / a.noise AS hb
        FROM edges JOIN sc a ON a.marker_idx = i JOIN sc b ON b.marker_idx = edges.j AND b.trait = a.trait
    ), w AS (
        SELECT trait, i, j, p.c AS component_i, q.c AS component_j, ln(p.pi) + ln(q.pi) + CASE WHEN p.c > 0 AND q.c > 0 THEN
                0.5 * ((db + 1 / q.v) * ha * ha - 2 * x * ha * hb + (da + 1 / p.v) * hb * hb) / ((da + 1 / p.v) * (db + 1 / q.v) - x * x)
                - 0.5 * ln(p.v * q.v * ((da + 1 / p.v) * (db + 1 / q.v) - x * x))
            WHEN p.c > 0 THEN 0.5 * ha * ha / (da + 1 / p.v) - 0.5 * ln(p.v * (da + 1 / p.v))
            WHEN q.c > 0 THEN 0.5 * hb * hb / (db + 1 / q.v) - 0.5 * ln(q.v * (db + 1 / q.v)) ELSE 0 END AS lw
        FROM h CROSS JOIN mix p CROSS JOIN mix q
    ), e AS (SELECT *, exp(lw - max(lw) OVER (PARTITION BY trait, i, j)) AS e FROM w)
    SELECT trait, i::INT AS i, j::INT AS j, component_i::INT AS component_i, component_j::INT AS component_j, round(e / sum(e) OVER (PARTITION BY trait, i, j), 7) AS prob FROM e""",
)
def q108(spark: SparkSession, d: str) -> DataFrame:
    """Joint component probabilities of the two markers of every LD edge, at fixed effects of the others."""
    out = pairwise.pair_conditionals(_stats(spark, d), _edges(spark, d), _effects(spark), vb=VB, ve_share=SHARE, gamma=MIXTURE, pi=_MIX_PI)
    return out.withColumn("prob", F.round("prob", 7))


def _selection_markers(spark: SparkSession, d: str) -> DataFrame:
    """Components by marker number, three annotations, and latents from trait 1's marginal z scores."""
    k = F.col("marker_idx")
    a = F.array(F.lit(1.0), (k % 2).cast("double"), (k % 5).cast("double") / 4, (k < 20).cast("double"))
    z = F.col("wy") / F.sqrt(F.col("ww") * F.col("yy") / F.col("n"))
    s = _stats(spark, d).filter("trait = 'T1'")
    return s.select("marker_idx", F.pmod(k * 7, F.lit(4)).alias("component"), a.alias("a"), F.array(*[F.round(z * (0.5 + 0.25 * x), 6) for x in range(3)]).alias("z"))


@query(
    "q109_annotation_selection",
    f"""WITH {_PANEL}, mk AS (
        SELECT marker_idx, (marker_idx * 7) % 4 AS component, [(marker_idx % 2)::DOUBLE, (marker_idx % 5) / 4.0e0, (marker_idx < 20)::INT::DOUBLE] AS a, wy / sqrt(ww * yy / n) AS z
        FROM stats WHERE trait = 'T1'
    ), st AS (
        SELECT k, a, round(z * (0.5e0 + 0.25e0 * k), 6) - (0.1e0 - 0.2e0 * k) AS z FROM mk, range(3) t(k) WHERE component >= k
    ), mo AS (
        SELECT k, sum(a[1] * a[1]) AS s11, sum(a[1] * a[2]) AS s12, sum(a[1] * a[3]) AS s13, sum(a[2] * a[2]) AS s22, sum(a[2] * a[3]) AS s23, sum(a[3] * a[3]) AS s33,
            sum(a[1] * z) AS t1, sum(a[2] * z) AS t2, sum(a[3] * z) AS t3, 0.5e0 + 0.5e0 * k AS tau FROM st GROUP BY k
    ), sub AS (
        SELECT n, n % 2 AS u1, n // 2 % 2 AS u2, n // 4 AS u3 FROM range(8) t(n)
    ), mm AS (
        SELECT n, u1, u2, u3, k, tau, 1 + tau * s11 * u1 AS a, tau * s12 * u1 * u2 AS b, tau * s13 * u1 * u3 AS c, 1 + tau * s22 * u2 AS d, tau * s23 * u2 * u3 AS e,
            1 + tau * s33 * u3 AS f, t1 * u1 AS x, t2 * u2 AS y, t3 * u3 AS z
        FROM mo CROSS JOIN sub
    ), dt AS (
        SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM mm
    ), lw AS (
        SELECT n, u1, u2, u3, (u1 + u2 + u3) * ln(0.3e0) + (3 - u1 - u2 - u3) * ln(0.7e0) + sum(-0.5e0 * ln(det) + 0.5e0 * tau * (
            x * x * (d * f - e * e) + y * y * (a * f - c * c) + z * z * (a * d - b * b) + 2 * x * y * (c * e - b * f) + 2 * x * z * (b * e - c * d) + 2 * y * z * (b * c - a * e)) / det) AS lw
        FROM dt GROUP BY n, u1, u2, u3
    ), pr AS (SELECT *, exp(lw - max(lw) OVER ()) AS p FROM lw)
    SELECT annotation::INT AS annotation, round(sum(p * CASE annotation WHEN 1 THEN u1 WHEN 2 THEN u2 ELSE u3 END) / sum(p), 7) AS prob FROM pr, range(1, 4) t(annotation) GROUP BY 1""",
)
def q109(spark: SparkSession, d: str) -> DataFrame:
    """Inclusion probabilities of three annotations over all their subsets, coefficients integrated out."""
    out = selection.inclusion_table(_selection_markers(spark, d), 3, intercept=[0.1, -0.1, -0.3], tau2=[0.5, 1.0, 1.5], pi_a=0.3)
    return out.withColumn("prob", F.round("prob", 7))


_STICK_ALPHA = np.array([[-1.0, -0.5, 0.1], [0.5, 0.2, -0.3]])


@query(
    "q110_mcem_newton_step",
    f"""WITH {_PIPS}, eta AS (SELECT o, unnest([0, 1, 2]) AS k, unnest([-1.0e0 + 0.5e0 * o, -0.5e0 + 0.2e0 * o, -0.3e0 * o + 0.1e0]) AS x FROM (SELECT unnest([0, 1]) AS o)), phi AS (
        SELECT o, k, x, 0.5e0 + sign(x) * sum(exp((2 * t + 1) * ln(abs(x)) - (t + 1) * ln(2) - lgamma(t + 1.5) + 0.5 * ln(pi()))) * exp(-x * x / 2) / sqrt(2 * pi()) AS p
        FROM eta, range(0, 121) r(t) GROUP BY o, k, x
    ), la AS (SELECT o, k, x, exp(-x * x / 2) / sqrt(2 * pi()) / p AS one, exp(-x * x / 2) / sqrt(2 * pi()) / (1 - p) AS zero FROM phi), mass AS (
        SELECT marker_idx % 2 AS o, k, sum(CASE k WHEN 0 THEN pip WHEN 1 THEN pip / 2 ELSE pip / 6 END) AS up,
            sum(CASE k WHEN 0 THEN 1 - pip WHEN 1 THEN pip / 2 ELSE pip / 3 END) AS off FROM p1, range(3) t(k) GROUP BY 1, 2
    ), te AS (
        SELECT o, k, up * one - off * zero AS g, up * one * (one + x) + off * zero * (zero - x) AS w FROM mass JOIN la USING (o, k)
    ), su AS (
        SELECT k, sum(g) - ([-1.0e0, -0.5e0, 0.1e0])[k + 1] AS g0, sum(g * o) - ([0.5e0, 0.2e0, -0.3e0])[k + 1] / 2 AS g1, sum(w) + 1 AS h00, sum(w * o) AS h01, sum(w * o) + 0.5e0 AS h11 FROM te GROUP BY k
    )
    SELECT k::INT AS stick, a::INT AS annotation, round(CASE a WHEN 0 THEN ([-1.0e0, -0.5e0, 0.1e0])[k + 1] + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01)
        ELSE ([0.5e0, 0.2e0, -0.3e0])[k + 1] + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) END, 6) AS alpha FROM su, range(2) t(a)""",
)
def q110(spark: SparkSession, d: str) -> DataFrame:
    """The first Newton step of the M-step on expected components from the scan's inclusion probabilities."""
    p = F.col("pip")
    probs = F.array(1 - p, p / 2, p / 3, p / 6)
    markers = _pips(spark, d).select("marker_idx", F.array(F.lit(1.0), (F.col("marker_idx") % 2).cast("double")).alias("a"), probs.alias("probs"))
    alpha, _ = selection.m_step(markers, _STICK_ALPHA, sigma2=2.0, steps=1)
    rows = [(k, a, round(float(alpha[a, k]), 6)) for k in range(3) for a in range(2)]
    return spark.createDataFrame(rows, "stick int, annotation int, alpha double")


@query(
    "q111_architecture_test",
    f"""WITH {_PIPS}, a AS (SELECT trait, ln((wy / ww) * (wy / ww) * pip + 1e-12) AS y,
            ln(greatest(2 * least(round(p, 8), 1 - round(p, 8)) * (1 - least(round(p, 8), 1 - round(p, 8))), 1e-8)) AS x
        FROM stats JOIN pips USING (trait, marker_idx) JOIN m ON m.j = marker_idx),
    f AS (SELECT trait, count(*) AS n, count(*) - 2 AS df, regr_slope(y, x) AS slope, sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2) / regr_sxx(y, x)) AS se FROM a GROUP BY trait),
    th AS (SELECT *, slope / se AS t, atan(abs(slope / se) / sqrt(df)) AS theta FROM f),
    -- For whole degrees of freedom the distribution is a finite sum of powers of the cosine.
    co AS (SELECT trait, k, exp(sum(ln(CASE WHEN df % 2 = 0 THEN (2 * i - 1) / (2.0e0 * i) ELSE 2.0e0 * i / (2 * i + 1) END)) FILTER (i > 0)) AS c
        FROM th, range(0, 200) r(k), range(0, 200) q(i) WHERE k <= (df - 2 - df % 2) // 2 AND i <= k GROUP BY trait, k),
    s AS (SELECT trait, sum(coalesce(c, 1) * power(cos(theta), 2 * k + df % 2)) * sin(theta) AS s FROM th JOIN co USING (trait) GROUP BY trait, theta)
    SELECT trait, n, round(slope, 6) AS slope, round(se, 6) AS se, round(1 - CASE WHEN df % 2 = 0 THEN s ELSE 2 / pi() * (theta + s) END, 8) AS p_value FROM th JOIN s USING (trait)""",
)
def q111(spark: SparkSession, d: str) -> DataFrame:
    """The slope of log signal on log heterozygosity against zero."""
    af = genotypes.allele_freq(_panel(spark, d)[0]).select("marker_idx", F.least(F.col("af"), 1 - F.col("af")).alias("maf"))
    s = _stats(spark, d).select("trait", "marker_idx", (F.col("wy") / F.col("ww")).alias("effect"))
    p = _scan(spark, d).select("trait", "marker_idx", F.round("pip", 8).alias("pip"))
    out = summaries.architecture_test(s.join(p, ["trait", "marker_idx"]).join(af, "marker_idx"))
    return out.select("trait", "n", F.round("slope", 6).alias("slope"), F.round("se", 6).alias("se"), F.round("p_value", 8).alias("p_value"))


@query(
    "q112_extended_convergence",
    f"""WITH t AS (SELECT event_type, event_id % 4 AS chain, event_id // 4 AS it, round(value, 4) AS value FROM events WHERE value IS NOT NULL),
    l AS (SELECT event_type, chain, count(*) AS len, min(it) AS first FROM t GROUP BY 1, 2), h AS (
        SELECT event_type, chain, CASE WHEN it - first < len // 2 THEN 0 WHEN it - first >= len - len // 2 THEN 1 END AS half, value
        FROM t JOIN l USING (event_type, chain)
    ), p AS (SELECT event_type, chain, half, avg(value) AS m, var_samp(value) AS w, count(*) AS n FROM h WHERE half IS NOT NULL GROUP BY 1, 2, 3),
    a AS (SELECT event_type, count(DISTINCT chain) AS chains, sum(n)::BIGINT AS draws, min(n) AS n, var_samp(m) AS bm, avg(w) AS w, sum(n * m) / sum(n) AS mean,
        avg(m) FILTER (half = 1) - avg(m) FILTER (half = 0) AS change FROM p GROUP BY 1), r AS (SELECT *, sqrt((bm * n / w + n - 1) / n) AS rhat FROM a)
    SELECT event_type, chains, draws AS n, round(mean, 6) AS mean, round(sqrt(w), 6) AS sd, round(rhat, 6) AS rhat, round(change / sqrt(w), 6) AS drift,
        CASE WHEN rhat > 1.01 THEN 'not_converged' ELSE 'converged' END AS status FROM r""",
)
def q112(spark: SparkSession, d: str) -> DataFrame:
    """Convergence from compact states, first of blocks of 64 iterations, then merged."""
    t = _chains(spark, d)
    keys = ["event_type"]
    whole = summaries.trace_states(t, keys).select(*keys, "chain", "half", F.col("from").alias("lo"), F.col("to").alias("hi"))
    of = F.col("iteration").between(F.col("lo"), F.col("hi"))
    parts = t.join(whole, [*keys, "chain"]).filter(of).withColumn("part", F.floor(F.col("iteration") / 64))
    states = parts.groupBy(*keys, "chain", "half", "part").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value")).alias("m2"),
        F.min_by("value", "iteration").alias("first"), F.max_by("value", "iteration").alias("last"), F.min("iteration").alias("from"), F.max("iteration").alias("to"),
    )
    return summaries.extended_convergence(summaries.merge_states(states, keys), keys)


@query(
    "q113_component_stability",
    f"""WITH {_PIPS}, c AS (SELECT trait, marker_idx, chain, k AS component, CASE k WHEN 0 THEN 1 - q ELSE q * k / 3 END AS prob
        FROM (SELECT trait, marker_idx, chain, round(pip * (1 - 0.1e0 * chain), 8) AS q FROM pips, range(3) r(chain)), range(3) t(k)),
    o AS (SELECT trait, chain, marker_idx, sum(prob) FILTER (component > 0) AS pip FROM c GROUP BY 1, 2, 3),
    s AS (SELECT trait, marker_idx, max(pip) - min(pip) AS r FROM o GROUP BY 1, 2),
    f AS (SELECT trait, marker_idx, avg(abs(a.prob - b.prob)) AS far FROM c a JOIN c b USING (trait, marker_idx, component) WHERE a.chain < b.chain GROUP BY 1, 2)
    SELECT trait, count(*) AS m, round(avg(far), 8) AS mean_distance, round(max(far), 8) AS max_distance, round(avg(r), 8) AS mean_pip_range, round(max(r), 8) AS max_pip_range
    FROM s JOIN f USING (trait, marker_idx) GROUP BY trait""",
)
def q113(spark: SparkSession, d: str) -> DataFrame:
    """How far three chains agree, their probabilities being shares of the scan's."""
    p = _scan(spark, d).select("trait", "marker_idx", F.round("pip", 8).alias("pip"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("chain"))
    p = p.withColumn("q", F.round(F.col("pip") * (1 - 0.1 * F.col("chain")), 8)).withColumn("component", F.explode(F.sequence(F.lit(0), F.lit(2))))
    prob = F.when(F.col("component") == 0, 1 - F.col("q")).otherwise(F.col("q") * F.col("component") / 3)
    return summaries.component_stability(p.select("trait", "chain", "marker_idx", "component", prob.alias("prob")))[0]


@query(
    "q115_particle_evidence",
    f"""WITH {_EDGES}, k AS (
        SELECT a.trait AS trait, a.marker_idx // 2 AS block, {SHARE}e0 * a.yy / a.n AS noise, a.wy / ({SHARE}e0 * a.yy / a.n) AS ha, c.wy / ({SHARE}e0 * a.yy / a.n) AS hc,
            a.ww / ({SHARE}e0 * a.yy / a.n) + 1 / {VB}e0 AS pa, c.ww / ({SHARE}e0 * a.yy / a.n) + 1 / {VB}e0 AS pc, coalesce(r, 0) * sqrt(a.ww * c.ww) / ({SHARE}e0 * a.yy / a.n) AS x
        FROM stats a JOIN stats c ON c.trait = a.trait AND c.marker_idx = a.marker_idx + 1 LEFT JOIN edges ON i = a.marker_idx AND edges.j = c.marker_idx WHERE a.marker_idx % 2 = 0
    )
    SELECT trait, block::INT AS block, round(ln({1 - PI}e0 * {1 - PI}e0 + {1 - PI}e0 * {PI}e0 * (exp(0.5 * ha * ha / pa) / sqrt({VB}e0 * pa) + exp(0.5 * hc * hc / pc) / sqrt({VB}e0 * pc))
        + {PI}e0 * {PI}e0 * exp(0.5 * (pc * ha * ha - 2 * x * ha * hc + pa * hc * hc) / (pa * pc - x * x)) / sqrt({VB}e0 * {VB}e0 * (pa * pc - x * x))), 6) AS exact, true AS close FROM k""",
)
def q115(spark: SparkSession, d: str) -> DataFrame:
    """The evidence of every pair of neighbours by enumeration, and whether that of the particles is within a hundredth."""

    def table(block: particles.Block, start: int, key: tuple) -> pd.DataFrame:
        v, prior = np.array([VB]), np.tile(np.log([1 - PI, PI]), (len(block.wy), 1))
        exact = particles.exact_evidence(block, v, prior)
        found = particles.run_particles(block, v, prior, np.random.default_rng(start), 1 << 16).log_evidence
        return pd.DataFrame([{"exact": exact, "close": abs(found - exact) < 0.01}])

    out = particles.over_blocks(_stats(spark, d), _edges(spark, d), 2, SHARE, table, "exact double, close boolean")
    return out.withColumn("exact", F.round("exact", 6))


@query(
    "q116_coupling_exchange",
    f"""WITH {_PIPS}, co AS (SELECT replica, marker_idx, (floor(pip * 10000)::BIGINT + replica) % 4 AS component FROM p1, range(3) r(replica)),
    sl AS (SELECT replica, slot, slot * 0.5e0 AS c FROM range(3) r(replica), range(3) q(slot) WHERE abs(replica - slot) <= 1),
    eta AS (SELECT replica, slot, o, k, (1 - c) * (-0.5e0 + 0.3e0 * k) + c * ((-1.0e0 + 0.1e0 * replica) + 0.4e0 * k + o * (0.5e0 - 0.3e0 * k + 0.2e0 * replica)) AS x FROM sl, range(2) q(o), range(3) t(k)),
    phi AS (
        SELECT replica, slot, o, k, 0.5e0 + sign(x) * sum(exp((2 * t + 1) * ln(abs(x)) - (t + 1) * ln(2) - lgamma(t + 1.5) + 0.5 * ln(pi()))) * exp(-x * x / 2) / sqrt(2 * pi()) AS p
        FROM eta, range(0, 121) r(t) GROUP BY replica, slot, o, k, x
    ), st AS (SELECT replica, slot, o, max(p) FILTER (k = 0) AS a, max(p) FILTER (k = 1) AS b, max(p) FILTER (k = 2) AS c FROM phi GROUP BY 1, 2, 3),
    l AS (SELECT replica, slot, sum(ln(([1 - a, a * (1 - b), a * b * (1 - c), a * b * c])[component + 1])) AS x FROM co JOIN st USING (replica) WHERE st.o = co.marker_idx % 2 GROUP BY 1, 2)
    SELECT low.replica::INT AS lower, round(up.x + down.x - low.x - high.x, 6) AS log_ratio FROM l low JOIN l high ON high.replica = low.replica + 1 AND high.slot = high.replica
        JOIN l up ON up.replica = low.replica AND up.slot = low.replica + 1 JOIN l down ON down.replica = low.replica + 1 AND down.slot = low.replica WHERE low.slot = low.replica""",
)
def q116(spark: SparkSession, d: str) -> DataFrame:
    """Log ratios of exchanging the states of neighbouring replicas, components following the scan's inclusion probabilities."""
    p = _pips(spark, d).withColumn("replica", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    comps = p.select("replica", "marker_idx", ((F.floor(F.col("pip") * 10000) + F.col("replica")) % 4).cast("int").alias("component"))
    notes = _markers(spark).select("marker_idx", F.array(F.lit(1.0), (F.col("marker_idx") % 2).cast("double")).alias("a"))
    k = np.arange(3)
    alpha = [np.array([-1.0 + 0.1 * r + 0.4 * k, 0.5 - 0.3 * k + 0.2 * r]) for r in range(3)]
    out = tempering.exchange_terms(comps, notes, alpha, baseline=tuple(-0.5 + 0.3 * k))
    return out.withColumn("log_ratio", F.round("log_ratio", 6))


@query(
    "q117_aligned_annotations",
    """WITH f AS (SELECT p_partkey AS k, p_size::DOUBLE AS size, (p_partkey % 3 = 0)::INT::DOUBLE AS third FROM part WHERE p_partkey % 2 = 0),
    s AS (SELECT avg(size) AS m, stddev_samp(size) AS sd, avg(third) AS t FROM f)
    SELECT k::INT AS marker_idx, 1.0e0 AS intercept, round((size - m) / sd, 8) AS size, round(third - t, 8) AS third FROM f, s""",
)
def q117(spark: SparkSession, d: str) -> DataFrame:
    """Annotations of all parts, matched by name to those that are fitted, every second one."""
    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("size"), (F.col("p_partkey") % 3 == 0).cast("double").alias("third"))
    names = F.concat(F.lit("m"), F.col("k")).alias("marker_id")
    long = part.select(names, F.explode(F.create_map(F.lit("a_size"), F.col("size"), F.lit("b_third"), F.col("third"))).alias("annotation", "value"))
    fitted = part.filter("k % 2 = 0").select(F.col("k").cast("int").alias("marker_idx"), names)
    a = priors.align_annotations(long, fitted, center_binary=True)
    return a.select("marker_idx", F.col("a")[0].alias("intercept"), F.round(F.col("a")[1], 8).alias("size"), F.round(F.col("a")[2], 8).alias("third"))


@query(
    "q118_local_statistics",
    f"""WITH {_EXACT}, lo AS (SELECT j AS marker_idx, 'L' || j // 16 AS locus FROM m WHERE j % 16 < 10), mv AS (
        SELECT lo.locus AS locus, lo.marker_idx AS marker_idx, sum(round(r * sqrt(a.ww * b.ww), 6) * b.b) AS moved
        FROM lo JOIN sym ON sym.i = lo.marker_idx JOIN sc a ON a.marker_idx = sym.i AND a.trait = 'T1' JOIN sc b ON b.marker_idx = sym.j AND b.trait = 'T1'
        LEFT JOIN lo own ON own.locus = lo.locus AND own.marker_idx = sym.j WHERE own.locus IS NULL GROUP BY 1, 2
    )
    SELECT locus, marker_idx, round(wy - coalesce(moved, 0), 6) AS wy, ww, yy, n FROM lo JOIN sc USING (marker_idx) LEFT JOIN mv USING (locus, marker_idx) WHERE trait = 'T1'""",
)
def q118(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of loci of ten markers less what the fixed effects outside explain, as a refit of a locus takes them."""
    from effectforge.api import local_statistics

    k = F.col("marker_idx")
    loci = _markers(spark).filter(k % 16 < 10).select(F.concat(F.lit("L"), F.floor(k / 16)).alias("locus"), "marker_idx")
    out = local_statistics(_stats(spark, d).filter("trait = 'T1'"), _edges(spark, d), loci, _effects(spark))
    return out.select("locus", "marker_idx", F.round("wy", 6).alias("wy"), "ww", "yy", "n")


@query("q119_fit_consistency")
def q119(spark: SparkSession, d: str) -> DataFrame:
    """Checks of a scale mixture's own rows."""
    model = samplers.Model(gamma=MIXTURE, pi=_MIX_PI)
    fit = samplers.fit_summary(_stats(spark, d), _edges(spark, d), model, priors.ChainControls(nit=20, nburn=10, nchains=2, seed=3))
    return summaries.fit_consistency(fit, MARKERS)


RESIDUAL = ((6.0, 0.5), (0.5, 0.8))
_RDET = RESIDUAL[0][0] * RESIDUAL[1][1] - RESIDUAL[0][1] ** 2
_INVERSE = (RESIDUAL[1][1] / _RDET, -RESIDUAL[0][1] / _RDET, RESIDUAL[0][0] / _RDET)


@query(
    "q120_joint_genotype_conditional",
    f"""WITH {_EDGES}, z AS (SELECT s, j, (g - 2 * p) / sqrt(2 * p * (1 - p)) AS z FROM g JOIN m USING (j)),
    f AS (SELECT z.s AS s, sum(z * x / 100) AS f FROM z JOIN vec ON vec.marker_idx = z.j GROUP BY z.s),
    own AS (SELECT j, sum(z * z) AS ww FROM z GROUP BY j),
    sx AS (SELECT trait, z.j AS marker_idx, sum(z * (y - f * CASE trait WHEN 'T2' THEN 0.5e0 ELSE 1 END)) AS e FROM z JOIN t USING (s) JOIN f USING (s) GROUP BY 1, 2),
    sc AS (SELECT trait, marker_idx, ww, e + ww * x / 100 * CASE trait WHEN 'T2' THEN 0.5e0 ELSE 1 END AS s FROM sx JOIN own ON own.j = marker_idx JOIN vec USING (marker_idx)),
    u AS (SELECT a.marker_idx AS marker_idx, {_INVERSE[0]}::DOUBLE * a.s + {_INVERSE[1]}::DOUBLE * c.s AS u1, {_INVERSE[1]}::DOUBLE * a.s + {_INVERSE[2]}::DOUBLE * c.s AS u2,
        {_INVERSE[0]}::DOUBLE * a.ww AS i1, {_INVERSE[2]}::DOUBLE * a.ww AS i2, {_INVERSE[1]}::DOUBLE * a.ww AS i12 FROM sc a JOIN sc c USING (marker_idx) WHERE a.trait = 'T1' AND c.trait = 'T2')"""
    + _PATTERNS.replace(f"-{JOINT[0][1]}e0 / {_DET}::DOUBLE AS p12", f"-{JOINT[0][1]}e0 / {_DET}::DOUBLE + i12 AS p12").replace("list_sum(e), 7)", "list_sum(e), 6)"),
)
def q120(spark: SparkSession, d: str) -> DataFrame:
    """Activity patterns of two traits with correlated residuals at each marker, from the samples themselves."""
    panel, traits = _panel(spark, d)
    b = (np.arange(MARKERS) % 7 - 3)[:, None] / 100.0 * np.array([1.0, 0.5])
    out = multitrait.genotype_patterns(panel, traits, b, np.array(RESIDUAL), np.array(JOINT), np.full(4, 0.25))
    return out.withColumn("prob", F.round("prob", 6))


@query(
    "q121_annotation_signal",
    f"""WITH {_PIPS}, se AS (SELECT marker_idx, a AS annotation FROM (SELECT j AS marker_idx FROM m), range(2, 5) t(a) WHERE marker_idx % a = 0)
    SELECT annotation::INT AS annotation, count(*) AS size, round(avg((pip > 0.01)::INT::DOUBLE), 8) AS causal_rate, round(avg(pip), 8) AS mean_pip, round(avg(abs(wy / ww)), 8) AS mean_abs_effect
    FROM se JOIN pips USING (marker_idx) JOIN stats USING (trait, marker_idx) WHERE trait = 'T1' GROUP BY 1""",
)
def q121(spark: SparkSession, d: str) -> DataFrame:
    """What annotations that overlap say of the scan's inclusion probabilities and effects."""
    truth = _pips(spark, d).join(_stats(spark, d).filter("trait = 'T1'").select("marker_idx", (F.col("wy") / F.col("ww")).alias("effect")), "marker_idx").withColumn("causal", F.col("pip") > 0.01)
    sets = _markers(spark).select("marker_idx", F.explode(F.array(*[F.lit(a) for a in (2, 3, 4)])).alias("annotation")).filter("marker_idx % annotation = 0")
    out = simulate.annotation_signal(truth, sets)
    return out.select("annotation", "size", *[F.round(c, 8).alias(c) for c in ("causal_rate", "mean_pip", "mean_abs_effect")])
