"""The registered queries of the analytics operators, with their SQL.

The test panel is bound from ``embeddings`` (dosages), its labels (traits) and
``events`` (chains).  Sums are of integers and results are rounded, so values do
not depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectforge.functions.expressions import log_bayes_factor, logistic
from effectforge.operators import controls, finemap, genotypes, ld, multitrait, priors, samplers, simulate, summaries
from effectforge.streaming import incremental

MARKERS, WINDOW, R2 = 64, 8, 0.001
VB, PI = 0.02, 0.1
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_PANEL = """
    g AS (
        SELECT s, j, CASE WHEN e < -0.1e0 THEN 0 WHEN e < 0.1e0 THEN 1 ELSE 2 END AS g
        FROM (SELECT vec_id AS s, generate_subscripts(embedding, 1) - 1 AS j, unnest(embedding)::DOUBLE AS e FROM embeddings)
    ), m AS (
        SELECT *, sg / (2.0e0 * n) AS p FROM (
            SELECT j, count(*) AS n, sum(g)::BIGINT AS sg, sum(g * g)::BIGINT AS sgg FROM g GROUP BY j)
    ), t AS (
        SELECT vec_id AS s, 'T1' AS trait, label::BIGINT AS y FROM embeddings
        UNION ALL SELECT vec_id, 'T2', (label % 3)::BIGINT FROM embeddings
    ), tot AS (
        SELECT trait, sum(y * y)::BIGINT AS yy, sum(y)::BIGINT AS sy, count(*) AS ny FROM t GROUP BY trait
    ), x AS (
        SELECT trait, j, sum(g * y)::BIGINT AS gy FROM g JOIN t USING (s) GROUP BY trait, j
    ), stats AS (
        SELECT trait, j AS marker_idx, round((gy - 2 * p * sy) / sqrt(2 * p * (1 - p)), 8) AS wy,
            round((sgg - 4 * p * sg + 4 * n * p * p) / (sqrt(2 * p * (1 - p)) * sqrt(2 * p * (1 - p))), 8) AS ww, yy, ny AS n
        FROM x JOIN m USING (j) JOIN tot USING (trait)
    )"""
_EDGES = (
    _PANEL
    + f""", xx AS (
        SELECT *, sgg - 4 * p * sg + 4 * n * p * p AS xx FROM m
    ), pairs AS (
        SELECT a.j AS i, b.j AS j, sum(a.g * b.g)::BIGINT AS gg FROM g a JOIN g b
            ON a.s = b.s AND b.j > a.j AND b.j <= a.j + {WINDOW} GROUP BY a.j, b.j
    ), edges AS (
        SELECT * FROM (
            SELECT i, pairs.j AS j, round((gg - 2 * b.p * a.sg - 2 * a.p * b.sg + 4 * a.n * a.p * b.p) / sqrt(a.xx * b.xx), 8) AS r
            FROM pairs JOIN xx a ON a.j = i JOIN xx b ON b.j = pairs.j
        ) WHERE r * r >= {R2}
    ), sym AS (
        SELECT i, j, r FROM edges UNION ALL SELECT j, i, r FROM edges
    ), vec AS (
        SELECT j AS marker_idx, (j % 7 - 3)::DOUBLE AS x FROM m
    ), rx AS (
        SELECT i, sum(v)::DOUBLE AS rx FROM (
            SELECT i, r * x AS v FROM sym JOIN vec ON vec.marker_idx = sym.j UNION ALL SELECT marker_idx, x FROM vec
        ) GROUP BY i
    )"""
)
_PIPS = (
    _EDGES
    + f""", bf AS (
        SELECT trait, marker_idx, wy, ww, yy, n, 0.5e0 * ln(v / (v + ww * {VB}e0)) + 0.5e0 * wy * wy * {VB}e0 / (v * (v + ww * {VB}e0)) AS logbf
        FROM (SELECT *, yy / n::DOUBLE AS v FROM stats)
    ), pips AS (
        SELECT trait, marker_idx, round(1 / (1 + exp(-(ln({PI}e0 / (1 - {PI}e0)) + logbf))), 8) AS pip FROM bf
    ), p1 AS (
        SELECT marker_idx, pip FROM pips WHERE trait = 'T1'
    ), map AS (
        SELECT j AS marker_idx, j // 16 AS chr, j * 1000 AS pos FROM m
    )"""
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with the SQL that gives the same rows."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _panel(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return genotypes.embedding_panel(spark, d)


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return genotypes.summary_stats(*_panel(spark, d))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return ld.ld_edges(_panel(spark, d)[0], max_distance_variants=WINDOW, r2_threshold=R2)


def _markers(spark: SparkSession) -> DataFrame:
    return spark.range(MARKERS).select(
        F.col("id").cast("int").alias("marker_idx"), F.floor(F.col("id") / 16).cast("int").alias("chr"), (F.col("id") * 1000).alias("pos")
    )


def _vector(spark: SparkSession) -> DataFrame:
    return spark.range(MARKERS).select(F.col("id").cast("int").alias("marker_idx"), (F.col("id") % 7 - 3).cast("double").alias("x"))


def _scan(spark: SparkSession, d: str) -> DataFrame:
    s = _stats(spark, d).withColumn("v", F.col("yy") / F.col("n"))
    bf = log_bayes_factor(F.col("wy"), F.col("ww"), F.lit(VB), F.col("v"))
    return s.select("trait", "marker_idx", bf.alias("log_bf"), logistic(float(np.log(PI / (1 - PI))) + bf).alias("pip"))


def _pips(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d).filter("trait = 'T1'").select("marker_idx", F.round("pip", 8).alias("pip"))


def _values(spark: SparkSession, d: str) -> DataFrame:
    """marker_idx, effect, wy, r, pip, ww, yy, n of trait T1 at the fixed effects x / 100."""
    s = _stats(spark, d).filter("trait = 'T1'")
    b = _vector(spark).select("marker_idx", (F.col("x") / 100).alias("effect"))
    x = ld.cross_products(_edges(spark, d), s)
    xb = x.join(b.withColumnRenamed("marker_idx", "j"), "j").groupBy(F.col("i").alias("marker_idx")).agg(F.sum(F.col("xtx") * F.col("effect")).alias("xb"))
    v = s.join(b, "marker_idx").join(xb, "marker_idx", "left").join(_pips(spark, d), "marker_idx")
    r = F.col("wy") - F.col("ww") * F.col("effect") - F.coalesce("xb", F.lit(0.0))
    return v.select("marker_idx", "effect", "wy", "ww", "yy", "n", "pip", r.alias("r"))


_VALUES = (
    _PIPS
    + """, s1 AS (SELECT * FROM stats WHERE trait = 'T1'), xb AS (
        SELECT i AS marker_idx, sum(round(r * sqrt(a.ww * b.ww), 6) * x / 100) AS xb
        FROM sym JOIN s1 a ON a.marker_idx = i JOIN s1 b ON b.marker_idx = sym.j JOIN vec ON vec.marker_idx = sym.j GROUP BY i
    ), vals AS (
        SELECT marker_idx, x / 100 AS effect, wy, ww, yy, n, pip, wy - ww * x / 100 - coalesce(xb, 0) AS r
        FROM s1 JOIN vec USING (marker_idx) LEFT JOIN xb USING (marker_idx) JOIN p1 USING (marker_idx)
    )"""
)


@query(
    "q01_allele_freq",
    f"WITH {_PANEL} SELECT j AS marker_idx, n, round(p, 8) AS af, round(least(p, 1 - p), 8) AS maf, round(2 * p * (1 - p), 8) AS het FROM m",
)
def q01(spark: SparkSession, d: str) -> DataFrame:
    return genotypes.allele_freq(_panel(spark, d)[0])


@query("q02_summary_stats", f"WITH {_PANEL} SELECT trait, marker_idx, wy, ww, yy, n FROM stats")
def q02(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d)


@query(
    "q03_marginal_gwas",
    f"""WITH {_PANEL}, c AS (
        SELECT trait, j, ny::DOUBLE AS ny, sgg - sg * sg / ny::DOUBLE AS sxx, gy - sg * sy / ny::DOUBLE AS sxy, yy - sy * sy / ny::DOUBLE AS syy
        FROM x JOIN m USING (j) JOIN tot USING (trait)
    ), b AS (SELECT *, sxy / sxx AS beta, sqrt((syy - sxy / sxx * sxy) / (ny - 2) / sxx) AS se FROM c WHERE sxx > 0)
    SELECT trait, j AS marker_idx, round(beta, 8) AS beta, round(se, 8) AS se, round(beta / se, 8) AS z FROM b""",
)
def q03(spark: SparkSession, d: str) -> DataFrame:
    return genotypes.marginal_gwas(*_panel(spark, d))


@query("q04_ld_edges", f"WITH {_EDGES} SELECT i, j, r FROM edges")
def q04(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


@query(
    "q05_ld_row_ptr",
    f"""WITH {_EDGES}, c AS (SELECT m.j AS i, count(e.i) AS nnz FROM m LEFT JOIN edges e ON e.i = m.j GROUP BY m.j)
    SELECT i, nnz, coalesce(sum(nnz) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS row_ptr FROM c""",
)
def q05(spark: SparkSession, d: str) -> DataFrame:
    return ld.row_pointers(_edges(spark, d), _markers(spark))


@query(
    "q06_ld_friends",
    f"""WITH {_EDGES} SELECT i, j, r2, rank FROM (
        SELECT i, j, round(r * r, 10) AS r2, row_number() OVER (PARTITION BY i ORDER BY round(r * r, 10) DESC, j) AS rank FROM sym
        WHERE round(r * r, 10) >= {R2}) WHERE rank <= 3""",
)
def q06(spark: SparkSession, d: str) -> DataFrame:
    return ld.friends(_edges(spark, d), min_r2=R2, max_friends=3)


@query("q07_ld_matvec", f"WITH {_EDGES} SELECT i, round(rx, 6) AS rx FROM rx")
def q07(spark: SparkSession, d: str) -> DataFrame:
    return ld.matvec(_edges(spark, d), _vector(spark))


@query(
    "q08_xtx_rescale",
    f"""WITH {_EDGES} SELECT i, sym.j AS j, round(r * sqrt(a.ww * b.ww), 6) AS xtx FROM sym
    JOIN stats a ON a.marker_idx = i AND a.trait = 'T1' JOIN stats b ON b.marker_idx = sym.j AND b.trait = 'T1'""",
)
def q08(spark: SparkSession, d: str) -> DataFrame:
    return ld.cross_products(_edges(spark, d), _stats(spark, d).filter("trait = 'T1'"))


@query(
    "q09_bf_scan",
    f"WITH {_PIPS} SELECT trait, marker_idx, round(logbf, 6) AS log_bf, round(pip, 6) AS pip FROM bf JOIN pips USING (trait, marker_idx)",
)
def q09(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d).select("trait", "marker_idx", F.round("log_bf", 6).alias("log_bf"), F.round(F.round("pip", 8), 6).alias("pip"))


@query(
    "q10_sweep_order",
    f"""WITH {_PANEL} SELECT marker_idx, row_number() OVER (ORDER BY s DESC, marker_idx) AS place FROM (
        SELECT marker_idx, max(round((wy / ww) * (wy / ww), 10)) AS s FROM stats GROUP BY marker_idx)""",
)
def q10(spark: SparkSession, d: str) -> DataFrame:
    return samplers.sweep_order(_stats(spark, d))


@query(
    "q11_quadratic_terms",
    f"""WITH {_VALUES} SELECT round(max(yy) - sum(effect * (r + wy)), 4) AS sse, round(sum(effect * (wy - r)) / max(n), 6) AS vg,
        round(sum(ww * effect * effect) / max(n), 6) AS vle,
        round(sum(effect * (wy - r)) / max(n) - sum(ww * effect * effect) / max(n), 6) AS vld FROM vals""",
)
def q11(spark: SparkSession, d: str) -> DataFrame:
    return samplers.quadratic_terms(_values(spark, d))


@query(
    "q12_prior_calibration",
    f"""WITH {_PANEL} SELECT trait, round(vy * 0.3e0 / (64 * {PI}e0), 10) AS vb, round(vy * 0.7e0, 10) AS ve,
        round(0.5e0 * vy * 0.3e0 / (64 * {PI}e0), 10) AS ssb_prior, round(0.5e0 * vy * 0.7e0, 10) AS sse_prior
    FROM (SELECT trait, yy / ny::DOUBLE AS vy FROM tot)""",
)
def q12(spark: SparkSession, d: str) -> DataFrame:
    t = _panel(spark, d)[1].groupBy("trait").agg((F.sum(F.col("y") * F.col("y")) / F.count("*")).alias("vy"))
    unit = priors.calibrate_prior(1.0, 0.3, MARKERS * PI)
    return t.select("trait", *[F.round(F.col("vy") * v, 10).alias(k) for k, v in unit.items()])


@query(
    "q13_loci",
    f"""WITH RECURSIVE {_PIPS}, start AS (
        SELECT chr, list(marker_idx ORDER BY pip DESC, marker_idx) AS rem FROM p1 JOIN map USING (marker_idx) WHERE pip >= 0.01 GROUP BY chr
    ), walk AS (
        SELECT chr, NULL::BIGINT AS lead, rem FROM start
        UNION ALL
        SELECT chr, rem[1], list_filter(rem, lambda z: abs(z - rem[1]) * 1000 > 3000) FROM walk WHERE len(rem) > 0
    ), leads AS (SELECT chr, lead, pip AS lead_pip FROM walk JOIN p1 ON p1.marker_idx = lead WHERE lead IS NOT NULL)
    SELECT leads.chr AS chr, lead, lead_pip, min(pos)::DOUBLE AS start, max(pos)::DOUBLE AS "end",
        array_to_string(list(marker_idx ORDER BY marker_idx), ',') AS members,
        row_number() OVER (ORDER BY lead_pip DESC, lead) AS locus
    FROM leads JOIN map ON map.chr = leads.chr AND abs(pos - lead * 1000) <= 3000 GROUP BY leads.chr, lead, lead_pip""",
)
def q13(spark: SparkSession, d: str) -> DataFrame:
    loci = finemap.define_loci(_pips(spark, d), _markers(spark), max_locus_distance=3000)
    return loci.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query(
    "q14_credible_set_first",
    f"""WITH {_PIPS}, lead AS (SELECT marker_idx AS lead FROM p1 WHERE pip >= 0.001 ORDER BY pip DESC, marker_idx LIMIT 1), near AS (
        SELECT j AS marker_idx, round(r * r, 10) AS r2 FROM sym JOIN lead ON i = lead UNION ALL SELECT lead, 1.0 FROM lead
    ), c AS (
        SELECT marker_idx, pip, r2, row_number() OVER (ORDER BY pip DESC, marker_idx) AS rank,
            sum(pip) OVER (ORDER BY pip DESC, marker_idx ROWS UNBOUNDED PRECEDING) AS cum
        FROM near JOIN p1 USING (marker_idx) WHERE r2 >= {R2} AND pip >= 0.001
    ) SELECT marker_idx, pip, r2, rank FROM c WHERE cum - pip < 0.25""",
)
def q14(spark: SparkSession, d: str) -> DataFrame:
    return finemap.first_credible_set(_pips(spark, d), _edges(spark, d), coverage=0.25, min_r2=R2, pip_cutoff=0.001)


def _sets(spark: SparkSession, d: str, **more) -> DataFrame:
    regions = _markers(spark).select(F.col("chr").alias("region"), "marker_idx")
    return finemap.credible_sets(_pips(spark, d), regions, ld.region(_edges(spark, d), regions), min_r2=R2, coverage=0.25, **more)


@query("q15_credible_sets_all")
def q15(spark: SparkSession, d: str) -> DataFrame:
    return _sets(spark, d)


@query("q16_multisignal")
def q16(spark: SparkSession, d: str) -> DataFrame:
    return _sets(spark, d, multi=True, signal_coverage=0.3, min_signal_pip=0.02, remove="credible_set", method="ld_pip")


@query(
    "q17_locus_table",
    f"""WITH {_PIPS}, k AS (SELECT chr AS locus, marker_idx, pip, row_number() OVER (PARTITION BY chr ORDER BY pip DESC, marker_idx) AS rank
        FROM p1 JOIN map USING (marker_idx))
    SELECT locus, max(CASE WHEN rank = 1 THEN marker_idx END) AS lead, max(CASE WHEN rank = 1 THEN pip END) AS lead_pip,
        max(CASE WHEN rank = 2 THEN pip END) AS secondary_pip, round(sum(pip), 8) AS total_pip, count(*) AS n_markers FROM k GROUP BY locus""",
)
def q17(spark: SparkSession, d: str) -> DataFrame:
    return finemap.locus_table(_markers(spark).select(F.col("chr").alias("locus"), "marker_idx"), _pips(spark, d))


@query(
    "q18_set_tests",
    f"""WITH {_VALUES}, w AS (SELECT sum(pip) AS all_pip, count(*) AS m FROM vals), k AS (
        SELECT marker_idx % 4 AS "set", count(*) AS size, sum(effect * (wy - r) / n) AS vg, sum(effect * (wy - r) / n * pip) AS wvg, sum(pip) AS pip
        FROM vals GROUP BY 1)
    SELECT "set", size, round(vg, 8) AS vg, round(wvg, 8) AS weighted_vg,
        round((pip / size) / ((all_pip - pip) / (m - size)), 8) AS enrichment, round((1 + pip) / (2 + size), 8) AS annotation_pi FROM k, w""",
)
def q18(spark: SparkSession, d: str) -> DataFrame:
    v = _values(spark, d)
    n = v.agg(F.max("n")).first()[0]
    return finemap.set_tests(v, _markers(spark).select((F.col("marker_idx") % 4).alias("set"), "marker_idx"), n)


@query(
    "q21_fixed_marker_prior",
    f"""WITH {_PANEL}, e AS (SELECT j, 0.5e0 * (j % 2) + 2.0e0 * round(p, 8) AS a, 0.3e0 * (j % 2) AS v FROM m),
    c AS (SELECT j, a - avg(a) OVER () AS a, v - avg(v) OVER () AS v FROM e)
    SELECT j AS marker_idx, round(least(greatest(1 / (1 + exp(-(ln(0.01e0 / 0.99e0) + a))), 1e-8), 0.05), 10) AS pi,
        round(least(greatest(exp(v), 0.25), 4.0), 10) AS vb_multiplier FROM c""",
)
def q21(spark: SparkSession, d: str) -> DataFrame:
    af = genotypes.allele_freq(_panel(spark, d)[0]).select("marker_idx", F.lit("af").alias("annotation"), F.col("af").alias("value"))
    odd = _markers(spark).select("marker_idx", F.lit("odd").alias("annotation"), (F.col("marker_idx") % 2).cast("double").alias("value"))
    return priors.fixed_marker_prior(af.unionByName(odd), {"odd": 0.5, "af": 2.0}, {"odd": 0.3}, pi_base=0.01)


@query(
    "q22_group_counts",
    f"""WITH {_PIPS} SELECT marker_idx % 4 AS "group", count(*) AS size, count(*) FILTER (pip >= 0.1) AS active, round(avg(pip), 8) AS mean_pip
    FROM p1 GROUP BY 1""",
)
def q22(spark: SparkSession, d: str) -> DataFrame:
    states = _pips(spark, d).withColumn("active", F.col("pip") >= 0.1)
    return samplers.group_counts(states, _markers(spark).select("marker_idx", (F.col("marker_idx") % 4).alias("group")))


@query(
    "q23_stick_probabilities",
    f"""WITH {_PANEL}, e AS (SELECT j, unnest([0, 1, 2]) AS k, unnest([-1.0e0 + 0.5e0 * af, -0.5e0 + 0.2e0 * af, -0.3e0 * af]) AS x
        FROM (SELECT j, round(p, 8) AS af FROM m)), phi AS (
        SELECT j, k, 0.5e0 + sign(x) * sum(exp((2 * t + 1) * ln(abs(x)) - (t + 1) * ln(2) - lgamma(t + 1.5) + 0.5 * ln(pi())))
            * exp(-x * x / 2) / sqrt(2 * pi()) AS p
        FROM e, range(0, 121) r(t) GROUP BY j, k, x
    ), w AS (SELECT j, max(p) FILTER (k = 0) AS a, max(p) FILTER (k = 1) AS b, max(p) FILTER (k = 2) AS c FROM phi GROUP BY j)
    SELECT j AS marker_idx, unnest([0, 1, 2, 3]) AS component,
        unnest([round(1 - a, 8), round(a * (1 - b), 8), round(a * b * (1 - c), 8), round(a * b * c, 8)]) AS pi FROM w""",
)
def q23(spark: SparkSession, d: str) -> DataFrame:
    af = genotypes.allele_freq(_panel(spark, d)[0]).select("marker_idx", F.lit("af").alias("annotation"), F.col("af").alias("value"))
    one = _markers(spark).select("marker_idx", F.lit("one").alias("annotation"), F.lit(1.0).alias("value"))
    sticks = priors.marker_sticks(af.unionByName(one), {"one": [-1.0, -0.5, 0.0], "af": [0.5, 0.2, -0.3]})
    return sticks.withColumn("pi", F.round("pi", 8))


@query(
    "q24_retention_plan",
    """WITH t AS (SELECT unnest(range(1, max(event_id) // 4 + 2)) AS k FROM events WHERE value IS NOT NULL)
    SELECT k::INT AS iteration, k % 3 = 0 AS retained, CASE WHEN k % 3 = 0 THEN k // 3 END::INT AS position, legacy FROM t, (SELECT false AS legacy)
    UNION ALL SELECT k::INT, (k - 1) % 3 = 0, CASE WHEN (k - 1) % 3 = 0 THEN (k - 1) // 3 + 1 END::INT, true FROM t""",
)
def q24(spark: SparkSession, d: str) -> DataFrame:
    """Which iterations of the events' chains are kept."""
    plan = priors.ChainControls(nit=_chains(spark, d).agg(F.max("iteration")).first()[0] + 1, nthin=3)
    both = [controls.retention_plan(spark, plan, legacy).withColumn("legacy", F.lit(legacy)) for legacy in (False, True)]
    return both[0].unionByName(both[1])


def _chains(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").filter("value is not null")
    return e.select(
        "event_type", (F.col("event_id") % 4).cast("int").alias("chain"), F.floor(F.col("event_id") / 4).alias("iteration"), F.round("value", 4).alias("value")
    )


@query(
    "q25_trace_summary",
    """WITH v AS (SELECT event_type, event_id % 4 AS chain, list_sort(list(round(value, 4))) AS v, count(*) AS n, avg(round(value, 4)) AS mean,
            stddev_samp(round(value, 4)) AS sd FROM events WHERE value IS NOT NULL GROUP BY 1, 2), q AS (
        SELECT *, (n + 1.0e0 / 3) * 0.5 + 1.0e0 / 3 AS h0, (n + 1.0e0 / 3) * 0.025 + 1.0e0 / 3 AS h1, (n + 1.0e0 / 3) * 0.975 + 1.0e0 / 3 AS h2 FROM v
    ), j AS (
        SELECT *, least(greatest(floor(h0), 1), n)::BIGINT AS j0, least(greatest(floor(h1), 1), n)::BIGINT AS j1, least(greatest(floor(h2), 1), n)::BIGINT AS j2 FROM q)
    SELECT event_type, chain, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(v[1], 6) AS min, round(v[n], 6) AS max,
        round(v[j0] + least(greatest(h0 - j0, 0), 1) * (v[least(j0 + 1, n)] - v[j0]), 6) AS median,
        round(v[j1] + least(greatest(h1 - j1, 0), 1) * (v[least(j1 + 1, n)] - v[j1]), 6) AS lower,
        round(v[j2] + least(greatest(h2 - j2, 0), 1) * (v[least(j2 + 1, n)] - v[j2]), 6) AS upper FROM j""",
)
def q25(spark: SparkSession, d: str) -> DataFrame:
    return summaries.trace_summary(_chains(spark, d), ["event_type", "chain"])


@query(
    "q27_rhat_basic",
    """WITH t AS (SELECT event_type, event_id % 4 AS chain, event_id // 4 AS it, round(value, 4) AS value FROM events WHERE value IS NOT NULL),
    l AS (SELECT event_type, chain, count(*) AS len, min(it) AS first FROM t GROUP BY 1, 2), h AS (
        SELECT event_type, chain, CASE WHEN it - first < len // 2 THEN 0 WHEN it - first >= len - len // 2 THEN 1 END AS half, value
        FROM t JOIN l USING (event_type, chain)
    ), p AS (SELECT event_type, chain, half, avg(value) AS m, var_samp(value) AS w, count(*) AS n FROM h WHERE half IS NOT NULL GROUP BY 1, 2, 3),
    a AS (SELECT event_type, var_samp(m) AS bm, avg(w) AS w, min(n) AS n FROM p GROUP BY 1)
    SELECT event_type, round(sqrt((bm * n / w + n - 1) / n), 6) AS rhat FROM a""",
)
def q27(spark: SparkSession, d: str) -> DataFrame:
    return summaries.rhat_basic(_chains(spark, d), ["event_type"])


@query("q27b_convergence")
def q27b(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("event_type", "chain").orderBy("iteration")
    numbered = _chains(spark, d).withColumn("iteration", F.row_number().over(w))
    shortest = numbered.groupBy("event_type", "chain").agg(F.max("iteration").alias("n")).groupBy("event_type").agg(F.min("n").alias("n"))
    return summaries.convergence(numbered.join(shortest, "event_type").filter("iteration <= n").drop("n"), ["event_type"])


@query(
    "q28_component_summary",
    f"""WITH {_PIPS}, c AS (SELECT trait, 1 - (1 - pip) AS pip FROM pips) SELECT trait, count(*) AS m, round(avg(pip), 8) AS mean_pip,
        round(sum(pip), 8) AS expected_nonnull, count(*) FILTER (pip >= 0.01) AS n_pip_0_01, count(*) FILTER (pip >= 0.05) AS n_pip_0_05,
        count(*) FILTER (pip >= 0.5) AS n_pip_0_5 FROM c GROUP BY trait""",
)
def q28(spark: SparkSession, d: str) -> DataFrame:
    p = _scan(spark, d).select("trait", "marker_idx", F.lit(0).alias("component"), (1 - F.round("pip", 8)).alias("prob"))
    return summaries.component_summary(p, (0.01, 0.05, 0.5))


@query(
    "q29_architecture",
    f"""WITH {_PIPS}, a AS (SELECT trait, ln((wy / ww) * (wy / ww) * pip + 1e-12) AS y,
            ln(greatest(2 * least(round(p, 8), 1 - round(p, 8)) * (1 - least(round(p, 8), 1 - round(p, 8))), 1e-8)) AS x
        FROM stats JOIN pips USING (trait, marker_idx) JOIN m ON m.j = marker_idx)
    SELECT trait, count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2
    FROM a GROUP BY trait""",
)
def q29(spark: SparkSession, d: str) -> DataFrame:
    panel, _ = _panel(spark, d)
    af = genotypes.allele_freq(panel).select("marker_idx", F.least(F.col("af"), 1 - F.col("af")).alias("maf"))
    s = _stats(spark, d).select("trait", "marker_idx", (F.col("wy") / F.col("ww")).alias("effect"))
    p = _scan(spark, d).select("trait", "marker_idx", F.round("pip", 8).alias("pip"))
    return summaries.architecture(s.join(p, ["trait", "marker_idx"]).join(af, "marker_idx"))


@query(
    "q30_provider_scatter",
    f"""WITH {_PANEL}, pm AS (SELECT trait, marker_idx AS global_idx, wy / (yy / n::DOUBLE) AS score FROM stats WHERE marker_idx % 3 <> 0)
    SELECT t.trait AS trait, m.j AS global_idx, round(coalesce(score, 0), 8) AS score
    FROM (SELECT DISTINCT trait FROM stats) t CROSS JOIN m LEFT JOIN pm ON pm.trait = t.trait AND pm.global_idx = m.j""",
)
def q30(spark: SparkSession, d: str) -> DataFrame:
    s = _stats(spark, d)
    provider = s.select(F.col("trait").alias("provider_id"), "trait", (F.col("yy") / F.col("n")).alias("residual_scale")).distinct()
    local = s.filter("marker_idx % 3 <> 0").select(F.col("trait").alias("provider_id"), F.col("marker_idx").alias("global_idx"), F.col("wy").alias("score"))
    return multitrait.provider_scores(local, provider, _markers(spark).select(F.col("marker_idx").alias("global_idx")))


@query(
    "q31_alignment",
    """SELECT 'P' AS provider_id, 'm' || p_partkey AS marker_id, CASE WHEN p_partkey % 5 = 0 THEN 'unknown_marker'
        WHEN p_partkey % 7 = 0 THEN 'alleles' ELSE 'coding' END AS problem
    FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 7 = 0 OR p_partkey % 11 = 0""",
)
def q31(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat(F.lit("m"), "p_partkey").alias("marker_id"))
    known = p.filter("p_partkey % 5 <> 0").select("marker_id", F.lit("A").alias("effect"), F.lit("G").alias("other"), F.lit("add").alias("coding"))
    k = F.col("p_partkey")
    local = p.select(
        F.lit("P").alias("provider_id"),
        "marker_id",
        F.when(k % 7 == 0, "C").otherwise("A").alias("effect"),
        F.lit("G").alias("other"),
        F.when(k % 11 == 0, "dom").otherwise("add").alias("coding"),
    )
    return multitrait.alignment_errors(local, known)


@query("q32_block_edges", f"WITH {_EDGES} SELECT DISTINCT i // 8 AS a, j // 8 AS b FROM edges WHERE abs(r) > 0.04 AND i // 8 <> j // 8")
def q32(spark: SparkSession, d: str) -> DataFrame:
    return ld.block_edges(_edges(spark, d), 8, 0.04)


@query(
    "q33_run_aggregation",
    """WITH r AS (SELECT event_type AS locus, user_id % 10 AS marker_idx, round(value / 1000, 6) AS pip, round(value, 4) AS effect FROM events WHERE value IS NOT NULL)
    SELECT locus, marker_idx, round(avg(pip), 8) AS pip_mean, round(stddev_samp(pip), 8) AS pip_sd, round(min(pip), 8) AS pip_min, round(max(pip), 8) AS pip_max,
        round(avg(effect), 8) AS effect_mean, round(stddev_samp(effect), 8) AS effect_sd, round(min(effect), 8) AS effect_min, round(max(effect), 8) AS effect_max
    FROM r GROUP BY 1, 2""",
)
def q33(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").filter("value is not null")
    runs = e.select(
        F.col("event_type").alias("locus"), (F.col("user_id") % 10).alias("marker_idx"), F.round(F.col("value") / 1000, 6).alias("pip"), F.round("value", 4).alias("effect")
    )
    return finemap.aggregate_runs(runs)


def _fit(spark: SparkSession, d: str, model: samplers.Model, operator: str = "csr") -> samplers.Fit:
    chains = priors.ChainControls(nit=60, nburn=20, nchains=2, seed=7)
    return samplers.fit_summary(_stats(spark, d), _edges(spark, d), model, chains, operator, block_size=16)


MIXTURE = (0.0, 0.01, 0.1, 1.0)


@query("q34_bayesc_fit")
def q34(spark: SparkSession, d: str) -> DataFrame:
    return _fit(spark, d, samplers.Model(pi=(1 - PI, PI))).posterior()


@query("q35_bayesr_fit")
def q35(spark: SparkSession, d: str) -> DataFrame:
    return _fit(spark, d, samplers.Model(gamma=MIXTURE, pi=(0.85, 0.05, 0.05, 0.05))).components()


@query("q36_group_fit")
def q36(spark: SparkSession, d: str) -> DataFrame:
    return _fit(spark, d, samplers.Model(policy="group", pi=(1 - PI, PI), extra={"group": [k % 4 for k in range(MARKERS)], "group_vb": True})).posterior()


@query("q37_bayesrc_fit")
def q37(spark: SparkSession, d: str) -> DataFrame:
    a = np.column_stack([np.ones(MARKERS), np.arange(MARKERS) % 2])
    pi = (0.85, 0.05, 0.05, 0.05)
    weights = [x / (1 - pi[0]) for x in pi[1:]]
    extra = {"annotations": a, "alpha0": priors.alpha_init(list(MIXTURE), 1 - pi[0], weights)}
    return _fit(spark, d, samplers.Model(gamma=MIXTURE, pi=pi, policy="probit_stick", extra=extra)).posterior()


@query("q38_learned_logistic_fit")
def q38(spark: SparkSession, d: str) -> DataFrame:
    return _fit(spark, d, samplers.Model(policy="learned_logistic", pi=(1 - PI, PI), extra={"annotations": (np.arange(MARKERS) % 2 - 0.5)[:, None]})).posterior()


@query("q39_log_variance_fit")
def q39(spark: SparkSession, d: str) -> DataFrame:
    return _fit(spark, d, samplers.Model(policy="log_variance", pi=(1 - PI, PI), extra={"annotations": (np.arange(MARKERS) % 2 - 0.5)[:, None]})).posterior()


@query("q40_low_rank_fit")
def q40(spark: SparkSession, d: str) -> DataFrame:
    return _fit(spark, d, samplers.Model(pi=(1 - PI, PI)), "low_rank").posterior()


@query("q41_genotype_fit")
def q41(spark: SparkSession, d: str) -> DataFrame:
    panel, traits = _panel(spark, d)
    chains = priors.ChainControls(nit=60, nburn=20, nchains=2, seed=7)
    return samplers.fit_genotypes(panel, traits, samplers.Model(pi=(1 - PI, PI), adj_e=0.0), chains).posterior()


@query("q46_scheduled_fit")
def q46(spark: SparkSession, d: str) -> DataFrame:
    return _fit(spark, d, samplers.Model(pi=(1 - PI, PI), skip_nulls=4, swap=True, swap_r2=R2)).posterior()


@query("q42_joint_fit")
def q42(spark: SparkSession, d: str) -> DataFrame:
    chains = priors.ChainControls(nit=20, nburn=10, seed=7)
    return multitrait.fit_providers(*multitrait.same_ld(_stats(spark, d), _edges(spark, d)), chains, vb=np.eye(2) * VB, vb_df=4.0, vb_scale=np.eye(2) * VB)


@query("q43_gsim")
def q43(spark: SparkSession, d: str) -> DataFrame:
    """Phenotypes of the panel's own genotypes."""
    return simulate.simulate_on(_panel(spark, d)[0], nt=2, architecture="bayesr", rg=0.3, seed=5)[0]


@query(
    "q44_basket_allele_freq",
    """WITH d AS (SELECT l_orderkey, l_partkey % 256 AS marker_idx, least(2, count(*)) AS g FROM lineitem GROUP BY 1, 2),
    n AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem)
    SELECT marker_idx, sum(g)::BIGINT AS sum_g, sum(g * g)::BIGINT AS sum_gg, round(sum(g) / (2.0e0 * max(n)), 8) AS af FROM d, n GROUP BY 1""",
)
def q44(spark: SparkSession, d: str) -> DataFrame:
    """Allele frequencies of the large binding: orders by part, absent is 0."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", (F.col("l_partkey") % 256).alias("marker_idx"))
    g = lines.groupBy("l_orderkey", "marker_idx").agg(F.least(F.lit(2), F.count("*")).alias("g"))
    n = lines.select("l_orderkey").distinct().agg(F.count("*").alias("n"))
    sums = g.groupBy("marker_idx").agg(F.sum("g").alias("sum_g"), F.sum(F.col("g") * F.col("g")).alias("sum_gg"))
    return sums.crossJoin(F.broadcast(n)).select("marker_idx", "sum_g", "sum_gg", F.round(F.col("sum_g") / (2.0 * F.col("n")), 8).alias("af"))


@query(
    "q45_windowed_rates",
    """SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(avg(round(value, 4)), 6) AS mean_value FROM events GROUP BY 1, 2""",
)
def q45(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("value", F.round("value", 4))
    return incremental.windowed_rates(e).withColumn("mean_value", F.round("mean_value", 6))
