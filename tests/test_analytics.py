"""The analytics operators against SQL, enumeration, fixtures and round trips."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from effectforge import api
from effectforge.functions.expressions import normal_cdf, normal_quantile, quantile_type8
from effectforge.operators import controls, finemap, genotypes, ld, multitrait, priors, samplers, simulate, summaries
from effectforge.model_queries import ORACLE_SQL, QUERIES
from effectforge.sources import bed, csr
from effectforge.streaming import incremental

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def cells(df):
    df = df[sorted(df.columns)]
    rows = []
    for row in df.itertuples(index=False):
        rows.append(tuple("" if v is None or v is pd.NA or v != v else f"{v:.6g}" if isinstance(v, int | float | np.number) and not isinstance(v, bool) else str(v) for v in row))
    return sorted(rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, sf, name):
    ours, theirs = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert cells(ours) == cells(theirs)


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["i", "j", "r"]
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


TINY = [[0, 1, 2, 0, 1, 2, 1, 0], [2, 0, 1, 2, 0, 1, 1, 2], [0, 0, 1, 1, 2, 2, 1, 0]]


def test_bed_round_trip(spark, tmp_path):
    g = np.array([*TINY, [-1, 0, -1, 2, 1, 1, 0, -1]], np.int8)[:, :7]
    path = tmp_path / "x.bed"
    path.write_bytes(bed.encode(g))
    assert path.read_bytes()[:3] == b"\x6c\x1b\x01"
    for options in ({}, {"block": 1}, {"columns": "3,0,1", "samples": "6,0"}):
        got = {r["marker_idx"]: r["dosages"] for r in api.read_bed(spark, str(path), 7, **options).collect()}
        want = g if "columns" not in options else g[[3, 0, 1]][:, [6, 0]]
        assert got == {k: [None if x < 0 else int(x) for x in row] for k, row in enumerate(want)}
    panel = api.bed_panel(api.read_bed(spark, str(path), 7))
    af = {r["marker_idx"]: r["af"] for r in genotypes.allele_freq(panel).collect()}
    assert af[3] == pytest.approx(np.mean([0, 2, 1, 1, 0]) / 2)
    path.write_bytes(b"abc")
    with pytest.raises(Exception, match="SNP-major|whole markers"):
        api.read_bed(spark, str(path) + "x" if not os.path.exists(path) else str(path), 7, columns="0").collect()


def test_missing_dosages(spark):
    rng = np.random.default_rng(1)
    g = rng.integers(0, 3, (50, 6)).astype(float)
    g[rng.random(g.shape) < 0.1] = np.nan
    y = rng.integers(-5, 6, 50)
    rows = [(k, [None if np.isnan(x) else int(x) for x in r]) for k, r in enumerate(g)]
    panel = spark.createDataFrame(rows, "sample_idx bigint, dosages array<int>").repartition(3)
    traits = spark.createDataFrame([(k, "T", int(v)) for k, v in enumerate(y)], "sample_idx bigint, trait string, y bigint")
    z = samplers.standardise(g)
    s = {r["marker_idx"]: r for r in genotypes.summary_stats(panel, traits).collect()}
    assert np.allclose([s[k]["wy"] for k in range(6)], z.T @ y, atol=1e-6)
    assert np.allclose([s[k]["ww"] for k in range(6)], np.square(z).sum(0), atol=1e-6)
    raw = np.where(np.isnan(g), np.nanmean(g, 0), g)
    s = {r["marker_idx"]: r for r in genotypes.summary_stats(panel, traits, scale=False).collect()}
    assert np.allclose([s[k]["wy"] for k in range(6)], raw.T @ y, atol=1e-6)
    assert np.allclose([s[k]["ww"] for k in range(6)], np.square(raw).sum(0), atol=1e-6)
    xtx = z.T @ z
    e = {(r["i"], r["j"]): r["r"] for r in ld.ld_edges(panel, max_distance_variants=3, r2_threshold=0.0).collect()}
    assert set(e) == {(i, j) for i in range(6) for j in range(i + 1, min(6, i + 4))}
    for (i, j), r in e.items():
        assert r == pytest.approx(xtx[i, j] / np.sqrt(xtx[i, i] * xtx[j, j]), abs=1e-6)
    with pytest.raises(ValueError):
        ld.ld_edges(panel, max_distance_variants=0)
    assert ld.ld_edges(panel, max_distance_variants=0, allow_full=True, r2_threshold=0.0).count() == 15


SIX = [(0, 1, 0.65), (0, 2, -0.25), (1, 2, 0.45), (2, 3, 0.55), (4, 5, -0.35)]


def test_csr_round_trip(spark, tmp_path):
    edges = spark.createDataFrame(SIX, "i int, j int, r float")
    markers = spark.createDataFrame([(k,) for k in range(6)], "marker_idx int")
    prefix = f"file://{tmp_path}/ld"
    csr.write_csr(edges, markers, prefix, n_used=8)
    assert np.fromfile(f"{tmp_path}/ld.row_ptr.u64.bin", "<u8").tolist() == [0, 2, 3, 4, 4, 5, 5]
    got = sorted((r["i"], r["j"], round(r["r"], 6)) for r in api.read_sparse_ld(spark, prefix).collect())
    assert got == SIX
    assert csr.read_meta(prefix)["nnz"] == "5"
    assert api.read_sparse_ld(spark, prefix, one_based=True).agg(F.min("i")).first()[0] == 1
    band = np.zeros((6, 5), "<f4")
    band[:, 2] = 1
    for i, j, r in SIX:
        if j - i <= 2:
            band[i, 2 + j - i] = band[j, 2 - j + i] = r
    band.tofile(f"{tmp_path}/band.bin")
    got = sorted((r["i"], r["j"], round(r["r"], 6)) for r in csr.read_banded(spark, f"{tmp_path}/band.bin", 2, 0.3).collect())
    assert got == [x for x in SIX if abs(x[2]) > 0.3]
    assert ld.colour_blocks([(0, 1), (1, 2), (0, 2)], 4) == [0, 1, 2, 0]


def region_ld(pairs):
    return [("a", i, j, r) for i, j, r in pairs]


def test_credible_sets(spark):
    pips = spark.createDataFrame([(1, 0.60), (2, 0.25), (3, 0.08), (4, 0.004), (5, 0.0005)], "marker_idx int, pip double")
    regions = pips.select(F.lit("a").alias("region"), "marker_idx")
    pairs = spark.createDataFrame(region_ld([(1, 2, 0.8**0.5), (1, 3, 0.6**0.5), (4, 5, 0.9**0.5)]), "region string, i int, j int, r double")
    sets = finemap.credible_sets(pips, regions, pairs, coverage=0.8, min_r2=0.5, pip_cutoff=0.001).toPandas()
    first = sets[sets["cs"] == 1]
    assert first["marker_idx"].tolist() == [1, 2] and first["pip"].sum() >= 0.8 and (first["r2_to_lead"] >= 0.5).all()
    s = finemap.credible_set_summary(spark.createDataFrame(sets)).first()
    assert (s["lead_marker"], s["n_markers"]) == (1, 2)
    low = spark.createDataFrame([(1, 0.1), (2, 0.05), (3, 0.02)], "marker_idx int, pip double")
    none = finemap.credible_sets(low, low.select(F.lit("a").alias("region"), "marker_idx"), pairs.limit(0))
    assert none.count() == 0
    some = finemap.credible_sets(low, low.select(F.lit("a").alias("region"), "marker_idx"), pairs.limit(0), allow_incomplete=True)
    assert [r["marker_idx"] for r in some.orderBy("cs").collect()] == [1, 2, 3]


def test_multisignal_rules():
    r = np.eye(4)
    r[0, 1] = r[1, 0] = 0.9
    pip = np.array([0.9, 0.08, 0.97, 0.02])
    got = finemap.region_sets(pip, r, multi=True, remove="credible_set", coverage=0.95, signal_coverage=0.95)
    assert [[m[0] for m in s] for s in got] == [[2], [0, 1]]
    assert finemap.region_sets(np.zeros(3), np.eye(3)) == []


def test_kernels_match_enumeration():
    rng = np.random.default_rng(3)
    z = rng.standard_normal((200, 4))
    z[:, 1] = 0.7 * z[:, 0] + 0.5 * z[:, 1]
    z = (z - z.mean(0)) / z.std(0)
    y = z[:, 0] * 0.25 + rng.standard_normal(200)
    xtx, wy = z.T @ z, z.T @ y
    ww = np.diag(xtx).copy()
    c = xtx / np.sqrt(np.outer(ww, ww))
    i, j = np.triu_indices(4, 1)
    exact = samplers.brute_force_pips(wy, ww, xtx, 0.05, 1.0, 0.2)
    model = samplers.Model(pi=(0.8, 0.2), vb=0.05, ve=1.0, update_vb=False, update_ve=False, update_pi=False, adj_e=0.0)
    swap = samplers.Model(**{**model.__dict__, "swap": True, "swap_prob": 1.0, "swap_r2": 0.1})
    controls = priors.ChainControls(nit=4000, nburn=200)
    for m, op in (
        (model, samplers.CsrOperator(wy, ww, i, j, c[i, j])),
        (model, samplers.GenotypeOperator(z, y)),
        (model, samplers.LowRankOperator([(0, *samplers.low_rank_block(c, wy, ww, 1.0))])),
        (swap, samplers.CsrOperator(wy, ww, i, j, c[i, j])),
    ):
        assert np.abs(samplers.sample(op, float(y @ y), 200, m, controls, 5)["pip"] - exact).max() < 0.03


def test_scheduled_sweeps_and_cpo():
    """Skipping nulls keeps the answer; a model with the effect predicts better than one without."""
    rng = np.random.default_rng(8)
    z = rng.standard_normal((300, 60))
    z = (z - z.mean(0)) / z.std(0)
    y = 0.5 * z[:, 11] + rng.standard_normal(300)
    controls = priors.ChainControls(nit=300, nburn=100)
    out = {}
    for name, more in (("all", {}), ("some", {"skip_nulls": 4}), ("none", {"pi": (1.0, 1e-40), "update_pi": False, "vb": 0.01, "update_vb": False})):
        model = samplers.Model(**({"pi": (0.99, 0.01), "adj_e": 0.0, "log_cpo": True} | more))
        out[name] = samplers.sample(samplers.GenotypeOperator(z, y), float(y @ y), 300, model, controls, 3)
    assert out["all"]["pip"][11] > 0.95 and out["some"]["pip"][11] > 0.95
    assert abs(out["all"]["pip"].sum() - out["some"]["pip"].sum()) < 1.0
    assert out["all"]["log_cpo"] > out["none"]["log_cpo"] + 10
    assert [samplers.skip_length(p, 8, 20) for p in (1e-7, 5e-6, 5e-5, 5e-4, 0.1)] == [20, 16, 8, 4, 0]


def test_block_filters():
    rng = np.random.default_rng(2)
    z = rng.standard_normal((40, 60))
    z = (z - z.mean(0)) / z.std(0)
    corr = z.T @ z / 40
    weight = samplers.shrinkage(z)
    assert 0 < weight < 1 and samplers.shrinkage(rng.standard_normal((5000, 3)) * [1, 2, 3]) < 0.05
    assert np.linalg.eigvalsh(samplers.filtered_block(corr, "ridge_lw", weight=weight)).min() > 0
    assert np.allclose(np.diag(samplers.filtered_block(corr, "ridge_fixed", eta=0.5)), 1)
    kept = np.linalg.eigvalsh(samplers.filtered_block(corr, "hard_truncate", tau=0.5))
    assert ((kept > 0.49) | (abs(kept) < 1e-9)).all() and (kept > 0.49).sum() == (np.linalg.eigvalsh(corr) >= 0.5).sum()
    with pytest.raises(ValueError):
        samplers.filtered_block(corr, "other")


def test_joint_kernel_matches_scalar_products():
    """Two independent traits: pattern weights factorise."""
    rng = np.random.default_rng(1)
    u, info, v = rng.normal(size=2), np.diag([3.0, 4.0]), np.diag([0.5, 0.2])
    w = multitrait.pattern_log_weights(u, info, v, np.zeros(4), multitrait.patterns(2))
    assert w[3] == pytest.approx(w[1] + w[2]) and w[0] == 0
    draws = np.mean([multitrait.inverse_wishart(rng, 20.0, np.eye(2) * 17) for _ in range(2000)], axis=0)
    assert np.allclose(draws, np.eye(2), atol=0.06)
    with pytest.raises(ValueError):
        multitrait.patterns(13)


def test_recovery_and_api(spark):
    """A simulated causal marker is found by every kind of fit; summaries and loci follow."""
    m = 30
    beta = np.zeros(m)
    beta[7] = 1.0
    sim = simulate.gsim(spark, n=400, m=m, beta=beta, h2=0.4, seed=3)
    assert "30 markers" in repr(sim)
    panel = sim.panel.cache()
    y = sim.phenotypes.withColumn("y", F.round(F.col("y") * 1000).cast("bigint"))
    check = sim.phenotypes.agg(F.max(F.abs(F.col("y") - F.col("g") - F.col("e")))).first()[0]
    assert check < 1e-12
    stats = genotypes.summary_stats(panel, y.select("sample_idx", "trait", "y"))
    stats = stats.withColumns({"wy": F.col("wy") / 1000, "yy": F.col("yy") / 1e6}).cache()
    edges = ld.ld_edges(panel, max_distance_variants=10, r2_threshold=0.0).cache()
    controls = priors.ChainControls(nit=80, nburn=40, nchains=2, seed=9)
    more = dict(pi_init=0.05, controls=controls)
    a = np.column_stack([np.ones(m), np.arange(m) % 2])
    fits = [
        api.fit_csr(stats, edges, **more),
        api.fit_csr(stats, edges, "bayesr", **more),
        api.fit_block_eigen(stats, edges, block_size=30, **more),
        api.fit_csr_annotated(stats, edges, "annotation_probit_stick", a, **more),
        api.fit_csr_annotated(stats, edges, "fixed_marker", np.full(m, 0.05), **more),
        api.fit_bed(panel, sim.phenotypes.select("sample_idx", "trait", "y"), **more),
    ]
    for fit in fits:
        top = fit.posterior().orderBy(F.col("pip").desc()).first()
        assert top["marker_idx"] == 7 and top["pip"] > 0.9
    fit = fits[0]
    fit.rows = fit.rows.cache()
    assert {r["check"]: r["ok"] for r in summaries.consistency(fit.posterior(), m).collect()} == {"markers": True, "pip_range": True, "finite_effects": True}
    s = api.summarise_posterior(fit).toPandas().set_index("quantity")
    assert s.loc["vg", "mean"] > 0 and s.loc["vg", "lower"] <= s.loc["vg", "median"] <= s.loc["vg", "upper"]
    d = api.extract_diagnostics(fit)["convergence"].toPandas()
    assert set(d["quantity"]) == set(samplers.TRACES)
    assert api.extract_posterior(fit, "pip", markers=[7], chains=[0]).count() == 1
    with pytest.raises(ValueError):
        api.extract_posterior(fit, "nothing")
    markers = spark.createDataFrame([(k, 1, k * 1000.0) for k in range(m)], "marker_idx int, chr int, pos double")
    sets = api.make_credible_sets(fit, markers, edges, trait="T1", max_locus_distance=5000, coverage=0.8).toPandas()
    assert 7 in set(sets["marker_idx"])
    locus = spark.createDataFrame([("x", k) for k in range(4, 12)], "locus string, marker_idx int")
    effects = fit.posterior().select("marker_idx", "effect")
    fine = api.finemap(stats, edges, locus, vb=0.3, ve=1.5, pi=0.05, effects=effects, nruns=2, nit=200, nburn=50).toPandas().set_index("marker_idx")
    assert fine["pip_mean"].idxmax() == 7
    table = api.extract_loci(fit, locus, markers, "T1").first()
    assert table["lead"] == 7 and table["n_markers"] == 8


def test_joint_fits(spark):
    sim = simulate.mtsim(spark, n=300, m=12, n_shared=1, n_specific=0, h2=0.4, rg=0.9, seed=2)
    causal = int(np.flatnonzero(sim.component)[0])
    controls = priors.ChainControls(nit=40, nburn=20, seed=4)
    args = dict(vb=np.eye(2) * 0.3, vb_df=5.0, vb_scale=np.eye(2) * 0.3)
    traits = sim.phenotypes.select("sample_idx", "trait", "y")
    joint = multitrait.fit_joint_genotypes(sim.panel, traits, controls, ve=np.eye(2) * 1.5, ve_df=10.0, **args)
    y = traits.withColumn("y", F.round(F.col("y") * 1000).cast("bigint"))
    stats = genotypes.summary_stats(sim.panel, y).withColumns({"wy": F.col("wy") / 1000, "yy": F.col("yy") / 1e6})
    edges = ld.ld_edges(sim.panel, max_distance_variants=12, r2_threshold=0.0)
    for fit in (joint, api.fit_joint_csr(stats, edges, controls, **args), api.fit_joint_block_eigen(stats, edges, controls, block_size=6, **args)):
        d = fit.filter("quantity = 'pip'").groupBy("marker_idx").agg(F.max("value").alias("pip")).orderBy(F.col("pip").desc()).first()
        assert d["marker_idx"] == causal and d["pip"] > 0.8


def test_architectures(spark):
    for name in simulate.ARCHITECTURES:
        sim = simulate.gsim(spark, n=20, m=200, nt=2, architecture=name, n_causal=10, rg=0.5, seed=1)
        assert (sim.component > 0).sum() == 10 and sim.effects.shape == (200, 2)
    a = simulate.gsim(spark, n=30, m=10, seed=4).panel.orderBy("sample_idx").collect()
    assert a == simulate.gsim(spark, n=30, m=10, seed=4).panel.repartition(5).orderBy("sample_idx").collect()
    sim, sets = simulate.mtsim_annotation(spark, n=10, m=100, n_shared=5, n_specific=2, seed=3)
    assert sets.shape == (100, 5) and (sim.component > 0).sum() == 9


def test_diagnostics(spark):
    rng = np.random.default_rng(0)
    good = rng.standard_normal((500, 4))
    status, rhat, *_, = summaries.diagnose(good)
    assert status == "computed" and abs(rhat - 1) < 0.01
    assert summaries.diagnose(good)[4] > 1000
    slow = np.cumsum(rng.standard_normal((500, 4)), axis=0)
    assert summaries.diagnose(slow)[1] > 1.1 and summaries.diagnose(slow)[4] < 100
    cases = {"constant": np.ones((9, 4)), "nonfinite": np.full((9, 4), np.nan), "unavailable_single_chain": good[:, :1], "insufficient_draws": good[:3]}
    assert {k: summaries.diagnose(v)[0] for k, v in cases.items()} == {k: k for k in cases}
    assert summaries.diagnose(np.tile([0.0, 1.0, 2.0, 3.0], (20, 1)))[0] == "constant_chain_mismatch"
    assert summaries.diagnose(good[:, :3])[0] == "computed_fewer_than_four_chains"
    draws = spark.createDataFrame([(0, k, float(v)) for k, v in enumerate(np.exp(good.ravel()))], "chain int, iteration int, value double")
    r = summaries.hpd(draws, ["chain"]).first()
    assert r["lower"] < 0.2 and r["upper"] < np.quantile(np.exp(good), 0.975)


def test_expressions(spark):
    from statistics import NormalDist

    xs = [-9.0, -3.0, -0.5, 0.0, 1.0, 4.0, 8.0]
    d = spark.createDataFrame([(x,) for x in xs], "x double").select("x", normal_cdf(F.col("x")).alias("p")).collect()
    for r in d:
        assert r["p"] == pytest.approx(min(max(NormalDist().cdf(r["x"]), 1e-12), 1 - 1e-12), abs=1e-13)
    v = spark.createDataFrame([([1.0, 2.0, 4.0, 8.0],)], "v array<double>")
    got = v.select(quantile_type8(F.col("v"), 0.5), quantile_type8(F.col("v"), 0.01), quantile_type8(F.col("v"), 0.99)).first()
    assert got[0] == pytest.approx(3.0) and got[1] == 1.0 and got[2] == 8.0


def test_priors(spark):
    c = priors.ChainControls(nchains=2, seed=5)
    assert priors.task_seed(c, "x", "T1", 0) != priors.task_seed(c, "x", "T1", 1)
    assert priors.task_seed(c, "x", "T1", 0) == priors.task_seed(priors.ChainControls(nchains=9, seed=5), "x", "T1", 0)
    for bad in (dict(nit=0), dict(seed=-1), dict(nchains=2, chain_seeds=(1,))):
        with pytest.raises(ValueError):
            priors.ChainControls(**bad)
    alpha = priors.alpha_init([0, 0.01, 0.1, 1], 0.1, [3, 2, 1])
    pi = api.annotation_pi({"one": alpha})["one"]
    assert np.allclose(pi, [0.9, 0.05, 0.1 / 3, 0.1 / 6])
    one = spark.createDataFrame([(0, "one", 1.0)], "marker_idx int, annotation string, value double")
    sticks = priors.marker_sticks(one, {"one": alpha})
    assert np.allclose([r["pi"] for r in sticks.orderBy("component").collect()], pi)
    mean = priors.sticks_gamma_mean(sticks, [0, 0.01, 0.1, 1]).first()["gamma_mean"]
    assert mean == pytest.approx(api.annotation_gamma_mean({"one": alpha})["one"])
    with pytest.raises(ValueError):
        priors.annotation_matrix(one)


def test_streaming_equals_batch(spark, sf, tmp_path):
    panel, _ = genotypes.embedding_panel(spark, sf)
    panel.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(panel.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = incremental.running_allele_sums(stream).writeStream.outputMode("complete").format("memory").queryName("sums")
    q.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    key = ["marker_idx"]
    pd.testing.assert_frame_equal(
        spark.table("sums").toPandas().sort_values(key).reset_index(drop=True),
        incremental.running_allele_sums(panel).toPandas().sort_values(key).reset_index(drop=True),
    )


def small_problem(m=24, n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, m))
    for j in range(1, m):
        x[:, j] = 0.4 * x[:, j - 1] + np.sqrt(1 - 0.16) * x[:, j]
    x = (x - x.mean(0)) / x.std(0)
    b = np.zeros(m)
    b[[2, 9, 17]] = (0.5, -0.4, 0.3)
    y = x @ b + rng.standard_normal(n)
    corr = x.T @ x / n
    i, j = np.triu_indices(m, 1)
    return x.T @ y, np.full(m, float(n)), i, j, corr[i, j], float(y @ y), float(n)


@pytest.mark.parametrize("kind", ["csr", "low_rank", "hard_truncate", "ridge_fixed", "ridge_lw"])
def test_operators_agree(kind):
    """Every operator keeps its residual as a rebuild gives it, and scores as its own X'X says."""
    wy, ww, i, j, r, _, _ = small_problem()
    op = samplers.build_operator(kind, wy, ww, i, j, r, 8, {"eta": 0.1, "weight": 0.05, "eigen_prop": 0.999})
    rng = np.random.default_rng(1)
    parts = op.segments(rng.permutation(len(wy)))
    assert sorted(np.concatenate(parts).tolist()) == list(range(len(wy)))
    b = np.zeros(len(wy))
    for k in rng.integers(0, len(wy), 30):
        change = rng.normal()
        op.move(int(k), change)
        b[k] += change
    moved = op.residual().copy()
    scores = np.concatenate([op.scores(p) for p in parts])
    assert np.allclose(scores, moved[np.concatenate(parts)])
    op.set_effects(b)
    assert np.allclose(op.residual(), moved, rtol=1e-6, atol=1e-5)


@pytest.mark.parametrize("more", [{}, {"skip_nulls": 4}, {"swap": True, "swap_r2": 0.1, "swap_prob": 0.5}])
def test_wide_sweeps_are_the_same(more, monkeypatch):
    """Looking at many markers at once gives the draws of one at a time, but for those that scheduling adds."""
    wy, ww, i, j, r, yy, n = small_problem()
    model = samplers.Model(pi=(0.8, 0.2), **more)
    out = []
    for width in (1, 64):
        monkeypatch.setattr(samplers, "WIDTH", width)
        monkeypatch.setattr(samplers, "MOST_WIDTH", width)
        out.append(samplers.sample(samplers.CsrOperator(wy, ww, i, j, r), yy, n, model, priors.ChainControls(nit=400, nburn=50), 5))
    assert np.allclose(out[0]["pip"], out[1]["pip"], atol=0.15 if more.get("skip_nulls") else 1e-12)
    assert out[1]["pip"][[2, 9, 17]].min() > 0.9


@pytest.mark.parametrize("policy,mode", [("fixed_block", "fixVe"), ("gctb_block", "samVe"), ("gctb_block", "allMixVe"), ("gctb_block", "mixVe")])
def test_block_policies(policy, mode):
    wy, ww, i, j, r, yy, n = small_problem()
    op = samplers.build_operator("low_rank", wy, ww, i, j, r, 8)
    model = samplers.Model(pi=(0.8, 0.2), adj_e=0.0, block_policy=policy, block_mode=mode)
    out = samplers.sample(op, yy, n, model, priors.ChainControls(nit=150, nburn=50), 5)
    assert out["pip"][[2, 9]].min() > 0.8
    with pytest.raises(ValueError):
        samplers.sample(samplers.CsrOperator(wy, ww, i, j, r), yy, n, model, priors.ChainControls(nit=1, nburn=0), 5)


def test_block_selection():
    chosen = lambda mode, it, vg, ss, was=False: samplers.block_selected(mode, it, vg, ss, 1.1, was)
    assert chosen("fixVe", 9, 1, 9) == (False, False) and chosen("samVe", 0, 0, 0)[0]
    assert chosen("allMixVe", 0, 1, 1.2)[0] and not chosen("allMixVe", 0, 1, 1.0)[0] and not chosen("allMixVe", 0, 0, 1)[0]
    assert chosen("mixVe", 49, 1, 2) == (False, False) and chosen("mixVe", 50, 1, 2) == (True, True)
    assert chosen("mixVe", 51, 0, 0, True) == (True, True) and chosen("mixVe", 51, 1, 2, False) == (False, False)
    with pytest.raises(ValueError):
        chosen("other", 0, 1, 1)


def test_learned_annotations():
    """An annotation of the causal markers learns a positive effect on inclusion; the base moves by a slice step."""
    wy, ww, i, j, r, yy, n = small_problem()
    a = np.zeros((len(wy), 1))
    a[[2, 9, 17, 5]] = 1
    extra = {"annotations": a, "rw_sd": 0.5, "learn_vb": True}
    model = samplers.Model(pi=(0.9, 0.1), pi_strength=10.0, policy="learned_logistic", extra=extra)
    out = samplers.sample(samplers.CsrOperator(wy, ww, i, j, r), yy, n, model, priors.ChainControls(nit=600, nburn=200), 5)
    assert out["prior"].coef[0, 0] > 0 and out["pip"][[2, 9]].min() > 0.9 and np.isfinite(out["prior"].base)
    rng = np.random.default_rng(0)
    x, draws = 0.0, []
    for _ in range(4000):
        x = samplers.slice_draw(rng, lambda v: -0.5 * (v - 2.0) ** 2 / 0.25, x)
        draws.append(x)
    assert abs(np.mean(draws) - 2) < 0.1 and abs(np.std(draws) - 0.5) < 0.1


def test_normal_quantile(spark):
    from statistics import NormalDist

    ps = [1e-15, 1e-9, 0.001, 0.02, 0.3, 0.5, 0.8, 0.999999, 1.0]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(normal_quantile(F.col("p"))).collect()
    for p, r in zip(ps, got, strict=True):
        assert r[0] == pytest.approx(NormalDist().inv_cdf(min(max(p, 1e-12), 1 - 1e-12)), abs=1e-9)


def test_controls(spark):
    good = dict(model="bayesr", gamma=(0.0, 0.1), pi=(0.9, 0.1), nub=4.0, nue=4.0, h2=0.3, nit=10, nthin=1, nchains=1)
    assert controls.validate_spec(spark, good).filter("not ok").count() == 0
    text = controls.report(controls.validate_spec(spark, good | {"pi": (0.9, 0.2), "h2": 1.5}))
    assert text.startswith("7 checks, 2 failed") and "FAIL simplex: probabilities add up to 1" in text
    rows = spark.createDataFrame([(0, None, None, None, 0.1), (1, 0.2, 0.7, None, 0.2)], "marker_idx int, explicit_maf double, gwas_af double, analysis_maf double, reference_maf double")
    with pytest.raises(ValueError, match="no allele frequencies"):
        controls.effect_maf(rows)
    assert {r["source"] for r in controls.effect_maf(rows, allow_reference=True).collect()} == {"reference_panel"}
    catalog = spark.createDataFrame([(1, "a", 0, 0)], "chr int, marker_id string, marker_idx int, bed_column int")
    with pytest.raises(ValueError, match="does not know"):
        controls.resolve_markers(spark.createDataFrame([("b",)], "marker_id string"), catalog)
    labels = spark.createDataFrame([(0, "x"), (1, "y")], "marker_idx int, label string")
    with pytest.raises(ValueError, match="are not the groups"):
        priors.group_index(labels, ["x", "y", "z"])
    twins = spark.createDataFrame([(k, n, float(k * f)) for k in range(5) for n, f in (("a", 1), ("b", 2))], "marker_idx int, annotation string, value double")
    with pytest.raises(ValueError, match="determine each other"):
        priors.centred_annotations(twins)


def test_overview_and_warnings(spark):
    rows = [("a", "computed", 1.2, 50.0, 40.0, True), ("b", "computed", 1.0, 500.0, 400.0, False), ("c", "not_updated", None, None, None, False)]
    d = spark.createDataFrame(rows, "quantity string, status string, rhat double, ess_bulk double, ess_tail double, rhat_flag boolean")
    d = d.withColumn("ess_flag", F.lit(False)).withColumn("mcse_flag", F.lit(False))
    over = summaries.overview(d)
    r = over.first()
    assert (r["overall_status"], r["n_computed"], r["n_unavailable"], r["max_rhat_quantity"]) == ("warning", 2, 0, "a")
    assert summaries.warnings(over, "fit x")[0].startswith("fit x: warning, 1 of 3") and summaries.warnings(summaries.overview(d.filter("not rhat_flag"))) == []
    assert summaries.overview(d.limit(0)).first()["overall_status"] == "unavailable"


def test_force_correlation():
    x = np.random.default_rng(2).standard_normal((200, 3))
    target = np.array([[1, 0.5, 0.1], [0.5, 1, -0.3], [0.1, -0.3, 1]])
    assert np.allclose(np.corrcoef(simulate.force_correlation(x, target), rowvar=False), target)
    with pytest.raises(ValueError):
        simulate.force_correlation(x, np.ones((3, 3)))
