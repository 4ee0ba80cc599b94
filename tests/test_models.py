"""Pair allocation, annotation selection, MCEM, particles, convergence states and user hooks against exact answers."""

from math import gamma as gamma_function

import numpy as np
import pytest
from pyspark.sql import functions as F

from effectforge.functions.expressions import incomplete_beta, log_gamma, student_p_value
from effectforge.operators import controls, genotypes, particles, priors, samplers, selection, simulate, summaries, tempering
from effectforge.sources.provider import provider_panel


def correlated(n=150, m=8, seed=3, rho=0.7):
    rng = np.random.default_rng(seed)
    z = rng.standard_normal((n, m))
    for k in range(1, m):
        z[:, k] = rho * z[:, k - 1] + np.sqrt(1 - rho * rho) * z[:, k]
    y = 0.3 * z[:, 2 % m] + 0.25 * z[:, 5 % m] + rng.standard_normal(n)
    return z, y


def csr_of(z, y):
    xtx = z.T @ z
    ww = np.diag(xtx).copy()
    i, j = np.triu_indices(len(ww), 1)
    return samplers.CsrOperator(z.T @ y, ww, i, j, xtx[i, j] / np.sqrt(ww[i] * ww[j])), xtx


# Pairs


def test_pair_states_are_exact():
    z, y = correlated(m=2)
    xtx, noise, v, prior = z.T @ z, 1.1, np.array([0.02, 0.3]), np.log([0.7, 0.2, 0.1])
    lw = samplers.pair_states(z.T @ y, np.diag(xtx), xtx[0, 1], np.tile(v, (2, 1)), np.tile(prior, (2, 1)), noise)
    block = particles.Block(z.T @ y, xtx, noise)
    assert np.logaddexp.reduce(lw.ravel()) == pytest.approx(particles.exact_evidence(block, v, np.tile(prior, (2, 1))))
    flat = samplers.pair_states(np.array([3.0, -2.0]), np.array([9.0, 8.0]), 0.0, np.ones((2, 1)), np.tile(np.log([0.5, 0.5]), (2, 1)), 1.0)
    assert flat[0, 0] + flat[1, 1] == pytest.approx(flat[0, 1] + flat[1, 0])


@pytest.mark.parametrize("pairs", [0.0, 1.0])
def test_pair_moves_keep_the_posterior(pairs):
    z, y = correlated(rho=0.9, m=6)
    op, xtx = csr_of(z, y)
    model = samplers.Model(pi=(0.7, 0.3), vb=0.05, ve=1.0, adj_e=0.0, update_vb=False, update_ve=False, update_pi=False, pair_prob=pairs, pair_r2=0.3)
    out = samplers.sample(op, float(y @ y), len(y), model, priors.ChainControls(nit=8000, nburn=500), 7)
    want = samplers.brute_force_pips(z.T @ y, np.diag(xtx), xtx, 0.05, 1.0, 0.3)
    assert np.abs(out["pip"] - want).max() < 0.04


# Annotations


def test_selection_sweeps_agree_with_all_subsets():
    rng = np.random.default_rng(2)
    a = np.column_stack([np.ones(60), rng.standard_normal((60, 3))])
    a[:, 3] = 0.7 * a[:, 2] + 0.7 * a[:, 3]
    z = np.column_stack([0.3 * a[:, 1] + 0.25 * a[:, 2] + rng.standard_normal(60) for _ in range(2)])
    xx, xz = np.array([a.T @ a] * 2), np.array([a.T @ z[:, k] for k in range(2)])
    # Intercepts are drawn too, so they are fixed by a prior that leaves no room.
    mean = (np.array([0.2, -0.1]), 1e12)
    alpha, delta, state, kept = np.zeros((4, 2)), np.ones(3, bool), {"pi_a": 0.4, "tau2": np.array([0.2, 0.5])}, np.zeros(3)
    for _ in range(20_000):
        samplers.selection_sweep(rng, xx, xz, alpha, delta, state, intercept=mean, fixed=True)
        kept += delta
    weights = selection.subset_weights(xx, xz, mean[0], state["tau2"], 0.4)
    want = [sum(w for s, w in weights.items() if k in s) for k in range(3)]
    assert np.allclose(kept / 20_000, want, atol=0.02) and sum(weights.values()) == pytest.approx(1)
    with pytest.raises(ValueError, match="too many"):
        selection.subset_weights(np.zeros((1, 15, 15)), np.zeros((1, 15)), np.zeros(1), np.ones(1), 0.5)


def annotated_markers(spark, m=3000, parts=4):
    rng = np.random.default_rng(11)
    a = np.column_stack([np.ones(m), rng.integers(0, 2, m), rng.standard_normal(m)])
    going = samplers._phi(a @ np.array([[-0.6, 0.0], [0.9, 0.8], [0.0, 0.0]]))
    first = rng.random(m) < going[:, 0]
    comp = np.where(first, np.where(rng.random(m) < going[:, 1], 2, 1), 0)
    rows = [(k, int(comp[k]), a[k].tolist(), [float(x == comp[k]) for x in range(3)]) for k in range(m)]
    return spark.createDataFrame(rows, "marker_idx int, component int, a array<double>, probs array<double>").repartition(parts).cache()


def test_annotations_are_selected(spark):
    """The annotation that makes components is in, the one that does not is out, and coefficients are recovered."""
    found = selection.select_annotations(annotated_markers(spark), 2, sweeps=40, burn=15, seed=3)
    assert found["inclusion"][0] > 0.95 and found["inclusion"][1] < 0.5
    assert np.allclose(found["alpha"][:2], [[-0.6, 0.0], [0.9, 0.8]], atol=0.25)


def test_selection_in_a_chain():
    z, y = correlated(m=12)
    op, _ = csr_of(z, y)
    a = np.column_stack([np.ones(12), np.isin(np.arange(12), (2, 5)), np.arange(12) % 2])
    model = samplers.Model(gamma=(0.0, 0.1, 1.0), pi=(0.8, 0.1, 0.1), policy="probit_stick", extra={"annotations": a, "select": True})
    out = samplers.sample(op, float(y @ y), len(y), model, priors.ChainControls(nit=200, nburn=50), 5)
    assert np.isfinite(out["effect"]).all() and (out["prior"].coef[1:][~out["prior"].delta] == 0).all()


def test_m_step_ascends_to_the_mode(spark):
    markers = annotated_markers(spark)
    alpha, values = selection.m_step(markers, np.zeros((3, 2)), sigma2=4.0)
    assert all(b >= a - 1e-9 for a, b in zip(values, values[1:], strict=False)) and len(values) < 15
    assert np.allclose(alpha, [[-0.6, 0.0], [0.9, 0.8], [0.0, 0.0]], atol=0.2)
    _, slope, _ = selection.newton_terms(markers, alpha)
    assert np.abs(slope.T - alpha / np.array([[1.0], [4.0], [4.0]])).max() < 1e-4
    tiny = markers.limit(40).cache()
    value, slope, bend = selection.newton_terms(tiny, alpha)
    for k in range(2):
        for i in range(3):
            e = np.zeros_like(alpha)
            e[i, k] = 1e-5
            up, down = selection.newton_terms(tiny, alpha + e), selection.newton_terms(tiny, alpha - e)
            assert (up[0][k] - down[0][k]) / 2e-5 == pytest.approx(slope[k, i], abs=1e-3)
            assert np.allclose((down[1][k] - up[1][k]) / 2e-5, bend[k, i], atol=1e-3)


def test_mcem_finds_the_enriched_annotation(spark):
    m, rng = 60, np.random.default_rng(5)
    z = rng.standard_normal((500, m))
    inside = np.arange(m) < 20
    y = z[:, :10] @ np.full(10, 0.35) + rng.standard_normal(500)
    rows = [("T", k, float(z[:, k] @ y), float(z[:, k] @ z[:, k]), float(y @ y), 500) for k in range(m)]
    stats = spark.createDataFrame(rows, "trait string, marker_idx int, wy double, ww double, yy double, n int")
    r = np.corrcoef(z.T)
    edges = spark.createDataFrame([(i, j, float(r[i, j])) for i in range(m) for j in range(i + 1, m)], "i int, j int, r double")
    model = samplers.Model(gamma=(0.0, 1.0), pi=(0.9, 0.1), update_pi=False)
    a = np.column_stack([np.ones(m), inside])
    found = selection.fit_mcem(stats, edges, a, model, priors.ChainControls(nit=60, nburn=30, seed=2), alpha=np.array([[-1.0], [0.0]]), outer=4)
    assert found["alpha"][1, 0] > 0.5 and len(found["history"]) <= 5
    top = found["fit"].posterior().orderBy(F.desc("pip")).limit(8).toPandas()
    assert (top["marker_idx"] < 10).mean() >= 0.75


# Particles


@pytest.mark.parametrize(("rho", "least"), [(0.3, 0.9), (0.7, 0.5)])
def test_particle_evidence_is_unbiased(rho, least):
    z, y = correlated(rho=rho)
    block = particles.Block(z.T @ y, z.T @ z, 1.0)
    v, prior = np.array([0.02, 0.1]), np.tile(np.log([0.6, 0.25, 0.15]), (8, 1))
    exact = particles.exact_evidence(block, v, prior)
    rng = np.random.default_rng(1)
    clouds = [particles.run_particles(block, v, prior, rng, 300, least) for _ in range(200)]
    ratio = np.exp(np.array([c.log_evidence for c in clouds]) - exact)
    assert abs(ratio.mean() - 1) < 4 * ratio.std() / np.sqrt(len(ratio)) and ratio.std() < 1
    assert sum(c.resampled for c in clouds) > 0 or least < 0.9
    wide = particles.run_particles(block, v, prior, rng, 4000)
    assert wide.log_evidence == pytest.approx(exact, abs=0.1)
    for s, mean in list(zip(wide.states, wide.means, strict=True))[:20]:
        on = np.flatnonzero(s)
        p = block.xtx[np.ix_(on, on)] + np.diag(1 / v[s[on] - 1])
        assert np.allclose(mean[on], np.linalg.solve(p, block.wy[on])) and not mean[s == 0].any()


def test_particle_moves(spark):
    """Independence moves give the inclusion probabilities of an enumeration; a marginal chain moves."""
    z, y = correlated()
    xtx = z.T @ z
    ww = np.diag(xtx)
    rows = [("T", k, float(z[:, k] @ y), float(ww[k]), float(len(y)), len(y)) for k in range(8)]
    stats = spark.createDataFrame(rows, "trait string, marker_idx int, wy double, ww double, yy double, n int")
    r = xtx / np.sqrt(np.outer(ww, ww))
    edges = spark.createDataFrame([(i, j, float(r[i, j])) for i in range(8) for j in range(i + 1, 8)], "i int, j int, r double")
    got = particles.particle_inclusion(stats, edges, size=8, vb=0.05, ve_share=1.0, gamma=(0.0, 1.0), pi=(0.7, 0.3), moves=150, particles=100).orderBy("marker_idx").toPandas()
    assert np.abs(got["pip"] - samplers.brute_force_pips(z.T @ y, ww, xtx, 0.05, 1.0, 0.3)).max() < 0.04 and got["accepted"].min() > 0.3
    chain = particles.marginal_moves(stats, edges, size=8, vb=0.05, ve_share=1.0, pi=0.3, prior=(2.0, 2.0), steps=4, particles=50)
    assert len(chain) == 4 and chain["pi"].between(0, 1).all()
    again = particles.block_evidence(stats, edges, size=4, vb=0.05, ve_share=1.0, gamma=(0.0, 1.0), pi=(0.7, 0.3))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, again.collect())) and again.count() == 2


# Diagnostics


def test_p_values(spark):
    def exact(t, df):
        """A finite sum of powers of the cosine, for whole degrees of freedom."""
        theta, term, total = np.arctan(abs(t) / np.sqrt(df)), 1.0, 0.0
        for k in range((df - 2 - df % 2) // 2 + 1 if df > 1 else 0):
            total += term * np.cos(theta) ** (2 * k + df % 2)
            term *= (2 * k + 2) / (2 * k + 3) if df % 2 else (2 * k + 1) / (2 * k + 2)
        total *= np.sin(theta)
        return 1 - (2 / np.pi * (theta + total) if df % 2 else total)

    cases = [(t, df, float(exact(t, df))) for t in (0.0, 0.5, -3.5, 12.0) for df in (1, 2, 3, 4, 10, 61, 62, 999)] + [(1.0, 1, 0.5), (0.0, 7, 1.0)]
    d = spark.createDataFrame([(float(t), float(n), p) for t, n, p in cases], "t double, df double, p double")
    for r in d.withColumn("got", student_p_value(F.col("t"), F.col("df"))).collect():
        assert r["got"] == pytest.approx(r["p"], rel=1e-9, abs=1e-12)
    d = spark.createDataFrame([(x,) for x in (0.5, 1.0, 3.7, 20.0)], "x double")
    for r in d.withColumn("g", log_gamma(F.col("x"))).collect():
        assert r["g"] == pytest.approx(np.log(gamma_function(r["x"])), abs=1e-12)
    two = spark.range(1).select(incomplete_beta(F.lit(2.0), F.lit(3.0), F.lit(0.4)).alias("x"), incomplete_beta(F.lit(2.0), F.lit(3.0), F.lit(0.9)).alias("y")).first()
    assert two["x"] == pytest.approx(0.5248, abs=1e-12) and two["y"] == pytest.approx(0.9963, abs=1e-12)


def test_trace_states_merge(spark):
    rng = np.random.default_rng(7)
    rows = [(q, c, k, float(rng.normal() + (q == "b") * c)) for q in "ab" for c in range(3) for k in range(41)]
    t = spark.createDataFrame(rows + [("c", 0, k, 1.0) for k in range(10)], "quantity string, chain int, iteration int, value double")
    whole = summaries.trace_states(t, ["quantity"])
    out = {r["quantity"]: r for r in summaries.extended_convergence(whole, ["quantity"]).collect()}
    rhat = {r["quantity"]: r["rhat"] for r in summaries.rhat_basic(t.filter("quantity <> 'c'"), ["quantity"]).collect()}
    assert {k: out[k]["rhat"] for k in "ab"} == rhat
    assert [out[k]["status"] for k in "bc"] == ["not_converged", "constant"] and out["a"]["n"] == 120
    spans = t.join(whole.select("quantity", "chain", "half", F.col("from").alias("lo"), F.col("to").alias("hi")), ["quantity", "chain"]).filter("iteration between lo and hi")
    parts = spans.withColumn("part", F.col("iteration") % 3 == 0).groupBy("quantity", "chain", "half", "part").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("*")).alias("m2"),
        F.min_by("value", "iteration").alias("first"), F.max_by("value", "iteration").alias("last"), F.min("iteration").alias("from"), F.max("iteration").alias("to"),
    )
    merged = {tuple(r[:3]): r for r in summaries.merge_states(parts, ["quantity"]).select(*whole.columns).collect()}
    for r in whole.collect():
        m = merged[tuple(r[:3])]
        assert (m["n"], m["first"], m["last"], m["from"], m["to"]) == (r["n"], r["first"], r["last"], r["from"], r["to"])
        assert (m["mean"], m["m2"]) == (pytest.approx(r["mean"]), pytest.approx(r["m2"], abs=1e-9))


def test_traces_of_selected_markers_and_stability(spark):
    z, y = correlated()
    rows = [("T", k, float(z[:, k] @ y), float(z[:, k] @ z[:, k]), float(y @ y), len(y)) for k in range(8)]
    stats = spark.createDataFrame(rows, "trait string, marker_idx int, wy double, ww double, yy double, n int")
    edges = spark.createDataFrame([(0, 1, 0.7)], "i int, j int, r double")
    fit = samplers.fit_summary(stats, edges, samplers.Model(pi=(0.8, 0.2), trace_markers=(2, 5)), priors.ChainControls(nit=40, nburn=10, nchains=3))
    names = {r[0] for r in fit.traces().select("quantity").distinct().collect()}
    assert {"effect:2", "inclusion:5", "component:1", "probability:0", "vb"} <= names
    states = summaries.trace_states(fit.traces().filter("iteration > 10"), ["quantity"])
    assert summaries.extended_convergence(states, ["quantity"]).count() == len(names)
    comps = fit.rows.filter("quantity like 'component_%' and kind = 'marker'").select("trait", "chain", "marker_idx", F.substring_index("quantity", "_", -1).cast("int").alias("component"), F.col("value").alias("prob"))
    one, worst = summaries.component_stability(comps, 3)
    w = worst.orderBy("rank").toPandas()
    assert one.first()["m"] == 8 and len(w) == 3 and w["pip_range"].is_monotonic_decreasing and one.first()["max_pip_range"] == w["pip_range"].iloc[0]


# User hooks and marker-major rows


def test_provider_equals_the_panel(spark):
    rng = np.random.default_rng(1)
    g = rng.integers(-1, 3, (30, 11))
    names = [f"m{k}" for k in range(11)]

    def fetch(wanted):
        # In another order than asked for.
        back = sorted(wanted, reverse=True)
        return back, np.array([g[:, names.index(n)] for n in back], float)

    rows = provider_panel(spark, fetch, names, chunk=4)
    got = rows.orderBy("marker_idx").collect()
    assert [r["marker_id"] for r in got] == names and [[-1 if x is None else x for x in r["dosages"]] for r in got] == g.T.tolist()
    traits = spark.createDataFrame([(k, t, int(v)) for t in ("A", "B") for k, v in enumerate(rng.integers(-9, 9, 30)) if (k, t) != (3, "B")], "sample_idx bigint, trait string, y bigint")
    panel = spark.createDataFrame([(k, [None if x < 0 else int(x) for x in row]) for k, row in enumerate(g)], "sample_idx bigint, dosages array<int>")
    key = lambda d: sorted((r["trait"], r["marker_idx"], *(round(r[c], 6) for c in d.columns[2:])) for r in d.collect())
    for stripe in (4, 8192):
        genotypes.STRIPE = stripe
        for scale in (True, False):
            assert key(genotypes.marker_major_stats(rows, traits, scale)) == key(genotypes.summary_stats(panel, traits, scale))
        sums = genotypes.marker_major_sums(rows, traits, stripe)
        assert sums.count() == 22 and sums.agg(F.max("size")).first()[0] == 30
    assert key(genotypes.marker_major_gwas(rows, traits)) == key(genotypes.marginal_gwas(panel, traits))


@pytest.mark.parametrize("wrong", [lambda w: (w[:-1], np.zeros((len(w) - 1, 3))), lambda w: ([w[0]] * len(w), np.zeros((len(w), 3)))])
def test_provider_of_other_markers(spark, wrong):
    with pytest.raises(Exception, match="other markers"):
        provider_panel(spark, wrong, ["a", "b"], name="wrong_provider").collect()
    with pytest.raises(ValueError, match="once each"):
        provider_panel(spark, wrong, ["a", "a"])


class Halves:
    """A user's prior: the first half of the markers is likelier."""

    def start(self, m):
        p = np.where(np.arange(m) < m // 2, 0.4, 0.1)
        return np.column_stack([1 - p, p]), np.ones(m)

    def update(self, rng, comp, b, vb):
        return self.start(len(b))


def test_user_priors():
    z, y = correlated()
    op, _ = csr_of(z, y)
    controls = priors.ChainControls(nit=50, nburn=10)
    rows, _ = Halves().start(8)
    outs = [
        samplers.sample(csr_of(z, y)[0], float(y @ y), len(y), samplers.Model(pi=(0.75, 0.25), policy=policy, extra=extra), controls, 4)
        for policy, extra in (("custom", {"prior": Halves()}), ("fixed_marker", {"marker_pi": rows}))
    ]
    assert np.allclose(outs[0]["pip"], outs[1]["pip"]) and np.allclose(outs[0]["effect"], outs[1]["effect"])
    bad = Halves()
    bad.start = lambda m: (np.ones((m, 2)), np.ones(m))
    with pytest.raises(ValueError, match="add up to 1"):
        samplers.sample(op, 1.0, 10.0, samplers.Model(pi=(0.75, 0.25), policy="custom", extra={"prior": bad}), controls, 4)


# Replica exchange


@pytest.mark.parametrize("kind", ["csr", "genotypes"])
def test_tempered_chain_keeps_the_posterior(kind):
    """The replica at coupling 1 has the inclusion probabilities of an enumeration with its own prior; exchanges happen both ways."""
    z, y = correlated(m=6, rho=0.8)
    op, xtx = csr_of(z, y)
    op = op if kind == "csr" else samplers.GenotypeOperator(z, y)
    a = np.column_stack([np.ones(6), np.arange(6) % 2])
    extra = {"annotations": a, "coefficients": [[-0.8], [1.2]], "alpha0": np.array([-0.3]), "fixed": True}
    model = samplers.Model(pi=(0.7, 0.3), vb=0.05, ve=1.0, adj_e=0.0, update_vb=False, update_ve=False, policy="probit_stick", extra=extra)
    nit = 5000 if kind == "csr" else 2500
    out = tempering.sample_tempered(op, float(y @ y), len(y), model, priors.ChainControls(nit=nit, nburn=200), 3, swap_every=1)
    p = samplers._phi(a @ np.array([-0.8, 1.2]))
    logs = np.zeros(64)
    for state in range(64):
        on = [k for k in range(6) if state >> k & 1]
        logs[state] = sum(np.log(p[k]) if k in on else np.log1p(-p[k]) for k in range(6))
        if on:
            q = xtx[np.ix_(on, on)] + np.eye(len(on)) / 0.05
            u = (z.T @ y)[on]
            logs[state] += 0.5 * u @ np.linalg.solve(q, u) - 0.5 * np.linalg.slogdet(q)[1] - 0.5 * len(on) * np.log(0.05)
    w = np.exp(logs - logs.max())
    want = [w[[s for s in range(64) if s >> k & 1]].sum() / w.sum() for k in range(6)]
    assert np.abs(out["pip"] - want).max() < (0.04 if kind == "csr" else 0.06)
    rate = np.mean([s[-1] for s in out["swaps"]])
    assert 0.2 < rate < 1 and {s[1] for s in out["swaps"]} == {0, 1}
    assert [r["prior"].coupling for r in out["replicas"]] == [0.0, 0.5, 1.0]


def test_exchange_terms(spark):
    rng = np.random.default_rng(2)
    a = np.column_stack([np.ones(40), rng.standard_normal(40)])
    alpha = [rng.normal(0, 0.7, (2, 2)) for _ in range(3)]
    comps = rng.integers(0, 3, (3, 40))
    parts = []
    for slot in range(3):
        rows = {}
        for c in range(3):
            p = samplers.Prior(samplers.Model(gamma=(0.0, 0.1, 1.0), pi=(0.8, 0.1, 0.1), policy="probit_stick", extra={"annotations": a, "coefficients": alpha[slot], "alpha0": np.array([-0.5, 0.1]), "coupling": tempering.COUPLINGS[c]}), 40)
            rows[c] = tempering.log_target(p, comps[slot])
        parts.append(rows)
    want = {k: parts[k][k + 1] + parts[k + 1][k] - parts[k][k] - parts[k + 1][k + 1] for k in range(2)}
    c = spark.createDataFrame([(r, k, int(x)) for r in range(3) for k, x in enumerate(comps[r])], "replica int, marker_idx int, component int")
    ann = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(a)], "marker_idx int, a array<double>")
    got = {r["lower"]: r["log_ratio"] for r in tempering.exchange_terms(c, ann, alpha, baseline=(-0.5, 0.1)).collect()}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


def test_tempered_fit_of_the_panel(spark):
    rng = np.random.default_rng(4)
    g = rng.integers(0, 3, (120, 8))
    y = 1.2 * g[:, 3] + rng.standard_normal(120)
    panel = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(g)], "sample_idx bigint, dosages array<int>")
    traits = spark.createDataFrame([(k, "T", float(v - y.mean())) for k, v in enumerate(y)], "sample_idx bigint, trait string, y double")
    model = samplers.Model(pi=(0.8, 0.2), policy="probit_stick", extra={"annotations": np.column_stack([np.ones(8), np.arange(8) == 3])})
    rows = tempering.fit_tempered(panel, traits, model, priors.ChainControls(nit=40, nburn=20, nchains=2)).toPandas()
    pip = rows[rows["quantity"] == "pip"].groupby("marker_idx")["value"].mean()
    assert pip.idxmax() == 3 and pip[3] > 0.9 and (rows["kind"] == "swap").sum() == 2 * 12 * 3


# Inputs and checks


def test_aligned_annotations(spark):
    rows = [(f"m{k}", name, float(v)) for k in range(6) for name, v in (("size", k * k), ("even", k % 2))]
    notes = spark.createDataFrame(rows + [("other", "size", 3.0), ("other", "even", 1.0)], "marker_id string, annotation string, value double")
    fitted = spark.createDataFrame([(0, "m4"), (1, "m1"), (2, "m5")], "marker_idx int, marker_id string")
    got = {r["marker_idx"]: r["a"] for r in priors.align_annotations(notes, fitted).collect()}
    size = np.array([16.0, 1.0, 25.0])
    want = np.column_stack([np.ones(3), [0, 1, 1], (size - size.mean()) / size.std(ddof=1)])
    assert np.allclose([got[k] for k in range(3)], want)
    plain = priors.align_annotations(notes, fitted, add_intercept=False, standardize=False, center_binary=True).orderBy("marker_idx").first()["a"]
    assert plain == pytest.approx([-2 / 3, 16.0])
    bad = [
        (notes.filter("marker_id <> 'm5' or annotation = 'size'"), fitted, "without an annotation"),
        (notes.unionByName(notes.limit(1)), fitted, "once each"),
        (notes, fitted.unionByName(spark.createDataFrame([(3, "m1")], fitted.schema)), "once each"),
        (notes, spark.createDataFrame([(0, "")], fitted.schema), "once each"),
        (notes, spark.createDataFrame([(0, "m1"), (1, "m3")], fitted.schema), "without variation"),
    ]
    for a, m, why in bad:
        with pytest.raises(ValueError, match=why):
            priors.align_annotations(a, m)


def test_intercept_priors():
    gamma, pi = [0.0, 0.1, 1.0], [0.7, 0.2, 0.1]
    mean, precision = priors.intercepts(gamma, pi, variance=2.0)
    assert np.allclose(selection.stick_rows(np.ones((1, 1)), np.array([mean])), [pi], atol=1e-9) and precision == [0.5, 0.5]
    assert priors.intercepts(gamma, pi, "standard") == ([0.0, 0.0], [1.0, 1.0]) and priors.intercepts(gamma, pi, "flat")[1] == [0.0, 0.0]
    for wrong in ({"form": "other"}, {"variance": 0.0}):
        with pytest.raises(ValueError):
            priors.intercepts(gamma, pi, **wrong)


def test_covariances(spark):
    named = {"good": [[2, 1], [1, 2]], "flat": [[1, 1], [1, 1]], "skew": [[1, 0.5], [0.2, 1]], "nan": [[1, 0], [0, np.nan]], "short": [[1, 0]]}
    rows = [(n, i, j, float(x)) for n, v in named.items() for i, r in enumerate(v) for j, x in enumerate(r)]
    d = spark.createDataFrame(rows, "name string, i int, j int, value double")
    got = {r["name"]: r["message"] for r in controls.validate_covariances(d).collect()}
    assert got == {"good": "", "flat": "not positive definite", "skew": "not symmetric", "nan": "entries are not finite", "short": "entries are missing or repeated"}


def test_consistency_of_a_fit(spark):
    z, y = correlated()
    rows = [("T", k, float(z[:, k] @ y), float(z[:, k] @ z[:, k]), float(y @ y), len(y)) for k in range(8)]
    stats = spark.createDataFrame(rows, "trait string, marker_idx int, wy double, ww double, yy double, n int")
    fit = samplers.fit_summary(stats, spark.createDataFrame([(0, 1, 0.7)], "i int, j int, r double"), samplers.Model(pi=(0.8, 0.2)), priors.ChainControls(nit=10, nburn=5, nchains=2))
    fit.rows = fit.rows.cache()
    assert {r["ok"] for r in summaries.fit_consistency(fit, 8).collect()} == {True}
    whole = fit.rows

    def failed(rows, markers=8):
        fit.rows = rows
        return {r["check"] for r in summaries.fit_consistency(fit, markers).collect() if not r["ok"]}

    v, q = F.col("value"), F.col("quantity")
    one = (F.col("marker_idx") == 3) & (F.col("chain") == 1)
    assert failed(whole, 9) == {"markers"}
    assert failed(whole.filter("chain = 0")) == {"chains"}
    assert failed(whole.filter("iteration <> 4")) == {"iterations"}
    assert failed(whole.withColumn("value", F.when((q == "effect") & one, float("nan")).otherwise(v))) >= {"finite"}
    assert failed(whole.withColumn("value", F.when((q == "pip") & one, 1.5).otherwise(v))) == {"range", "pip_of_components"}
    assert failed(whole.withColumn("value", F.when((q == "component_1") & one, 0.5 + v).otherwise(v))) == {"simplex"}
    assert failed(whole.withColumn("value", F.when((q == "ve") & (F.col("iteration") == 2), -1.0).otherwise(v))) == {"positive"}
    assert failed(whole.withColumn("value", F.when((q == "vg") & (F.col("iteration") == 2), 9.0).otherwise(v))) == {"parts"}


def test_simulation_on_given_genotypes(spark):
    rng = np.random.default_rng(3)
    g = rng.integers(0, 3, (300, 12))
    panel = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(g)], "sample_idx bigint, dosages array<int>")
    rows, b = simulate.simulate_on(panel, n_causal=3, h2=0.5, seed=4)
    d = rows.toPandas()
    assert (b != 0).any(1).sum() == 3 and d["g"].std() == pytest.approx(1) and (d["y"] - d["g"] - d["e"]).abs().max() < 1e-12
    design = np.column_stack([np.ones(300), g])
    fit = design @ np.linalg.lstsq(design, d.sort_values("sample_idx")["g"].to_numpy(), rcond=None)[0]
    assert np.allclose(fit, d.sort_values("sample_idx")["g"])


def test_rank_rhat_ranks_by_slices(spark):
    """Every window of the ranks is over a slice of a group's values, or over its slices; ties, a lone value and an outlier included."""
    rows = [("a", k % 2, k // 2, float(v)) for k, v in enumerate([1, 1, 2, 5, 5, 5, 7, 1e6])] + [("b", k % 2, k // 2, (k * 7 % 5) / 4) for k in range(40)]
    d = spark.createDataFrame(rows, "quantity string, chain int, iteration bigint, value double")
    out = summaries.rank_rhat(d, ["quantity"])
    windows = [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in line]
    assert windows and all("slice" in line for line in windows)
    x = {q: [r[3] for r in rows if r[0] == q] for q in ("a", "b")}
    cells = d.groupBy("quantity", d["value"].alias("x")).count().withColumnRenamed("count", "n")
    for r in summaries._below(cells, ["quantity"]).collect():
        mine = x[r["quantity"]]
        assert (r["below"], r["total"], r["n"]) == (sum(v < r["x"] for v in mine), len(mine), mine.count(r["x"]))
    assert {r["quantity"]: r["median"] for r in summaries._medians(d, ["quantity"]).collect()} == {"a": 5.0, "b": 0.5}
    assert {r["quantity"] for r in out.collect()} == {"a", "b"}
