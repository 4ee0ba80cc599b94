"""LD by reach and stripes, providers with LD of their own, and sweeps over blocks, against brute force."""

import numpy as np
import pytest

from effectforge.operators import blocks, ld, multitrait, priors, samplers


def panel_of(spark, g, parts=3):
    rows = [(k, [None if x < 0 else int(x) for x in row]) for k, row in enumerate(g)]
    return spark.createDataFrame(rows, "sample_idx bigint, dosages array<int>").repartition(parts)


def correlations(g):
    """r of all pairs with missing dosages (-1) at their marker's mean."""
    seen = g >= 0
    p = np.where(seen, g, 0).sum(0) / (2.0 * seen.sum(0))
    z = np.where(seen, g - 2 * p, 0.0)
    xx = np.square(z).sum(0)
    return (z.T @ z) / np.sqrt(np.outer(xx, xx))


@pytest.mark.parametrize(("tile", "span", "parallel"), [(4, 5, "3"), (512, 4096, "4"), (7, 100, "1")])
def test_ld_in_parts_and_stripes(spark, tile, span, parallel):
    rng = np.random.default_rng(2)
    g = rng.integers(-1, 3, (90, 23))
    r = correlations(g)
    chrs, pos = np.sort(rng.integers(0, 3, 23)), np.zeros(23, int)
    for c in range(3):
        pos[chrs == c] = np.sort(rng.integers(0, 100, (chrs == c).sum()))
    where = spark.createDataFrame([(k, int(c), int(x)) for k, (c, x) in enumerate(zip(chrs, pos, strict=True))], "marker_idx int, chr int, pos bigint")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parallel)
    try:
        for window, bp, same in ((6, 0, False), (0, 20, False), (0, 20, True), (9, 30, True), (0, 0, True)):
            got = ld.ld_edges(panel_of(spark, g), max_distance_variants=window, r2_threshold=0.0, positions=where, max_distance_bp=bp, same_chr=same, allow_full=True, tile=tile, span=span)
            want = {
                (i, j): pytest.approx(r[i, j], abs=2e-8)
                for i in range(23)
                for j in range(i + 1, 23)
                if (not window or j - i <= window) and (not bp or pos[j] - pos[i] <= bp) and (not same or chrs[i] == chrs[j])
            }
            assert {(x["i"], x["j"]): x["r"] for x in got.collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_reach_is_linear(spark):
    """A base-pair window alone takes the tiles in reach, not all of them."""
    where = spark.range(40_000).selectExpr("cast(id as int) marker_idx", "cast(id % 2 as int) chr", "id * 1000 pos")
    ends = ld.tile_ends(40_000, 0, 512, where.selectExpr("marker_idx", "0 chr", "pos"), 5000)
    assert (ends - np.arange(1, len(ends) + 1) * 512 <= 512).all() and ends[-1] == 40_000
    assert ld.tile_ends(40_000, 0, 512)[0] == 40_000
    assert ld.tile_ends(100, 5, 10).tolist() == [15, 25, 35, 45, 55, 65, 75, 85, 95, 100]


def test_pair_audit_in_passes(spark, monkeypatch):
    g = np.random.default_rng(5).integers(-1, 3, (60, 9))
    pairs = spark.createDataFrame([(0, 3), (2, 8), (2, 8), (1, 4), (5, 6)], "i int, j int")
    monkeypatch.setattr(ld, "PAIRS", 2)
    got = {(x["i"], x["j"]): x["r"] for x in ld.pair_check(panel_of(spark, g), pairs).collect()}
    r = correlations(g)
    assert got == {k: pytest.approx(r[k], abs=1e-7) for k in ((0, 3), (2, 8), (1, 4), (5, 6))}


def summaries_of(spark, z, ys):
    """Statistics and edges of genotypes and traits, and X'X."""
    xtx = z.T @ z
    ww = np.diag(xtx)
    stats = [(t, k, float(z[:, k] @ y), float(ww[k]), float(y @ y), len(y)) for t, y in ys.items() for k in range(z.shape[1])]
    i, j = np.triu_indices(z.shape[1], 1)
    edges = [(int(a), int(b), float(xtx[a, b] / np.sqrt(ww[a] * ww[b]))) for a, b in zip(i, j, strict=True)]
    return spark.createDataFrame(stats, "trait string, marker_idx int, wy double, ww double, yy double, n int"), edges, xtx


def test_block_sweeps_sample_the_posterior(spark):
    """Inclusion probabilities of sweeps over blocks are those of an enumeration of all states; reruns agree."""
    rng = np.random.default_rng(3)
    n, m = 120, 6
    z = rng.standard_normal((n, m))
    for k in range(1, m):
        z[:, k] = 0.5 * z[:, k - 1] + z[:, k]
    y = 0.25 * z[:, 1] + 0.2 * z[:, 4] + rng.standard_normal(n)
    stats, edges, xtx = summaries_of(spark, z, {"T": y})
    stats, edges = stats.repartition(1), spark.createDataFrame(edges, "i int, j int, r double").repartition(1)
    model = samplers.Model(pi=(0.7, 0.3), vb=0.05, ve=1.0, adj_e=0.0, update_vb=False, update_ve=False, update_pi=False)
    controls = priors.ChainControls(nit=7, nburn=4, nchains=150, seed=5)
    fit = blocks.fit_blocks(stats, edges, model, controls, 3)
    got = fit.posterior().orderBy("marker_idx").toPandas()["pip"].to_numpy()
    want = samplers.brute_force_pips(z.T @ y, np.diag(xtx), xtx, 0.05, 1.0, 0.3)
    assert np.abs(got - want).max() < 0.08 and fit.provenance["colours"] == 2
    assert fit.traces().filter("quantity = 'vg'").count() == 11 * 150


def test_blocks_refuse_other_models(spark):
    with pytest.raises(ValueError, match="blocks in parallel"):
        blocks.fit_blocks(None, None, samplers.Model(policy="group"), priors.ChainControls())


def test_block_sweep_equals_the_operator(spark):
    """A sweep of many markers leaves the residual where all effects at once would."""
    rng = np.random.default_rng(8)
    z = rng.standard_normal((80, 11))
    stats, edges, _ = summaries_of(spark, z, {"A": z[:, 3] + rng.standard_normal(80), "B": rng.standard_normal(80)})
    near = spark.createDataFrame([e for e in edges if e[1] - e[0] <= 4], "i int, j int, r double")
    layout = blocks.block_layout(near, 11, 3)
    assert layout.colours == 3
    tasks = stats.select("trait").distinct().selectExpr("trait", "0 chain")
    effects = spark.createDataFrame([(k, float(x)) for k, x in enumerate(rng.normal(0, 0.2, 11))], "marker_idx int, effect double")
    state = blocks.set_effects(blocks.block_states(stats, tasks, layout), layout, effects).collect()
    b = np.array([r["effect"] for r in effects.orderBy("marker_idx").collect()])
    for trait in "AB":
        s = stats.filter(f"trait = '{trait}'").orderBy("marker_idx").toPandas()
        e = near.toPandas()
        op = samplers.CsrOperator(s["wy"].to_numpy(), s["ww"].to_numpy(), e["i"].to_numpy(int), e["j"].to_numpy(int), e["r"].to_numpy())
        op.set_effects(b)
        mine = np.concatenate([r["res"] for r in sorted(state, key=lambda r: r["block"]) if r["trait"] == trait])
        assert np.allclose(mine, op.residual(), atol=1e-4)


def test_providers_with_their_own_ld(spark):
    """Two providers of one trait with other markers and samples, and one of another trait, find the shared marker."""
    rng = np.random.default_rng(4)
    m, local, edges, providers = 14, [], [], []
    for name, trait, ids, n in (("A", "T1", np.arange(0, 10), 300), ("B", "T1", np.arange(4, 14), 250), ("C", "T2", np.array([1, 3, 6, 7, 12]), 300)):
        z = rng.standard_normal((n, len(ids))) + 0.4 * rng.standard_normal((n, 1)) * (1 + len(name))
        y = 0.6 * z[:, list(ids).index(6)] + rng.standard_normal(n)
        stats, e, _ = summaries_of(spark, z, {trait: y})
        local += [(name, int(ids[r["marker_idx"]]), r["wy"], r["ww"]) for r in stats.collect()]
        edges += [(name, int(ids[i]), int(ids[j]), r) for i, j, r in e]
        providers.append((name, trait, float(y @ y) / n))
    tables = [
        spark.createDataFrame(local, "provider_id string, global_idx int, score double, ww double"),
        spark.createDataFrame(edges, "provider_id string, i int, j int, r double"),
        spark.createDataFrame(providers, "provider_id string, trait string, residual_scale double"),
        spark.range(m).selectExpr("cast(id as int) global_idx"),
    ]
    controls = priors.ChainControls(nit=60, nburn=30, nchains=2, seed=3)
    fit = multitrait.fit_providers(*tables, controls, vb=np.eye(2) * 0.2, vb_df=6.0, vb_scale=np.eye(2) * 0.5).toPandas()
    pip = fit[fit["quantity"] == "pip"].groupby(["trait", "marker_idx"])["value"].mean()
    assert pip["T1", 6] > 0.95 and pip["T2", 6] > 0.95 and pip["T1"].drop(6).max() < 0.7
    effect = fit[fit["quantity"] == "effect"].groupby(["trait", "marker_idx"])["value"].mean()
    assert abs(effect["T1", 6] - 0.6) < 0.15 and abs(effect["T2", 6] - 0.6) < 0.2


def test_provider_set_adds_up():
    """Two providers of the same markers and LD are one of twice the information."""
    rng = np.random.default_rng(6)
    wy, ww, r = rng.normal(size=3) * 20, np.array([50.0, 60.0, 70.0]), np.array([0.3, -0.2])
    i, j = np.array([0, 1]), np.array([1, 2])
    two, one = multitrait.ProviderSet(5, 2), multitrait.ProviderSet(5, 2)
    for _ in range(2):
        two.add(0, 2.0, np.array([1, 2, 4]), wy, ww, np.array([1, 2]), np.array([2, 4]), r)
    one.add(0, 1.0, np.array([1, 2, 4]), wy, ww, np.array([1, 2]), np.array([2, 4]), r)
    b = np.zeros((5, 2))
    b[2, 0] = 0.5
    for s in (two, one):
        s.move(2, b[2])
    assert all(np.allclose(two.scores(k, b[k]), one.scores(k, b[k])) and np.allclose(two.information(k), one.information(k)) for k in range(5))
    assert not two.information(0).any() and not two.scores(3, b[3]).any()
    s = samplers.CsrOperator(wy, ww, i, j, r)
    s.move(1, 0.5)
    assert np.allclose(one.scores(1, b[1])[0], s.score(0, 0.0))
