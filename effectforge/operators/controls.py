"""Plans and checks around a fit: tasks, retention, memory, contracts, frequencies, validation."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from effectforge.operators.priors import ChainControls, task_seed

#: Names of the LD contracts and of how two operators compare.
EXACT, SPARSE, SUPPLIED = "exact_full_csr_v1", "hard_sparse_csr_v1", "supplied_csr_v1"
MODELS = ("bayesc", "sbayesc", "bayesr", "sbayesr")


def task_plan(traits: DataFrame, controls: ChainControls, mode: str = "scalar") -> DataFrame:
    """task_index, task_id, trait, chain, seed: traits in order, the chains of each after one another.

    Traits of a fit are few; seeds are made where they are named.
    """
    names = [r[0] for r in traits.select("trait").distinct().orderBy("trait").collect()]
    rows = [
        (t * controls.nchains + c, f"{mode}:{name}:{c + 1}", name, c, task_seed(controls, mode, name, c))
        for t, name in enumerate(names)
        for c in range(controls.nchains)
    ]
    return traits.sparkSession.createDataFrame(rows, "task_index int, task_id string, trait string, chain int, seed bigint")


def legacy_seeds(tasks: DataFrame, seed: int) -> DataFrame:
    """``tasks`` (trait_index, chain from 0) with the seed of the older rule."""
    return tasks.withColumn("seed", F.lit(seed).cast("bigint") + 1000003 * (F.col("trait_index") + 1) + 9176 * (F.col("chain") + 1))


def retention_plan(spark: SparkSession, controls: ChainControls, legacy: bool = False) -> DataFrame:
    """iteration (from 1, after burn-in), retained and its position among those that are kept.

    Every ``nthin``-th iteration is kept; the older rule starts with the first.
    """
    keep = (F.col("iteration") - 1) % controls.nthin == 0 if legacy else F.col("iteration") % controls.nthin == 0
    place = F.floor((F.col("iteration") - 1) / controls.nthin) + 1 if legacy else F.floor(F.col("iteration") / controls.nthin)
    plan = spark.range(1, controls.nit + 1).select(F.col("id").cast("int").alias("iteration")).withColumn("retained", keep)
    return plan.withColumn("position", F.when(F.col("retained"), place.cast("int")))


def memory_estimate(specs: DataFrame) -> DataFrame:
    """``specs`` with an upper bound in bytes of what each fit holds, by part and in all.

    Columns: m, nt, nchains, ncores, nit, ntrace, quantities (traced for convergence),
    operator_bytes, samples, keep_chains, keep_traces.
    """
    m, nt, chains, nit, ntrace, quantities = (F.col(c).cast("double") for c in ("m", "nt", "nchains", "nit", "ntrace", "quantities"))
    workers = F.least("nchains", "ncores")
    private = 8 * (4 * m * nt + 3 * nt * nt + F.col("samples") * nt)
    result = 8 * (4 * m * nt + 5 * ntrace * nt + 6 * nt * nt)
    capture = 8 * chains * nit * quantities
    workspace = F.when(quantities > 0, 8 * chains * nit * 12).otherwise(0.0)
    compact = F.when(F.col("keep_chains"), result * chains).otherwise(0.0)
    traces = F.when(F.col("keep_traces"), capture).otherwise(0.0)
    total = F.col("operator_bytes") + workers * private + chains * result + capture + workspace + compact + traces + result
    parts = {"private_bytes": private, "result_bytes": result, "capture_bytes": capture, "total_bytes": total}
    return specs.withColumn("workers", workers).withColumns({k: v.cast("double") for k, v in parts.items()})


def operator_contract(metadata: DataFrame) -> DataFrame:
    """``metadata`` (source, r2_threshold, max_distance_variants, max_distance_bp) with the LD's contract and whether it is approximate.

    LD that was built without any limit is exact; with one it is hard sparse; without
    a record of them nothing is known.
    """
    limits = [F.col(c) for c in ("r2_threshold", "max_distance_variants", "max_distance_bp")]
    known = limits[0].isNotNull() & limits[1].isNotNull() & limits[2].isNotNull()
    limited = known & ((limits[0] > 0) | (limits[1] > 0) | (limits[2] > 0))
    complete = known & ~limited & (F.coalesce("source", F.lit("")) == "ld_edges")
    return metadata.withColumn("contract", F.when(complete, EXACT).when(limited, SPARSE).otherwise(SUPPLIED)).withColumn(
        "approximate", F.when(complete, False).when(limited, True)
    )


def reduction_policy(pairs: DataFrame) -> DataFrame:
    """``pairs`` (family, operator_a, operator_b, filtered, residual) with how far two operators' fits compare."""
    both = F.sort_array(F.array("operator_a", "operator_b"))
    blocks = both == F.array(F.lit("block_eigen"), F.lit("csr"))
    packed = both == F.array(F.lit("csr"), F.lit("packed_bed"))
    joint = (F.col("family") == "joint") & (F.col("residual") == "full")
    return pairs.withColumn(
        "policy",
        F.when(blocks & F.col("filtered"), "approximate_filtered_operator")
        .when(blocks, "floating_point_equivalent")
        .when(packed & joint, "not_comparable_residual_covariance")
        .when(packed, "comparable_when_likelihood_contracts_match")
        .otherwise("not_comparable_operator_contract"),
    )


def effect_maf(markers: DataFrame, allow_reference: bool = False) -> DataFrame:
    """marker_idx, maf and its source, for all markers alike: given, of the GWAS, of the analysis, of the reference panel.

    ``markers`` has marker_idx and explicit_maf, gwas_af, analysis_maf, reference_maf, null
    where unknown.  The first source that has every marker is taken, the reference panel
    only if it is allowed; values are in (0, 0.5].  Without one it is an error.
    """
    gwas = F.least(F.col("gwas_af"), 1 - F.col("gwas_af"))
    sources = {"explicit": F.col("explicit_maf"), "gwas_summary": gwas, "analysis_genotypes": F.col("analysis_maf")}
    if allow_reference:
        sources["reference_panel"] = F.col("reference_maf")
    whole = markers.agg(*[F.count(F.when(~((c > 0) & (c <= 0.5)) | c.isNull(), 1)).alias(k) for k, c in sources.items()]).first()
    for name, value in sources.items():
        if whole[name] == 0:
            return markers.select("marker_idx", F.round(value, 10).alias("maf"), F.lit(name).alias("source"))
    raise ValueError(f"no allele frequencies for every marker among {list(sources)}")


def resolve_markers(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """chr, marker_id, marker_idx, bed_column of the ``wanted`` ids (marker_id), in catalogue order; an unknown id is an error."""
    found = wanted.select("marker_id").distinct().join(catalog, "marker_id", "left")
    missing = [r[0] for r in found.filter("marker_idx is null").select("marker_id").orderBy("marker_id").take(5)]
    if missing:
        raise ValueError(f"markers that the catalogue does not know: {missing}")
    return found.select("chr", "marker_id", "marker_idx", "bed_column")


def frequencies_differ(first: DataFrame, second: DataFrame) -> DataFrame:
    """marker_id and where it is: in one catalogue only, or in both with other alleles."""
    ids = lambda d: d.select("marker_id")
    only = lambda a, b, name: ids(a).exceptAll(ids(b)).withColumn("problem", F.lit(name))
    both = ids(first).intersect(ids(second)).join(first, "marker_id").join(second.select("marker_id", F.col("alleles").alias("other")), "marker_id")
    return only(first, second, "first_only").unionByName(only(second, first, "second_only")).unionByName(
        both.filter("alleles <> other").select("marker_id", F.lit("alleles").alias("problem"))
    )


def _rows(spark: SparkSession, checks: Iterable[tuple[str, bool, str]]) -> DataFrame:
    return spark.createDataFrame([(c, bool(ok), "" if ok else why) for c, ok, why in checks], "check string, ok boolean, message string")


def validate_spec(spark: SparkSession, spec: dict) -> DataFrame:
    """check, ok, message of a resolved fit: what a fit needs before any data is read."""
    gamma, pi = spec.get("gamma", ()), spec.get("pi", ())
    number = lambda k: isinstance(spec.get(k), int | float) and not isinstance(spec.get(k), bool)
    return _rows(
        spark,
        [
            ("model", spec.get("model") in MODELS, f"model is one of {MODELS}"),
            ("null_component", bool(gamma) and gamma[0] == 0, "the first component has variance 0"),
            ("components", len(gamma) == len(pi) and all(g > 0 for g in gamma[1:]), "a positive variance and a probability for each component"),
            ("simplex", bool(pi) and min(pi) >= 0 and abs(sum(pi) - 1) < 1e-8, "probabilities add up to 1"),
            ("degrees_of_freedom", all(number(k) and spec[k] > 2 for k in ("nub", "nue")), "nub and nue are above 2"),
            ("heritability", number("h2") and 0 < spec["h2"] < 1, "h2 is between 0 and 1"),
            ("iterations", all(isinstance(spec.get(k), int) and spec[k] >= 1 for k in ("nit", "nthin", "nchains")), "nit, nthin and nchains are 1 or more"),
        ],
    )


def validate_components(components: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """trait, markers, components, ok: whether the component probabilities of every marker are a simplex on the same axes.

    ``components`` has trait, marker_idx, component, prob.
    """
    per = components.groupBy("trait", "marker_idx").agg(
        F.count("*").alias("k"), F.count_distinct("component").alias("kinds"), F.min("prob").alias("least"), F.sum("prob").alias("total")
    )
    good = (F.col("k") == F.col("kinds")) & (F.col("least") >= -tolerance) & (F.abs(F.col("total") - 1) <= tolerance)
    return per.groupBy("trait").agg(
        F.count("*").alias("markers"), F.max("k").alias("components"), (F.min(F.coalesce(good, F.lit(False))) & (F.min("k") == F.max("k"))).alias("ok")
    )


def validate_covariances(entries: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """name, size, ok, message of covariance matrices (name, i, j, value): complete, finite, symmetric and positive definite.

    Matrices are of traits, a few rows each; one matrix is one group.
    """

    def task(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        size = int(max(part["i"].max(), part["j"].max())) + 1
        v = np.full((size, size), np.nan)
        v[part["i"].to_numpy(int), part["j"].to_numpy(int)] = part["value"].to_numpy(float)
        if len(part) != size * size or part.duplicated(["i", "j"]).any():
            why = "entries are missing or repeated"
        elif not np.isfinite(v).all():
            why = "entries are not finite"
        elif np.abs(v - v.T).max() > tolerance * max(1.0, np.abs(v).max()):
            why = "not symmetric"
        else:
            why = "" if np.linalg.eigvalsh((v + v.T) / 2).min() > tolerance * np.abs(v).max() else "not positive definite"
        return pd.DataFrame({"name": [key[0]], "size": [size], "ok": [not why], "message": [why]})

    return entries.groupBy("name").applyInPandas(task, "name string, size int, ok boolean, message string")


def report(checks: DataFrame) -> str:
    """A table of checks (check, ok, message) as text, failures first."""
    rows = checks.orderBy("ok", "check").collect()
    failed = sum(not r["ok"] for r in rows)
    lines = [f"{len(rows)} checks, {failed} failed"] + [f"  {'ok  ' if r['ok'] else 'FAIL'} {r['check']}{': ' + r['message'] if r['message'] else ''}" for r in rows]
    return "\n".join(lines)


def first_order(column: str, order: Column) -> Column:
    """Numbers from 0 of the values of ``column`` in the order in which they first come."""
    first = F.min(order).over(Window.partitionBy(column))
    return (F.dense_rank().over(Window.orderBy(first)) - 1).cast("int")
