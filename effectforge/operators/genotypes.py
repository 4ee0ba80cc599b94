"""Dosage tables, allele frequencies and sufficient statistics.

Genotypes are sample-major rows ``(sample_idx, dosages array<int>)``, null for a
missing dosage.  Statistics are sums of integers, combined before the shuffle,
and one closed form on the sums, so results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def embedding_panel(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The test panel: dosages from embeddings cut at -0.1 and 0.1, traits from labels."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    cut = lambda x: F.when(x.cast("double") < -0.1, 0).when(x.cast("double") < 0.1, 1).otherwise(2)
    panel = e.select(F.col("vec_id").alias("sample_idx"), F.transform("embedding", cut).alias("dosages"))
    traits = e.select(
        F.col("vec_id").alias("sample_idx"),
        F.explode(F.create_map(F.lit("T1"), F.col("label"), F.lit("T2"), F.col("label") % 3)).alias("trait", "y"),
    )
    return panel, traits.withColumn("y", F.col("y").cast("bigint"))


def sample_major(genotypes: DataFrame, markers: int) -> DataFrame:
    """Long (marker_idx, sample_idx, dosage) as sample-major rows of ``markers`` entries, null where there is none.

    Of rows that repeat a marker and sample the last one counts.
    """

    def scatter(ids: pa.Array, dosages: pa.Array) -> pa.Array:
        edges = np.asarray(ids.offsets) - ids.offsets[0].as_py()
        table = np.full((len(ids), markers), -1, np.int32)
        table[np.repeat(np.arange(len(ids)), np.diff(edges)), np.asarray(ids.flatten())] = np.asarray(dosages.flatten().fill_null(-1))
        values = pa.array(table.ravel(), mask=table.ravel() < 0)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, table.size + 1, markers), pa.int32()), values)

    one = F.array_sort(F.collect_list(F.struct(F.col("marker_idx").cast("int").alias("m"), F.col("dosage").cast("int").alias("d"))))
    listed = genotypes.groupBy("sample_idx").agg(one.alias("e"))
    return listed.select("sample_idx", F.arrow_udf(scatter, "array<int>")(F.col("e.m"), F.col("e.d")).alias("dosages"))


def marker_sums(panel: DataFrame) -> DataFrame:
    """marker_idx, n observed, sum and sum of squares of the dosages."""
    long = panel.select(F.posexplode("dosages").alias("marker_idx", "g"))
    return long.groupBy("marker_idx").agg(
        F.count("g").alias("n"),
        F.coalesce(F.sum("g"), F.lit(0)).cast("bigint").alias("sum_g"),
        F.coalesce(F.sum(F.col("g") * F.col("g")), F.lit(0)).cast("bigint").alias("sum_gg"),
    )


def allele_freq(panel: DataFrame) -> DataFrame:
    """marker_idx, n, af, maf and heterozygosity; a marker without data has af 0."""
    af = F.when(F.col("n") > 0, F.col("sum_g") / (2.0 * F.col("n"))).otherwise(0.0)
    return marker_sums(panel).select(
        "marker_idx",
        "n",
        F.round(af, 8).alias("af"),
        F.round(F.least(af, 1 - af), 8).alias("maf"),
        F.round(2 * af * (1 - af), 8).alias("het"),
    )


def _cross_sums(values: str):
    """Per batch: integer sums of dosage times trait for each (trait, marker)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, seen = dosage_matrix(b.column(0))
            if not len(g):
                continue
            trait = b.column(1).to_pylist()
            y = np.asarray(b.column(2)).astype(np.int64)
            for t in sorted(set(trait)):
                rows = np.array([x == t for x in trait])
                gy = (g[rows] * y[rows, None]).sum(0)
                oy = (seen[rows] * y[rows, None]).sum(0)
                k = np.arange(g.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t] * len(k)), pa.array(k), pa.array(gy), pa.array(oy)], names=["trait", "marker_idx", "gy", "oy"]
                )

    return run


def dosage_matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Dosages with zeros for missing ones, and which are observed, as int32 matrices."""
    rows = len(column)
    if not rows:
        return np.zeros((0, 0), np.int32), np.zeros((0, 0), np.int32)
    flat = column.flatten()
    seen = (~np.asarray(flat.is_null())).astype(np.int32).reshape(rows, -1)
    return np.asarray(flat.fill_null(0)).astype(np.int32).reshape(rows, -1), seen


def summary_stats(panel: DataFrame, traits: DataFrame, scale: bool = True) -> DataFrame:
    """trait, marker_idx, wy, ww, yy, n: X'y, diag X'X and y'y of a panel.

    With ``scale`` columns are (g - 2p) / sqrt(2p(1-p)), 0 where missing and for
    monomorphic markers; without, raw dosages, 2p where missing.  Samples
    without a trait value or of unknown id fall out; yy is not centred.
    """
    y = traits.filter("y is not null").select("sample_idx", "trait", "y")
    joined = panel.join(y, "sample_idx").select("dosages", "trait", "y")
    sums = joined.mapInArrow(_cross_sums("y"), "trait string, marker_idx int, gy bigint, oy bigint")
    sums = sums.groupBy("trait", "marker_idx").agg(F.sum("gy").alias("gy"), F.sum("oy").alias("oy"))
    totals = y.groupBy("trait").agg(
        F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum("y").alias("sum_y"), F.count("*").alias("n_samples")
    )
    p = F.when(F.col("n") > 0, F.col("sum_g") / (2.0 * F.col("n"))).otherwise(0.0)
    d = sums.join(marker_sums(panel), "marker_idx").join(F.broadcast(totals), "trait").withColumn("p", p)
    s = F.sqrt(2 * F.col("p") * (1 - F.col("p")))
    if scale:
        wy = F.when(s > 0, (F.col("gy") - 2 * F.col("p") * F.col("oy")) / s).otherwise(0.0)
        ww = F.when(s > 0, (F.col("sum_gg") - 4 * F.col("p") * F.col("sum_g") + 4 * F.col("n") * F.col("p") * F.col("p")) / (s * s)).otherwise(0.0)
    else:
        wy = F.col("gy") + 2 * F.col("p") * (F.col("sum_y") - F.col("oy"))
        ww = F.col("sum_gg") + 4 * F.col("p") * F.col("p") * (F.col("n_samples") - F.col("n"))
    return d.select("trait", "marker_idx", F.round(wy, 8).alias("wy"), F.round(ww, 8).alias("ww"), "yy", F.col("n_samples").alias("n"))


def marginal_gwas(panel: DataFrame, traits: DataFrame) -> DataFrame:
    """trait, marker_idx, beta, se, z of single-marker regressions on centred dosages."""
    y = traits.filter("y is not null").select("sample_idx", "trait", "y")
    joined = panel.join(y, "sample_idx").select("dosages", "trait", "y")
    sums = joined.mapInArrow(_cross_sums("y"), "trait string, marker_idx int, gy bigint, oy bigint")
    sums = sums.groupBy("trait", "marker_idx").agg(F.sum("gy").alias("gy"))
    totals = y.groupBy("trait").agg(F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum("y").alias("sy"), F.count("*").alias("n_y"))
    d = sums.join(marker_sums(panel), "marker_idx").join(F.broadcast(totals), "trait")
    n = F.col("n_y").cast("double")
    sxx = F.col("sum_gg") - F.col("sum_g") * F.col("sum_g") / n
    sxy = F.col("gy") - F.col("sum_g") * F.col("sy") / n
    syy = F.col("yy") - F.col("sy") * F.col("sy") / n
    beta = sxy / sxx
    se = F.sqrt((syy - beta * sxy) / (n - 2) / sxx)
    return d.filter(sxx > 0).select(
        "trait", "marker_idx", F.round(beta, 8).alias("beta"), F.round(se, 8).alias("se"), F.round(beta / se, 8).alias("z")
    )


def genetic_score(panel: DataFrame, effects: DataFrame) -> DataFrame:
    """sample_idx and the sum of dosage times effect; missing dosages add nothing.

    Effects (marker_idx, effect) are one number a marker: they become one array, as every
    score needs all of them; its size is that of a sample's dosages.
    """
    last = effects.agg(F.max("marker_idx").alias("m"))
    every = last.select(F.explode(F.sequence(F.lit(0), F.coalesce("m", F.lit(0)).cast("int"))).alias("marker_idx"))
    b = every.join(effects, "marker_idx", "left").agg(F.array_sort(F.collect_list(F.struct("marker_idx", F.coalesce("effect", F.lit(0.0)).alias("e")))).alias("b"))
    b = b.select(F.col("b.e").alias("b"))
    terms = F.zip_with("dosages", "b", lambda g, e: F.coalesce(g * e, F.lit(0.0)))
    return panel.crossJoin(F.broadcast(b)).select("sample_idx", F.aggregate(terms, F.lit(0.0), lambda a, x: a + x).alias("score"))


#: Samples whose dosages and trait values a task takes together, and dosages that are unpacked at once.
STRIPE, UNPACKED = 8192, 1 << 24
PACKED = "stripe int, markers array<int>, dosages binary"
MAJOR = "trait string, marker_idx int, n bigint, sum_g bigint, sum_gg bigint, gy double, oy double, sy double, size bigint"


def _striped(batches: Iterator[pa.RecordBatch], stripe: int) -> Iterator[pa.RecordBatch]:
    """Marker-major rows to rows of ``PACKED``: some markers by one stripe of the samples, a byte a dosage, 3 for missing."""
    for b in batches:
        lo = 0
        while lo < b.num_rows:
            wide = len(b.column(1)[lo]) or 1
            rows = min(max(1, UNPACKED // wide), b.num_rows - lo)
            g, seen = dosage_matrix(b.column(1).slice(lo, rows))
            packed = np.where(seen > 0, g, 3).astype(np.uint8)
            numbers = range(-(-g.shape[1] // stripe))
            ids = pa.array(b.column(0).slice(lo, rows).to_pylist(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(numbers, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(numbers) + 1) * len(ids), pa.int32()), pa.concat_arrays([ids] * len(numbers)) if len(numbers) else ids.slice(0, 0)),
                    pa.array([packed[:, k * stripe : (k + 1) * stripe].tobytes() for k in numbers], pa.binary()),
                ],
                names=["stripe", "markers", "dosages"],
            )
            lo += rows


def transposed(markers: DataFrame) -> DataFrame:
    """Sample-major rows (sample_idx, dosages) of (marker_idx, dosages by sample index); a marker without a row is missing.

    Stripes of samples are shuffled, a byte a dosage; a task fills the rows of one stripe at a
    time, of as many samples as 64 MB hold.
    """
    m = int((markers.agg(F.max("marker_idx")).first()[0] or 0) + 1)
    stripe = min(1024, max(1, (1 << 26) // m))

    def rows(number: int, table: np.ndarray) -> pa.RecordBatch:
        flat = pa.array(table.ravel().astype(np.int32), mask=table.ravel() == 3)
        ids = pa.array(number * stripe + np.arange(len(table)), pa.int64())
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1) * m, pa.int32()), flat)], names=["sample_idx", "dosages"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, table = -1, None
        for b in batches:
            for k, ids, raw in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                part = np.frombuffer(raw, np.uint8).reshape(len(ids), -1)
                if k != number:
                    if table is not None:
                        yield rows(number, table)
                    number, table = k, np.full((part.shape[1], m), 3, np.uint8)
                table[:, ids] = part.T
        if table is not None:
            yield rows(number, table)

    packed = markers.select(F.col("marker_idx").cast("int").alias("marker_idx"), "dosages").mapInArrow(lambda b: _striped(b, stripe), PACKED)
    return packed.repartition("stripe").sortWithinPartitions("stripe").mapInArrow(fill, "sample_idx bigint, dosages array<int>")


def _stripe_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``PACKED`` with their trait values to sums of each marker and (trait, marker) over the stripe."""
    for b in batches:
        for ids, raw, values in zip(*(b.column(c).to_pylist() for c in ("markers", "dosages", "values")), strict=True):
            packed = np.frombuffer(raw, np.uint8).reshape(len(ids), -1)
            seen = (packed < 3).astype(np.int64)
            g, none = packed * seen, [None] * len(ids)
            blank = [none] * 4
            rows = [([None] * len(ids), ids, seen.sum(1), g.sum(1), (g * g).sum(1), *blank)]
            for v in values or ():
                at, y = np.asarray(v["at"], int), np.asarray(v["y"], float)
                at, y = at[at < g.shape[1]], y[at < g.shape[1]]
                rows.append(([v["trait"]] * len(ids), ids, none, none, none, g[:, at] @ y, seen[:, at] @ y, np.full(len(ids), y.sum()), np.full(len(ids), len(at))))
            for row in rows:
                kinds = [pa.string(), pa.int32(), *[pa.int64()] * 3, *[pa.float64()] * 3, pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names=[f.split()[0] for f in MAJOR.split(", ")])


def marker_major_sums(markers: DataFrame, traits: DataFrame, stripe: int = STRIPE) -> DataFrame:
    """trait, marker_idx, n, sum_g, sum_gg, gy, oy, sy, size of (marker_idx, dosages by sample index) and (sample_idx, trait, y).

    Samples go in stripes: a task joins the dosages of some markers for one stripe with the trait
    values of that stripe, so it holds neither all samples nor all traits.  Trait values are sent to
    as many parts of a stripe as keep all tasks busy, and Spark broadcasts them where they are few.
    """
    y = traits.filter("y is not null").select("sample_idx", "trait", F.col("y").cast("double").alias("y"))
    one = F.array_sort(F.collect_list(F.struct("at", "y")))
    y = y.select(F.floor(F.col("sample_idx") / stripe).cast("int").alias("stripe"), F.pmod("sample_idx", F.lit(stripe)).cast("int").alias("at"), "trait", "y")
    y = y.groupBy("stripe", "trait").agg(one.alias("v")).select("stripe", F.struct("trait", F.col("v.at").alias("at"), F.col("v.y").alias("y")).alias("t"))
    y = y.groupBy("stripe").agg(F.collect_list("t").alias("values"))
    last = traits.agg(F.max("sample_idx")).first()[0] or 0
    salts = -(-int(markers.sparkSession.conf.get("spark.sql.shuffle.partitions")) // (int(last) // stripe + 1))
    packed = markers.select(F.col("marker_idx").cast("int").alias("marker_idx"), "dosages").mapInArrow(lambda b: _striped(b, stripe), PACKED)
    packed = packed.withColumn("salt", F.pmod(F.xxhash64(F.col("markers")[0]), F.lit(salts)))
    y = y.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    sums = packed.join(y, ["stripe", "salt"], "left").select("markers", "dosages", "values").mapInArrow(_stripe_sums, MAJOR)
    sums = sums.groupBy("trait", "marker_idx").agg(*[F.sum(c).alias(c) for c in ("n", "sum_g", "sum_gg", "gy", "oy", "sy", "size")])
    each = sums.filter("trait is null").select("marker_idx", "n", "sum_g", "sum_gg")
    return sums.filter("trait is not null").drop("n", "sum_g", "sum_gg").join(each, "marker_idx")


def _trait_totals(traits: DataFrame) -> DataFrame:
    y = traits.filter("y is not null")
    return y.groupBy("trait").agg(F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum("y").alias("sum_y"), F.count("*").alias("n_y"))


def marker_major_stats(markers: DataFrame, traits: DataFrame, scale: bool = True) -> DataFrame:
    """trait, marker_idx, wy, ww, yy, n as :func:`summary_stats`, from (marker_idx, dosages by sample index) without a transpose."""
    d = marker_major_sums(markers, traits)
    p = F.when(F.col("n") > 0, F.col("sum_g") / (2.0 * F.col("n"))).otherwise(0.0)
    s = F.sqrt(2 * p * (1 - p))
    if scale:
        wy = F.when(s > 0, (F.col("gy") - 2 * p * F.col("oy")) / s).otherwise(0.0)
        ww = F.when(s > 0, (F.col("sum_gg") - 4 * p * F.col("sum_g") + 4 * F.col("n") * p * p) / (s * s)).otherwise(0.0)
    else:
        wy = F.col("gy") + 2 * p * (F.col("sy") - F.col("oy"))
        ww = F.col("sum_gg") + 4 * p * p * (F.col("size") - F.col("n"))
    d = d.select("trait", "marker_idx", F.round(wy, 8).alias("wy"), F.round(ww, 8).alias("ww"))
    return d.join(F.broadcast(_trait_totals(traits)), "trait").select("trait", "marker_idx", "wy", "ww", "yy", F.col("n_y").alias("n"))


def marker_major_gwas(markers: DataFrame, traits: DataFrame) -> DataFrame:
    """trait, marker_idx, beta, se, z as :func:`marginal_gwas`, from marker-major rows by stripes of samples."""
    d = marker_major_sums(markers, traits).join(F.broadcast(_trait_totals(traits)), "trait")
    n = F.col("n_y").cast("double")
    sxx = F.col("sum_gg") - F.col("sum_g") * F.col("sum_g") / n
    sxy = F.col("gy") - F.col("sum_g") * F.col("sum_y") / n
    syy = F.col("yy") - F.col("sum_y") * F.col("sum_y") / n
    beta = sxy / sxx
    se = F.sqrt((syy - beta * sxy) / (n - 2) / sxx)
    return d.filter(sxx > 0).select("trait", "marker_idx", F.round(beta, 8).alias("beta"), F.round(se, 8).alias("se"), F.round(beta / se, 8).alias("z"))
