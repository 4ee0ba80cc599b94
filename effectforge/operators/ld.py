"""Linkage disequilibrium: banded edges and the operators on them.

Edges are ``(i, j, r)`` with i < j and an implicit unit diagonal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from effectforge.operators.genotypes import dosage_matrix, marker_sums

EDGES = "i int, j int, r double"
#: Markers whose pairs one tile has; markers after them that it takes together; samples of a row that is shuffled, and dosages that are unpacked at once, all at most.
TILE, SPAN, ROWS, UNPACKED = 512, 4096, 1024, 1 << 24
#: Pairs that one pass of an audit lists, and tiles whose reach the driver may hold.
PAIRS, TILES = 1 << 19, 1 << 20
PACKED = "tile int, part int, stripe int, samples int, dosages binary"
SUMS = "tile int, part int, own int, sums binary"


def _parts(number: int, ends: np.ndarray, tile: int, span: int) -> list[tuple[int, int]]:
    """Marker ranges after a tile's own that its parts hold; the first part holds the tile's own pairs too."""
    first, end = min((number + 1) * tile, int(ends[number])), int(ends[number])
    return [(a, min(a + span, end)) for a in range(first, end, span)] or [(first, first)]


def _tiles(ends: np.ndarray, m: int, tile: int, span: int, stripes: int):
    """Batches of dosage rows to rows of ``PACKED``: dosages of a tile's markers and of a part of those in reach, a byte each, 3 for missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = TaskContext.get().partitionId()
        for b in batches:
            for lo in range(0, b.num_rows, max(1, min(ROWS, UNPACKED // m))):
                g, seen = dosage_matrix(b.column(0).slice(lo, max(1, min(ROWS, UNPACKED // m))))
                packed = np.where(seen > 0, g, 3).astype(np.uint8)
                stripe, sent = sent % stripes, sent + 1
                held, size = [], 0
                for k in range(len(ends)):
                    own = packed[:, k * tile : min((k + 1) * tile, m)]
                    for part, (a, z) in enumerate(_parts(k, ends, tile, span)):
                        held.append((k, part, stripe, len(packed), np.hstack([own, packed[:, a:z]]).tobytes()))
                        size += len(held[-1][-1])
                    if size > UNPACKED or k == len(ends) - 1:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), [pa.int32()] * 4 + [pa.binary()], strict=True)], names=["tile", "part", "stripe", "samples", "dosages"])
                        held, size = [], 0

    return run


def _finish(number: int, part: int, sums: np.ndarray, ends: np.ndarray, m: int, tile: int, span: int, window: int, least_r2: float) -> pa.RecordBatch:
    """i, j, r of a tile's part from its sums: g_i g_j, g_i, g_j, n of every pair, and n, g, g^2 of each marker."""
    width = sums.shape[2]
    gg, gi, gj, both = sums[:4]
    own = min((number + 1) * tile, m) - number * tile
    n, sg, sgg = sums[4, :3]
    p = np.where(n > 0, sg / (2.0 * np.maximum(n, 1)), 0.0)
    xx = sgg - 4 * p * sg + 4 * n * p * p
    gg, gi, gj, both = (x[:own] for x in (gg, gi, gj, both))
    cross = gg - 2 * p * gi - 2 * p[:own, None] * gj + 4 * both * p[:own, None] * p
    size = np.sqrt(np.maximum(xx[:own, None] * xx, 0.0))
    r = np.divide(cross, size, out=np.zeros_like(cross), where=size > 0)
    at = np.arange(number * tile, number * tile + own)
    a, _ = _parts(number, ends, tile, span)[part]
    to = np.concatenate([at, np.arange(a, a + width - own)])
    gap = to - at[:, None]
    near = (gap > 0) & (gap <= (window or m)) & (r * r >= least_r2 - 1e-7)
    if part:
        near[:, :own] = False
    i, j = np.nonzero(near)
    return pa.RecordBatch.from_arrays([pa.array(at[i].astype(np.int32)), pa.array(to[j].astype(np.int32)), pa.array(r[i, j])], names=["i", "j", "r"])


def _summed(done):
    """Rows of ``PACKED``, sorted, to what ``done(tile, part, sums)`` makes of the sums over the samples of each part.

    A batch's products are exact in single precision; a part holds four sums for each of
    its pairs, however many samples there are.
    """

    def add(sums: np.ndarray, packed: np.ndarray, own: int) -> None:
        seen = packed < 3
        g, s = np.where(seen, packed, 0).astype(np.float32), seen.astype(np.float32)
        sums[0, :own] += g[:, :own].T @ g
        if seen.all():
            sums[1, :own] += g[:, :own].sum(0)[:, None]
            sums[2, :own] += g.sum(0)
            sums[3, :own] += len(packed)
        else:
            sums[1, :own] += g[:, :own].T @ s
            sums[2, :own] += s[:, :own].T @ g
            sums[3, :own] += s[:, :own].T @ s
        sums[4, :3] += [s.sum(0), g.sum(0), (g * g).sum(0)]

    def run(batches: Iterator[pa.RecordBatch], tile: int, m: int) -> Iterator[pa.RecordBatch]:
        key, sums = None, None
        for b in batches:
            for k, part, stripe, samples, raw in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                packed = np.frombuffer(raw, np.uint8).reshape(samples, -1)
                own = min((k + 1) * tile, m) - k * tile
                if key != (k, part, stripe):
                    if sums is not None:
                        yield done(key[0], key[1], sums)
                    key, sums = (k, part, stripe), np.zeros((5, max(own, 3), packed.shape[1]))
                add(sums, packed, own)
        if sums is not None:
            yield done(key[0], key[1], sums)

    return run


def tile_ends(m: int, window: int, tile: int, positions: DataFrame | None = None, max_distance_bp: int = 0, same_chr: bool = False) -> np.ndarray:
    """For each tile of markers, the end of those that any of its markers may be paired with.

    A window of variants reaches so far after the tile; positions (marker_idx, chr, pos), rising
    within a chromosome, end it at the last tile that begins within ``max_distance_bp`` of
    where the tile ends on a chromosome of both.  One row a tile comes to the driver.
    """
    tiles = -(-m // tile)
    if tiles > TILES:
        raise ValueError(f"{tiles} tiles are more than {TILES}: take larger ones")
    ends = np.minimum(np.arange(1, tiles + 1) * tile + (window if window > 0 else m), m)
    if positions is not None and (max_distance_bp > 0 or same_chr):
        of = F.floor(F.col("marker_idx") / tile).cast("int").alias("tile")
        by = ["chr"] if same_chr else []
        rows = positions.groupBy(of, *by).agg(F.min("pos").alias("low"), F.max("pos").alias("high")).toPandas()
        reach = np.arange(tiles)
        for _, d in rows.groupby("chr") if same_chr else [(None, rows)]:
            d = d.sort_values("tile")
            # The last tile whose lowest position is in reach; where positions rise, this is a search in them.
            low = np.minimum.accumulate(d["low"].to_numpy()[::-1])[::-1]
            last = np.searchsorted(low, d["high"].to_numpy() + max_distance_bp, side="right") - 1 if max_distance_bp > 0 else np.full(len(d), len(d) - 1)
            at = d["tile"].to_numpy()
            reach[at] = np.maximum(reach[at], at[last])
        ends = np.minimum(ends, np.minimum((reach + 1) * tile, m))
    return ends


def ld_edges(
    panel: DataFrame,
    *,
    max_distance_variants: int = 1000,
    r2_threshold: float = 0.001,
    positions: DataFrame | None = None,
    max_distance_bp: int = 0,
    same_chr: bool = False,
    allow_full: bool = False,
    tile: int = TILE,
    span: int = SPAN,
) -> DataFrame:
    """i, j, r for pairs in the window with r squared at the threshold or above.

    Markers go in tiles with those within reach after them, a byte a dosage, so what is
    shuffled is the genotypes once or a few times and not a band of sums from every
    partition; a task sums one part of a tile at a time and gives its edges alone, and a part
    has ``span`` markers after the tile's at most.  A panel of few tiles is summed in stripes of
    its samples by all tasks, and their sums are added.  Positions (marker_idx, chr, pos) serve the
    base-pair limit and ``same_chr``, and end a tile's reach; without any window
    ``allow_full`` is needed.  Undefined correlations are 0.
    """
    if max_distance_variants <= 0 and max_distance_bp <= 0 and not allow_full:
        raise ValueError("both windows are off: pass allow_full=True for all pairs")
    window = max(0, max_distance_variants)
    head = panel.select(F.size("dosages").alias("m")).first()
    if head is None:
        return panel.sparkSession.createDataFrame([], EDGES)
    m = max(head["m"], 1)
    ends = tile_ends(m, window, tile, positions, max_distance_bp, same_chr)
    parts = int(sum(len(_parts(k, ends, tile, span)) for k in range(len(ends))))
    wide = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stripes = 1 if parts >= wide else -(-wide // parts)

    def edges(k: int, part: int, sums: np.ndarray) -> pa.RecordBatch:
        return _finish(k, part, sums, ends, m, tile, span, window, r2_threshold)

    def partial(k: int, part: int, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([sums.shape[1]], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["tile", "part", "own", "sums"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for b in batches:
            for k, part, own, raw in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                sums = np.frombuffer(raw).reshape(5, own, -1)
                if key != (k, part):
                    if total is not None:
                        yield edges(*key, total)
                    key, total = (k, part), np.zeros(sums.shape)
                total += sums
        if total is not None:
            yield edges(*key, total)

    where = ["tile", "part"]
    packed = panel.select("dosages").mapInArrow(_tiles(ends, m, tile, span, stripes), PACKED)
    if stripes == 1:
        d = packed.repartition(*where).sortWithinPartitions(*where).mapInArrow(lambda b: _summed(edges)(b, tile, m), EDGES)
    else:
        striped = [*where, "stripe"]
        sums = packed.repartition(*striped).sortWithinPartitions(*striped).mapInArrow(lambda b: _summed(partial)(b, tile, m), SUMS)
        d = sums.repartition(*where).sortWithinPartitions(*where).mapInArrow(merged, EDGES)
    if positions is not None and (max_distance_bp > 0 or same_chr):
        left = positions.select(F.col("marker_idx").alias("i"), F.col("chr").alias("c_i"), F.col("pos").alias("b_i"))
        right = positions.select(F.col("marker_idx").alias("j"), F.col("chr").alias("c_j"), F.col("pos").alias("b_j"))
        d = d.join(left, "i").join(right, "j")
        if max_distance_bp > 0:
            d = d.filter(F.col("b_j") - F.col("b_i") <= max_distance_bp)
        if same_chr:
            d = d.filter("c_i = c_j")
    return d.select("i", "j", F.round("r", 8).alias("r")).filter(F.col("r") * F.col("r") >= r2_threshold)


def _pair_sums(i: np.ndarray, j: np.ndarray):
    """Batches of dosage rows to gg, gi, gj, n of each listed pair, summed over the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, len(i)), np.int64)
        for b in batches:
            rows = max(1, UNPACKED // max(len(i), 1))
            for lo in range(0, b.num_rows, rows):
                g, seen = dosage_matrix(b.column(0).slice(lo, rows))
                a, c, both = g[:, i], g[:, j], seen[:, i] * seen[:, j]
                total += [(a * c).sum(0), (a * both).sum(0), (c * both).sum(0), both.sum(0)]
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *map(pa.array, total)], names=["i", "j", "gg", "gi", "gj", "n"])

    return run


def pair_check(panel: DataFrame, pairs: DataFrame) -> DataFrame:
    """i, j, r and xtx of listed pairs (i, j) from the dosages themselves, to audit an LD table.

    Every task sums the products of the listed pairs over its samples before the shuffle.  The
    pairs go to the tasks ``PAIRS`` at a time; a longer list takes more passes.
    """
    listed = pairs.select("i", "j").distinct()
    passes = -(-listed.count() // PAIRS) or 1
    found = []
    for k in range(passes):
        part = listed.filter(F.pmod(F.xxhash64("i", "j"), F.lit(passes)) == k).toPandas()
        i, j = (part[c].to_numpy(np.int32) for c in ("i", "j"))
        found.append(panel.select("dosages").mapInArrow(_pair_sums(i, j), "i int, j int, gg bigint, gi bigint, gj bigint, n bigint"))
    long = found[0]
    for part in found[1:]:
        long = long.unionByName(part)
    sums = long.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("gg", "gi", "gj", "n")])
    p = F.when(F.col("n") > 0, F.col("sum_g") / (2.0 * F.col("n"))).otherwise(0.0)
    xx = F.col("sum_gg") - 4 * F.col("p") * F.col("sum_g") + 4 * F.col("n") * F.col("p") * F.col("p")
    one = marker_sums(panel).withColumn("p", p).select("marker_idx", "p", xx.alias("xx"))
    a = one.select(F.col("marker_idx").alias("i"), F.col("p").alias("p_i"), F.col("xx").alias("xx_i"))
    c = one.select(F.col("marker_idx").alias("j"), F.col("p").alias("p_j"), F.col("xx").alias("xx_j"))
    d = sums.join(a, "i").join(c, "j")
    cross = F.col("gg") - 2 * F.col("p_j") * F.col("gi") - 2 * F.col("p_i") * F.col("gj") + 4 * F.col("n") * F.col("p_i") * F.col("p_j")
    sd = lambda k: F.sqrt(2 * F.col(f"p_{k}") * (1 - F.col(f"p_{k}")))
    size = F.sqrt(F.col("xx_i") * F.col("xx_j"))
    return d.select("i", "j", F.round(F.when(size > 0, cross / size).otherwise(0.0), 8).alias("r"), F.round(cross / (sd("i") * sd("j")), 6).alias("xtx"))


def blocks_in_reach(markers: DataFrame, block: int, *, max_distance_variants: int = 0, max_distance_bp: int = 0) -> DataFrame:
    """a, b, a <= b: blocks of ``block`` markers that any pair of the window may join.

    ``markers`` has marker_idx and pos, rising; the last marker of one block and the first
    of the other decide.
    """
    of = F.floor(F.col("marker_idx") / block)
    ends = markers.groupBy(of.alias("k")).agg(
        F.min("marker_idx").alias("first"), F.max("marker_idx").alias("last"), F.min_by("pos", "marker_idx").alias("from_bp"), F.max_by("pos", "marker_idx").alias("to_bp")
    )
    a = ends.select(F.col("k").alias("a"), F.col("last").alias("last_a"), F.col("to_bp").alias("to_a"))
    b = ends.select(F.col("k").alias("b"), F.col("first").alias("first_b"), F.col("from_bp").alias("from_b"))
    near = F.lit(True)
    if max_distance_variants > 0:
        near = near & (F.col("first_b") - F.col("last_a") <= max_distance_variants)
    if max_distance_bp > 0:
        near = near & (F.col("from_b") - F.col("to_a") <= max_distance_bp)
    # Positions rise, so blocks in reach follow each other: look at the next ones until none has a partner.
    found, step = [], 0
    while True:
        pairs = a.withColumn("b", F.col("a") + step).join(b, "b").filter(near if step else F.lit(True)).select("a", "b")
        if step and pairs.isEmpty():
            break
        found.append(pairs)
        step += 1
    out = found[0]
    for pairs in found[1:]:
        out = out.unionByName(pairs)
    return out


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, without the diagonal."""
    return edges.select("i", "j", "r").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "r"))


def row_pointers(edges: DataFrame, markers: DataFrame) -> DataFrame:
    """i, nnz and row_ptr: cumulative counts of the upper rows, empty ones included.

    Cumulative sums run within blocks of markers and over the block totals.
    """
    counts = markers.select(F.col("marker_idx").alias("i")).join(edges.groupBy("i").agg(F.count("*").alias("nnz")), "i", "left")
    counts = counts.select("i", F.coalesce("nnz", F.lit(0)).cast("bigint").alias("nnz")).withColumn("block", F.floor(F.col("i") / 65536))
    blocks = counts.groupBy("block").agg(F.sum("nnz").alias("total"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("block").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return counts.join(F.broadcast(blocks), "block").select(
        "i", "nnz", (F.col("base") + F.coalesce(F.sum("nnz").over(inside), F.lit(0))).cast("bigint").alias("row_ptr")
    )


def friends(edges: DataFrame, min_r2: float = 0.8, max_friends: int = 50) -> DataFrame:
    """i, j, r2, rank: the strongest neighbours of each marker."""
    w = Window.partitionBy("i").orderBy(F.col("r2").desc(), "j")
    s = symmetric(edges).withColumn("r2", F.round(F.col("r") * F.col("r"), 10)).filter(F.col("r2") >= min_r2)
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max_friends).select("i", "j", "r2", "rank")


def matvec(edges: DataFrame, vector: DataFrame) -> DataFrame:
    """i and (R x)_i for a vector (marker_idx, x), with a unit diagonal."""
    x = vector.select(F.col("marker_idx").alias("j"), "x")
    off = symmetric(edges).join(x, "j").select("i", (F.col("r") * F.col("x")).alias("t"))
    diagonal = vector.select(F.col("marker_idx").alias("i"), F.col("x").alias("t"))
    return off.unionByName(diagonal).groupBy("i").agg(F.round(F.sum("t"), 6).alias("rx"))


def cross_products(edges: DataFrame, stats: DataFrame) -> DataFrame:
    """i, j, xtx on both sides of the diagonal: r times sqrt(ww_i ww_j)."""
    a = stats.select(F.col("marker_idx").alias("i"), F.col("ww").alias("ww_i"))
    b = stats.select(F.col("marker_idx").alias("j"), F.col("ww").alias("ww_j"))
    scaled = F.round(F.col("r") * F.sqrt(F.col("ww_i") * F.col("ww_j")), 6)
    return symmetric(edges).join(a, "i").join(b, "j").select("i", "j", scaled.alias("xtx"))


def region(edges: DataFrame, markers: DataFrame) -> DataFrame:
    """Dense (i, j, r) of a marker set (region, marker_idx), diagonal included."""
    left = markers.select("region", F.col("marker_idx").alias("i"))
    right = markers.select("region", F.col("marker_idx").alias("j"))
    off = symmetric(edges).join(left, "i").join(right, ["region", "j"]).select("region", "i", "j", "r")
    return off.unionByName(left.select("region", "i", F.col("i").alias("j"), F.lit(1.0).alias("r")))


def block_edges(edges: DataFrame, block: int, min_abs_r: float) -> DataFrame:
    """Pairs of marker blocks with any correlation above ``min_abs_r``, for colouring."""
    a, b = F.floor(F.col("i") / block), F.floor(F.col("j") / block)
    return edges.filter(F.abs("r") > min_abs_r).select(a.alias("a"), b.alias("b")).filter("a <> b").distinct()


def colour_blocks(pairs: list[tuple[int, int]], blocks: int) -> list[int]:
    """Greedy colours of the block graph, in block order."""
    near: dict[int, set[int]] = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    colours: list[int] = []
    for k in range(blocks):
        used = {colours[n] for n in near.get(k, ()) if n < k}
        colours.append(next(c for c in range(blocks + 1) if c not in used))
    return colours
