"""SimHash near-duplicates through pivot distance tables.

Each distinct fingerprint gets a table of Hamming distances to many reference
fingerprints.  The references live on four blocks of 16 bits, so the table holds
the distances block by block.  Two fingerprints at most two bits apart agree on
two whole blocks at least, and there all their pivot distances are equal: the
pairs of block tables are the join keys.  Pairs that meet are discarded where any
coordinate differs by more than two, and the survivors are verified by their
bits.  A key that too many fingerprints share is not joined with itself: its
members emit their one-bit variants instead.  Two fingerprints at most two bits
apart share a variant, and all that share one are at most two bits apart, so a
star to the least of them keeps the same components without any pairs.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from effectforge.llm.common import bare, fresh, materialize, row_order, small_batches
from effectforge.llm.components import components

BLOCKS, BLOCK_BITS, PIVOTS = 4, 16, 12
SEED = 42
#: Most fingerprints of a key that are paired; larger keys go by variants.
MAX_PAIRED = 32
RADIUS = 2


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of word shingles as a signed number; 0 without words."""
    words = raw.lower().split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= shingle:
        hashes = [digest(join(words), SEED)]
    else:
        runs = zip(*(words[k:] for k in range(shingle)))
        hashes = [digest(join(r), SEED) for r in runs]
    table = np.array(hashes, np.uint64)
    bits = np.unpackbits(table.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = 2 * np.add.reduce(bits, axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(over, bitorder="little").view(np.int64)[0])


def _fingerprint_udf(text: Column, shingle: int) -> Column:
    def of(texts: pa.Array) -> pa.Array:
        raws = texts.cast(pa.large_binary()).to_pylist()
        return pa.array([fingerprint(r or b"", shingle) for r in raws], pa.int64())

    return F.arrow_udf(of, "bigint")(text)


def references() -> list[list[int]]:
    """Reference fingerprints of each block, as 16-bit numbers, the same in every run."""
    rng = random.Random(SEED)
    return [[rng.getrandbits(BLOCK_BITS) for _ in range(PIVOTS)] for _ in range(BLOCKS)]


def pivot_table(fp: Column) -> list[Column]:
    """For each block the array of Hamming distances to its references."""
    mask = F.lit((1 << BLOCK_BITS) - 1)
    tables = []
    for b, refs in enumerate(references()):
        part = F.shiftright(fp, b * BLOCK_BITS).bitwiseAND(mask)
        tables.append(F.array(*[F.bit_count(part.bitwiseXOR(F.lit(r))).cast("tinyint") for r in refs]))
    return tables


def link_fingerprints(prints: DataFrame) -> DataFrame:
    """Edges (hi, lo) between distinct fingerprints ``fp``, whole up to components."""
    tables = pivot_table(F.col("fp"))
    keys = F.array(
        *[F.xxhash64(F.lit(a * BLOCKS + b), tables[a], tables[b]) for a in range(BLOCKS) for b in range(a + 1, BLOCKS)]
    )
    keyed = materialize(prints.select("fp", F.explode(keys).alias("key")), "simhash-keys")
    sizes = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-sizes")
    met = materialize(keyed.join(sizes, "key"), "simhash-met")
    few = met.filter(F.col("n") <= MAX_PAIRED).select("key", "fp")
    pairs = few.select("key", F.col("fp").alias("hi")).join(few.select("key", F.col("fp").alias("lo")), "key").filter("hi > lo")
    hi, lo = (F.concat(*pivot_table(F.col(c))) for c in ("hi", "lo"))
    farthest = F.array_max(F.zip_with(hi, lo, lambda x, y: F.abs(x - y)))
    pairs = pairs.select("hi", "lo").filter(farthest <= RADIUS)
    pairs = pairs.filter(F.bit_count(F.col("hi").bitwiseXOR(F.col("lo"))) <= RADIUS)
    crowd = met.filter(F.col("n") > MAX_PAIRED).select("fp").distinct()
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit((1 << b) - (1 << 64) * (b == 63)) for b in range(64)])
    variants = crowd.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("variant"))
    stars = materialize(variants.groupBy("variant").agg(F.min("fp").alias("lo"), F.count("*").alias("n")).filter("n > 1"), "simhash-stars")
    spokes = variants.join(stars, "variant").select(F.col("fp").alias("hi"), "lo").filter("hi <> lo")
    return pairs.unionByName(spokes)


def fingerprint_classes(docs: DataFrame, shingle: int = 3) -> tuple[DataFrame, DataFrame]:
    """Tables (doc_id, fp) of all documents and (fp, component_id) of all fingerprints."""
    d = bare(small_batches(docs), "doc_id", "text")
    printed = materialize(d.select("doc_id", _fingerprint_udf(F.col("text").cast("string"), shingle).alias("fp")), "simhash")
    prints = materialize(printed.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-prints")
    roots = components(link_fingerprints(prints.select("fp")))
    rooted = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return printed, materialize(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"), "simhash-classes")


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each document.

    Null and empty texts have the fingerprint zero and link like any other; a
    null id counts as the last; repeated rows each get their row; an empty
    table gives no rows.
    """
    printed, classes = fingerprint_classes(docs, shingle)
    return printed.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of ``docs`` for each row of ``kept`` (id, and hash of the text if it has one): of several the least by a hash."""
    names = {c: fresh(docs, c) for c in ("id", "hash", "n")}
    d = docs.withColumn(names["id"], F.col("doc_id"))
    keys = [names["id"]]
    k = kept.withColumnRenamed("id", "kept_id")
    same = d[names["id"]].eqNullSafe(k["kept_id"])
    if "hash" in kept.columns:
        d = d.withColumn(names["hash"], F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
        keys.append(names["hash"])
        same = same & (d[names["hash"]] == k["hash"])
    d = d.join(k, same, "left_semi")
    w = Window.partitionBy(*keys).orderBy(row_order(docs))
    return d.withColumn(names["n"], F.row_number().over(w)).filter(F.col(names["n"]) == 1).drop(names["n"], *keys)


def keep_first_of_class(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """The document with the smallest id of each class, with the columns of ``docs``.

    Rows that repeat that id are one document and leave one row.
    """
    _, classes = fingerprint_classes(docs, shingle)
    return keep_rows(docs, classes.select(F.col("component_id").alias("id")).distinct())
