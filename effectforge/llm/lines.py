"""Line dedup by distinct-site spread, in DataFrame operations alone.

Every line with a word is keyed by hashes; an HLL sketch of the sites that hold
it is merged by aggregation for each key.  A key whose estimate is clearly above
or below the threshold is decided by it; keys near the threshold get an exact
distinct count.  Lines that spread over enough sites are boilerplate: all of
their occurrences but the first go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectforge.llm.common import bare, fresh, materialize

LG_K = 12


def line_key(line: Column) -> Column:
    """Two independent hashes of a line, 96 bits in all."""
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def _has_word(line: Column) -> Column:
    return line.rlike("[^\\x20\\x09-\\x0D]")


def line_rows(docs: DataFrame, site: str) -> DataFrame:
    """A row for each line with a word: doc_id, row hash, position, key, site."""
    d = bare(docs, "doc_id", "text", site).select(
        "doc_id",
        F.col("text").cast("string").alias("text"),
        F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"),
    )
    lines = d.select(
        "doc_id",
        F.xxhash64("text").alias("row_hash"),
        "site",
        F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"),
    )
    return lines.filter(_has_word(F.col("line"))).select("doc_id", "row_hash", "site", "pos", line_key(F.col("line")).alias("k"))


def boilerplate_keys(lines: DataFrame, min_sites: int, band: float = 0.1) -> DataFrame:
    """Keys of lines on ``min_sites`` sites or more: k.a, k.b and the first holder.

    Estimates within ``band`` of the threshold, and at least one site of it, are
    settled by exact distinct counts over all rows of those keys.
    """
    spread = materialize(
        lines.groupBy(F.col("k.a").alias("a"), F.col("k.b").alias("b"))
        .agg(
            F.count("*").alias("n"),
            F.hll_sketch_agg("site", LG_K).alias("sketch"),
            F.min("doc_id").alias("first_id"),
        )
        .filter(F.col("n") >= min_sites)
        .select("a", "b", "first_id", F.hll_sketch_estimate("sketch").alias("sites")),
        "line-spread",
    )
    slack = max(1, int(min_sites * band))
    near = spread.filter((F.col("sites") >= min_sites - slack) & (F.col("sites") < min_sites + slack)).select("a", "b")
    exact = (
        lines.select(F.col("k.a").alias("a"), F.col("k.b").alias("b"), "site")
        .join(near, ["a", "b"])
        .distinct()
        .groupBy("a", "b")
        .agg(F.count("*").alias("exact"))
    )
    return materialize(
        spread.filter(F.col("sites") >= min_sites - slack)
        .join(exact, ["a", "b"], "left")
        .filter(F.coalesce("exact", F.col("sites")) >= min_sites)
        .select("a", "b", "first_id"),
        "line-boilerplate",
    )


def mark_lines(docs: DataFrame, into: str, *, site: str = "source", min_sites: int = 10, keep_first: bool = True) -> DataFrame:
    """``docs`` with a struct column ``into``: the kept text, lines and lines removed.

    With ``keep_first`` the document with the smallest id keeps the first of its
    occurrences of a boilerplate line.  A null site counts as the site named by
    the empty string, a null text stays null with no lines, lines without a word
    are never removed, and a null id never keeps a line that another id holds.
    """
    lines = line_rows(docs, site)
    found = boilerplate_keys(lines, min_sites)
    hits = lines.select("doc_id", "row_hash", "pos", F.col("k.a").alias("a"), F.col("k.b").alias("b")).join(found, ["a", "b"])
    removed = hits.groupBy("doc_id", "row_hash").agg(
        F.sort_array(F.collect_set(F.struct("pos", "a", "b", F.col("doc_id").eqNullSafe(F.col("first_id")).alias("own")))).alias("gone")
    )
    row_id, row_hash = fresh(docs, "row_id"), fresh(docs, "row_hash")
    removed = removed.withColumnsRenamed({"doc_id": row_id, "row_hash": row_hash, "gone": into})
    d = docs.withColumn(fresh(docs, "text_hash"), F.xxhash64(F.col("text").cast("string")))
    text_hash = d.columns[-1]
    joined = d.join(removed, d["doc_id"].eqNullSafe(removed[row_id]) & (d[text_hash] == removed[row_hash]), "left")
    gone = F.col(into)
    if keep_first:
        seen_before = lambda g, i: F.exists(
            F.slice(gone, 1, i), lambda h: (h["a"] == g["a"]) & (h["b"] == g["b"])
        )
        gone = F.filter(gone, lambda g, i: ~g["own"] | seen_before(g, i))
    positions = F.coalesce(F.transform(gone, lambda g: g["pos"]), F.array().cast("array<int>"))
    split = F.split(F.col("text").cast("string"), "\n")
    kept = F.filter(split, lambda x, i: ~F.array_contains(positions, i))
    result = F.struct(
        F.when(F.size(positions) > 0, F.array_join(kept, "\n")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("bigint").alias("n_lines"),
        F.size(positions).cast("bigint").alias("n_removed"),
    )
    return joined.withColumn(into, result).drop(row_id, row_hash, text_hash)


def line_dedup(docs: DataFrame, **params) -> DataFrame:
    """doc_id, n_lines, n_removed and the text that is left, for each document."""
    params = {"site": "source"} | params
    d = bare(docs, "doc_id", "text", params["site"])
    return mark_lines(d, "lines", **params).select("doc_id", "lines.n_lines", "lines.n_removed", "lines.text")


def drop_boilerplate(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with the boilerplate lines gone from the texts; no document goes."""
    into = fresh(docs, "lines")
    marked = mark_lines(docs, into, **params)
    return marked.select(*[F.col(into)["text"].alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
