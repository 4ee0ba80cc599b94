"""Source divergence audit: how far the sources of a language are apart in their use of terms.

Words are counted for each (language, source, term) in Arrow batches that add up
what they can before the shuffle.  A term's column of counts is a sparse vector of
(source, count); terms of a language with the same vector are one row with a
multiplicity, as natural vocabularies have far more terms than vectors.  Every
pair of sources is evaluated once for each distinct vector that both are in, and
what a vector adds where one of them or neither has the term comes from one row for
each source and probability.  All arithmetic is on integers, so the result does
not depend on the order of any sum.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from effectforge.llm.common import bare, materialize, small_batches

#: A-Z lower-cased, other letters and all non-ASCII bytes kept, the rest a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
#: Counts that one task holds before it sends them on, rows of a batch, and pairs before they are added up.
HELD, ROWS, PAIRS = 1 << 18, 1 << 16, 1 << 21
COUNTS = "lang string, source string, term string, n bigint, d bigint"
SUMS = "lang string, a string, b string, s bigint"


def fold_terms(raw: bytes) -> list[bytes]:
    """Terms of letters and non-ASCII characters, A-Z lower-cased."""
    return raw.translate(_FOLD).split()


def _count_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term), added up as far as ``HELD`` allows."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in held.items():
            terms = list(n)
            for k in range(0, len(terms), ROWS):
                part = terms[k : k + ROWS]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(part), pa.string()),
                        pa.array([source] * len(part), pa.string()),
                        pa.array(part, pa.binary()).cast(pa.string()),
                        pa.array([n[t] for t in part], pa.int64()),
                        pa.array([d[t] for t in part], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "d"],
                )
        held.clear()

    for batch in batches:
        for lang, source, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            terms = fold_terms(raw)
            n, d = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(n)
            n.update(terms)
            d.update(set(terms))
            size += len(n)
            if size > HELD:
                yield from sent()
                size = 0
    yield from sent()


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of positive whole numbers below 3 * 10^9."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def probability(count: Column, denominator: Column, scale: int, smooth: int) -> Column:
    """1 + floor(scale * (count + smooth) / denominator), exact for any long."""
    whole = F.lit(scale).cast("decimal(10,0)") * (count + smooth).cast("decimal(20,0)")
    return F.call_function("div", whole, denominator.cast("decimal(20,0)")) + 1


def _pair_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For pairs of sources of one vector, what both having its terms adds, in sums over the batch."""

    def f(p, q):
        return (p - q) * (p - q) // (p + q)

    for batch in batches:
        langs, entries = batch.column("lang").dictionary_encode(), batch.column("entries")
        flat = entries.flatten()
        names = pc.struct_field(flat, "source").dictionary_encode()
        source = np.asarray(names.indices, np.int64)
        p, p0 = (np.asarray(pc.struct_field(flat, c), np.int64) for c in ("p", "p0"))
        lang, mult = np.asarray(langs.indices, np.int64), np.asarray(batch.column("mult"), np.int64)
        width = np.asarray(pc.list_value_length(entries), np.int64)
        begin = np.cumsum(width) - width
        many = len(names.dictionary)
        codes, values, waiting = [], [], 0

        def added(codes, values):
            code = np.concatenate(codes)
            order = np.argsort(code, kind="stable")
            code, value = code[order], np.concatenate(values)[order]
            first = np.flatnonzero(np.diff(code, prepend=-1))
            return [code[first]], [np.add.reduceat(value, first)]

        for step in range(1, int(width.max(initial=0))):
            rows = np.flatnonzero(width > step)
            per = width[rows] - step
            row = np.repeat(rows, per)
            i = np.repeat(begin[rows] - (np.cumsum(per) - per), per) + np.arange(per.sum())
            j = i + step
            codes.append((lang[row] * many + source[i]) * many + source[j])
            values.append(mult[row] * (f(p[i], p[j]) - f(p[i], p0[j]) - f(p0[i], p[j]) + f(p0[i], p0[j])))
            waiting += len(row)
            if waiting > PAIRS:
                codes, values = added(codes, values)
                waiting = 0
        if codes:
            (code,), (value,) = added(codes, values)
            at = [code // many // many, code // many % many, code % many]
            yield pa.RecordBatch.from_arrays(
                [
                    *(x.dictionary.take(pa.array(k)) for x, k in zip((langs, names, names), at, strict=True)),
                    pa.array(value, pa.int64()),
                ],
                names=["lang", "a", "b", "s"],
            )


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents) of every term of every group."""
    d = bare(docs, "lang", "source", "text")
    name = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    words = small_batches(d.select(*name, F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")))
    return words.mapInArrow(_count_batches, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def count_vectors(counts: DataFrame, min_docs: int, top: int) -> DataFrame:
    """lang, vec (source, n), mult and the ``top`` least terms of each distinct vector of kept terms.

    ``total`` is the vector's count in all sources, ``key`` its least term, which no other
    vector of the language has.
    """
    entry = F.array_sort(F.collect_list(F.struct("source", "n")))
    kept = counts.groupBy("lang", "term").agg(F.sum("d").alias("d"), entry.alias("vec")).filter(F.col("d") >= min_docs)
    kept = materialize(kept.select("lang", "term", "vec"), "audit-terms")
    least = F.row_number().over(Window.partitionBy("lang", "vec").orderBy("term"))
    terms = kept.withColumn("k", least).filter(F.col("k") <= top).groupBy("lang", "vec").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    vectors = kept.groupBy("lang", "vec").agg(F.count("*").alias("mult")).join(terms, ["lang", "vec"])
    total = F.aggregate("vec", F.lit(0).cast("bigint"), lambda a, e: a + e["n"])
    return materialize(vectors.select("*", total.alias("total"), F.col("terms")[0].alias("key")), "audit-vectors")


def source_divergence(docs: DataFrame, *, min_docs: int = 10, scale: int = 10**9, smooth: int = 2, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: sources most apart, and what sets a source apart.

    Terms in ``min_docs`` documents of their language are kept.  Part ``pair`` has
    each other source of the language and the distance summed over all kept terms;
    part ``term`` the ``top`` terms that a source uses more than its language does.

    A null text has no terms, null languages and sources are those named by the
    empty string; a repeated row is a document of its own; ties go by the item's
    UTF-8; a source without a kept term still has its pairs, a language without
    one has pairs of value 0; an empty table gives no rows; other columns are no matter.
    """
    vectors = count_vectors(term_counts(docs), min_docs, top)
    named = bare(docs, "lang", "source").select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    each = vectors.select("lang", "key", "mult", "total", F.explode("vec").alias("e")).select("lang", "key", "mult", "total", "e.source", "e.n")
    sums = each.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("mult")).alias("words"))
    langs = vectors.groupBy("lang").agg(F.sum("mult").alias("v"), F.sum(F.col("total") * F.col("mult")).alias("lang_words"))
    groups = named.distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["words", "v", "lang_words"])
    size = F.col("words") + 2 * F.col("v")
    p0 = F.when(F.col("v") > 0, probability(F.lit(0).cast("bigint"), size, scale, smooth)).otherwise(1)
    groups = materialize(groups.select("lang", "source", "v", size.alias("size"), p0.alias("p0"), (F.col("lang_words") + 2 * F.col("v")).alias("lang_size")), "audit-groups")

    entries = each.join(groups, ["lang", "source"]).select(
        "lang", "key", "mult", "source", "p0",
        probability(F.col("n"), F.col("size"), scale, smooth).alias("p"),
        probability(F.col("total"), F.col("lang_size"), scale, smooth).alias("q"),
    )
    entries = materialize(entries, "audit-entries")

    both = entries.groupBy("lang", "key").agg(F.first("mult").alias("mult"), F.array_sort(F.collect_list(F.struct("source", "p", "p0"))).alias("entries"))
    both = both.select("lang", "mult", "entries").mapInArrow(_pair_batches, SUMS)
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), "v")
    one = entries.groupBy("lang", "source", "p", "p0").agg(F.sum("mult").alias("mult")).join(other, "lang").filter("source <> item")
    one = one.select("lang", "source", "item", (F.col("mult") * (distance(F.col("p"), F.col("q0")) - distance(F.col("p0"), F.col("q0")))).alias("s"))
    none = groups.select("lang", "source", "p0").join(other, "lang").filter("source <> item")
    none = none.select("lang", "source", "item", (F.col("v") * distance(F.col("p0"), F.col("q0"))).alias("s"))

    def turned(d: DataFrame, a: str, b: str) -> DataFrame:
        return d.select("lang", F.col(a).alias("source"), F.col(b).alias("item"), "s")

    one, both = (d.groupBy(*d.columns[:-1]).agg(F.sum("s").alias("s")) for d in (one, both))
    parts = [none, one, turned(one, "item", "source"), turned(both, "a", "b"), turned(both, "b", "a")]
    pairs = parts[0]
    for part in parts[1:]:
        pairs = pairs.unionByName(part)
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("s").alias("value"))

    group = Window.partitionBy("lang", "source")
    pairs = pairs.withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "item")))
    value = distance(F.col("p"), F.col("q"))
    best = entries.filter("p > q").select("lang", "source", "key", value.alias("value"))
    best = best.withColumn("k", F.row_number().over(group.orderBy(F.desc("value"), "key"))).filter(F.col("k") <= top)
    best = best.join(vectors.select("lang", "key", "terms"), ["lang", "key"]).select("lang", "source", "value", F.explode("terms").alias("item"))
    best = best.withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "item"))).filter(F.col("rank") <= top)
    out = [d.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for d, part in ((pairs, "pair"), (best, "term"))]
    return out[0].unionByName(out[1])
