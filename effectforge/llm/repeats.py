"""Where sequences of W tokens repeat: anchors, contexts and their order.

Every window of W tokens has one anchor, its least-hashed run of K tokens (the
leftmost of equals), so equal windows have equal anchors at equal offsets.  The
consecutive windows of one anchor are a unit, and the tokens they span are its
context.  About 2 / (W - K + 2) of the positions are anchors, and only anchors
are shuffled.  Among units of equal anchors

* one whose anchor comes once has no repeated window,
* one whose whole context came earlier is repeated throughout,
* the first of each context is *open* if its anchor has other contexts: some of
  its windows may still repeat in part of another context.

What repeats whole within one block of documents is settled before the shuffle,
so a large group of copies sends a row a block for each anchor.  Contexts are
equal if two independent hashes of 64 bits are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from effectforge.llm.common import bare, materialize, small_batches

_ODD, _ODD2 = 0x9E3779B97F4A7C17, 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1
#: Tokens handled at once; longer documents go in overlapping pieces.
BLOCK = 1 << 20
UNITS = "g bigint, c bigint, c2 bigint, key bigint, n smallint, off smallint, done boolean"
#: Bits of a key: a document's number and a position in it.
KEY_BITS = 63


@lru_cache(maxsize=2)
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    def run(x: int) -> np.ndarray:
        out = np.full(n, x & _MASK, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(base), run(pow(base, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class RangeHash:
    """Hashes of token ranges of one sequence from polynomial prefix sums."""

    def __init__(self, tokens: np.ndarray, base: int = _ODD) -> None:
        n = len(tokens)
        size = 1 << max(10, int(n).bit_length())
        self.power, self.inverse = _powers(size, base)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(tokens * self.power[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def runs(self, k: int) -> np.ndarray:
        """Hash of the k tokens at every start."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:-k]) * self.inverse[:n] + np.uint64(k))


def second_hash(tokens: np.ndarray, gram: int) -> RangeHash:
    """Range hashes, independent of those of the tokens, over runs of ``gram`` of them: a range of k tokens has k - gram + 1."""
    return RangeHash(mix(RangeHash(mix(tokens + np.uint64(_ODD2)), _ODD2).runs(gram)), _ODD2)


def units(tokens: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """First window start, windows, anchor offset, anchor hash and two context hashes of each unit.

    ``ends`` gives for every token the end of its document.
    """
    n = len(tokens)
    none = np.zeros(0, np.int64)
    starts = np.flatnonzero(ends - np.arange(n) >= window)
    if not len(starts):
        return none, none, none, *(none.astype(np.uint64),) * 3
    ranged = RangeHash(tokens)
    grams = ranged.runs(gram)
    least, at, wide, need = grams, np.arange(len(grams), dtype=np.int32), 1, window - gram + 1
    while wide < need:
        step = min(wide, need - wide)
        left = least[:-step] <= least[step:]
        at = np.where(left, at[:-step], at[step:])
        least = np.where(left, least[:-step], least[step:])
        wide += step
    anchor = at[starts].astype(np.int64)
    change = np.flatnonzero(np.diff(anchor, prepend=-1))
    first = starts[change]
    count = np.diff(change, append=len(starts))
    anchor = anchor[change]
    offset = anchor - first
    shift = offset.astype(np.uint64)
    context = mix(ranged(first, first + count + (window - 1)) + shift)
    context2 = mix(second_hash(tokens, gram)(first, first + count + (window - gram)) + shift)
    return first, count, offset, grams[anchor], context, context2


def pieces(lengths: np.ndarray, window: int, block: int = BLOCK) -> Iterator[list[tuple[int, int, int]]]:
    """Blocks of (document, from, to) with about ``block`` tokens; long documents overlap by W - 1."""
    held, size = [], 0
    for k, n in enumerate(lengths.tolist()):
        if n < window:
            continue
        for lo in range(0, n - window + 1, block):
            hi = min(n, lo + block + window - 1)
            if size and size + hi - lo > block:
                yield held
                held, size = [], 0
            held.append((k, lo, hi))
            size += hi - lo
    if held:
        yield held


def unit_rows(
    sequences: Callable[[pa.RecordBatch], tuple[np.ndarray, Callable[[int, int, int], np.ndarray]]],
    window: int,
    gram: int,
    bits: int,
):
    """A mapInArrow function from (dk, text) batches to rows of ``UNITS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dk = np.asarray(batch.column(0)).astype(np.int64)
            lengths, tokens_of = sequences(batch)
            for held in pieces(lengths, window):
                tokens = np.concatenate([tokens_of(*p) for p in held])
                sizes = np.array([hi - lo for _, lo, hi in held])
                tops = np.cumsum(sizes)
                first, count, offset, g, c, c2 = units(tokens, np.repeat(tops, sizes), window, gram)
                if not len(first):
                    continue
                which = np.searchsorted(tops, first, side="right")
                base = np.array([lo for _, lo, _ in held]) - (tops - sizes)
                key = (dk[np.array([k for k, _, _ in held])][which] << bits) + first + base[which]
                order = np.lexsort((key, c2, c, g))
                again = np.zeros(len(order), bool)
                again[1:] = key[order][1:] != key[order][:-1]
                for x in (g[order], c[order], c2[order]):
                    again[1:] &= x[1:] == x[:-1]
                done = np.zeros(len(order), bool)
                done[order] = again
                g = np.where(done, mix(key.view(np.uint64)), g)
                c, c2 = (np.where(done, np.uint64(0), x) for x in (c, c2))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(g.view(np.int64)),
                        pa.array(c.view(np.int64)),
                        pa.array(c2.view(np.int64)),
                        pa.array(key),
                        pa.array(count.astype(np.int16)),
                        pa.array(offset.astype(np.int16)),
                        pa.array(done),
                    ],
                    names=["g", "c", "c2", "key", "n", "off", "done"],
                )

    return run


def ordered(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, dk, text) with ``dk`` in the order of the ids, and bits for a position.

    Whole-number ids that are unique and leave room for a position in 63 bits are
    their own order.  Others, of any type, are numbered in the order of id and text,
    so rows that repeat an id with another text come one after the other, and equal
    rows share a number.  A null id comes before all others.  Where even the numbers
    leave no room, it is an error.
    """
    d = bare(small_batches(docs), "doc_id", "text").withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    longest, low, high = d.agg(F.max(F.octet_length("text")), F.min("doc_id"), F.max("doc_id")).first()
    bits = max(8, int(longest or 0).bit_length() + 1)
    twice = d.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    plain = isinstance(low, int) and not twice and (high - low + 2).bit_length() + bits <= KEY_BITS - 1
    if low is None and not twice or plain:
        dk = F.coalesce(F.col("doc_id") - F.lit(low or 0) + 1, F.lit(0)).cast("bigint")
        return d.select("doc_id", dk.alias("dk"), "text"), bits
    d = d.withColumn("th", F.xxhash64("text"))
    ids = d.select(F.col("doc_id").alias("id"), F.col("th").alias("t")).distinct().orderBy(F.col("id").asc_nulls_first(), "t")
    ids = materialize(ids.withColumn("at", F.monotonically_increasing_id()), "order-ids")
    # Sorted partitions are numbered from 0; a row for each of them tells how many come before.
    part = F.shiftright("at", 33)
    sizes, before, total = ids.groupBy(part.alias("part")).count().collect(), [], 0
    for k, n in sorted(map(tuple, sizes)):
        before.append((k, total))
        total += n
    if total.bit_length() + bits > KEY_BITS - 1:
        raise ValueError(f"{total} documents of up to {longest} bytes do not fit keys of {KEY_BITS} bits")
    offsets = d.sparkSession.createDataFrame(before, "part bigint, before bigint")
    dk = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = materialize(ids.join(F.broadcast(offsets), part == F.col("part")).select("id", "t", dk.alias("dk")), "order")
    same = d["doc_id"].eqNullSafe(ranked["id"]) & (d["th"] == ranked["t"])
    return d.join(ranked, same).select("doc_id", "dk", "text"), bits


def classify(rows: DataFrame, crowd: int) -> DataFrame:
    """The units that matter: g, key, n, off, done, crowded; see the module."""
    by_context = Window.partitionBy("g").orderBy("c", "c2", "key")
    whole = Window.partitionBy("g")
    same = (F.lag("c").over(by_context) == F.col("c")) & (F.lag("c2").over(by_context) == F.col("c2"))
    seen_before = same & (F.lag("key").over(by_context) != F.col("key"))
    context = F.struct("c", "c2")
    marked = rows.select(
        "g",
        "key",
        "n",
        "off",
        (F.col("done") | F.coalesce(seen_before, F.lit(False))).alias("done"),
        (F.min(context).over(whole) != F.max(context).over(whole)).alias("varied"),
        (F.count("*").over(whole) > crowd).alias("crowded"),
    )
    return marked.filter(F.col("done") | F.col("varied")).drop("varied")


def by_document(rows: DataFrame, bits: int, *columns: Column) -> DataFrame:
    """(dk, found): an array of structs of ``columns`` for each document."""
    dk = F.shiftright("key", bits).alias("dk")
    return rows.groupBy(dk).agg(F.collect_list(F.struct(*columns)).alias("found"))


def place(bits: int) -> Column:
    """The position that a key holds."""
    return F.col("key").bitwiseAND(F.lit((1 << bits) - 1))


def covered(starts: np.ndarray, counts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Merged token spans of runs of window starts."""
    spans: list[tuple[int, int]] = []
    order = np.argsort(starts, kind="stable")
    for s, n in zip(starts[order].tolist(), counts[order].tolist(), strict=True):
        end = s + n - 1 + window
        if spans and s <= spans[-1][1]:
            if end > spans[-1][1]:
                spans[-1] = (spans[-1][0], end)
        else:
            spans.append((s, end))
    return spans
