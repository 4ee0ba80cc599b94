"""Exact word-substring dedup by level-wise doubling.

Only windows that repeat at one length go on to twice that length: five words,
ten, twenty.  At five words it is enough to look at the anchor of each window
(see ``repeats``).  An anchor that repeats with its whole context is repeated at
every length, and settled.  The others are extended to the ten words ending and
the ten words starting with the anchor: each window of twenty holds one of them
or both, and is a candidate only if all that it holds repeat.  What is left is
compared at twenty words, by two hashes, and later copies go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectforge.llm import repeats
from effectforge.llm.common import materialize

LEVELS = (5, 10, 20)


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text."""
    return np.array(list(map(xxhash.xxh64_intdigest, raw.split())), np.uint64)


def _sequences(batch: pa.RecordBatch):
    hashed = [word_hashes(r or b"") for r in batch.column(1).cast(pa.large_binary()).to_pylist()]
    return np.array([len(h) for h in hashed], np.int64), lambda k, lo, hi: hashed[k][lo:hi]


def _candidates(bits: int, gram: int, half: int, window: int):
    """From (dk, text, found) to key, n, off, the two middle hashes and two hashes of every window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, tokens_of = _sequences(batch)
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for k, found in enumerate(batch.column(2).to_pylist()):
                tokens = tokens_of(k, 0, lengths[k])
                ranged = repeats.RangeHash(tokens)
                key, n, off = (np.array([f[c] for f in found], np.int64) for c in ("key", "n", "off"))
                start = key & ((1 << bits) - 1)
                end = start + off + gram
                fits = end - half >= start
                left = ranged(np.where(fits, end - half, start), end).view(np.int64)
                holds = start + off + half <= lengths[k]
                right = ranged(start + off, np.where(holds, start + off + half, end)).view(np.int64)
                runs = ranged.runs(window).view(np.int64)
                runs2 = repeats.second_hash(tokens, gram).runs(window - gram + 1).view(np.int64)
                out[0].extend(key.tolist())
                out[1].extend(n.tolist())
                out[2].extend(off.tolist())
                out[3].extend([x if f else None for x, f in zip(left.tolist(), fits.tolist(), strict=True)])
                out[4].extend([x if h else None for x, h in zip(right.tolist(), holds.tolist(), strict=True)])
                for o, x in ((out[5], runs), (out[6], runs2)):
                    o.extend([x[s : s + m] for s, m in zip(start.tolist(), n.tolist(), strict=True)])
                if len(out[0]) > 20_000:
                    yield _batch(out)
                    out = ([], [], [], [], [], [], [])
            if out[0]:
                yield _batch(out)

    return run


def _batch(out: tuple[list, ...]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int16(), pa.int16(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    names = ["key", "n", "off", "ending", "starting", "windows", "windows2"]
    return pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types, strict=True)], names=names)


def _kept(window: int):
    def of(texts: pa.Array, found: pa.Array) -> pa.Array:
        out: tuple[list, ...] = ([], [], [], [])
        for raw, packed in zip(texts.cast(pa.large_binary()).to_pylist(), found.to_pylist(), strict=True):
            words = (raw or b"").split()
            spans = []
            if packed:
                p = np.array(packed, np.int64)
                spans = repeats.covered(p >> 8, p & 255, window)
            kept, at = [], 0
            for a, b in spans:
                kept += words[at:a]
                at = b
            kept += words[at:]
            out[0].append(len(words))
            out[1].append(len(words) - len(kept))
            out[2].append(hashlib.sha256(b" ".join(kept)).hexdigest())
            out[3].append([x for s in spans for x in s])
        types = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
        names = ["n_words", "n_removed", "kept_sha256", "spans"]
        return pa.StructArray.from_arrays([pa.array(o, t) for o, t in zip(out, types, strict=True)], names=names)

    return F.arrow_udf(of, "struct<n_words:bigint,n_removed:bigint,kept_sha256:string,spans:array<bigint>>")


def repeated_windows(candidates: DataFrame, window: int, half: int, gram: int) -> DataFrame:
    """(key, n): windows of the candidates that come earlier too, level by level."""
    sides = candidates.select(
        "key",
        F.explode(F.array(F.struct(F.col("ending").alias("h"), F.lit(1).alias("side")), F.struct(F.col("starting").alias("h"), F.lit(2).alias("side")))).alias("s"),
    ).select("key", "s.h", "s.side").filter("h is not null")
    repeated = materialize(
        sides.groupBy("h", "side").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low < high").select("h", "side"),
        "level-half",
    )
    sided = sides.join(repeated, ["h", "side"]).groupBy("key").agg(F.bit_or("side").alias("sides"))
    # A window starts ``o`` words before its anchor.  It holds the ending half
    # from o = half - gram on, and the starting half up to o = window - half.
    o = F.col("off") - F.col("j")
    wants = F.when(o >= half - gram, 1).otherwise(0) + F.when(o <= window - half, 2).otherwise(0)
    windows = (
        candidates.join(sided, "key")
        .select("key", "off", "sides", "windows2", F.posexplode("windows").alias("j", "h"))
        .filter(F.col("sides").bitwiseAND(wants) == wants)
        .select((F.col("key") + F.col("j")).alias("key"), "h", F.col("windows2")[F.col("j")].alias("h2"))
    )
    windows = materialize(windows, "level-windows")
    first = materialize(
        windows.groupBy("h", "h2").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low < high").select("h", "h2", "low"),
        "level-first",
    )
    return windows.join(first, ["h", "h2"]).filter("key > low").select("key", F.lit(1).cast("smallint").alias("n"))


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the removed spans of words.

    Null and empty texts have no words; of rows that share an id, equal ones
    are one document and others follow each other by a hash of their text; a
    null id comes first; an empty table gives no rows.
    """
    gram, half, window = LEVELS
    d, bits = repeats.ordered(docs)
    rows = d.filter(F.octet_length("text") >= 2 * window - 1).select("dk", "text")
    rows = rows.mapInArrow(repeats.unit_rows(_sequences, window, gram, bits), repeats.UNITS)
    marked = materialize(repeats.classify(rows, 1), "repeat-units")
    open_ = repeats.by_document(marked.filter("not done"), bits, *(F.col(c) for c in ("key", "n", "off")))
    candidates = materialize(
        d.select("dk", "text").join(open_, "dk").mapInArrow(
            _candidates(bits, gram, half, window),
            "key bigint, n smallint, off smallint, ending bigint, starting bigint, windows array<bigint>, windows2 array<bigint>",
        ),
        "repeat-candidates",
    )
    again = repeated_windows(candidates, window, half, gram)
    removed = marked.filter("done").select("key", "n").unionByName(again)
    packed = F.shiftleft(repeats.place(bits), 8).bitwiseOR(F.col("n").cast("bigint"))
    spans = removed.groupBy(F.shiftright("key", bits).alias("dk")).agg(F.collect_list(packed).alias("found"))
    return d.join(spans, "dk", "left").select("doc_id", _kept(window)("text", "found").alias("r")).select("doc_id", "r.*")
