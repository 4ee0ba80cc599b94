"""Exact byte-substring dedup by longest previous factors.

Windows of 100 bytes that may repeat are found by their anchors (see
``repeats``).  The contexts of open units meet by anchor; each bounded batch of
them gets a suffix array and the common prefixes of neighbours in it.  The
previous and the next smaller position of a suffix, in suffix order, are the
earlier ones that share most with it; the larger common prefix is its longest
previous factor.  Positions where that is the window or more start a later copy,
and go; the first stays.
Anchors with more contexts than one batch takes are settled by aggregation
instead: the least position of each window, by two hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectforge.llm import repeats
from effectforge.llm.common import materialize

GRAM = 32
#: Contexts of one anchor that one suffix array takes; more are one key's unbounded group and go by aggregation.
CROWD = 2048
#: Fixed value: bytes that the first ranking takes, 9 bits each.
FIRST = 7
BATCH = 1 << 20
_TABLE = repeats.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and data of a text column as UTF-8 bytes."""
    raw = column.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = raw.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def _sequences(batch: pa.RecordBatch):
    offsets, data = _bytes_of(batch.column(1))
    return np.diff(offsets), lambda k, lo, hi: _TABLE[data[offsets[k] + lo : offsets[k] + hi]]


def suffix_array(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the common prefix of each with the one before it.

    ``ends`` gives for every byte the end of its context, where its suffix ends, before
    any other byte.  Equal suffixes are in text order.  The rank of a suffix by its first
    7, 14, 28, ... bytes is the place where those of its rank begin in the order; only
    those that still share one are sorted on.  The ranks that are kept of every
    length give the common prefixes, longest part first.
    """
    n = len(text)
    left = ends - np.arange(n)
    symbols = np.concatenate([text.astype(np.int64) + 1, np.zeros(FIRST, np.int64)])
    word = np.zeros(n, np.int64)
    for k in range(FIRST):
        word = (word << 9) | np.where(left > k, symbols[k : k + n], 0)
    order = np.argsort(word, kind="stable")
    rank, levels, length, longest = np.zeros(n, np.int64), [], FIRST, int(left.max(initial=0))
    places, keys = np.arange(n), word[order]
    while True:
        # ``places`` are those of the order that were sorted by ``keys`` just now.
        at = order[places]
        new = np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]])
        rank[at] = places[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        levels.append((length, rank.astype(np.int32)))
        alone = new & np.concatenate([new[1:], np.ones(min(1, len(keys)), bool)])
        places = places[~alone]
        if length >= longest or not len(places):
            break
        at = order[places]
        further = left[at] > length
        keys = rank[at] * (n + 1) + np.where(further, rank[np.where(further, at + length, 0)] + 1, 0)
        sort = np.argsort(keys, kind="stable")
        order[places], keys = at[sort], keys[sort]
        length *= 2
    one, other = order[1:], order[:-1]
    shared = np.zeros(len(one), np.int64)
    room = np.minimum(left[one], left[other])
    for length, known in reversed(levels):
        near = np.flatnonzero(shared + length <= room)
        whole = near[known[one[near] + shared[near]] == known[other[near] + shared[near]]] if len(near) else near
        shared[whole] += length
    near = np.flatnonzero(shared < room)
    for _ in range(FIRST - 1):
        near = near[text[one[near] + shared[near]] == text[other[near] + shared[near]]]
        shared[near] += 1
        near = near[shared[near] < room[near]]
    return order, np.concatenate([np.zeros(min(1, n), np.int64), shared])


def _nearest_smaller(values: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the nearest smaller one before it, -1 for none, and the least of ``shared`` on the way.

    All entries between an entry and its candidate are larger; a candidate that is
    larger too hands over its own, so ways double.
    """
    at, least = np.arange(len(values)) - 1, shared.copy()
    going = np.flatnonzero((at >= 0) & (values[at] > values))
    while len(going):
        step = at[going]
        least[going] = np.minimum(least[going], least[step])
        at[going] = at[step]
        going = going[(at[going] >= 0) & (values[at[going]] > values[going])]
    return at, np.where(at >= 0, least, 0)


def previous_factors(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Longest previous factor of every position: what it shares with any earlier one, at most.

    The earlier suffixes next to it in suffix order, the previous and the next smaller
    position, share the most of all earlier ones.
    """
    order, shared = suffix_array(text, ends)
    before = _nearest_smaller(order, shared)[1]
    after = _nearest_smaller(order[::-1], np.concatenate([shared[1:], np.zeros(min(1, len(text)), np.int64)])[::-1])[1][::-1]
    out = np.empty(len(text), np.int64)
    out[order] = np.maximum(before, after)
    return out


def _contexts(window: int, bits: int):
    """From (dk, text, found) to g, key, n and the context bytes; crowded units to windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = _bytes_of(batch.column(1))
            found = batch.column(2)
            flat, edges = found.flatten(), np.asarray(found.offsets) - np.asarray(found.offsets)[0]
            key, n = (np.asarray(flat.field(c)).astype(np.int64) for c in ("key", "n"))
            g, crowded = np.asarray(flat.field("g")).astype(np.int64), np.asarray(flat.field("crowded").cast(pa.int8())) > 0
            at = (key & ((1 << bits) - 1)) + np.repeat(offsets[:-1], np.diff(edges))
            out: tuple[list, ...] = ([], [], [], [])
            size = 0
            for k in range(len(key)):
                raw = data[at[k] : at[k] + n[k] + window - 1]
                if crowded[k]:
                    tokens, starts = _TABLE[raw], np.arange(n[k])
                    out[0].extend(repeats.RangeHash(tokens).runs(window).view(np.int64).tolist())
                    out[1].extend(range(key[k], key[k] + n[k]))
                    out[2].extend([0] * n[k])
                    second = repeats.second_hash(tokens, GRAM)(starts, starts + window - GRAM + 1)
                    out[3].extend(x.tobytes() for x in second)
                    size += 32 * int(n[k])
                else:
                    out[0].append(int(g[k]))
                    out[1].append(int(key[k]))
                    out[2].append(int(n[k]))
                    out[3].append(raw.tobytes())
                    size += 24 + len(raw)
                if size > 4 << 20:
                    yield _context_batch(out)
                    out, size = ([], [], [], []), 0
            if out[0]:
                yield _context_batch(out)

    return run


def _context_batch(out: tuple[list, ...]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int16(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types, strict=True)], names=["g", "key", "n", "context"])


def _later_copies(window: int):
    """From rows sorted by g and key to (key, n): runs of windows that are later copies."""

    def settle(g: list, key: list, n: list, context: list) -> pa.RecordBatch:
        text = np.frombuffer(b"".join(context), np.uint8)
        sizes = np.array(n, np.int64)
        lengths = sizes + window - 1
        tops = np.cumsum(lengths)
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        factors = previous_factors(text, np.repeat(tops, lengths))
        copies = factors[np.repeat(tops - lengths, sizes) + inside] >= window
        starts, counts = [], []
        keys = (np.repeat(np.array(key, np.int64), sizes) + inside)[copies]
        if len(keys):
            unit = np.searchsorted(np.cumsum(sizes), np.flatnonzero(copies), side="right")
            cut = np.flatnonzero((np.diff(keys, prepend=keys[0] - 2) != 1) | (np.diff(unit, prepend=-1) != 0))
            starts, counts = keys[cut], np.diff(cut, append=len(keys))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.asarray(starts, np.int64)), pa.array(np.asarray(counts, np.int16))], names=["key", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = ([], [], [], [])
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if held[0] and row[:2] == (held[0][-1], held[1][-1]):
                    continue
                if size > BATCH and row[0] != held[0][-1]:
                    yield settle(*held)
                    held, size = ([], [], [], []), 0
                for h, v in zip(held, row, strict=True):
                    h.append(v)
                size += len(row[3])
        if held[0]:
            yield settle(*held)

    return run


def _kept(window: int):
    """From (dk, text, found) columns to the digest columns of the result."""

    def of(texts: pa.Array, found: pa.Array) -> pa.Array:
        offsets, data = _bytes_of(texts)
        view = memoryview(data)
        rows = found.to_pylist()
        out: tuple[list, ...] = ([], [], [], [], [])
        for k, packed in enumerate(rows):
            lo, hi = int(offsets[k]), int(offsets[k + 1])
            spans = []
            if packed:
                p = np.array(packed, np.int64)
                spans = repeats.covered(p >> 8, p & 255, window)
            digest, at = hashlib.sha256(), lo
            for a, b in spans:
                digest.update(view[at : lo + a])
                at = lo + b
            digest.update(view[at:hi])
            out[0].append(hi - lo)
            out[1].append(sum(b - a for a, b in spans))
            out[2].append(len(spans))
            out[3].append(digest.hexdigest())
            out[4].append([x for s in spans for x in s])
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
        return pa.StructArray.from_arrays(
            [pa.array(o, t) for o, t in zip(out, types, strict=True)], names=["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        )

    return F.arrow_udf(of, "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept_sha256:string,spans:array<bigint>>")


def suffix_dedup(docs: DataFrame, window: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans.

    ``window`` is at most 200 and above the anchor length.  Null and empty texts
    have no bytes; of rows that share an id, equal ones are one document and
    others follow each other by a hash of their text; a null id comes first; an
    empty table gives no rows.
    """
    if not GRAM < window <= 200:
        raise ValueError(f"window must be above {GRAM} and at most 200")
    d, bits = repeats.ordered(docs)
    rows = d.filter(F.octet_length("text") >= window).select("dk", "text")
    rows = rows.mapInArrow(repeats.unit_rows(_sequences, window, GRAM, bits), repeats.UNITS)
    marked = materialize(repeats.classify(rows, CROWD), "repeat-units")
    open_ = repeats.by_document(marked.filter("not done"), bits, *(F.col(c) for c in ("key", "n", "g", "crowded")))
    contexts = materialize(
        d.select("dk", "text").join(open_, "dk").mapInArrow(
            _contexts(window, bits), "g bigint, key bigint, n smallint, context binary"
        ),
        "repeat-contexts",
    )
    plain = contexts.filter("n > 0").repartition("g").sortWithinPartitions("g", "key")
    factors = plain.mapInArrow(_later_copies(window), "key bigint, n smallint")
    crowded = contexts.filter("n = 0").select("g", F.col("context").alias("g2"), "key")
    least = crowded.groupBy("g", "g2").agg(F.min("key").alias("least"), F.max("key").alias("last")).filter("least < last").drop("last")
    again = crowded.join(materialize(least, "repeat-least"), ["g", "g2"]).filter("key > least").select("key", F.lit(1).cast("smallint").alias("n"))
    removed = marked.filter("done").select("key", "n").unionByName(factors).unionByName(again)
    packed = F.shiftleft(repeats.place(bits), 8).bitwiseOR(F.col("n").cast("bigint"))
    spans = removed.groupBy(F.shiftright("key", bits).alias("dk")).agg(F.collect_list(packed).alias("found"))
    return d.join(spans, "dk", "left").select("doc_id", _kept(window)("text", "found").alias("r")).select("doc_id", "r.*")
