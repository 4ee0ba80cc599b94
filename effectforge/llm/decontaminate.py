"""Benchmark decontamination as a prefix-filtered set join.

Every benchmark item becomes windows of consecutive words, and each window a set
of word shingles.  Exact containment of a window needs all of its shingles, so
one of them, the rarest by document frequency over the whole corpus, is enough
as its join prefix.  A document position that holds a prefix shingle gives one
candidate start (the positional bound); starts that would leave the document
fall to the length bound; the survivors are verified word by word.

The benchmark side is sent to the tasks in blocks of a bounded size: its bytes
are summed first.  A block is one buffer of words and sorted arrays of 64-bit keys
that point into it, a few times its text.  A larger benchmark takes more passes over
the documents, each adding to the spans that the row already carries, without a
shuffle; rows are written out before more blocks than a task should hold.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectforge.llm.common import bare, fresh, materialize, small_batches
from effectforge.llm.repeats import RangeHash

#: A-Z lower-cased, letters, digits and all non-ASCII bytes kept, the rest a space.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
#: Words of documents that are looked up at once, and blocks that one task holds.
CHUNK, HELD_BLOCKS = 1 << 19, 4
#: Candidate places that are looked at together.
CANDIDATES = 1 << 20
RESULT = "struct<n_words:bigint,spans:array<bigint>,items:array<string>>"


def fold_words(raw: bytes) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII characters."""
    return raw.translate(_FOLD).split()


def word_tokens(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class WindowIndex:
    """Windows of one block of items, found by their prefix shingles.

    An item of fewer words than a window is one window, one without words is none.
    Windows are places in one list of words; they are compared by the words themselves.
    Windows of equal words are one, with all items that have it, so that a text that repeats
    itself has no more of them than it has different ones.
    """

    def __init__(self, items: list[tuple[str | None, bytes]], window: int, shingle: int) -> None:
        self.shingle = shingle
        owners: dict[bytes, set[str]] = {}
        for item_id, raw in items:
            if text := b" ".join(fold_words(raw)):
                owners.setdefault(text, set()).update(() if item_id is None else (item_id,))
        self.owners = [sorted(ids) for ids in owners.values()]
        self.buffer = b" ".join(owners)
        words = self.buffer.split()
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(lengths + 1) - 1
        self.begins = self.ends - lengths
        counts = np.array([text.count(b" ") + 1 for text in owners], np.int64)
        self.tops = np.cumsum(counts)
        size = np.minimum(counts, window)
        per = counts - size + 1
        #: Every window's first word and number of words.
        self.start = np.repeat(self.tops - counts - (np.cumsum(per) - per), per) + np.arange(per.sum())
        self.size = np.repeat(size, per).astype(np.int16)
        ranged = RangeHash(word_tokens(words))
        self._merge(ranged, np.repeat(np.arange(len(owners)), per), words)
        #: The hash of the shingle at each word, for every size of shingle that its windows have.
        width = np.minimum(self.size, shingle).astype(np.int64)
        self.sizes = np.unique(width).tolist()
        self._keys_at = {}
        for k in self.sizes:
            runs = ranged.runs(k)
            self._keys_at[k] = np.concatenate([runs, np.zeros(len(words) - len(runs), np.uint64)])
        self.windows = {k: np.flatnonzero(width == k) for k in self.sizes}
        held = []
        for k, w in self.windows.items():
            held += [self._keys_at[k][self.start[w[self.size[w] >= k + j]] + j] for j in range(window - k + 1)]
        self.keys = np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)

    def _merge(self, ranged: RangeHash, item: np.ndarray, words: list[bytes]) -> None:
        """Keep one window of each text; ``items_of`` gives the numbers of the items that have it."""
        digest = ranged(self.start, self.start + self.size) if len(self.start) else np.zeros(0, np.uint64)
        order = np.argsort(digest, kind="stable")
        first, size, digest = self.start[order], self.size[order], digest[order]
        new = np.ones(len(order), bool)
        new[1:] = (digest[1:] != digest[:-1]) | (size[1:] != size[:-1])
        leads = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        for k in np.flatnonzero(~new).tolist():
            a, b, n = int(first[leads[k]]), int(first[k]), int(size[k])
            if words[a : a + n] != words[b : b + n]:
                new[k] = True  # two texts of one hash: this one stays apart
        group = np.cumsum(new) - 1
        kept = order[new]
        wide = int(item.max(initial=0)) + 1
        pairs = np.unique(group * wide + item[order])
        self.items_of = (pairs % wide).astype(np.int32)
        self.items_at = np.searchsorted(pairs // wide, np.arange(len(kept) + 1)).astype(np.int32)
        self.start, self.size, self.digest = self.start[kept], self.size[kept], digest[new]

    def __len__(self) -> int:
        return len(self.start)

    def _lookup(self, raws: list[bytes]):
        """For chunks of documents: the first one's number, words of each, all words, their hashes, ends, and places of known shingles with their keys' numbers."""
        first, held, size = 0, [], 0
        for k, raw in enumerate(raws):
            held.append(fold_words(raw))
            size += len(held[-1])
            if size >= CHUNK or k == len(raws) - 1:
                words = [w for ws in held for w in ws]
                tops = np.cumsum([len(ws) for ws in held])
                ranged = RangeHash(word_tokens(words))
                at, key = [], []
                for n in self.sizes:
                    runs = ranged.runs(n) if len(words) >= n else np.zeros(0, np.uint64)
                    near = np.minimum(np.searchsorted(self.keys, runs), max(len(self.keys) - 1, 0))
                    hit = np.flatnonzero(self.keys[near] == runs) if len(self.keys) else np.zeros(0, np.int64)
                    hit = hit[hit + n <= tops[np.searchsorted(tops, hit, side="right")]]
                    at.append(hit)
                    key.append(near[hit])
                yield first, held, words, ranged, tops, np.concatenate([*at, np.zeros(0, np.int64)]), np.concatenate([*key, np.zeros(0, np.int64)])
                first, held, size = k + 1, [], 0

    def held(self, raws: list[bytes]) -> list[np.ndarray]:
        """Numbers of the block's shingles that each document holds."""
        out: list[np.ndarray] = []
        for _, held, _, _, tops, at, key in self._lookup(raws):
            of = np.searchsorted(tops, at, side="right")
            known = np.unique(np.stack([of, key], 1), axis=0)
            cut = np.searchsorted(known[:, 0], np.arange(1, len(held)))
            out += np.split(known[:, 1], cut)
        return out

    def choose(self, frequency: np.ndarray) -> None:
        """Keep of each window the shingle that the fewest documents hold, ties by number and place."""
        best_key, best_at = np.zeros(len(self), np.int64), np.zeros(len(self), np.int16)
        for k, windows in self.windows.items():
            least = np.full(len(windows), np.iinfo(np.int64).max)
            for j in range(int(self.size[windows].max(initial=0)) - k + 1):
                some = np.flatnonzero(self.size[windows] >= k + j)
                key = np.searchsorted(self.keys, self._keys_at[k][self.start[windows[some]] + j])
                cost = frequency[key] * (len(self.keys) + 1) + key
                better = cost < least[some]
                least[some[better]] = cost[better]
                best_key[windows[some[better]]] = key[better]
                best_at[windows[some[better]]] = j
        order = np.argsort(best_key, kind="stable")
        kept, begin = np.unique(best_key[order], return_index=True)
        self.keys = self.keys[kept]
        self.first = np.append(begin, len(order))
        self.start, self.size, self.at = self.start[order].astype(np.int32), self.size[order], best_at[order]
        self.digest, self.place = self.digest[order], order.astype(np.int32)
        self.windows, self._keys_at = {}, {}

    def match(self, raws: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """Number of words, word spans of all verified occurrences, and the items, of each document."""
        out: list[tuple[int, list[tuple[int, int]], set[str]]] = []
        for first, held, words, ranged, tops, at, key in self._lookup(raws):
            out += [(len(ws), [], set()) for ws in held]
            base = tops - np.array([len(ws) for ws in held], np.int64)
            many = self.first[key + 1] - self.first[key]
            found: set[tuple[int, int]] = set()
            # A shingle that many windows hold costs time, not memory.
            parts = np.searchsorted(np.cumsum(many) - many, np.arange(0, many.sum(), CANDIDATES))
            for lo, hi in zip(parts.tolist(), [*parts[1:].tolist(), len(many)], strict=False):
                some = many[lo:hi]
                window = np.repeat(self.first[key[lo:hi]] - (np.cumsum(some) - some), some) + np.arange(some.sum())
                of = np.repeat(np.searchsorted(tops, at[lo:hi], side="right"), some)
                begin = np.repeat(at[lo:hi], some) - self.at[window]
                end = begin + self.size[window]
                fits = np.flatnonzero((begin >= base[of]) & (end <= tops[of]))
                fits = fits[ranged(begin[fits], end[fits]) == self.digest[window[fits]]]
                for k, w, s, e in zip(of[fits].tolist(), window[fits].tolist(), begin[fits].tolist(), end[fits].tolist(), strict=True):
                    there = int(self.start[w])
                    if b" ".join(words[s:e]) == self.buffer[self.begins[there] : self.ends[there + e - s - 1]]:
                        b = int(base[k])
                        out[first + k][1].append((s - b, e - b))
                        found.add((k, w))
            for k, w in found:
                place = self.place[w]
                for item in self.items_of[self.items_at[place] : self.items_at[place + 1]].tolist():
                    out[first + k][2].update(self.owners[item])
        return out


def merge_spans(spans: Iterable[tuple[int, int]]) -> list[int]:
    """Flat start and end of the union of spans."""
    flat: list[int] = []
    for start, end in sorted(spans):
        if flat and start <= flat[-1]:
            flat[-1] = max(flat[-1], end)
        else:
            flat += [start, end]
    return flat


def _block_udf(index: WindowIndex):
    def find(texts: pa.Array, before: pa.Array) -> pa.Array:
        raws = [r or b"" for r in texts.cast(pa.large_binary()).to_pylist()]
        counts, all_spans, all_items = [], [], []
        for (n, spans, items), old in zip(index.match(raws), before.to_pylist(), strict=True):
            flat = old["spans"] if old else []
            counts.append(n)
            all_spans.append(merge_spans([*spans, *zip(flat[::2], flat[1::2], strict=True)]))
            all_items.append(sorted(items | set(old["items"] if old else ())))
        return pa.StructArray.from_arrays(
            [
                pa.array(counts, pa.int64()),
                pa.array(all_spans, pa.list_(pa.int64())),
                pa.array(all_items, pa.list_(pa.string())),
            ],
            names=["n_words", "spans", "items"],
        )

    return F.arrow_udf(find, RESULT)


def _held_udf(index: WindowIndex):
    def held(texts: pa.Array) -> pa.Array:
        return pa.array(index.held([r or b"" for r in texts.cast(pa.large_binary()).to_pylist()]), pa.list_(pa.int64()))

    return F.arrow_udf(held, "array<bigint>")


def benchmark_blocks(benchmark: DataFrame, block_bytes: int) -> Iterable[list[tuple[str | None, bytes]]]:
    """The items with a text, in blocks of about ``block_bytes`` on the driver."""
    b = bare(benchmark, "item_id", "text").filter("text is not null").select(
        F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")
    )
    total = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    for k in range(n):
        part = b.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else b
        rows = part.distinct().collect()
        if rows:
            yield sorted(((r[0], r[1].encode()) for r in rows), key=lambda x: (x[0] or "", x[1]))


def find_windows(
    docs: DataFrame, benchmark: DataFrame, into: str, *, window: int = 10, shingle: int = 5, block_bytes: int = 16 << 20
) -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, merged hit spans, item ids.

    Null and empty texts have no words and no hits; an empty benchmark hits
    nothing; items with a null id hit words but are not listed; rows with equal
    item ids count as one item.  Texts of any length, repetitive ones too, take time and
    memory in proportion to it.
    """
    texts = bare(small_batches(docs), "text").select(F.col("text").cast("string").alias("text"))
    carried, text, blocks = docs.withColumn(into, F.lit(None).cast(RESULT)), F.col("text").cast("string"), 0
    for items in benchmark_blocks(benchmark, block_bytes):
        index = WindowIndex(items, window, shingle)
        if not len(index):
            continue
        if blocks and blocks % HELD_BLOCKS == 0:
            carried = materialize(carried, "benchmark-spans")
        blocks += 1
        counted = texts.select(F.explode(_held_udf(index)("text")).alias("s")).groupBy("s").count().toArrow()
        frequency = np.zeros(len(index.keys), np.int64)
        frequency[np.asarray(counted["s"])] = np.asarray(counted["count"])
        index.choose(frequency)
        carried = carried.withColumn(into, _block_udf(index)(text, F.col(into)))
    if not blocks:
        index = WindowIndex([], window, shingle)
        index.choose(np.zeros(0, np.int64))
        carried = carried.withColumn(into, _block_udf(index)(text, F.col(into)))
    return carried


def contamination(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """One row per document: words, hit words, items with an occurring window."""
    d = find_windows(bare(docs, "doc_id", "text"), benchmark, "hits", **params)
    spans, items = F.col("hits.spans"), F.col("hits.items")
    n_hit = F.aggregate(
        F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("bigint"), lambda a, x: a + x
    )
    return d.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        items.alias("item_ids"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The documents without any benchmark window, with the columns of ``docs``."""
    into = fresh(docs, "hits")
    return find_windows(docs, benchmark, into, **params).filter(F.size(F.col(into)["spans"]) == 0).drop(into)
