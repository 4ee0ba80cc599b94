"""Fill-in-middle transformation by a parallel automaton scan.

An automaton reads UTF-8 bytes; at each byte it tells whether a unit (a code point,
say) begins there and whether a marker ends there.  Texts are cut into chunks of a
fixed number of bytes.  Nobody knows in which state the automaton enters a chunk,
so each chunk gives, for every state, the state in which it leaves and what it
counts on the way.  Such functions compose associatively: inside a chunk from
lanes of ``LANE`` bytes, which numpy takes side by side, and above it in a tree
of fan-out ``FANOUT`` over the chunks of a text.  The root says how many units the
text has, so the cuts are known by number; a cut then goes down the tree to the one
child in which its unit begins, with the state that enters there, and is found in
that chunk alone.  A text of one chunk is a tree of one leaf.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectforge.llm.common import bare, materialize, small_batches

LANE, FANOUT, CHUNK = 128, 256, 1 << 16
#: Bytes that are scanned at once.
SCANNED = 1 << 22
#: The markers before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
FUNCTION = "struct<ends:array<int>,units:array<bigint>,hits:array<bigint>>"


class Automaton:
    """A table of states by bytes, with what begins (a unit) or ends (a marker) at each.

    ``begins(state, byte)`` of the unit automaton gives its next state and whether a
    unit begins at that byte; it runs beside the search for the markers.
    """

    def __init__(self, markers: Iterable[str], begins=lambda state, byte: (0, byte & 0xC0 != 0x80)) -> None:
        words = [m.encode() for m in markers]
        heads = sorted({w[:k] for w in words for k in range(len(w))} | {b""})

        def follow(head: bytes, byte: int) -> tuple[bytes, bool]:
            seen = head + bytes([byte])
            hit = any(seen.endswith(w) for w in words)
            return max((h for h in heads if seen.endswith(h)), key=len), hit

        states, table = [(0, b"")], []
        for unit, head in states:
            row = []
            for byte in range(256):
                to, begun = begins(unit, byte)
                head_to, hit = follow(head, byte)
                if (to, head_to) not in states:
                    states.append((to, head_to))
                row.append(states.index((to, head_to)) | int(begun) << 8 | int(hit) << 40)
            table.append([*row, states.index((unit, head))])
        #: Next state, units from bit 8 and hits from bit 40, for 256 bytes and the empty place.
        self.table = np.array(table, np.int64)
        self.size = len(states)

    @classmethod
    def code_points(cls, markers: Iterable[str] = MARKERS) -> Automaton:
        """Units are code points."""
        return cls(markers)

    @classmethod
    def words(cls, markers: Iterable[str] = MARKERS) -> Automaton:
        """Units are words with the white space (ASCII) after them."""
        space = {9, 10, 11, 12, 13, 32}
        return cls(markers, lambda state, byte: (0, False) if byte in space else (1, state == 0))

    def lanes(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all pieces in lanes, a row each, and the number of lanes of each piece."""
        many = np.array([-(-len(p) // LANE) for p in pieces], np.int64)
        symbols = np.full(int(many.sum()) * LANE, 256, np.int16)
        at = (np.cumsum(many) - many) * LANE
        for piece, first in zip(pieces, at.tolist(), strict=True):
            symbols[first : first + len(piece)] = np.frombuffer(piece, np.uint8)
        return symbols.reshape(-1, LANE), many

    def run(self, symbols: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States at the end of each lane and packed counts, for entry states of shape (lanes, k)."""
        state, counts = entry, np.zeros(entry.shape, np.int64)
        flat = self.table.ravel()
        for column in symbols.T:
            step = flat[state * 257 + column[:, None]]
            state = step & 255
            counts += step >> 8
        return state, counts

    def compose(self, first, second):
        """The function that is ``first``, then ``second``, row by row."""
        (ends, counts), (then, more) = first, second
        return np.take_along_axis(then, ends, 1), counts + np.take_along_axis(more, ends, 1)

    def functions(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """End state and packed counts of each piece for every entry state."""
        symbols, many = self.lanes(pieces)
        ends, counts = self.run(symbols, np.tile(np.arange(self.size), (len(symbols), 1)))
        piece = np.repeat(np.arange(len(pieces)), many)
        while len(piece) > np.count_nonzero(many):
            place = np.arange(len(piece)) - np.searchsorted(piece, piece)
            left = np.flatnonzero(place % 2 == 0)
            joined = left[np.append(piece[1:], -1)[left] == piece[left]]
            a, b = self.compose((ends[joined], counts[joined]), (ends[joined + 1], counts[joined + 1]))
            ends[joined], counts[joined] = a, b
            ends, counts, piece = ends[left], counts[left], piece[left]
        out = np.tile(np.arange(self.size), (len(pieces), 1)), np.zeros((len(pieces), self.size), np.int64)
        out[0][piece], out[1][piece] = ends, counts
        return out

    def locate(self, pieces: list[bytes], entry: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Offsets of the units of the given ranks, from 0, in pieces entered in the given states; the length where there are no more."""
        symbols, many = self.lanes(pieces)
        first = np.cumsum(many) - many
        ends, counts = self.run(symbols, np.tile(np.arange(self.size), (len(symbols), 1)))
        units = counts & 0xFFFFFFFF
        state, rank = entry.copy(), ranks.copy()
        lane = np.full(len(pieces), -1)
        open_ = np.arange(len(pieces))
        for k in range(int(many.max(initial=0))):
            open_ = open_[many[open_] > k]
            here = first[open_] + k
            inside = units[here, state[open_]]
            found = rank[open_] < inside
            lane[open_[found]] = k
            open_, here, inside = open_[~found], here[~found], inside[~found]
            rank[open_] -= inside
            state[open_] = ends[here, state[open_]]
        out = np.array([len(p) for p in pieces], np.int64)
        some = np.flatnonzero(lane >= 0)
        out[some] = lane[some] * LANE
        here, state, rank = symbols[first[some] + lane[some]], state[some], rank[some]
        waiting = np.ones(len(some), bool)
        for k in range(LANE):
            step = self.table[state, here[:, k]]
            begun = (step >> 8 & 1).astype(bool)
            done = waiting & begun & (rank == 0)
            out[some[done]] += k
            waiting &= ~done
            rank -= begun
            state = step & 255
        return out


def _slices(sizes: list[int]) -> Iterator[slice]:
    """Runs of neighbours of about ``SCANNED`` bytes."""
    first = held = 0
    for k, size in enumerate(sizes):
        held += size
        if held >= SCANNED or k == len(sizes) - 1:
            yield slice(first, k + 1)
            first, held = k + 1, 0


def _function_udf(automaton: Automaton):
    def scan(texts: pa.Array) -> pa.Array:
        pieces, parts = [t or b"" for t in texts.to_pylist()], []
        for some in _slices([len(p) for p in pieces]):
            ends, counts = automaton.functions(pieces[some])
            rows = [pa.array(x.ravel(), t) for x, t in ((ends, pa.int32()), (counts & 0xFFFFFFFF, pa.int64()), (counts >> 32, pa.int64()))]
            at = pa.array(np.arange(len(ends) + 1) * automaton.size, pa.int32())
            parts.append(pa.StructArray.from_arrays([pa.ListArray.from_arrays(at, r) for r in rows], names=["ends", "units", "hits"]))
        return pa.concat_arrays(parts) if parts else pa.array([], _arrow_function())

    return F.arrow_udf(scan, FUNCTION)


def _arrow_function() -> pa.DataType:
    return pa.struct([("ends", pa.list_(pa.int32())), ("units", pa.list_(pa.int64())), ("hits", pa.list_(pa.int64()))])


def _locate_udf(automaton: Automaton, size: int):
    """Byte offset of a unit in a text, given its chunk's number, entry state and rank; null where the unit is null."""

    def locate(texts: pa.Array, chunk: pa.Array, state: pa.Array, rank: pa.Array) -> pa.Array:
        wanted = np.flatnonzero(np.asarray(rank.is_valid()))
        no, state, rank = (np.asarray(c.fill_null(0), np.int64)[wanted] for c in (chunk, state, rank))
        pieces = [(texts[k].as_py() or b"")[n * size : (n + 1) * size] for k, n in zip(wanted.tolist(), no.tolist(), strict=True)]
        out = np.zeros(len(texts), np.int64)
        for some in _slices([len(p) for p in pieces]):
            out[wanted[some]] = no[some] * size + automaton.locate(pieces[some], state[some], rank[some])
        gone = np.ones(len(texts), bool)
        gone[wanted] = False
        return pa.array(out, pa.int64(), mask=gone)

    return F.arrow_udf(locate, "bigint")


def _chunker(size: int):
    """Chunks of texts, a row each, in batches of bounded size."""

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("raw")
            for k in range(batch.num_rows):
                raw = text[k].as_py()
                numbers = range(-(-len(raw) // size))
                for first in range(0, len(numbers), max(1, SCANNED // size)):
                    some = numbers[first : first + max(1, SCANNED // size)]
                    row = batch.slice(k, 1).drop_columns(["raw"]).take(pa.array([0] * len(some), pa.int64()))
                    yield row.append_column("no", pa.array(some, pa.int64())).append_column(
                        "piece", pa.array([raw[n * size : (n + 1) * size] for n in some], pa.binary())
                    )

    return chunks


def _then(acc: Column, f: Column) -> Column:
    """The function ``acc``, then ``f``."""
    return F.struct(
        F.transform(acc["ends"], lambda e: f["ends"][e]).alias("ends"),
        F.transform(acc["ends"], lambda e, i: acc["units"][i] + f["units"][e]).alias("units"),
        F.transform(acc["ends"], lambda e, i: acc["hits"][i] + f["hits"][e]).alias("hits"),
    )


def _identity(automaton: Automaton) -> Column:
    none = f"array_repeat(0L, {automaton.size})"
    return F.expr(f"named_struct('ends', sequence(0, {automaton.size - 1}), 'units', {none}, 'hits', {none})")


def _child(acc: Column, x: Column) -> Column:
    """Go on to the next child as long as the unit begins in none so far."""
    inside = x["f"]["units"][acc["state"]]
    there = F.struct(x["no"].alias("no"), acc["state"].alias("state"), acc["rank"].alias("rank"), F.lit(True).alias("found"))
    on = F.struct(x["no"].alias("no"), x["f"]["ends"][acc["state"]].alias("state"), (acc["rank"] - inside).alias("rank"), F.lit(False).alias("found"))
    return F.when(acc["found"], acc).when(acc["rank"] < inside, there).otherwise(on)


def chunk_trees(texts: DataFrame, keys: list[str], automaton: Automaton, chunk_bytes: int) -> list[DataFrame]:
    """Trees over the chunks of ``texts`` (``keys``, raw): tables from the leaves' parents to the roots.

    Each has ``keys``, ``no``, ``children`` (no, f) in order and their composition ``f``.
    Chunks go to all tasks before they are scanned, however long one text is.
    """
    longest = texts.agg(F.max(F.octet_length("raw"))).first()[0] or 0
    schema = texts.select(*keys).withColumn("no", F.lit(0).cast("bigint")).withColumn("piece", F.lit(b"")).schema
    chunks = texts.mapInArrow(_chunker(chunk_bytes), schema).repartition(*keys, "no")
    level = chunks.select(*keys, "no", _function_udf(automaton)("piece").alias("f"))
    levels, width = [], -(-longest // chunk_bytes)
    while True:
        width = -(-width // FANOUT)
        by = [F.col(k) for k in keys]
        node = F.array_sort(F.collect_set(F.struct("no", "f"))).alias("children")
        nodes = level.groupBy(*by, F.floor(F.col("no") / FANOUT).alias("parent")).agg(node)
        nodes = nodes.select(*keys, F.col("parent").alias("no"), "children")
        f = F.aggregate(F.transform("children", lambda c: c["f"]), _identity(automaton), _then)
        levels.append(materialize(nodes.withColumn("f", f), "infill-level"))
        if width <= 1:
            return levels
        level = levels[-1].select(*keys, "no", "f")


def descend(wanted: DataFrame, levels: list[DataFrame], keys: list[str]) -> DataFrame:
    """``wanted`` (``keys``, rank, others) with the chunk ``no`` in which the unit of that rank begins, its entry ``state``, and the ``rank`` in it."""
    d = wanted.withColumn("no", F.lit(0).cast("bigint")).withColumn("state", F.lit(0))
    for level in reversed(levels):
        start = F.struct(F.lit(-1).cast("bigint").alias("no"), F.col("state"), F.col("rank"), F.lit(False).alias("found"))
        found = d.join(level.select(*keys, "no", "children"), [*keys, "no"]).withColumn("c", F.aggregate("children", start, _child))
        d = found.select(*[c for c in wanted.columns if c != "rank"], *[F.col(f"c.{x}").alias(x) for x in ("no", "state", "rank")])
    return d


def fill_in_middle(
    docs: DataFrame,
    *,
    markers: tuple[str, str, str] = MARKERS,
    plain_percent: int = 10,
    spm_percent: int = 20,
    seed: int = 1,
    unit: str = "code_points",
    chunk_bytes: int = CHUNK,
) -> DataFrame:
    """doc_id, text, n, form, prefix_chars, middle_chars, output for each document.

    A text of n units (``code_points`` or ``words``) is cut after two numbers of units
    drawn from a hash of seed and doc_id; ``output`` puts the middle last, behind its
    marker, with prefix and suffix in either order.  ``plain_percent`` of the texts,
    empty ones and those that hold a marker stay as they are.

    A null text is empty and a null doc_id is drawn like an empty one; rows that repeat an
    id have cuts of their own; very long texts are cut into chunks of ``chunk_bytes`` that all
    tasks share; an empty table gives no rows; other columns, of any name, are no matter.
    """
    automaton = getattr(Automaton, unit)(markers)
    if any(m[0] in n[1:] for m in markers for n in markers) or len(set(markers)) < 3:
        raise ValueError("the first character of a marker may be in none but first")
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    d = small_batches(bare(docs, "doc_id", "text")).select("doc_id", name.alias("id"), raw.alias("raw"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id")).cast("binary"), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]

    def planned(rows: DataFrame, f: str) -> DataFrame:
        n, hits = F.col(f)["units"][0], F.col(f)["hits"][0]
        plain = (n == 0) | (hits > 0) | (h[2] % 100 >= 100 - plain_percent)
        rows = rows.withColumns({"n": n, "form": F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")})
        cut = [F.when(F.col("form") != "plain", h[k] % (F.col("n") + 1)) for k in (0, 1)]
        return rows.withColumns({"a": F.least(*cut), "b": F.greatest(*cut)}).drop(f)

    def ranked(c: str) -> Column:
        return F.when(F.col(c) < F.col("n"), F.col(c))

    one = planned(d.filter(F.octet_length("raw") <= chunk_bytes).withColumn("f", _function_udf(automaton)("raw")), "f")
    for c in ("a", "b"):
        one = one.withColumns({f"{c}_no": F.lit(0).cast("bigint"), f"{c}_state": F.lit(0), f"{c}_rank": ranked(c)})

    keys = ["id", "k1", "k2"]
    many = d.filter(F.octet_length("raw") > chunk_bytes).withColumns({"k1": F.xxhash64("raw"), "k2": F.xxhash64(F.lit(seed), "raw")})
    levels = chunk_trees(many.select(*keys, "raw"), keys, automaton, chunk_bytes)
    roots = planned(levels[-1].filter("no = 0").select(*keys, "f"), "f")
    cuts = roots.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("cut"), ranked(c).alias("rank")) for c in ("a", "b")])).alias("c"))
    cuts = descend(cuts.select(*keys, "c.cut", "c.rank").filter("rank is not null"), levels, keys)
    pick = [F.max(F.when(F.col("cut") == c, F.col(x))).alias(f"{c}_{x}") for c in ("a", "b") for x in ("no", "state", "rank")]
    many = many.join(roots.join(cuts.groupBy(*keys).agg(*pick), keys, "left"), keys).select(*one.columns)

    d, find = one.unionByName(many), _locate_udf(automaton, chunk_bytes)
    whole = F.octet_length("raw").cast("bigint")
    d = d.withColumns({f"{c}_at": find("raw", f"{c}_no", f"{c}_state", f"{c}_rank") for c in ("a", "b")})
    d = d.withColumns({f"{c}_at": F.coalesce(f"{c}_at", whole) for c in ("a", "b")})
    begin, end = F.col("a_at"), F.col("b_at")
    part = [F.substring(F.col("raw"), at.cast("int") + 1, n.cast("int")) for at, n in ((F.lit(0), begin), (begin, end - begin), (end, whole - end))]
    prefix, middle, suffix = (x.cast("string") for x in part)
    mark = [F.lit(m) for m in markers]
    text = F.col("raw").cast("string")
    output = (
        F.when(F.col("form") == "plain", text)
        .when(F.col("form") == "psm", F.concat(mark[0], prefix, mark[1], suffix, mark[2], middle))
        .otherwise(F.concat(mark[1], suffix, mark[0], prefix, mark[2], middle))
    )
    return d.select(
        "doc_id", text.alias("text"), "n", "form", F.col("a").alias("prefix_chars"), (F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output")
    )


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that :func:`fill_in_middle` made ``output`` of.

    No text holds a marker, so each marker is where it is found first.
    """
    p, s, m = markers
    first, second = F.when(form == "psm", F.lit(p)).otherwise(s), F.when(form == "psm", F.lit(s)).otherwise(p)
    rest = F.split_part(output, F.lit(m), F.lit(2))
    head = F.split_part(output, F.lit(m), F.lit(1))
    a = F.substr(F.split_part(head, second, F.lit(1)), F.length(first) + 1)
    b = F.split_part(head, second, F.lit(2))
    return F.when(form == "plain", output).when(form == "psm", F.concat(a, rest, b)).otherwise(F.concat(b, rest, a))
