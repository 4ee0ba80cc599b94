"""Quality rules: an isolation forest on per-document rule statistics.

The rule statistics of every whole text are computed in one Arrow pass.  The
forest is grown on a bounded, documented sample of labelled rows; path lengths
over its random splits give each document an anomaly score, and the threshold
on that score is calibrated from the same labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectforge.llm.common import bare, fresh, small_batches

STATS_TYPE = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,"
    "n_repeat_words:bigint,n_upper:bigint,n_marks:bigint>"
)
STAT_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")
_ARROW = pa.struct([(n, pa.int64()) for n in STAT_NAMES])

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_MARKS = b"!?.,;:"
_CONTINUATION = bytes(range(0x80, 0xC0))
_HAS_WORD = re.compile(rb"[^\x20\x09-\x0d]")
WINDOW = 5
PRIOR_WORDS = 30.0


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a ``window``-word sequence that the text holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    grams = list(zip(*(words[k : k + n] for k in range(window))))
    counts = Counter(grams)
    if len(counts) == n:
        return 0
    covered, end = 0, 0
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered += i + window - max(i, end)
            end = i + window
    return covered


def text_stats(raw: bytes) -> tuple[int, ...]:
    """The rule statistics of one text; an empty text gives zeros."""
    words = raw.split()
    seen: set[bytes] = set()
    dup_lines = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup_lines += 1
        elif _HAS_WORD.search(line):
            seen.add(line)
    n = len(raw)
    space = n - len(raw.translate(None, _SPACE))
    tail = n - len(raw.translate(None, _CONTINUATION))
    return (
        len(words),
        n - space - tail,
        n - len(raw.translate(None, _SYMBOLS)),
        dup_lines,
        repeated_words(words),
        n - len(raw.translate(None, _UPPER)),
        n - len(raw.translate(None, _MARKS)),
    )


def _stats_of(texts: pa.Array) -> pa.Array:
    raws = texts.cast(pa.large_binary()).to_pylist()
    table = np.array([text_stats(r or b"") for r in raws], np.int64).reshape(len(raws), len(STAT_NAMES))
    return pa.StructArray.from_arrays(
        [pa.array(np.ascontiguousarray(table[:, k])) for k in range(len(STAT_NAMES))], fields=list(_ARROW)
    )


def _stats_udf(text):
    return F.arrow_udf(_stats_of, STATS_TYPE)(text)


def features(table: np.ndarray) -> np.ndarray:
    """Length-free ratios of the rule statistics, one row per document.

    ``PRIOR_WORDS`` ordinary words are added to each text, so that the ratios
    of a very short one do not stand out by chance.  Repetition is left to the
    base rules, which judge it outright.
    """
    s = {n: table[:, k].astype(float) for k, n in enumerate(STAT_NAMES)}
    words = s["n_words"] + PRIOR_WORDS
    return np.column_stack(
        [
            (s["word_chars"] + 5.0 * PRIOR_WORDS) / words,
            s["n_symbols"] / words,
            s["n_upper"] / (s["word_chars"] + 5.0 * PRIOR_WORDS),
            s["n_marks"] / words,
        ]
    )


def _mean_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a tree of ``n`` rows."""
    if n <= 1:
        return 0.0
    return 2.0 * (np.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


@dataclass
class IsolationForest:
    """Random-split trees as flat arrays; ``threshold`` is the largest kept score."""

    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    sample: int = 256
    threshold: float = float("inf")

    @classmethod
    def grow(cls, x: np.ndarray, good: np.ndarray, n_trees: int, sample: int, odd: float, seed: int) -> IsolationForest:
        """Trees on subsamples of ``x`` in which about ``odd`` of the rows are not good.

        Anomalies are rare in each subsample whatever their share of the labels;
        fewer than two rows give a forest that keeps all.
        """
        forest = cls(sample=max(2, min(sample, len(x))))
        rng = np.random.default_rng(seed)
        if len(x) < 2:
            return forest
        weight = np.ones(len(x))
        if good.any() and not good.all():
            weight[good] = (1 - odd) / good.sum()
            weight[~good] = odd / (~good).sum()
        weight /= weight.sum()
        depth = int(np.ceil(np.log2(forest.sample)))
        for _ in range(n_trees):
            rows = x[rng.choice(len(x), forest.sample, p=weight)]
            feature, split, left, right, path = [], [], [], [], []

            def node(part: np.ndarray, level: int) -> int:
                k = len(feature)
                feature.append(-1)
                split.append(0.0)
                left.append(k)
                right.append(k)
                path.append(level + _mean_path(len(part)))
                low, high = part.min(0), part.max(0)
                usable = np.flatnonzero(high > low)
                if level < depth and len(part) > 1 and len(usable):
                    f = int(rng.choice(usable))
                    cut = rng.uniform(low[f], high[f])
                    below = part[:, f] < cut
                    if below.any() and not below.all():
                        feature[k], split[k] = f, cut
                        left[k] = node(part[below], level + 1)
                        right[k] = node(part[~below], level + 1)
                return k

            node(rows, 0)
            forest.trees.append(
                (np.array(feature), np.array(split), np.array(left), np.array(right), np.array(path))
            )
        return forest

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1]; 0 without trees."""
        if not self.trees or not len(x):
            return np.zeros(len(x))
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, split, left, right, path in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(64):
                f = feature[at]
                going = f >= 0
                if not going.any():
                    break
                below = x[rows, np.maximum(f, 0)] < split[at]
                at = np.where(going, np.where(below, left[at], right[at]), at)
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / _mean_path(self.sample))

    def calibrate(self, scores: np.ndarray, good: np.ndarray, max_false: float) -> None:
        """Largest recall of bad rows with at most ``max_false`` of good ones above."""
        if not good.any() or good.all():
            self.threshold = float("inf")
            return
        kept = np.sort(scores[good])
        allowed = int(np.floor(max_false * len(kept)))
        self.threshold = float(kept[len(kept) - 1 - allowed])


def fit_forest(
    docs: DataFrame,
    labels: DataFrame,
    *,
    max_labelled: int = 8192,
    n_trees: int = 100,
    sample: int = 256,
    odd: float = 0.03,
    max_false: float = 0.002,
    seed: int = 7,
) -> IsolationForest:
    """Grow and calibrate the forest on at most ``max_labelled`` labelled rows.

    The sample is the ``max_labelled`` labels with the smallest hashes of their
    id, so it does not depend on partitioning.  Trees grow on rows that
    pass the base rules, with those labelled bad thinned to ``odd``; rows with a null label or id are not used.
    """
    spark = small_batches(docs).sparkSession
    picked = (
        bare(labels, "doc_id", "quality")
        .filter("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64(F.col("doc_id"), F.lit(seed)), "doc_id")
        .limit(max_labelled)
        .collect()
    )
    if not picked:
        return IsolationForest()
    chosen = spark.createDataFrame([(r[0], int(r[1])) for r in picked], f"doc_id {dict(labels.dtypes)['doc_id']}, quality int")
    chosen = chosen.withColumn("doc_id", F.col("doc_id").try_cast(docs.schema["doc_id"].dataType)).filter("doc_id is not null")
    rows = (
        bare(docs, "doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "quality")
        .agg(F.max("text").alias("text"))
        .select("doc_id", "quality", _stats_udf("text").alias("s"))
        .select("doc_id", "quality", "s.*")
        .collect()
    )
    if not rows:
        return IsolationForest()
    rows.sort(key=lambda r: r[0])
    table = np.array([r[2:] for r in rows], np.int64)
    good = np.array([r[1] for r in rows]) > 0
    x = features(table)
    passed = ~base_failed(table)
    forest = IsolationForest.grow(x[passed], good[passed], n_trees, sample, odd, seed)
    forest.calibrate(forest.score(x[passed]), good[passed], max_false)
    return forest


def base_failed(table: np.ndarray) -> np.ndarray:
    """Under 10 words, or over a fifth of the words in repeated windows."""
    return (table[:, 0] < 10) | (100 * table[:, 4] > 20 * table[:, 0])


def _verdict_udf(forest: IsolationForest):
    @F.arrow_udf("struct<score:double,kept:boolean>")
    def verdict(stats: pa.Array) -> pa.Array:
        table = np.column_stack([np.asarray(stats.field(n)) for n in STAT_NAMES]).reshape(-1, len(STAT_NAMES))
        score = forest.score(features(table))
        return pa.StructArray.from_arrays(
            [pa.array(score), pa.array(~base_failed(table) & (score <= forest.threshold))], names=["score", "kept"]
        )

    return verdict


def judge(docs: DataFrame, forest: IsolationForest, into: str) -> DataFrame:
    """``docs`` with a struct column ``into``: the statistics, score and verdict."""
    stats, verdict = fresh(small_batches(docs), "stats"), fresh(docs, "verdict")
    d = docs.withColumn(stats, _stats_udf(F.col("text").cast("string")))
    d = d.withColumn(verdict, _verdict_udf(forest)(F.col(stats)))
    s = F.col(stats)
    fields = [s[n].alias(n) for n in STAT_NAMES] + [
        F.col(verdict)["score"].alias("score"),
        ((s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])).alias("base_failed"),
        F.col(verdict)["kept"].alias("kept"),
    ]
    return d.withColumn(into, F.struct(*fields)).drop(stats, verdict)


def quality_rules(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """One row per document: statistics, anomaly score, ``base_failed``, ``kept``.

    Null and empty texts have no words and fail the base rules; repeated rows
    each get their own row; an empty table gives an empty result; without
    usable labels only the base rules decide; columns beside ``doc_id`` and
    ``text`` are ignored.
    """
    forest = fit_forest(docs, labels, **params)
    d = bare(docs, "doc_id", "text")
    return judge(d, forest, "q").select(
        "doc_id",
        *[f"q.{n}" for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "q.base_failed",
        "q.kept",
        F.col("q.score").alias("anomaly_score"),
    )


def drop_rejected(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The documents that pass, with the columns of ``docs``."""
    forest = fit_forest(docs, labels, **params)
    into = fresh(docs, "quality")
    return judge(docs, forest, into).filter(F.col(into)["kept"]).drop(into)
