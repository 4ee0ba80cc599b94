"""License scans by diagonal voting, in DataFrame operations alone.

Every rolling k-gram of words of every text is joined by its hash to the places of
the same k-gram in licence templates.  A match votes for its diagonal, the place
in the text less the place in the template: a copy of the template votes for one
diagonal, and words put in or left out move the rest of it to diagonals nearby.
Votes are added up by diagonal, diagonals nearby are merged, and the span that
they cover is verified: a vote counts only if the words are equal, and those that
agree are held against all k-grams of the span and of the template.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from effectforge.llm.common import bare, materialize
from effectforge.llm.license_templates import TEMPLATES

#: The base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Bytes of template k-grams that every task may hold; more are joined by a shuffle.
HELD_BYTES = 64 << 20
KEYS = ["id", "k1", "k2"]


def licence_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased; null text has none."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: w != "")


def grams(words: Column, k: int) -> Column:
    """place and text of every run of ``k`` words."""
    last = F.size(words) - k
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("at"), F.array_join(F.slice(words, i + 1, k), " ").alias("gram")))
    return F.when(last >= 0, runs)


def _templates(spark: SparkSession, templates: Sequence[tuple[str, str]], k: int) -> DataFrame:
    """template, label, t_at, n_grams, hash and t_gram of every k-gram; a template of fewer words has none."""
    rows = [(n, label, text) for n, (label, text) in enumerate(templates)]
    t = spark.createDataFrame(rows, "template int, label string, text string").withColumn("words", licence_words(F.col("text")))
    t = t.select("template", "label", F.greatest(F.size("words") - k + 1, F.lit(0)).alias("n_grams"), F.explode(grams(F.col("words"), k)).alias("g"))
    t = t.select("template", "label", "n_grams", F.col("g.at").alias("t_at"), F.col("g.gram").alias("t_gram"), F.xxhash64("g.gram").alias("hash"))
    t = materialize(t, "license-templates")
    held = t.agg(F.sum(F.octet_length("t_gram") + F.octet_length("label") + 64)).first()[0] or 0
    return F.broadcast(t) if held <= HELD_BYTES else t


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key that rows of the same id and text share."""
    d = bare(docs, "doc_id", "text").select("doc_id", F.col("text").cast("string").alias("text"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return d.select("*", name.alias("id"), F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))


def _agreement(both: Column, span: Column, n_grams: Column) -> Column:
    """Share of the k-grams of span and template that agree."""
    return both / (span + n_grams - both)


def license_spans(keyed: DataFrame, templates: Sequence[tuple[str, str]], k: int, gap: int) -> DataFrame:
    """KEYS, template, label, start, n_words, similarity of every place with a vote of its own that no neighbour outvotes."""
    t = _templates(keyed.sparkSession, templates, k)
    g = keyed.withColumn("words", licence_words(F.col("text"))).select(*KEYS, F.explode(grams(F.col("words"), k)).alias("g"))
    g = g.select(*KEYS, F.col("g.at").alias("at"), F.col("g.gram").alias("gram"), F.xxhash64("g.gram").alias("hash"))
    votes = g.join(t, "hash").filter(F.col("gram") == F.col("t_gram"))
    each = [*KEYS, "template", "label", "n_grams"]
    lines = votes.groupBy(*each, (F.col("at") - F.col("t_at")).alias("diagonal")).agg(F.collect_set("t_at").alias("places"))
    near = Window.partitionBy(*KEYS, "template").orderBy("diagonal").rangeBetween(-gap, gap)
    lines = lines.withColumn("near", F.collect_list(F.struct("diagonal", "places")).over(near))
    reach = F.least(F.lit(gap), F.floor(F.col("n_grams") / 10))
    lines = lines.withColumn("near", F.filter("near", lambda x: F.abs(x["diagonal"] - F.col("diagonal")) <= reach))
    own = F.size("places")
    beaten = F.exists("near", lambda x: (F.size(x["places"]) > own) | ((F.size(x["places"]) == own) & (x["diagonal"] < F.col("diagonal"))))
    merged = F.array_distinct(F.flatten(F.transform("near", lambda x: F.transform(x["places"], lambda p: p + x["diagonal"]))))
    lines = lines.filter(~beaten).select(
        *each,
        own.alias("own"),
        F.transform("places", lambda p: p + F.col("diagonal")).alias("alone"),
        merged.alias("merged"),
        F.size(F.array_distinct(F.flatten(F.transform("near", lambda x: x["places"])))).alias("covered"),
    )
    options = [
        F.struct(
            _agreement(both, F.array_max(ats) - F.array_min(ats) + 1, F.col("n_grams")).alias("similarity"),
            (-F.array_min(ats)).alias("low"),
            (F.array_max(ats) - F.array_min(ats) + k).alias("n_words"),
        )
        for both, ats in ((F.col("own"), F.col("alone")), (F.least(F.col("covered"), F.size("merged")), F.col("merged")))
    ]
    best = lines.select(*each, F.greatest(*options).alias("o"))
    return best.select(
        *KEYS, "template", "label", (-F.col("o.low")).cast("bigint").alias("start"), F.col("o.n_words").cast("bigint").alias("n_words"), "o.similarity"
    )


def _phrase_places(words: Column, phrases: Sequence[tuple[str, str]]) -> Column:
    """place and label of every phrase, wherever its words stand one after the other."""
    found = []
    for phrase, label in phrases:
        parts = phrase.split()
        last = F.size(words) - len(parts)

        def here(i: Column) -> Column:
            same = F.get(words, i) == parts[0]
            for j, part in enumerate(parts[1:], 1):
                same = same & (F.get(words, i + j) == part)
            return same

        at = F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), here))
        at = F.coalesce(at, F.array().cast("array<int>"))
        found.append(F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label"))))
    return F.concat(*found)


def scan_licenses(
    docs: DataFrame,
    *,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    k: int = 5,
    gap: int = 8,
    min_similarity: float = 0.8,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans for each document.

    ``base_labels`` are those of the phrases; ``labels`` has those of templates too of which
    a span shares ``min_similarity`` of the k-grams.  ``score`` is the best similarity of any
    span, 0 where no k-gram of a template is found.  Diagonals are merged up to ``gap`` words
    and a tenth of the template away.  ``spans`` lists the verified ones.

    A null or empty text has no words and no labels; rows that repeat an id are scanned each by
    its own text; equal rows have equal results; of spans that vote alike the lowest counts;
    a template of fewer than ``k`` words is never found; an empty table gives no rows; other columns
    are no matter.  A text must fit Spark's arrays with its words (about 50 million).
    """
    keyed = _keyed(docs)
    spans = license_spans(keyed, templates, k, gap)
    span = F.when(F.col("similarity") >= min_similarity, F.struct("start", "n_words", "label", "template", "similarity"))
    found = spans.groupBy(*KEYS).agg(F.max("similarity").alias("score"), F.array_sort(F.collect_set(span)).alias("spans"))
    has = F.exists(F.array(*[F.lit(p.split()[0]) for p, _ in phrases]), lambda w: F.array_contains("words", w))
    base = keyed.withColumn("words", licence_words(F.col("text")))
    none = F.array().cast("array<struct<at:int,label:string>>")
    base = base.select("doc_id", *KEYS, F.size("words").cast("bigint").alias("n_words"), F.when(has, _phrase_places(F.col("words"), phrases)).otherwise(none).alias("base"))
    base = base.select(
        "doc_id",
        *KEYS,
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["at"])).cast("bigint").alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["at"])).cast("bigint").alias("last_word"),
        F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"]))).alias("own"),
    )
    spans = F.coalesce("spans", F.array().cast(found.schema["spans"].dataType))
    return base.join(found, KEYS, "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("own", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("own", F.transform(spans, lambda s: s["label"]))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        spans.alias("spans"),
    )
