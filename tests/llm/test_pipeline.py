"""Each stage of the pipeline against brute force, on what the stage before it kept."""

import pytest
from pyspark.sql import functions as F
from test_documents import shares, words
from test_similar import brute

import __spark_entry__
import corpus_pipeline
from effectforge.llm import quality


def cells(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """name -> (input, output) of every stage, written and read again."""
    out, docs = {}, spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, sf).write.parquet(path)
        now = spark.read.parquet(path)
        out[name] = (docs, now)
        docs = now
    return out


def test_shape(spark, sf, stages):
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert [list(now.columns) for _, now in stages.values()][:-1] == [columns] * 4
    assert list(stages["mix"][1].columns) == [*columns, "copies"]
    whole = __spark_entry__.queries()["pipeline"](spark, sf)
    assert sorted(map(tuple, whole.select("doc_id", "text", "copies").collect())) == sorted(
        map(tuple, stages["mix"][1].select("doc_id", "text", "copies").collect())
    )


def test_quality_stage(spark, sf, stages):
    before, after = stages["quality"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r["doc_id"] for r in quality.quality_rules(before, labels).filter("kept").collect()}
    assert set(cells(after)) == kept
    assert {i for i, t in cells(before).items() if len(words(t)) < 10} & kept == set()


def test_line_stage(stages):
    before, after = cells(stages["lines"][0]), cells(stages["lines"][1])
    site = {r["doc_id"]: r["source"] for r in stages["lines"][0].collect()}
    spread, first = {}, {}
    for i, t in sorted(before.items()):
        for line in t.split("\n"):
            if words(line):
                spread.setdefault(line, set()).add(site[i])
                first.setdefault(line, i)
    expected = {}
    for i, t in before.items():
        kept, seen = [], set()
        for line in t.split("\n"):
            if len(spread.get(line, ())) < 10 or first[line] == i and line not in seen:
                kept.append(line)
            seen.add(line)
        expected[i] = "\n".join(kept)
    assert after == expected


def test_near_duplicate_stage(stages):
    rows = sorted(cells(stages["simhash"][0]).items())
    groups = {}
    for (i, _), c in zip(rows, brute(rows), strict=True):
        groups.setdefault(c, []).append(i)
    assert set(cells(stages["simhash"][1])) == {min(g) for g in groups.values()}


def test_decontamination_stage(spark, sf, stages):
    import re

    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = fold(r["text"])
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    clean = {
        i
        for i, t in cells(stages["decontaminate"][0]).items()
        if not any(tuple(w[k : k + n]) in windows for w in [fold(t)] for n in sizes for k in range(len(w) - n + 1))
    }
    assert set(cells(stages["decontaminate"][1])) == clean


def test_mix_stage(stages):
    rows, sizes, largest = stages["mix"][0].collect(), {}, {}
    for r in rows:
        n = len(words(r["text"]))
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
        largest[r["source"]] = max(largest.get(r["source"], 0), n)
    taken = dict.fromkeys(sizes, 0)
    for r in stages["mix"][1].collect():
        assert 1 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * len(words(r["text"]))
    for s, target in shares(sizes).items():
        assert abs(taken[s] - target) <= largest[s]


ODD = [
    (None, None, None, "x", 1),
    (None, "a text with a null id and enough words to be kept by the rules of quality here", "s", None, 2),
    (1, "", "s", "x", 3),
    (2, "the same row comes twice and has enough words to be kept by the rules", "s", "x", 4),
    (2, "the same row comes twice and has enough words to be kept by the rules", "s", "x", 4),
    (2, "another text of the same id that has enough words to be kept by the rules too", None, "y", 5),
    (3, "word " * 30_000, "s", "x", 6),
]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_odd_tables(spark, sf, name, stage):
    """Nulls in any column, empty and very long texts, ties, repeated rows and clashing columns pass every stage; an empty table gives no rows."""
    columns = "doc_id bigint, text string, source string, copies string, `__mix_id` int"
    d = spark.createDataFrame(ODD, columns)
    out = stage(spark, d, sf).collect()
    ids = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in out)
    expected = {"quality": 4, "lines": 7, "simhash": 5, "decontaminate": 7}
    assert len(out) == expected.get(name, len(out)) and (name == "mix" or out[0].asDict().keys() == set(d.columns))
    assert name != "simhash" or ids == [(False, 0), (True, 1), (True, 2), (True, 2), (True, 3)]
    if name == "mix":
        assert {"doc_id", "text", "source", "copies", "__mix_id"} < out[0].asDict().keys()
    assert name == "simhash" or stage(spark, d.limit(0), sf).count() == 0


@pytest.mark.parametrize("kind", ["string", "decimal(20,2)"])
@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_ids_of_any_type(spark, sf, name, stage, kind):
    """Ids need not be whole numbers: every stage gives what it gives for numbers (quality knows no labels of other ids)."""
    d = spark.createDataFrame(ODD, "doc_id bigint, text string, source string, copies string, `__mix_id` int")
    named = F.col("doc_id").cast(kind) if kind != "string" else F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    texts = [sorted(str(r["text"]) for r in stage(spark, t, sf).collect()) for t in (d, d.withColumn("doc_id", named))]
    if name == "mix" or (name, kind) == ("quality", "string"):
        assert texts[1] and set(texts[1]) <= {str(r[1]) for r in ODD}
    else:
        assert texts[0] == texts[1]
