"""Operators on documents against brute force, on a table with every odd case."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from effectforge.llm import components, decontaminate, lines, mixing, quality, repeats, simhash, substring_dedup, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, r string, sites string"


def words(text):
    return WORD.findall(text or "")


def passage(seed, n):
    rng = np.random.default_rng(seed)
    return [f"w{x}é" if x % 7 == 0 else f"w{x}" for x in rng.integers(0, 5000, n)]


def odd_documents():
    shared, tail = passage(1, 60), passage(2, 40)
    texts = {
        0: " ".join(passage(10, 30) + shared),
        1: " ".join(shared + passage(11, 25)),
        2: " ".join(shared),
        3: " ".join(shared),
        4: None,
        5: "",
        6: "   \n\t ",
        7: "one two",
        8: " ".join(passage(12, 15) + tail + passage(13, 5) + tail),
        9: "ab " * 300,
        10: "x" * 500,
        11: "x" * 350 + "y" * 20,
        12: " ".join(passage(14, 6000)),
        13: " ".join(passage(14, 6000)[100:3000]),
        14: "line a b\nline a b\nline c\n\nline a b",
        15: " ".join(passage(15, 50)) + "\u00a0nbsp\u2003em " + " ".join(shared[:19]),
        16: " ".join(shared[1:30]).upper(),
        17: "###$$$ %%%*** " * 20,
    }
    return [(k, t, None, [None, "s1", "s2", "ß"][k % 4], None, 1, "x", "y") for k, t in texts.items()]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_words(rows, window=20):
    first, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            if g in first:
                gone[k : k + window] = [True] * window
            first.add(g)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def brute_bytes(rows, window=100):
    first, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            g = b[k : k + window]
            if g in first:
                gone[k : k + window] = b"\1" * window
            first.add(g)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_substring_dedup(docs, empty):
    expected = brute_words([(r[0], r[1]) for r in odd_documents()])
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(docs).collect()}
    assert got == expected
    assert sum(v[1] for v in expected.values()) > 100
    assert substring_dedup.substring_dedup(empty).count() == 0


@pytest.mark.parametrize("crowd", [2048, 2])
def test_suffix_dedup(docs, empty, crowd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    expected = brute_bytes([(r[0], r[1]) for r in odd_documents()])
    rows = suffix_dedup.suffix_dedup(docs).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == expected
    if crowd > 2:
        assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_repeated_and_wide_ids(spark):
    same = " ".join(passage(3, 50))
    other = " ".join(passage(4, 50))
    rows = [(-(2**62), same), (2**62, same), (2**62, same), (None, other), (7, other), (7, same)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["n_removed"]) for r in substring_dedup.substring_dedup(d).collect()))
    assert got == [(False, 0, 0), (True, -(2**62), 0), (True, 7, 50), (True, 7, 50), (True, 2**62, 50), (True, 2**62, 50)]
    ordered, bits = repeats.ordered(d)
    assert ordered.select("dk").distinct().count() == 5 and bits >= 8
    named = spark.createDataFrame([(f"d{k:03}", same if k % 3 else other) for k in range(90)], "doc_id string, text string").repartition(5)
    numbers = [r["doc_id"] for r in repeats.ordered(named)[0].orderBy("dk").collect()]
    assert numbers == sorted(numbers) and len(numbers) == 90
    kept = {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(named).collect()}
    assert [k for k, v in sorted(kept.items()) if v == 0] == ["d000", "d001"]


def test_keys_have_room(spark, monkeypatch):
    """Documents and positions that do not fit a key together are an error, not an overflow."""
    monkeypatch.setattr(repeats, "KEY_BITS", 10)
    d = spark.createDataFrame([(k, "text of some length") for k in range(20)], "doc_id bigint, text string")
    with pytest.raises(ValueError, match="do not fit"):
        repeats.ordered(d)


def test_previous_factors():
    """Suffix order, common prefixes and longest previous factors of several contexts against brute force."""
    rng = np.random.default_rng(5)
    cases = [[b"banana bandana banana"], [b"abc", b"abc", b"ab", b"\0\0", b"\0"], [b"a" * 40], [b""], []]
    cases += [[bytes(rng.integers(0, 3, int(n)).astype(np.uint8)) for n in rng.integers(1, 60, 8)] + [b"\1\2" * 30] * 2 for _ in range(20)]
    for contexts in cases:
        text = np.frombuffer(b"".join(contexts), np.uint8)
        sizes = np.array([len(c) for c in contexts], np.int64)
        ends = np.repeat(np.cumsum(sizes), sizes)
        suffixes = [bytes(text[k:e]) for k, e in enumerate(ends)]
        share = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        order, shared = suffix_dedup.suffix_array(text, ends)
        assert order.tolist() == sorted(range(len(text)), key=lambda k: (suffixes[k], k))
        assert shared.tolist()[1:] == [share(suffixes[a], suffixes[b]) for a, b in zip(order, order[1:])]
        factors = suffix_dedup.previous_factors(text, ends)
        assert factors.tolist() == [max((share(suffixes[j], suffixes[k]) for j in range(k)), default=0) for k in range(len(text))]


def test_quality_statistics(spark, docs, empty):
    labels = spark.createDataFrame([(None, 1, 0), (0, 1, 0), (0, None, 0), (17, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality_rules(docs, labels).collect()}
    for i, t, *_ in odd_documents():
        w = words(t)
        text = t or ""
        lines_, seen = 0, set()
        for line in text.split("\n"):
            if words(line):
                lines_ += line in seen
                seen.add(line)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        counts = Counter(grams)
        hit = {k + j for k, g in enumerate(grams) if counts[g] > 1 for j in range(5)}
        r = got[i]
        expected = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), lines_, len(hit))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected
        assert r["base_failed"] == (len(w) < 10 or 100 * len(hit) > 20 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert quality.quality_rules(empty, labels).count() == 0
    assert quality.quality_rules(docs, labels.limit(0)).filter("kept = base_failed").count() == 0
    assert quality.drop_rejected(docs, labels).columns == docs.columns


def test_quality_held_out(spark):
    """A forest fitted on some rows finds most junk among others and keeps clean ones."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    forest = quality.fit_forest(d, labels.filter("doc_id % 2 = 0"))
    held = labels.filter("doc_id % 2 = 1").select("doc_id", "quality")
    judged = quality.judge(d.select("doc_id", "text").join(held, "doc_id"), forest, "q").groupBy("quality").agg(
        F.avg(F.col("q.kept").cast("double")).alias("kept"), F.avg((~F.col("q.base_failed")).cast("double")).alias("passed")
    )
    by = {r["quality"]: r for r in judged.collect()}
    assert by[1]["kept"] > by[1]["passed"] - 0.02
    assert by[0]["kept"] < 0.3 * by[0]["passed"]


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(500, 3)), np.full((5, 3), 9.0)])
    good = np.arange(505) < 500
    forest = quality.IsolationForest.grow(x, good, 50, 128, 0.03, 1)
    scores = forest.score(x)
    assert scores[500:].min() > np.quantile(scores[:500], 0.99)
    forest.calibrate(scores, good, 0.01)
    assert (scores[:500] > forest.threshold).mean() <= 0.01


def test_forest_verdicts_by_plain_python(spark, sf):
    """Every verdict of the query is that of a walk down every tree, statement by statement, and the threshold that of the labelled rows."""
    documents, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    forest = quality.fit_forest(documents, labels)
    assert len(forest.trees) >= 50

    def mean_path(n):
        return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def ratios(text):
        w, t = words(text), text or ""
        n, chars = len(w) + quality.PRIOR_WORDS, sum(map(len, w)) + 5 * quality.PRIOR_WORDS
        upper, marks = (sum(t.encode().count(bytes([c])) for c in table) for table in (quality._UPPER, quality._MARKS))
        return [chars / n, sum(t.count(c) for c in "#*$%&|<>") / n, upper / chars, marks / n]

    def score(text):
        x, total = ratios(text), 0.0
        for feature, split, left, right, path in forest.trees:
            at = 0
            while feature[at] >= 0:
                at = left[at] if x[feature[at]] < split[at] else right[at]
            total += path[at]
        return 2 ** (-total / len(forest.trees) / mean_path(forest.sample))

    def failed(text):
        w = words(text)
        places = {}
        for k in range(len(w) - 4):
            places.setdefault(tuple(w[k : k + 5]), []).append(k)
        repeated = {k + j for ks in places.values() if len(ks) > 1 for k in ks for j in range(5)}
        return len(w) < 10 or 100 * len(repeated) > 20 * len(w)

    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    scores = {i: score(t) for i, t in texts.items()}
    good = sorted(scores[r["doc_id"]] for r in labels.collect() if r["quality"] and r["doc_id"] in texts and not failed(texts[r["doc_id"]]))
    assert forest.threshold in (float("inf"), *[pytest.approx(x, abs=1e-12) for x in good])
    for r in quality.quality_rules(documents, labels).collect():
        i = r["doc_id"]
        assert r["anomaly_score"] == pytest.approx(scores[i], abs=1e-12) and r["base_failed"] == failed(texts[i])
        assert r["kept"] == (not r["base_failed"] and (scores[i] <= forest.threshold or scores[i] == pytest.approx(forest.threshold, abs=1e-12)))


def test_decontamination(spark, docs, empty):
    items = [(1, " ".join(passage(1, 60)[5:25])), (10, "W1 two!"), (2, "one-two"), (3, None), (4, ""), (None, "x" * 500), (2, " ".join(passage(2, 40)))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    owners = {}
    for i, t in items:
        w = fold(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            owners.setdefault(tuple(w[k : k + 10]), set()).update({str(i)} - {"None"})
    expected = {}
    for i, t, *_ in odd_documents():
        w, hit, found = fold(t), set(), set()
        for n in {len(x) for x in owners}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in owners:
                    hit |= set(range(k, k + n))
                    found |= owners[tuple(w[k : k + n])]
        expected[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    for block in (1 << 24, 64):
        rows = decontaminate.contamination(docs, bench, block_bytes=block).collect()
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows}
        assert got == expected
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, v in expected.items() if not v[4]}


def test_decontamination_of_repetitive_text(spark):
    """Equal windows are one: a text of one word costs no more than its length, and hits are those of brute force."""
    rng = np.random.default_rng(6)
    items = [("one", "word " * 3000), ("two", "word " * 30 + "tail"), ("three", "a b " * 40), ("four", "b a b"), ("five", "word " * 4)]
    texts = ["word " * 5000, "word " * 9, "word " * 3 + "x", "a b " * 25, "b a " * 4, "tail " + "word " * 11 + "tail"]
    texts += [" ".join(rng.choice(["word", "a", "b", "tail"], 400, p=[0.7, 0.1, 0.1, 0.1])) for _ in range(8)]
    owners = {}
    for i, t in items:
        w = t.split()
        for k in range(max(1, len(w) - 9)):
            owners.setdefault(tuple(w[k : k + 10]), set()).add(i)
    expected = {}
    for i, t in enumerate(texts):
        w, hit, found = t.split(), set(), set()
        for n in {len(x) for x in owners}:
            for k in range(len(w) - n + 1):
                if of := owners.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= of
        expected[i] = (len(w), len(hit), ",".join(sorted(found)))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = decontaminate.contamination(d, spark.createDataFrame(items, "item_id string, text string")).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], ",".join(r["item_ids"])) for r in got} == expected
    raw = b"word " * 100_000
    index = decontaminate.WindowIndex([("a", raw), ("b", raw[:500])], 10, 5)
    index.choose(np.ones(len(index.keys), np.int64))
    (n, spans, found), *_ = index.match([raw])
    assert len(index) == 1 and (n, len(spans), found) == (100_000, 99_991, {"a", "b"})


def test_windows_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(decontaminate.RangeHash, "__call__", lambda self, start, end: np.zeros(len(start), np.uint64))
    index = decontaminate.WindowIndex([("a", b"x y z"), ("b", b"x y q"), ("c", b"x y z")], 10, 5)
    index.choose(np.ones(len(index.keys), np.int64))
    assert [m[2] for m in index.match([b"x y z", b"x y q", b"x y"])] == [{"a", "c"}, {"b"}, set()]


def brute_fingerprint(text, shingle=3):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [w[k : k + shingle] for k in range(max(1, len(w) - shingle + 1))] if w else []
    counts = [0] * 64
    for r in runs:
        h = xxhash.xxh64_intdigest(" ".join(r).encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(runs))


def brute_components(prints):
    parent = {k: k for k in prints}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in prints:
        for b in prints:
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in prints}


def test_simhash(docs, empty):
    prints = {r[0]: brute_fingerprint(r[1]) for r in odd_documents()}
    classes = brute_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {k: (f"{prints[k]:016x}", classes[k]) for k in prints}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_first_of_class(docs.unionByName(docs))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(classes.values()))


@pytest.mark.parametrize("limit", [32, 2])
def test_links_are_whole(spark, limit, monkeypatch):
    """All links of a ball of near fingerprints, by pairs and by variants."""
    monkeypatch.setattr(simhash, "MAX_PAIRED", limit)
    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 2**62))
    values = {base, 0, -1} | {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 60, (60, 2))} | {int(x) for x in rng.integers(0, 2**62, 50)}
    prints = {v: v & (2**64 - 1) for v in values}
    d = spark.createDataFrame([(v,) for v in values], "fp bigint")
    roots = {r["node"]: r["root"] for r in components.components(simhash.link_fingerprints(d)).collect()}
    expected = brute_components(dict(sorted(prints.items())))
    group = lambda of: sorted(sorted(k for k in values if of(k) == g) for g in {of(k) for k in values})
    assert group(lambda k: roots.get(k, k)) == group(lambda k: expected[k])


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(60)] + [(101, 100)], "hi bigint, lo bigint")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}


def test_line_dedup(spark, empty):
    rows = []
    for k in range(30):
        text = f"own line {k}\ncommon\n  \ncommon" if k % 2 else f"own line {k}\nrare"
        rows.append((k, text if k != 7 else None, None, f"s{k}" if k < 26 else None, None, 1, "x", "y"))
    d = spark.createDataFrame(rows, SCHEMA)
    for min_sites in (5, 13, 14, 20):
        expected = {}
        sites = {}
        for i, t, _, s, *_ in rows:
            for line in (t or "").split("\n"):
                if words(line):
                    sites.setdefault(line, set()).add(s or "")
        firsts = {line: min(r[0] for r in rows if line in (r[1] or "").split("\n")) for line in sites}
        for i, t, *_ in rows:
            if t is None:
                expected[i] = (0, 0, None)
                continue
            kept, seen = [], set()
            for line in t.split("\n"):
                if len(sites.get(line, ())) >= min_sites and (firsts[line] != i or line in seen):
                    continue
                seen.add(line)
                kept.append(line)
            expected[i] = (len(t.split("\n")), len(t.split("\n")) - len(kept), "\n".join(kept))
        got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in lines.line_dedup(d, min_sites=min_sites).collect()}
        assert got == expected
    assert lines.line_dedup(empty).count() == 0
    again = lines.drop_boilerplate(d.unionByName(d), min_sites=5)
    assert again.columns == d.columns and again.count() == 60


def shares(sizes):
    """Targets by resharing the excess until none is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing(spark, docs, empty):
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(["w"] * int(n)), f"s{k % 5}" if k % 11 else None) for k, n in enumerate(rng.integers(0, 60, 1500))]
    rows += [(5, "w w w", "s0")] * 40 + [(None, "a b", "s1")] * 3
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    got = mixing.round_copies(d).toPandas()
    assert len(got) == len(rows)
    target = shares(sizes)
    for s, size in sizes.items():
        part = got[got["source"].isna() if s is None else got["source"] == s]
        assert (part["source_size"] == size).all() and np.allclose(part["target"], target[s])
        assert abs((part["size"] * part["copies"]).sum() - target[s]) <= part["size"].max()
    assert got["copies"].between(0, 2).all()
    key = ["doc_id", "source", "size", "rep"]
    again = mixing.round_copies(d.repartition(7)).toPandas()
    assert got.sort_values(key)["copies"].tolist() == again.sort_values(key)["copies"].tolist()
    taken = mixing.take_mix(d)
    assert taken.columns == [*d.columns, "copies"] and taken.count() == (got["copies"] > 0).sum()
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.mix_sources(docs).count() == 18


def test_mixing_keeps_expectations(spark):
    """Over many seeds a document is taken as often as its probability says."""
    rows = [(k, " ".join(["w"] * n), s) for s in "ab" for k, n in enumerate([1, 2, 3, 5, 8, 13])]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string").cache()
    total = {}
    for seed in range(12):
        for r in mixing.round_copies(d, weights=(1.0, 3.0), share=1.2, seed=seed).collect():
            k = (r["source"], r["size"])
            total[k] = total.get(k, 0) + (r["copies"] - r["target"] / r["source_size"]) / 12
    assert max(abs(v) for v in total.values()) < 0.6
