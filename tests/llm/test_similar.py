"""Near-duplicates by similarity against brute force, whole groups and odd rows included."""

import numpy as np
import pytest

from effectforge.llm import similar, simhash


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b and (not a or rows[i][1].lower().split() == rows[j][1].lower().split()) or len(a & b) >= 0.8 * len(a | b) > 0:
                parent[find(i)] = find(j)
    return [find(k) for k in range(len(rows))]


def edited(words, edits, rng):
    out = list(words)
    for k in rng.choice(len(out), edits, replace=False):
        out[k] = f"e{rng.integers(1_000_000)}"
    return " ".join(out)


@pytest.mark.parametrize("paired", [12, 2])
def test_classes(spark, paired, monkeypatch):
    monkeypatch.setattr(similar, "MAX_PAIRED", paired)
    rng = np.random.default_rng(6)
    rows = [(None, None), (1, ""), (2, " \n "), (3, "one"), (4, "ONE"), (5, "one two"), (5, "one two"), (6, "é É")]
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 4000, 200)]
        rows += [(len(rows) + 10, edited(base, int(e), rng)) for e in (0, 0, 1, 2, 12)]
    crowd = [f"w{x}" for x in rng.integers(0, 4000, 300)]
    rows += [(1000 + k, edited(crowd, 3, rng)) for k in range(40)]
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, id int").repartition(3)
    got = {}
    for r in similar.similar_classes(d).collect():
        got.setdefault(r["class"], set()).add(r["doc_id"])
    expected = {}
    for (i, _), c in zip(rows, brute(rows), strict=True):
        expected.setdefault(c, set()).add(i)
    assert sorted(map(str, map(sorted, [[str(x) for x in g] for g in got.values()]))) == sorted(map(str, map(sorted, [[str(x) for x in g] for g in expected.values()])))
    kept = similar.keep_first_similar(d)
    assert kept.columns == d.columns
    assert kept.count() == len(expected)
    assert similar.keep_first_similar(d.limit(0)).count() == 0


def classes_of(spark, rows):
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    return {r["doc_id"]: r["class"] for r in similar.similar_classes(d).collect()}


def same_classes(got, rows):
    """Whether two texts share a class exactly where brute force says so."""
    expected = dict(zip((i for i, _ in rows), brute(rows), strict=True))
    return len(set(got.values())) == len(set(expected.values())) == len({(got[i], expected[i]) for i in got})


def test_contiguous_edits(spark):
    """Copies with one long edit: new or repeated words appended, the end cut off, a block or the tail replaced."""
    rng, rows = np.random.default_rng(8), []
    for k in range(150):
        n = int(rng.integers(30, 400))
        base = [f"w{x}" for x in rng.integers(0, 4000, n)]
        more, less = int(0.2 * (n - 4)), int(0.09 * (n - 4))
        at = int(rng.integers(0, n - less - 3))
        new = [f"n{k}_{x}" for x in range(more)]
        copy = (base + new, base + [f"again{k}"] * more, base[: n - more], base[:at] + new[: less - 3] + base[at + less - 3 :], base[: n - less] + new[:less])[k % 5]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    got = classes_of(spark, rows)
    pairs = [k for k in range(150) if len(shingles(rows[2 * k][1]) & shingles(rows[2 * k + 1][1])) >= 0.8 * len(shingles(rows[2 * k][1]) | shingles(rows[2 * k + 1][1]))]
    assert len(pairs) >= 140
    assert [k for k in pairs if got[2 * k] != got[2 * k + 1]] == []
    assert same_classes(got, rows)


def test_crowd(spark):
    """Texts of one template, all below the similarity to each other, each with one copy above it."""
    rng, rows = np.random.default_rng(9), []
    passage = [f"w{x}" for x in rng.integers(0, 4000, 178)]
    for k in range(250):
        own = [f"o{k}_{x}" for x in range(22)]
        rows += [(2 * k, " ".join(passage + own)), (2 * k + 1, " ".join(passage[: 178 - 8] + [f"c{k}_{x}" for x in range(8)] + own))]
    got = classes_of(spark, rows)
    assert [k for k in range(250) if got[2 * k] != got[2 * k + 1]] == []
    assert same_classes(got, rows) and len(set(got.values())) == 250


def test_simhash_links_come_first(spark, monkeypatch):
    """SimHash alone links the texts within two bits that are similar too, and no others; what it leaves apart is found by shingles."""
    rng, texts = np.random.default_rng(10), []
    for _ in range(40):
        base = [f"w{x}" for x in rng.integers(0, 4000, 400)]
        texts += [edited(base, e, rng) for e in (0, 1, 1, 25)]
    # One fingerprint, as one phrase decides each bit, but other shingles.
    phrase = "one phrase that comes again and again " * 400
    texts += [phrase + " ".join(f"t{k}_{x}" for x in range(40)) for k in range(3)]
    rows = list(enumerate(texts))
    prints = [simhash.fingerprint(t.encode()) & (2**64 - 1) for _, t in rows]
    bits = lambda i, j: (prints[i] ^ prints[j]).bit_count()
    alike = lambda i, j: len(shingles(rows[i][1]) & shingles(rows[j][1])) >= 0.8 * len(shingles(rows[i][1]) | shingles(rows[j][1]))
    groups = [range(k, k + 4) for k in range(0, 160, 4)] + [range(160, 163)]
    met = [(i, j) for g in groups for i in g for j in g if i < j and bits(i, j) <= 2]
    linked = [p for p in met if alike(*p)]
    assert len(linked) >= 40 and {(160, 161), (161, 162)} <= set(met) - set(linked)
    whole = classes_of(spark, rows)
    assert same_classes(whole, rows)

    held = similar.held_shingles
    monkeypatch.setattr(similar, "held_shingles", lambda texts: similar.materialize(held(texts).limit(0), "no-shingles"))
    got = classes_of(spark, rows)
    assert [p for p in linked if got[p[0]] != got[p[1]]] == []
    together = lambda of: {(i, j) for i in of for j in of if i < j and of[i] == of[j]}
    assert together(got) <= together(whole)
    assert len({got[k] for k in (160, 161, 162)}) == 3
    assert len(set(got.values())) > len(set(whole.values()))

