"""Divergence, fill-in-middle and license scans against brute force, with every odd case."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from effectforge.llm import divergence, infill, licenses
from effectforge.llm.license_templates import TEMPLATES

SCHEMA = "doc_id bigint, text string, lang string, source string, n bigint, k1 string, part string, words string"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, s, 1, "x", "y", "z") for i, t, g, s in rows], SCHEMA).repartition(3)


# Source divergence


def brute_divergence(rows, min_docs=3, top=10):
    rows = [(g or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(t or ""))) for _, t, g, s in rows]
    out = []
    for lang in {g for g, _, _ in rows}:
        df = Counter(t for g, _, ws in rows if g == lang for t in set(ws))
        kept = [t for t, d in df.items() if d >= min_docs]
        counts = {s: Counter() for g, s, _ in rows if g == lang}
        for g, s, ws in rows:
            if g == lang:
                counts[s].update(ws)
        total = sum(counts.values(), Counter())

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(total)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = {o: sum(f(p[s][t], p[o][t]) for t in kept) for o in counts if o != s}
            terms = {t: f(p[s][t], q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]}
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(found.items(), key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(ranked[:most])]
    return sorted(out)


def divergence_rows():
    rng = np.random.default_rng(3)
    pool = [f"{c}{d}" for c in "abcdefgh" for d in ("x", "é", "Y", "zz")] + ["ß", "日本"]
    rows = []
    for k in range(160):
        lang, source = ("en", "de", None)[k % 3], f"s{min(int(rng.integers(0, 12)), 5)}"
        n = int(rng.integers(0, 40))
        rows.append((k, " ".join(rng.choice(pool[: 10 + 4 * (k % 6)], n)), lang, source))
    rows += [(500, "lonely words here", "fr", "s1"), (501, None, "fr", None), (502, "", "fr", "s2"), (503, "12 34 !!", "en", "none")]
    rows += [(600, "ax ax bx", "en", "s0")] * 4 + [(None, "ax long " * 20000, "en", "s9"), (602, "same same", "it", "only")]
    return rows


def test_divergence(spark):
    rows = divergence_rows()
    got = divergence.source_divergence(table(spark, rows), min_docs=3)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect())) == brute_divergence(rows)
    assert divergence.source_divergence(table(spark, []).limit(0)).count() == 0


def test_divergence_in_small_parts(spark, monkeypatch):
    """Counts that are sent on early and pairs that are added up early give the same."""
    import pyarrow as pa

    texts = pa.record_batch({"lang": ["a", "b", "a"], "source": ["s", "s", "s"], "text": [b"X y x", b"", "é y".encode()]})
    whole = [r for b in divergence._count_batches([texts, texts]) for r in b.to_pylist()]
    assert Counter({r["term"]: r["n"] for r in whole}) == Counter({"x": 4, "y": 4, "é": 2})
    monkeypatch.setattr(divergence, "HELD", 1)
    monkeypatch.setattr(divergence, "ROWS", 1)
    small = Counter()
    for b in divergence._count_batches([texts, texts]):
        for r in b.to_pylist():
            small[r["term"]] += r["n"]
    assert small == Counter({"x": 4, "y": 4, "é": 2})
    rng = np.random.default_rng(1)
    rows = [
        {"lang": "en", "mult": int(rng.integers(1, 5)), "entries": [{"source": f"s{s}", "p": int(rng.integers(1, 10**9)), "p0": 7 + s} for s in sorted(rng.choice(9, rng.integers(1, 9), False))]}
        for _ in range(40)
    ]
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([("lang", pa.string()), ("mult", pa.int64()), ("entries", pa.list_(pa.struct([("source", pa.string()), ("p", pa.int64()), ("p0", pa.int64())])))]))
    f = lambda a, b: (a - b) ** 2 // (a + b)
    want = Counter()
    for r in rows:
        for k, a in enumerate(r["entries"]):
            for b in r["entries"][k + 1 :]:
                want[a["source"], b["source"]] += r["mult"] * (f(a["p"], b["p"]) - f(a["p"], b["p0"]) - f(a["p0"], b["p"]) + f(a["p0"], b["p0"]))
    for limit in (1 << 21, 3):
        monkeypatch.setattr(divergence, "PAIRS", limit)
        assert {(r["a"], r["b"]): r["s"] for b in divergence._pair_batches([batch.slice(0)]) for r in b.to_pylist()} == dict(want)


def test_probability_is_exact(spark):
    big = 4 * 10**12
    row = spark.range(1).select(divergence.probability(F.lit(big), F.lit(big + 77), 10**9, 2).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (big + 2) // (big + 77)


# Fill-in-middle


def brute_infill(doc_id, text, units=None):
    text = text or ""
    pieces = list(text) if units is None else units(text)
    n = len(pieces)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(pieces[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if h[3] % 100 < 20 else "psm", a, b - a, out


def infill_rows():
    rng = np.random.default_rng(9)
    letters = np.array(list("ab <PSM>é日😀\n"))
    rows = [(k, "".join(rng.choice(letters, int(rng.integers(0, 90)))), None, None) for k in range(60)]
    rows += [(100, None, None, None), (101, "", None, None), (102, "x<P>y", None, None), (103, "<S", None, None), (None, "no id ü" * 9, None, None)]
    rows += [(104, "twice the id", None, None), (104, "twice the id, not the text " * 9, None, None), (105, "twin " * 40, None, None), (105, "twin " * 40, None, None)]
    return rows + [(k, ("wörd 😀 " * 700) + ("<M>" if k == 301 else "."), None, None) for k in range(300, 306)]


@pytest.mark.parametrize(("size", "fanout"), [(1 << 16, 256), (37, 3), (130, 256)])
def test_infill(spark, monkeypatch, size, fanout):
    monkeypatch.setattr(infill, "FANOUT", fanout)
    rows = infill_rows()
    got = infill.fill_in_middle(table(spark, rows), chunk_bytes=size).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    got = got.collect()
    assert all(r["back"] == r["text"] for r in got)
    order = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted(((r["doc_id"], *r[2:-1]) for r in got), key=order) == sorted(((i, *brute_infill(i, t)) for i, t, _, _ in rows), key=order)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    if size < 100:
        assert infill.fill_in_middle(table(spark, []).limit(0), chunk_bytes=size).count() == 0


def test_infill_by_words(spark):
    def units(text):
        found = [m.start() for m in re.finditer(r"(?<![^ \n])[^ \n]", text)]
        cuts = [0, *found[1:], len(text)] if found else [0, len(text)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] if found else []

    rows = [(k, t, None, None) for k, t, _, _ in infill_rows() if t and not re.match(r"[ \n]", t)]
    got = infill.fill_in_middle(table(spark, rows), unit="words", chunk_bytes=50).collect()
    want = {(i, t): brute_infill(i, t, units) for i, t, _, _ in rows}
    assert {(r["doc_id"], r["text"]): tuple(r[2:]) for r in got} == want
    with pytest.raises(ValueError, match="marker"):
        infill.fill_in_middle(table(spark, rows), markers=("<<", "<S>", "<M>"))


def test_automaton_composes():
    rng = np.random.default_rng(4)
    for automaton in (infill.Automaton.code_points(), infill.Automaton.words()):
        for n in (0, 1, 127, 128, 129, 1000):
            raw = "".join(rng.choice(list("a <PSM>é😀"), n)).encode()
            cut = n // 3
            whole, parts = automaton.functions([raw]), automaton.functions([raw[:cut], b"", raw[cut:]])
            joined = automaton.compose(automaton.compose(*[tuple(x[k : k + 1] for x in parts) for k in (0, 1)]), tuple(x[2:] for x in parts))
            assert all((a == b).all() for a, b in zip(whole, joined, strict=True))
            state, counts = 0, 0
            for byte in raw:
                step = int(automaton.table[state, byte])
                state, counts = step & 255, counts + (step >> 8)
            assert (whole[0][0, 0], whole[1][0, 0]) == (state, counts)


# License scans


def brute_license(text, k=5, gap=8, least=0.8):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
    ws = fold(text)
    base = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()]
    labels, score = {b for _, b in base}, 0.0
    for label, template in TEMPLATES:
        ts = fold(template)
        n = len(ts) - k + 1
        where = defaultdict(list)
        for j in range(n):
            where[tuple(ts[j : j + k])].append(j)
        lines = defaultdict(set)
        for i in range(len(ws) - k + 1):
            for j in where.get(tuple(ws[i : i + k]), ()):
                lines[i - j].add(j)
        for d, places in lines.items():
            near = {e: lines[e] for e in lines if abs(e - d) <= min(gap, n // 10)}
            if any(len(v) > len(places) or (len(v) == len(places) and e < d) for e, v in near.items()):
                continue
            merged = {j + e for e, v in near.items() for j in v}
            covered = len({j for v in near.values() for j in v})
            for both, ats in ((len(places), {j + d for j in places}), (min(covered, len(merged)), merged)):
                score = max(score, s := both / (max(ats) - min(ats) + 1 + n - both))
                labels |= {label} if s >= least else set()
    at = [i for i, _ in base]
    own = ",".join(sorted({b for _, b in base}))
    return len(ws), len(base), min(at, default=None), max(at, default=None), own, ",".join(sorted(labels)), score


def license_rows():
    rng = np.random.default_rng(2)
    texts = [None, "", " \n ", "MIT License", "the mit  license, MIT-license and MIT LICENSE mit license", "apache\nlicense general public license", "mit licenses"]
    for label, t in TEMPLATES:
        ws = t.split()
        texts += [t, f"foo {t} bar " * 3, " ".join(ws[: len(ws) // 2])]
        if len(ws) > 30:
            texts += [" ".join(ws[:20] + ["added", "words"] + ws[20:]), " ".join(ws[:15] + ws[18:])]
            texts += [" ".join(w if rng.random() > 0.1 else "changed" for w in ws)]
    texts += ["permission is hereby granted free of charge " * 300, " ".join(t for _, t in TEMPLATES) * 20, "ü" * 10]
    rows = [(k, t, None, None) for k, t in enumerate(texts)]
    return rows + [(900, texts[8], None, None)] * 3 + [(900, "other", None, None), (None, texts[8], None, None)]


def test_licenses(spark):
    rows = license_rows()
    got = licenses.scan_licenses(table(spark, rows)).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted((tuple(r[:-1]) for r in got), key=order) == sorted(((i, *brute_license(t)) for i, t, _, _ in rows), key=order)
    labels = {r["labels"] for r in got}
    assert {"mit", "bsd", "cc-by-nc", "isc", "mpl"} <= labels and any("mit" in x and "," in x for x in labels)
    for r in got:
        assert all(s["similarity"] >= 0.8 and s["start"] + s["n_words"] <= r["n_words"] for s in r["spans"])
    assert licenses.scan_licenses(table(spark, []).limit(0)).count() == 0


def test_templates_beyond_a_broadcast(spark, monkeypatch):
    d = table(spark, license_rows())
    a = sorted(map(tuple, licenses.scan_licenses(d).drop("spans").na.fill({"doc_id": -1, "first_word": -1, "last_word": -1}).collect()))
    monkeypatch.setattr(licenses, "HELD_BYTES", 0)
    assert sorted(map(tuple, licenses.scan_licenses(d).drop("spans").na.fill({"doc_id": -1, "first_word": -1, "last_word": -1}).collect())) == a
    assert all(licenses.scan_licenses(d, templates=[("short", "four words are few")]).select((F.col("score") == 0).alias("none")).toPandas()["none"])
