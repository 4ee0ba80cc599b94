"""Operators on pages: WARC round trips, URL filters and text extraction."""

import gzip
import hashlib
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from effectforge.llm import html_text, url_filter, warc

BIG = "<p>" + "payload " * 200 + "</p>"
ROWS = [
    (1, "http://a.example/x\r\ny", BIG, 1),
    (2, None, BIG, 1),
    (9, "http://b.example/", BIG, 1),
    (9, "http://b.example/", BIG, 1),
    (None, "http://c.example/", BIG, 1),
    (3, "http://d.example/", None, 1),
    (4, "http://e.example/", "", 1),
    (5, "http://f.example/", "short", 1),
    (6, "http://g.example/", "short", 1),
    (7, "http://h.example/", "é" * 70_000 + "\r\n\r\nWARC/1.1\r\n", 1),
]
SCHEMA = "page_id bigint, url string, html string, host int"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def test_round_trip(spark, pages):
    got = warc.round_trip(pages).toPandas()
    assert len(got) == len(ROWS)
    key = lambda r: (r[0] is None or r[0] != r[0], r[0] or 0, r[1])
    expected = []
    for i, _, h, _ in ROWS:
        b = (h or "").encode()
        again = len(b) >= 1000 and i != 9 and h == BIG
        expected.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", 9 if again else None))
    rows = [tuple(None if v != v else v for v in r) for r in got[["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]].itertuples(index=False)]
    assert sorted(rows, key=key) == sorted(expected, key=key)
    assert warc.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["string", "decimal(12,2)", "date"])
def test_round_trip_of_other_ids(spark, kind):
    """Ids come back in their own type, whatever is in them."""
    ids = {"string": ["p5", "a b>%é", "", "p\r\n6", None], "decimal(12,2)": ["1.50", "-2", "0", "7.25", None], "date": ["2020-01-01", "2021-02-03", "1999-12-31", "2000-01-01", None]}[kind]
    d = spark.createDataFrame([(i, BIG if k != 1 else "x") for k, i in enumerate(ids)], "page_id string, html string").withColumn("page_id", F.col("page_id").cast(kind))
    got = warc.round_trip(d.withColumn("url", F.lit("http://x/")))
    assert dict(got.dtypes)["page_id"] == dict(got.dtypes)["refers_to"] == kind
    rows = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in got.collect()}
    values = [r["page_id"] for r in d.collect()]
    last = max(v for k, v in enumerate(values) if v is not None and k != 1)
    assert rows == {v: ("response", None) if k == 1 or v == last else ("revisit", last) for k, v in enumerate(values)}


def test_members_beyond_a_length_field(monkeypatch):
    """A member that is too long for its length field has none."""
    data = b"payload " * 50
    assert warc.gzip_member(data, 6)[3] == 4
    monkeypatch.setattr(warc, "LONGEST", 20)
    long = warc.gzip_member(data, 6)
    assert long[3] == 0 and gzip.decompress(long) == data


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_source_pushes_predicates(spark, pages, tmp_path, compression):
    warc.register(spark)
    path = f"file://{tmp_path}/{compression}"
    warc.page_records(pages).write.format("warc").option("compression", compression).mode("append").save(path)
    read = spark.read.format("warc").load(path)
    assert read.count() == len(ROWS)
    some = read.filter("record_type = 'revisit'")
    assert some.count() == 3 and some.filter("payload = cast('' as binary)").count() == 3
    assert read.filter(F.col("record_id").isin("<urn:x-page:7>", "<urn:x-page:5>")).count() == 2
    long = read.filter("target_uri = 'http://h.example/'").first()
    assert bytes(long["payload"]).decode() == ROWS[-1][2] and long["headers"]["WARC-Type"] == "response"
    heads = spark.read.format("warc").option("payload", "false").load(path)
    assert heads.filter("payload is not null").count() == 0 and heads.count() == len(ROWS)
    assert read.filter("target_uri like 'http://a.example/x%'").first()["target_uri"].endswith("%0D%0Ay")


def test_members_without_stated_length(tmp_path):
    """Archives of other writers: plain gzip members, some in one read."""
    data = [warc.record_bytes({"record_type": "response", "record_id": f"<urn:x:{k}>", "payload": b"x" * n}) for k, n in enumerate((0, 10, 9000, 5_000_000, 3))]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(d) for d in data))
    with pa.OSFile(str(tmp_path / "a.warc.gz")) as f:
        got = list(warc._members(warc._Source(f), lambda h: h["WARC-Record-ID"] != "<urn:x:2>", True))
    assert [len(p) for _, p in got] == [0, 10, 5_000_000, 3]


RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
URLS = [
    ("https://www.Example.COM/en/7?x=1", "www.example.com", "/en/7", "example.com/en/7", "allow"),
    ("https://example.com/en/9#z", "example.com", "/en/9", "com/en/", "block"),
    ("http://notcom/en/9", "notcom", "/en/9", None, None),
    ("http://com/en/", "com", "/en/", "com/en/", "block"),
    ("http://a.example.net/de/81.html", "a.example.net", "/de/81.html", "example.net/de/8", "block"),
    ("http://a.example.net/de/1", "a.example.net", "/de/1", "net/de/", "allow"),
    ("http://x.org?u=http://y.org/es/1", "x.org", "", None, None),
    ("no scheme.org/es/1", "", "", None, None),
    ("a\n://B.org/es/\n1", "b.org", "/es/\n1", "org/es/", "block"),
    ("", "", "", None, None),
    (None, "", "", None, None),
]


def test_url_rules(spark):
    d = spark.createDataFrame([(k, u[0], "clash") for k, u in enumerate(URLS)], "page_id bigint, url string, path string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(d, RULES).collect()}
    assert len(got) == len(URLS)
    for k, (_, host, path, rule, verdict) in enumerate(URLS):
        r = got[k]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert url_filter.filter_urls(d.limit(0), RULES).count() == 0
    u = d.select("page_id", url_filter.url_host(F.col("url")).alias("host"), url_filter.url_path(F.col("url")).alias("path"))
    many = RULES + [("block", f"zz{k}.org/q") for k in range(300)]
    joined = {r["page_id"]: r["rule"] for r in url_filter.apply_rules(u, many).collect()}
    assert joined == {k: u[3] for k, u in enumerate(URLS)}


def test_url_templates(spark):
    """Bad and good branches of a host part; ids fall to a wildcard; bad ones are rejected."""
    rows = []
    for k in range(400):
        branch = ("spam", "news", "more")[k % 3]
        rows.append((k, f"http://h.org/{branch}/{k}", 1 if branch == "spam" else 0))
    d = spark.createDataFrame(rows, "page_id bigint, url string, blocked int")
    labels = d.filter("page_id % 2 = 0").select("page_id", "blocked")
    got = url_filter.filter_urls(d, [], labels=labels).toPandas()
    bad = got["path"].str.startswith("/spam")
    assert (got[bad]["template"] == "/spam/*").all() and (got[~bad]["template"] == "/{more,news}/*").all()
    assert (got[bad]["verdict"] == "block").all() and (got[~bad]["verdict"] == "allow").all()


@pytest.mark.parametrize("pages", [15, 1500])
def test_url_sizes(spark, pages):
    """A site of labelled bad pages and unlabelled others has the same verdicts at any size."""
    rows = [(k, f"http://h{pages}.com/{('en', 'en', 'de', 'fr', 'en')[k % 5]}/{k}") for k in range(pages)]
    rows += [(10_000 + k, f"http://x.net/de/{k}") for k in range(40)]
    d = spark.createDataFrame(rows, "page_id bigint, url string")
    got = url_filter.filter_urls(d, [("block", "com/en/"), ("allow", "net/de/")]).toPandas()
    got = got[got["host"] == f"h{pages}.com"]
    bad = got["path"].str.startswith("/en/")
    assert (got[bad]["verdict"] == "block").all() and (got[~bad]["verdict"] == "allow").all()
    assert set(got[bad]["template"]).isdisjoint(got[~bad]["template"])


def test_sparse_labels(spark):
    """Labels on a fifth of the pages reject a bad branch, also one of a hundredth of its host."""
    rows = [(k, f"http://h.org/{'spam' if k % 100 == 7 else f'news{k % 3}'}/{k}", int(k % 100 == 7)) for k in range(20_000)]
    d = spark.createDataFrame(rows, "page_id bigint, url string, blocked int")
    labels = d.filter("page_id % 1000 >= 800").select("page_id", "blocked")
    got = url_filter.filter_urls(d, [], labels=labels).toPandas()
    bad = got["path"].str.startswith("/spam/")
    assert bad.sum() == 200 and (got[bad]["verdict"] == "block").all() and (got[~bad]["verdict"] == "allow").all()


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>Menu</ul></nav>
    <div class="cookie-notice">Cookies!</div><script>var a = "<p>no</p>"</script><!-- <p>no --><aside>Side</aside>
    <article><header>Head</header><h1>Caf&eacute; &amp;
      co</h1><p><b>One<br><p>two&nbsp;  three <i>fo</i>ur<ul><li>a<li>b</ul><form><input>Send</form>
    <section class="comments"><p>Reader says</p></section><p>1 &lt; 2</p></article><footer>Foot</footer>"""
    assert html_text.main_text(page).split("\n") == ["Café & co", "One", "two three four", "a", "b", "1 < 2"]
    assert html_text.main_text("") == "" and html_text.main_text("plain  text") == "plain text"
    assert html_text.main_text("<p>a<p>b<div>c") == "a\nb\nc"
    assert html_text.main_text("<" * 50 + "<p") is not None
    assert html_text.main_text("<nav><ul><li>x<article><p>kept</p></article>") == "kept"


def test_site_templates(spark):
    """A subtree on most pages of a host goes, also from articles; elsewhere it stays."""
    shared = "<div><p>Follow us everywhere</p></div>"
    rows = [(k, f"http://a.org/{k}", f"<article><p>own {k}</p>{shared}</article>", 1) for k in range(20)]
    rows += [(k, f"http://b.org/{k}", f"<article><p>own {k}</p>{shared}</article>", 1) for k in range(100, 103)]
    rows += [(200, None, None, 1), (201, "x", "", 1)]
    d = spark.createDataFrame(rows, SCHEMA)
    got = {r["page_id"]: r for r in html_text.extract_text(d, min_pages=8).collect()}
    assert all(got[k]["text"] == f"own {k}" and got[k]["n_chars"] == len(f"own {k}") for k in range(20))
    assert all(got[k]["text"] == f"own {k}\nFollow us everywhere" for k in range(100, 103))
    assert got[200]["text"] == "" and got[201]["n_chars"] == 0
    assert html_text.extract_text(d.limit(0)).count() == 0


def test_site_templates_at_defaults(spark):
    """Recurring subtrees of small hosts, of 60 % of a host, of a section, and rotating ones go; copied articles stay."""
    advert = lambda k: f"<div><p>Buy thing {k} today</p></div>"
    rows = [(k, f"http://a.org/{k}", f"<article><p>own {k}</p><div><p>Follow us</p></div></article>", 1) for k in range(20)]
    rows += [(100 + k, f"http://b.org/{k}", f"<article><p>own {100 + k}</p><div><p>Follow us</p></div></article>", 1) for k in range(3)]
    rows += [(1000 + k, f"http://c.org/{k}", f"<article><p>own {1000 + k}</p>{advert(0) if k % 5 < 3 else ''}</article>", 1) for k in range(200)]
    rows += [(2000 + k, f"http://d.org/{k}", f"<article><p>own {2000 + k}</p></article>{advert(k % 8)}", 1) for k in range(200)]
    rows += [(3000 + k, f"http://e.org/s{k % 10}/{k}", f"<article><p>own {3000 + k}</p>{'<p>Section</p>' if k % 10 == 4 else ''}</article>", 1) for k in range(200)]
    d = spark.createDataFrame(rows, SCHEMA)
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(d).collect()}
    assert all(got[k] == (f"own {k}" if k < 100 or k >= 1000 else f"own {k}\nFollow us") for k in got)
    copies = [(k, f"http://f.org/{k}", f"<article><p>{'copied' if k % 10 == 0 else k}</p></article><p>id {k}</p>", 1) for k in range(200)]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(copies, SCHEMA)).collect()}
    assert all(got[k] == ("copied" if k % 10 == 0 else str(k)) for k in got)


def test_wrapper_classes():
    """Names of layout wrappers do not drop the article in them; those of its parts still do."""
    art = "<article class='post share'><p>kept</p><div class='share'>Share</div></article>"
    aside = "<div class='sidebar'><article>Teaser</article></div>"
    talk = "<div id='comments'><article>One</article></div>"
    for body in (f"<body class='single right-sidebar'>{art}", f"<div id='content-header-wrap'>{art}</div>", f"<main id='menu-main'><p>kept</p></main>"):
        assert html_text.main_text(f"<html>{body}") == "kept"
    assert html_text.main_text(f"<body class='nav'><div class='with-sidebar'>{art}</div>{talk}") == "kept"
    assert html_text.main_text(f"<div class='no-sidebar'><p>{'much text ' * 9}</p>{aside}</div>") != ""
    assert html_text.main_text(f"<div class='has-sidebar'><p>kept text</p><div class='ad'>Ad</div></div><div class='ad'>Ad</div>") == "kept text"


def test_frame_is_kept():
    """Classes, ids, roles and wrappers of the frame drop nothing."""
    kept = "<p>Kept text</p>"
    for page in (
        f"<body class='page has-sidebar'>{kept}",
        f"<html class='no-header'>{kept}",
        f"<article class='post share'>{kept}</article>",
        f"<article id='post-ad-12'>{kept}</article>",
        f"<main role='search'>{kept}</main>",
        f"<form id='aspnet'><div class='x'>{kept}</div><label>Name</label><input></form>",
        f"<div hidden><article>{kept}</article></div>",
        f"<head><title>T</title>{kept}",
        "<p class=it's>Kept text</p>",
    ):
        assert html_text.main_text(page) == "Kept text"
    assert html_text.main_text("<a title=\"foo>Kept text</a><p>more</p>") == "Kept text\nmore"
    assert html_text.main_text("<article><p>one</b></p><p>two</p></article>") == "one\ntwo"
    assert html_text.main_text("text <b unclosed") == "text <b unclosed" and html_text.main_text("a<!--b") == "a"


def test_article_keeps_its_text():
    """Names are chrome outside the article only; planted chrome goes, no planted text does."""
    rng = np.random.default_rng(8)
    names = sorted(html_text.NAMES - html_text.CERTAIN)
    for _ in range(60):
        want, body = ["Title here"], "<header class='header'><h1>Title here</h1></header>"
        for k in range(int(rng.integers(2, 9))):
            name = "-".join(rng.choice(names, int(rng.integers(1, 3))))
            tag = str(rng.choice(["p", "div", "section", "blockquote"]))
            want.append(f"text {k} of {name}")
            body += f"<{tag} {rng.choice(['class', 'id'])}='{name}'>text {k} of <b>{name}</b></{tag}>"
        body += "<table class='nav'><tr><td>a</td><td>b</td></tr></table>"
        want.append("a b")
        inner = "<div class='ad'>chrome</div><section class='comments'><p>chrome</p></section><form>chrome</form><nav>chrome</nav><p hidden>chrome</p>"
        chrome = [f"<div class='{rng.choice(names)}'><p>chrome</p></div>" for _ in range(3)]
        for art in ("article", "main"):
            page = f"<html><body><header>chrome</header>{chrome[0]}<div class='wrap'>{chrome[1]}<{art}>{body}{inner}</{art}>{chrome[2]}</div><footer>chrome</footer></body></html>"
            assert html_text.main_text(page).split("\n") == want


HOSTILE = {
    "unpaired quotes": ("<a '>", "x<b '", ""),
    "quotes after equals": ("<a b=\"", "x<b c='", ""),
    "alternating quotes": ("", "<b a='x<b a=\"", ""),
    "no end": ("", "<b ", ""),
    "declarations": ("", "<!", ""),
    "end of a script": ("<script>", "</script ", ""),
    "unknown ends": ("<div>" * 20_000, "</x>", ""),
    "shielded paragraphs": ("<p><button>" + "<b>" * 20_000, "<hr>", ""),
    "articles in depth": ("<b>" * 20_000, "<article>", ""),
    "inline ends": ("<i>" * 20_000 + "<div>", "</i>", ""),
    "items": ("<ul>", "<li>", ""),
    "spaces in a tag": ("<a x", " ", "y>"),
}


@pytest.mark.parametrize("name", HOSTILE)
def test_parsing_is_linear(name):
    """Four times as much takes no more than about four times as long."""
    before, unit, after = HOSTILE[name]
    took = []
    for size in (100_000, 400_000):
        page = before + unit * (size // len(unit)) + after
        start = time.process_time()
        html_text.main_text(page, frozenset([1]))
        took.append(time.process_time() - start)
    assert took[1] < 9 * took[0] + 0.3


def shape_pages(host, n, chrome, first=0):
    return [(first + k, f"http://{host}/{k}", f"<body>{chrome(k)[0]}<div id='c'><h1>Title {k}</h1>" + "".join(f"<p>long text of page {k} part {j}</p>" for j in range(5)) + f"</div>{chrome(k)[1]}</body>", 1) for k in range(n)]


def test_shapes_at_defaults(spark):
    """Chrome whose text changes from page to page goes by its shape and place alone, at the shipped defaults."""
    chrome = lambda k: ("<div class='m'><ul>" + "".join(f"<li><a href='/{j}'>go {k * 10 + j}</a></li>" for j in range(3 + k % 3)) + "</ul></div>", f"<section><p>now {k}</p></section>")
    rare = lambda k: ("", f"<section><p>once {k}</p></section>" if k == 3 else f"<div class='c{'abcdefghij'[k % 10]}'><p>own {k}</p></div>")
    rows = shape_pages("a.org", 20, chrome) + shape_pages("b.org", 3, chrome, 100) + shape_pages("c.org", 10, rare, 200)
    got = {r["page_id"]: r["text"].split("\n") for r in html_text.extract_text(spark.createDataFrame(rows, SCHEMA), lists=False).collect()}
    assert all(len(got[k]) == 6 and got[k][0] == f"Title {k}" for k in range(20))
    assert all(f"now {k}" in got[100 + k] and f"go {k * 10}" in got[100 + k] for k in range(3))
    assert all(len(got[200 + k]) == 7 for k in range(10))


def test_templates_against_counts(spark):
    """The templates of the given pages are those that exact counts by host and section give, at the defaults."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [(r["url"], r["html"]) for r in pages.collect()]
    per, known = Counter(), set()
    for url, page in rows:
        host, _, path = (url or "").partition("://")[2].partition("/")
        section = path.partition("/")[0] if "/" in path else ""
        root = html_text.parse(page or "")
        html_text.mark_frame(root)
        for unit in {"", section}:
            known.add((host.lower(), unit, page))
            for place, digest in html_text.hash_subtrees(root):
                if place == 0 or unit == "":
                    known.add((host.lower(), unit, page, place, digest))
    for k in known:
        per[k[:2] + k[3:]] += 1

    def significant(part, whole):
        part, z = min(part, whole), 1.96
        return (part + z * z / 2 - z * (part * (whole - part) / whole + z * z / 4) ** 0.5) / (whole + z * z) >= 0.5

    expected, places = {}, Counter()
    for k, n in per.items():
        if len(k) == 4 and n >= 5 and per[k[:2]] >= 5:
            if k[2] == 0 and significant(n, per[k[:2]]):
                expected.setdefault(k[0], set()).add(k[3])
            elif k[2]:
                places[k[0], k[2]] += n
    for k, n in per.items():
        if len(k) == 4 and n >= 5 and k[2] and per[k[:2]] >= 5 and significant(places[k[0], k[2]], per[k[:2]]):
            expected.setdefault(k[0], set()).add(k[3])
    p = pages.select("url", "html", html_text.page_host(F.col("url")).alias("host"))
    got = {r["host"]: set(r["templates"]) for r in html_text.site_templates(p).collect()}
    assert got == expected and len(got) > 10


def test_templates_alone(spark):
    """Without tag and name lists templates take most of the chrome of large sites, and no article text."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html", html_text.page_host(F.col("url")).alias("host"))
    large = pages.groupBy("host").count().filter("count >= 20").select("host")
    pages = pages.join(large, "host", "left_semi").drop("host").cache()
    alone = html_text.extract_text(pages, lists=False).select("page_id", F.col("text").alias("alone"))
    both = html_text.extract_text(pages).select("page_id", "text").join(alone, "page_id").collect()
    chrome = [len(html_text.main_text(r["html"], lists=False)) for r in pages.collect()]
    article, left = sum(len(r["text"]) for r in both), sum(len(r["alone"]) for r in both)
    assert all(set(r["text"].split("\n")) <= set(r["alone"].split("\n")) for r in both)
    assert left - article < 0.1 * (sum(chrome) - article)


def brute_templates(rows, min_labels=5, z=1.96):
    """Template of each (host, path, label): the tree grown one path segment at a time, in plain Python."""
    split = [[x for x in path.split("/") if x] for _, path, _ in rows]
    template = [""] * len(rows)
    deepest = max((len(s) for s, r in zip(split, rows) if r[2] is not None), default=0)
    for depth in range(deepest):
        nodes = {}
        for k, (host, _, label) in enumerate(rows):
            if len(split[k]) > depth:
                n = nodes.setdefault((host, template[k]), {}).setdefault(split[k][depth], [0, 0, 0])
                n[0] += 1
                n[1] += label is not None
                n[2] += label or 0
        branch = {}
        for node, children in nodes.items():
            known = sorted(((c[2] / c[1], s, c) for s, c in children.items() if c[1] >= min_labels))
            classes = []
            for rate, s, c in known:
                if classes:
                    last_rate, last = classes[-1][-1][0], classes[-1][-1][2]
                    pooled = (c[2] + last[2]) / (c[1] + last[1])
                    gap = rate - last_rate
                if not classes or gap > 0 and gap >= z * (pooled * (1 - pooled) * (1 / c[1] + 1 / last[1])) ** 0.5:
                    classes.append([])
                classes[-1].append((rate, s, c))
            for members in classes:
                names = sorted(s for _, s, _ in members)
                name = names[0] if len(names) == 1 else "{" + ",".join(names[:20]) + (f",+{len(names) - 20}" if len(names) > 20 else "") + "}"
                branch |= {(node, s): name for s in names}
            few = {s: c for s, c in children.items() if c[1] < min_labels}
            all_n, all_labelled = sum(c[0] for c in few.values()), sum(c[1] for c in few.values())
            for s, c in few.items() if all_labelled else ():
                rate = (all_labelled - c[1]) / max(all_n - c[0], 1)
                if c[0] * rate - c[1] >= max(z * max(c[0] * rate * (1 - rate), 0) ** 0.5, z * z):
                    branch[node, s] = s
        for k, (host, _, _) in enumerate(rows):
            if len(split[k]) > depth:
                template[k] += "/" + branch.get(((host, template[k]), split[k][depth]), "*")
    return [t + "/**" if len(s) > deepest else t for t, s in zip(template, split)]


@pytest.mark.parametrize("depth", [3, 40])
def test_url_tree_of_any_depth(spark, depth):
    """Labels by the last folder decide at every depth, where no table of labels covers a page."""
    folder = "/".join(f"s{k}" for k in range(depth - 1))
    rows = [(k, f"http://deep.org/{folder}/{('spam', 'news')[k % 2]}/{k}") for k in range(60)]
    labels = spark.createDataFrame([(k, int(k % 2 == 0)) for k in range(40)], "page_id bigint, blocked int")
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string"), [], labels=labels).collect()
    assert all(r["verdict"] == ("block" if r["page_id"] % 2 == 0 else "allow") for r in got)
    assert {r["template"] for r in got} == {f"/{folder}/{x}/*" for x in ("spam", "news")}


def test_url_templates_escape_literals(spark):
    rows = [(k, f"http://h.org/{('*', '{a,b}', 'a', 'b')[k % 4]}/{k}") for k in range(80)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(80)], "page_id bigint, blocked int")
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string"), [], labels=labels).collect()
    assert {r["template"] for r in got} == {r"/\*/*", r"/{\{a\,b\},a,b}/*"} or {r["template"] for r in got} == {r"/\*/*", r"/{a,b,\{a\,b\}}/*"}
    assert {r["page_id"] for r in got if r["verdict"] == "block"} == {k for k in range(80) if k % 4 == 0}


def test_url_tree_against_brute_force(spark):
    """Templates of the given pages and of deep made-up paths are those of a plain tree."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    made = [(10_000 + k, f"http://deep.com/{('u' + str(k), 'en')[k % 2]}/{('a', 'spam', 'b')[k % 3]}/x/{k % 4}/{k}") for k in range(240)]
    labels = {i: int("spam" in u) for i, u in made if i % 5 < 3}
    d = spark.createDataFrame(made, "page_id bigint, url string")
    for table, given in ((pages, None), (d, spark.createDataFrame(list(labels.items()), "page_id bigint, blocked int"))):
        got = url_filter.filter_urls(table, RULES if given is None else [], labels=given).toPandas().sort_values("page_id")
        known = [(None if r is None else int(r[0] == "block")) for r in ([next((v for v in RULES if v[1] == x), None) for x in got["rule"]])] if given is None else [labels.get(i) for i in got["page_id"]]
        rows = list(zip(got["host"], got["path"], known, strict=True))
        assert got["template"].tolist() == brute_templates(rows)
        assert got["template"].str.count("/").max() >= (1 if given is None else 4)
    assert (got[got["path"].str.contains("/spam/")]["verdict"] == "block").mean() > 0.9
