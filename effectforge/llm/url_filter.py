"""URL filters: explicit rules, and for the rest a path-template tree of each host.

The tree grows a segment at a time.  Segments with few labels, the variable ones
above all, become one wildcard branch, but for those that have significantly
fewer labels than the rest of it: nothing is known of them, and each is a branch.
Of the segments with enough labels, siblings whose labels do not tell them apart
statistically merge into one branch.  Neither the number of pages nor the share
of the host counts.  A template is rejected where the share of blocked labels
among its labels, smoothed towards its host's and that towards all hosts', is high
at its lower confidence bound.  Everything here is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from effectforge.llm.common import bare, materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules held as one expression; a longer list is joined.
MAX_INLINE_RULES = 200
#: Segments that the name of a merged branch lists.
MAX_NAMED = 20


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def split_rule(rule: str) -> tuple[str, str]:
    """Host and path of a rule such as ``example.com/en/``."""
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


def _fits(rule: str) -> Column:
    host, path = split_rule(rule)
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)


def apply_rules(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``urls`` (host, path, ...) with ``rule`` and ``rule_verdict``, the longest rule's.

    Of rules equally long the first in the list wins.  Up to
    ``MAX_INLINE_RULES`` are one expression; more are joined by host suffix and
    path prefix.
    """
    ordered = sorted(rules, key=lambda r: -len(r[1]))
    if len(ordered) <= MAX_INLINE_RULES:
        hit = F.lit(None).cast("struct<rule:string,rule_verdict:string>")
        for verdict, rule in reversed(ordered):
            hit = F.when(_fits(rule), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("rule_verdict"))).otherwise(hit)
        return urls.withColumn("hit", hit).select(*urls.columns, "hit.rule", "hit.rule_verdict")
    spark = urls.sparkSession
    table = spark.createDataFrame(
        [(*split_rule(r), r, v, k) for k, (v, r) in enumerate(ordered)],
        "rule_host string, rule_path string, rule string, rule_verdict string, place int",
    )
    lengths = F.array(*[F.lit(n) for n in sorted({len(split_rule(r)[1]) for _, r in ordered})])
    pairs = urls.select("host", "path").distinct()
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.char_length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    keyed = pairs.withColumn("rule_host", F.explode(suffixes)).withColumn("rule_path", F.explode(prefixes))
    best = (
        keyed.join(table, ["rule_host", "rule_path"])
        .groupBy("host", "path")
        .agg(F.min_by(F.struct("rule", "rule_verdict"), "place").alias("hit"))
        .select("host", "path", "hit.rule", "hit.rule_verdict")
    )
    return urls.join(best, ["host", "path"], "left").select(*urls.columns, "rule", "rule_verdict")


def _merge_similar(children: DataFrame, z: float) -> DataFrame:
    """host, template, segment, branch: siblings next to each other in rate merge unless they differ.

    Neighbours in the order of their blocked share stay apart where a test of
    two proportions tells them apart.  The window holds the children of a parent
    with enough labels each; a branch of many names some and tells their number.
    """
    rate = F.col("bad") / F.col("labelled")
    order = Window.partitionBy("host", "template").orderBy("rate", "segment")
    c = children.withColumn("rate", rate)
    n, m, b, d = F.col("labelled"), F.lag("labelled").over(order), F.col("bad"), F.lag("bad").over(order)
    pooled = (b + d) / (n + m)
    apart = (F.col("rate") - F.lag("rate").over(order) > 0) & (
        F.col("rate") - F.lag("rate").over(order) >= z * F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
    )
    c = c.withColumn("apart", F.coalesce(apart.cast("int"), F.lit(0)))
    c = c.withColumn("class", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    members = c.groupBy("host", "template", "class").agg(F.sort_array(F.collect_set("segment")).alias("members"))
    names = F.array_join(F.slice("members", 1, MAX_NAMED), ",")
    more = F.when(F.size("members") > MAX_NAMED, F.concat(F.lit(",+"), F.size("members") - MAX_NAMED)).otherwise(F.lit(""))
    name = F.when(F.size("members") == 1, F.col("members")[0]).otherwise(F.concat(F.lit("{"), names, more, F.lit("}")))
    named = members.select("host", "template", "class", name.alias("branch"))
    return c.join(named, ["host", "template", "class"]).select("host", "template", "segment", "branch")


def _unlabelled(children: DataFrame, z: float) -> DataFrame:
    """host, template, segment, branch: of segments with few labels, those with significantly fewer than the others.

    A segment's labels are compared with those expected at the rate of the other
    segments with few labels; a shortfall below z squared is never significant.
    """
    pools = children.groupBy("host", "template").agg(F.sum("n").alias("all_n"), F.sum("labelled").alias("all_labelled")).filter("all_labelled > 0")
    others = F.greatest(F.col("all_n") - F.col("n"), F.lit(1))
    rate = (F.col("all_labelled") - F.col("labelled")) / others
    short = F.col("n") * rate - F.col("labelled")
    least = F.greatest(z * F.sqrt(F.col("n") * rate * (1 - rate)), F.lit(z * z))
    return children.join(pools, ["host", "template"]).filter(short >= least).select("host", "template", "segment", F.col("segment").alias("branch"))


def path_templates(paths: DataFrame, *, min_labels: int = 5, z: float = 1.96) -> DataFrame:
    """``paths`` (host, path, n, labelled, bad) with ``template``: the branch of each path.

    n pages have the path, labelled of them a label, bad of them a blocking one.  The tree
    is as deep as the deepest path with a label, and branches without any label are not
    followed: each of their segments is a wildcard, and what lies deeper one for all.
    Segments that all paths of a branch share are taken in one step.  Asterisks, braces,
    commas and backslashes of a path are escaped by a backslash in templates.
    """
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    rest = F.transform(segments, lambda s: F.regexp_replace(s, r"([\\*{},])", r"\\$1"))
    known = ["host", "path", "n", "labelled", "bad"]
    rows = materialize(paths.select(*known, rest.alias("rest"), F.lit("").alias("template"), F.lit(0).alias("depth")), "url-rows")
    deepest = rows.filter("labelled > 0").agg(F.max(F.size("rest"))).first()[0] or 0
    ended = F.size("rest") == 0
    done = [rows.filter(ended).select(*known, "template")]
    rows = rows.filter(~ended)
    while not rows.isEmpty():
        groups = rows.groupBy("host", "template").agg(
            F.sum("labelled").alias("labels"), F.min("rest").alias("low"), F.max("rest").alias("high"), F.min(F.size("rest")).alias("least")
        )
        shared = F.filter(F.sequence(F.lit(1), F.col("least")), lambda k: F.slice("low", F.lit(1), k) == F.slice("high", F.lit(1), k))
        shared = F.slice("low", F.lit(1), F.size(shared))
        groups = groups.select("host", "template", "labels", shared.alias("run"))
        names = F.when(F.col("labels") >= min_labels, F.col("run")).otherwise(F.array_repeat(F.lit("*"), F.size("run")))
        wild = F.least(F.size("rest"), F.lit(deepest) - F.col("depth"))
        closed = F.concat("template", F.repeat(F.lit("/*"), wild), F.when(F.size("rest") > wild, "/**").otherwise(""))
        through = F.concat("template", F.array_join(F.transform(names, lambda s: F.concat(F.lit("/"), s)), ""))
        open_ = F.col("labels") > 0
        stepped = rows.join(groups, ["host", "template"]).select(
            *known,
            F.when(open_, through).otherwise(closed).alias("template"),
            F.when(open_, F.slice("rest", F.size("run") + 1, F.size("rest"))).otherwise(F.array().cast("array<string>")).alias("rest"),
            (F.col("depth") + F.size("run")).alias("depth"),
        )
        stepped = materialize(stepped, "url-runs")
        done.append(stepped.filter(ended).select(*known, "template"))
        rows = stepped.filter(~ended).withColumn("segment", F.col("rest")[0])
        counts = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
        children = rows.groupBy("host", "template", "segment").agg(*counts)
        enough = F.col("labelled") >= min_labels
        kept = _merge_similar(children.filter(enough), z).unionByName(_unlabelled(children.filter(~enough), z))
        branch = F.concat("template", F.lit("/"), F.coalesce("branch", F.lit("*")))
        rows = rows.join(kept, ["host", "template", "segment"], "left").select(
            *known, branch.alias("template"), F.slice("rest", F.lit(2), F.size("rest")).alias("rest"), (F.col("depth") + 1).alias("depth")
        )
        rows = materialize(rows, "url-rows")
        done.append(rows.filter(ended).select(*known, "template"))
        rows = rows.filter(~ended)
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return found


def judge_templates(
    rows: DataFrame, *, min_labels: int = 5, smoothing: float = 5.0, reject_at: float = 0.7, z: float = 1.2816
) -> DataFrame:
    """host, template, labels, smoothed purity and the verdict on each template of ``rows`` (see :func:`path_templates`).

    A template is rejected where the lower bound of its smoothed purity (Wilson's,
    one-sided 90 % by default) is at least ``reject_at``, however many pages have no
    label.  One with fewer labels than ``min_labels`` is allowed.
    """
    templates = rows.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("labelled", "bad", "n")])
    hosts = templates.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("bad").alias("host_bad"))
    top = hosts.agg(F.sum("host_labelled").alias("a"), F.sum("host_bad").alias("b")).first()
    prior = (top["b"] / top["a"]) if top["a"] else 0.0
    host_rate = (F.col("host_bad") + smoothing * prior) / (F.col("host_labelled") + smoothing)
    purity = (F.col("bad") + smoothing * host_rate) / (F.col("labelled") + smoothing)
    size = F.col("labelled") + smoothing
    spread = z * F.sqrt(purity * (1 - purity) / size + z * z / (4 * size * size))
    least = (purity + z * z / (2 * size) - spread) / (1 + z * z / size)
    return templates.join(hosts, "host").select(
        "host",
        "template",
        "n",
        "labelled",
        purity.alias("purity"),
        F.when((F.col("labelled") >= min_labels) & (least >= reject_at), "block").otherwise("allow").alias("template_verdict"),
    )


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str]], *, labels: DataFrame | None = None, **judging
) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for each page.

    Labels (page_id, blocked 0/1) train the templates; without them the rules'
    own verdicts do.  A null URL, or one without ``://``, has an empty host and
    path, fits no rule and shares one template; repeated rows count as often as
    they come; an empty table gives no rows.
    """
    u = bare(pages, "page_id", "url").select(
        "page_id", url_host(F.col("url").cast("string")).alias("host"), url_path(F.col("url").cast("string")).alias("path")
    )
    u = apply_rules(u, rules)
    if labels is None:
        u = u.withColumn("label", F.when(F.col("rule_verdict") == "block", 1).when(F.col("rule_verdict") == "allow", 0))
    else:
        known = bare(labels, "page_id", "blocked").groupBy("page_id").agg(F.max("blocked").cast("int").alias("label"))
        u = u.join(known, "page_id", "left")
    counts = [F.count("*").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad")]
    rows = materialize(path_templates(u.groupBy("host", "path").agg(*counts)), "url-templates")
    judged = rows.select("host", "path", "template").join(judge_templates(rows, **judging), ["host", "template"])
    judged = materialize(judged.select("host", "path", "template", "purity", "template_verdict"), "url-verdicts")
    return u.join(judged, ["host", "path"]).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("rule_verdict", "template_verdict").alias("verdict"),
        "template",
        "purity",
    )
