"""Mixing sources to target weights by pivotal dependent rounding, natively.

A source's target divided by its size is the copy probability of each of its
documents.  The whole part is certain; the fractions are rounded dependently:
two documents pass words from one to the other, in a random direction that
keeps both expectations, until one of them is in or out, and the other goes on
with what is left.  Buckets of documents do this first; the one residual of
each bucket goes on to a bucket of residuals, and so up a reduction tree to a
single residual for each source.  A source's words therefore miss its target by
less than one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from effectforge.llm.common import bare, fresh, materialize, row_order

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
FANOUT = 256
UNIT = "struct<doc_id:{id},rep:bigint,size:bigint,p:double>"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, n, target from rows of source, source_size, n.

    Targets share ``share`` of all sizes by weight and stop at ``most`` times a
    source's size; the excess goes to the others by weight.  With sources in
    the order of limit over weight those at their limit are a prefix, so the
    level of the rest follows from running sums.  One row for each source: the
    sources are a catalogue, not data.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    table = F.array(*[F.lit(w) for w in weights])
    s = sizes.withColumn("weight", F.element_at(table, F.pmod(rank - 1, F.lit(len(weights))).cast("int") + 1))
    s = s.withColumn("limit", most * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("words", share * F.sum("source_size").over(whole))
    s = s.withColumn("capped", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    s = s.withColumn("open_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", (F.col("words") - F.col("capped")) / F.col("open_weight"))
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole))
    target = F.least(F.col("limit").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit").cast("double")))
    return s.select("source", "source_size", "n", target.alias("target"))


def _uniform(*columns: Column) -> Column:
    """A number in [0, 1) fixed by its arguments."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) * F.lit(2.0**-53)


def _pivot(acc: Column, x: Column, seed: int) -> Column:
    """Fold one unit into the carry; one of the two is decided and joins ``out``."""
    a = acc["carry"]
    unit = lambda u, p: F.struct(u["doc_id"].alias("doc_id"), u["rep"].alias("rep"), u["size"].alias("size"), p.alias("p"))
    step = lambda carry, done: F.struct(carry.alias("carry"), F.concat(acc["out"], F.array(done)).alias("out"))
    room_a, has_a = (1 - a["p"]) * a["size"], a["p"] * a["size"]
    room_b, has_b = (1 - x["p"]) * x["size"], x["p"] * x["size"]
    up, down = F.least(room_a, has_b), F.least(has_a, room_b)
    u = _uniform(a["doc_id"], a["rep"], a["size"], x["doc_id"], x["rep"], x["size"], F.lit(seed))
    one, zero = F.lit(1.0), F.lit(0.0)
    to_a = F.when(room_a <= has_b, step(unit(x, F.greatest(zero, x["p"] - up / x["size"])), unit(a, one))).otherwise(
        step(unit(a, F.least(one, a["p"] + up / a["size"])), unit(x, zero))
    )
    to_b = F.when(has_a <= room_b, step(unit(x, F.least(one, x["p"] + down / x["size"])), unit(a, zero))).otherwise(
        step(unit(a, F.greatest(zero, a["p"] - down / a["size"])), unit(x, one))
    )
    settled = (a["p"] <= 1e-12) | (a["p"] >= 1 - 1e-12)
    return (
        F.when(a.isNull(), F.struct(x.alias("carry"), acc["out"].alias("out")))
        .when(settled, step(x, a))
        .when(u * (up + down) < down, to_a)
        .otherwise(to_b)
    )


def _reduce(units: DataFrame, id_type: str, seed: int) -> DataFrame:
    """Fold each (source, bucket) of ``units`` (source, bucket, rank, u)."""
    unit = UNIT.format(id=id_type)
    start = F.struct(F.lit(None).cast(unit).alias("carry"), F.array().cast(f"array<{unit}>").alias("out"))
    listed = units.groupBy("source", "bucket").agg(F.array_sort(F.collect_list(F.struct("rank", "u"))).alias("us"))
    folded = F.aggregate(F.transform("us", lambda e: e["u"]), start, lambda acc, x: _pivot(acc, x, seed))
    return listed.select("source", "bucket", folded.alias("f"))


def round_copies(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 11) -> DataFrame:
    """doc_id, source, size, rep, source_size, target, copies for each document.

    Rows equal in id, source and size are told apart by ``rep``, from 0.  A
    null text has size 0 and no words are taken from it; a null source is a
    source of its own, the last; a null id is an id like any other; an empty
    table gives no rows.
    """
    d = bare(docs, "doc_id", "source", "text").select(
        "doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size")
    )
    id_type = dict(d.dtypes)["doc_id"]
    many = 4096
    units = materialize(d.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")), "mix-units")
    units = (
        units.withColumn("first", F.explode(F.expr(f"sequence(0L, m - 1, {many}L)")))
        .withColumn("rep", F.explode(F.expr(f"sequence(first, least(first + {many - 1}, m - 1))")))
        .select("doc_id", "source", "size", "rep")
    )
    sums = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = materialize(source_targets(sums, weights, share, most), "mix-sources")
    largest = sources.agg(F.max("n")).first()[0] or 0
    p = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    slim = F.col("size").alias("size"), F.col("rep").alias("rep")
    joined = units.join(sources, units["source"].eqNullSafe(sources["source"])).drop(units["source"])
    joined = joined.withColumn("base", F.floor(p + 1e-12)).withColumn("p", F.greatest(F.lit(0.0), p - F.col("base")))
    open_ = (F.col("p") > 1e-12) & (F.col("size") > 0)
    fixed = joined.filter(~open_).select("source", "doc_id", *slim, F.lit(0).alias("extra"))
    spread = F.xxhash64("doc_id", "rep", "size", F.lit(seed))
    level = joined.filter(open_).select(
        "source",
        F.pmod(spread, F.ceil(F.col("n") / FANOUT)).alias("bucket"),
        spread.alias("rank"),
        F.struct("doc_id", "rep", "size", "p").alias("u"),
    )
    decided = [fixed]
    buckets = -(-largest // FANOUT)
    while True:
        folded = materialize(_reduce(level, id_type, seed), "mix-level")
        done = folded.select("source", F.explode("f.out").alias("u"))
        decided.append(done.select("source", "u.doc_id", "u.size", "u.rep", (F.col("u.p") > 0.5).cast("int").alias("extra")))
        rest = folded.filter("f.carry is not null").select("source", F.col("bucket"), F.col("f.carry").alias("u"))
        if buckets <= 1:
            draw = _uniform(F.col("u.doc_id"), F.col("u.rep"), F.col("u.size"), F.lit(seed + 1))
            decided.append(rest.select("source", "u.doc_id", "u.size", "u.rep", (draw < F.col("u.p")).cast("int").alias("extra")))
            break
        level = rest.select("source", F.floor(F.col("bucket") / FANOUT).alias("bucket"), F.col("bucket").alias("rank"), "u")
        buckets = -(-buckets // FANOUT)
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    s = sources.withColumnRenamed("source", "own")
    out = out.join(s, out["source"].eqNullSafe(s["own"])).drop("own", "n")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return out.withColumn("copies", F.floor(ratio + 1e-12) + F.col("extra")).drop("extra")


def mix_sources(docs: DataFrame, **params) -> DataFrame:
    """doc_id, size, source_size, target, taken for each document."""
    return round_copies(docs, **params).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("bigint").alias("taken")
    )


def take_mix(docs: DataFrame, **params) -> DataFrame:
    """The documents of the mix with the columns of ``docs`` and ``copies``.

    A document that the mix takes no copy of is left out; one without words
    comes with the certain copies of its source, if any.  Of rows equal in id, source
    and size, which has how many copies follows a hash of the row.  A column that is
    named ``copies`` already stays, and the new one has another name; an empty table
    gives no rows.
    """
    names = {c: fresh(docs, c) for c in ("mix_id", "mix_source", "mix_size", "mix_rep", "size", "rep")}
    plan = round_copies(docs, **params).select(
        F.col("doc_id").alias(names["mix_id"]),
        F.col("source").alias(names["mix_source"]),
        F.col("size").alias(names["mix_size"]),
        F.col("rep").alias(names["mix_rep"]),
        F.col("copies").alias("copies" if "copies" not in map(str.lower, docs.columns) else fresh(docs, "copies")),
    )
    plan = materialize(plan, "mix-plan")
    twice = plan.filter(F.col(names["mix_rep"]) > 0).limit(1).count() > 0
    plan = plan.filter(F.col(plan.columns[-1]) > 0)
    d = docs.withColumn(names["size"], word_count(F.col("text").cast("string")))
    same = d["doc_id"].eqNullSafe(plan[names["mix_id"]]) & d["source"].eqNullSafe(plan[names["mix_source"]]) & (d[names["size"]] == plan[names["mix_size"]])
    if twice:
        key = Window.partitionBy("doc_id", "source", names["size"]).orderBy(row_order(docs))
        d = d.withColumn(names["rep"], F.row_number().over(key).cast("bigint") - 1)
        same = same & (d[names["rep"]] == plan[names["mix_rep"]])
    return d.join(plan, same).drop(*names.values())
