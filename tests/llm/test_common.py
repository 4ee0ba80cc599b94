"""Scratch tables and fresh names."""

import os

from effectforge.llm import common


def test_scratch(spark):
    d = common.materialize(spark.range(5), "x")
    other = common.materialize(spark.range(0), "y")
    assert d.count() == 5 and other.count() == 0 and other.columns == ["id"]
    folder = d.scratch_path.removeprefix("file://")
    assert os.path.isdir(folder) and spark.sparkContext.applicationId in folder
    common.discard(d)
    assert not os.path.exists(folder)
    common.clear_scratch(spark)
    assert not os.path.exists(folder.rsplit("/", 1)[0])


def test_fresh(spark):
    d = spark.createDataFrame([(1, 2)], "__N int, __n_1 int")
    assert common.fresh(d, "n") == "__n_2"


def test_small_batches_keeps_smaller(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "7")
    common.small_batches(spark.range(1))
    assert spark.conf.get(name) == "7"
    spark.conf.unset(name)
    common.small_batches(spark.range(1))
    assert spark.conf.get(name) == "1000"
