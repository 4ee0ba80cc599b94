"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a local one (as in tests) gets a temporary
    folder; a cluster's executors would not share it, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="effectforge-")
        _own_dirs.append(found)
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
        found = f"file://{found}"
    elif "://" not in found and found.startswith("/") and found in _own_dirs:
        found = f"file://{found}"
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, in a folder of the application's own."""
    return f"{shared_dir(spark)}/effectforge/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application.

    A result that is not computed yet reads them: write it first.
    """
    _delete(spark, f"{shared_dir(spark)}/effectforge/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Shuffle files of a statement go when it ends, where this is on.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage with files that outlive any executor, and gives the
    planner true sizes for what follows.  The shuffle files of the write are of
    no more use and go at once.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, with Arrow batches of this session no longer than ``rows`` from here on.

    A Python worker holds a batch of whole texts at once and keeps the memory
    that it once took, so the default of 10 000 rows is too many for them.
    """
    conf = df.sparkSession.conf
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))
    return df


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`materialize`; what reads them must be written first."""
    for df in tables:
        _delete(df.sparkSession, df.scratch_path)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    name, k = f"__{stem}", 0
    while name.lower() in taken:
        k += 1
        name = f"__{stem}_{k}"
    return name


def bare(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of any name are no matter."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def row_order(df: DataFrame) -> Column:
    """A hash of the whole row, to order rows that repeat a key alike in every run.

    Maps and variants have no hash and are left out.
    """
    kinds = [(f.name, f.dataType.simpleString()) for f in df.schema]
    return F.xxhash64(F.lit(0), *[F.col(f"`{n}`") for n, kind in kinds if "map<" not in kind and "variant" not in kind])


def spark_words(text: Column) -> Column:
    """SQL form of ``[^\\x20\\x09-\\x0D]+`` as an array; null text has no words."""
    return F.filter(
        F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""
    )


def read_tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named Parquet tables of a folder."""
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]
