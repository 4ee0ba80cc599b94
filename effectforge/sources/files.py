"""Paths and files that tasks write side by side and one stream then joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def uri(path: str) -> str:
    return path if "://" in path else "file://" + path.removeprefix("file:")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir).

    A local session that names none gets a temporary folder; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if spark.sparkContext.applicationId not in _own:
            _own[spark.sparkContext.applicationId] = made = tempfile.mkdtemp(prefix="effectforge-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
        base = _own[spark.sparkContext.applicationId]
    return f"{uri(base).rstrip('/')}/effectforge/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def write_parts(rows: DataFrame, folder: str, encode: Callable[[pa.RecordBatch], dict[str, bytes]]) -> list[tuple]:
    """Every task writes its rows' bytes, a file for each kind that ``encode`` names; (partition, file, rows) of the tasks that counted.

    Files have names of their own, so those of a task that was lost or run twice are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name, out, count = uuid.uuid4().hex, {}, 0
        for b in batches:
            if not b.num_rows:
                continue
            for kind, raw in encode(b).items():
                if kind not in out:
                    out[kind] = fs.open_output_stream(f"{root}/{name}.{kind}", compression=None)
                out[kind].write(raw)
            count += b.num_rows
        for f in out.values():
            f.close()
        if count:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "file": name, "rows": count}])

    return sorted(tuple(r) for r in rows.mapInArrow(run, "part bigint, file string, rows bigint").collect())


def join_parts(folder: str, parts: list[tuple], kind: str, target: str, head: bytes = b"") -> None:
    """The parts' bytes of one kind after one another, behind ``head``."""
    fs, root = pafs.FileSystem.from_uri(folder)
    to, path = pafs.FileSystem.from_uri(target)
    to.create_dir(path.rpartition("/")[0], recursive=True)
    with to.open_output_stream(path, compression=None) as out:
        out.write(head)
        for _, name, _ in parts:
            with fs.open_input_file(f"{root}/{name}.{kind}") as f:
                while piece := f.read(1 << 22):
                    out.write(piece)


def remove(folder: str) -> None:
    fs, root = pafs.FileSystem.from_uri(folder)
    if fs.get_file_info(root).type == pafs.FileType.Directory:
        fs.delete_dir(root)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that what follows survives lost executors and has true sizes."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
