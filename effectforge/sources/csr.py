"""Sparse LD files: upper triangles in CSR, and the older banded format.

Four files share a prefix: row pointers (uint64), 0-based columns (uint32),
correlations (float32), and metadata lines ``key=value``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from effectforge.operators.ld import row_pointers
from effectforge.sources.files import join_parts, remove, shared_path, uri, write_parts

#: Names of the files of the format.
SUFFIXES = {"ptr": ".row_ptr.u64.bin", "idx": ".col_idx.u32.0based.bin", "val": ".values.f32.bin", "meta": ".meta.txt"}


def write_csr(edges: DataFrame, markers: DataFrame, prefix: str, **meta) -> None:
    """Export edges in marker order.

    Sorted ranges of rows are encoded by the tasks, side by side; the format is one file of
    each kind, so their bytes are then copied after one another.
    """
    folder = shared_path(edges.sparkSession, "csr")
    rows = row_pointers(edges, markers).orderBy("i").select((F.col("row_ptr") + F.col("nnz")).alias("end"))
    parts = write_parts(rows, folder, lambda b: {"ptr": np.asarray(b.column(0)).astype("<u8").tobytes()})
    join_parts(folder, parts, "ptr", uri(prefix) + SUFFIXES["ptr"], np.zeros(1, "<u8").tobytes())
    encode = lambda b: {"idx": np.asarray(b.column(0)).astype("<u4").tobytes(), "val": np.asarray(b.column(1)).astype("<f4").tobytes()}
    ordered = write_parts(edges.orderBy("i", "j").select("j", "r"), folder, encode)
    for kind in ("idx", "val"):
        join_parts(folder, ordered, kind, uri(prefix) + SUFFIXES[kind])
    remove(folder)
    m, nnz = sum(p[2] for p in parts), sum(p[2] for p in ordered)
    lines = {"format": "csr", "storage": "upper", "n_variants": m, "nnz": nnz, "triangle": "upper", "diagonal": "implicit_one", "value": "r"} | meta
    fs, root = pafs.FileSystem.from_uri(uri(prefix))
    with fs.open_output_stream(root + SUFFIXES["meta"]) as out:
        out.write("".join(f"{k}={v}\n" for k, v in lines.items()).encode())


def read_meta(prefix: str) -> dict[str, str]:
    fs, root = pafs.FileSystem.from_uri(uri(prefix))
    with fs.open_input_stream(root + SUFFIXES["meta"]) as f:
        return dict(line.split("=", 1) for line in f.read().decode().splitlines() if "=" in line)


@dataclass
class _Rows(InputPartition):
    start: int
    end: int


class CsrReader(DataSourceReader):
    """Partitions are ranges of rows; each reads its own slice of the three files."""

    def __init__(self, prefix: str, one_based: bool, block: int) -> None:
        self.prefix, self.one_based, self.block = uri(prefix), one_based, block

    def partitions(self) -> list[InputPartition]:
        fs, root = pafs.FileSystem.from_uri(self.prefix)
        m = fs.get_file_info(root + SUFFIXES["ptr"]).size // 8 - 1
        return [_Rows(k, min(k + self.block, m)) for k in range(0, m, self.block)] or [_Rows(0, 0)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(self.prefix)

        def part(kind: str, start: int, n: int, dtype: str) -> np.ndarray:
            size = np.dtype(dtype).itemsize
            with fs.open_input_file(root + SUFFIXES[kind]) as f:
                f.seek(start * size)
                return np.frombuffer(f.read(n * size), dtype)

        if partition.start == partition.end:
            return
        ptr = part("ptr", partition.start, partition.end - partition.start + 1, "<u8").astype(np.int64)
        n, base = int(ptr[-1] - ptr[0]), int(self.one_based)
        i = np.repeat(np.arange(partition.start, partition.end), np.diff(ptr)) + base
        j = part("idx", int(ptr[0]), n, "<u4").astype(np.int64) + base
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j.astype(np.int32)), pa.array(part("val", int(ptr[0]), n, "<f4"))], names=["i", "j", "r"]
        )


class CsrDataSource(DataSource):
    """Options: path (the prefix), one_based, block (rows of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "ld_csr"

    def schema(self) -> str:
        return "i int, j int, r float"

    def reader(self, schema: StructType) -> DataSourceReader:
        return CsrReader(self.options["path"], self.options.get("one_based", "false").lower() == "true", int(self.options.get("block", "65536")))


class BandedReader(DataSourceReader):
    """Ranges of markers of a banded file: 2 * half_width + 1 float32 each, kept where |r| is above the limit."""

    def __init__(self, path: str, half_width: int, min_abs_r: float, block: int) -> None:
        self.path, self.half, self.limit, self.block = uri(path), half_width, min_abs_r, block

    def _markers(self) -> int:
        fs, root = pafs.FileSystem.from_uri(self.path)
        size, stride = fs.get_file_info(root).size, 4 * (2 * self.half + 1)
        if size % stride:
            raise ValueError(f"{self.path} does not hold whole bands of {2 * self.half + 1}")
        return size // stride

    def partitions(self) -> list[InputPartition]:
        m = self._markers()
        return [_Rows(k, min(k + self.block, m)) for k in range(0, m, self.block)] or [_Rows(0, 0)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        width, m = 2 * self.half + 1, self._markers()
        with fs.open_input_file(root) as f:
            f.seek(4 * width * partition.start)
            band = np.frombuffer(f.read(4 * width * (partition.end - partition.start)), "<f4").reshape(-1, width)
        i, k = np.nonzero(np.abs(band) > self.limit)
        value, i = band[i, k], i + partition.start
        j = i + k - self.half
        up = (j > i) & (j < m)
        yield pa.RecordBatch.from_arrays([pa.array(i[up], pa.int32()), pa.array(j[up], pa.int32()), pa.array(value[up])], names=["i", "j", "r"])


class BandedDataSource(DataSource):
    """Options: path, half_width, min_abs_r, block (markers of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "ld_banded"

    def schema(self) -> str:
        return "i int, j int, r float"

    def reader(self, schema: StructType) -> DataSourceReader:
        return BandedReader(self.options["path"], int(self.options["half_width"]), float(self.options.get("min_abs_r", "0.01")), int(self.options.get("block", "4096")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CsrDataSource)
    spark.dataSource.register(BandedDataSource)


def read_banded(spark: SparkSession, path: str, half_width: int, min_abs_r: float = 0.01) -> DataFrame:
    """Edges of a banded file, with |r| above the limit."""
    register(spark)
    return spark.read.format("ld_banded").options(half_width=half_width, min_abs_r=min_abs_r).load(path)


def write_banded(edges: DataFrame, markers: DataFrame, path: str, half_width: int) -> None:
    """A banded file of edges within ``half_width``, the diagonal 1, what is not listed 0."""
    width = 2 * half_width + 1
    both = edges.select("i", "j", "r").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "r"))
    near = both.filter(F.abs(F.col("j") - F.col("i")) <= half_width).groupBy("i").agg(F.collect_list(F.struct((F.col("j") - F.col("i") + half_width).cast("int").alias("k"), F.col("r").cast("float").alias("r"))).alias("e"))
    rows = markers.select(F.col("marker_idx").alias("i")).join(near, "i", "left").orderBy("i").select(F.coalesce("e", F.array().cast("array<struct<k:int,r:float>>")).alias("e"))

    def encode(b: pa.RecordBatch) -> dict[str, bytes]:
        lists = b.column(0)
        edges_at = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        band = np.zeros((len(lists), width), "<f4")
        band[:, half_width] = 1
        flat = lists.flatten()
        band[np.repeat(np.arange(len(lists)), np.diff(edges_at)), np.asarray(flat.field("k"))] = np.asarray(flat.field("r"))
        return {"band": band.tobytes()}

    folder = shared_path(edges.sparkSession, "banded")
    join_parts(folder, write_parts(rows, folder, encode), "band", uri(path))
    remove(folder)


def subset(edges: DataFrame, markers: DataFrame) -> DataFrame:
    """Edges among (marker_idx, local_idx), renumbered."""
    a = markers.select(F.col("marker_idx").alias("i"), F.col("local_idx").alias("a"))
    b = markers.select(F.col("marker_idx").alias("j"), F.col("local_idx").alias("b"))
    return edges.join(a, "i").join(b, "j").select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "r")
