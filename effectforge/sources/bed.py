"""PLINK BED genotypes as a PySpark data source.

``spark.read.format("plink_bed")`` gives a row for each marker: marker_idx and
its dosages, null for missing.  Partitions are ranges of markers, each read with
one seek; only SNP-major files are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from effectforge.sources.files import join_parts, remove, shared_path, uri, write_parts

#: The header, and dosages of the 2-bit codes (1 is missing).
MAGIC = b"\x6c\x1b\x01"
CODES = np.array([2, -1, 1, 0], np.int8)


def decode(block: np.ndarray, n: int) -> np.ndarray:
    """Dosages (marker by sample) of packed rows, -1 for missing."""
    codes = (block[:, :, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3
    return CODES[codes.reshape(len(block), -1)[:, :n]]


def write_bed(markers: DataFrame, path: str) -> None:
    """A BED file of (marker_idx, dosages by sample), null for missing, in the order of the markers.

    Tasks pack ranges of markers; their bytes are then copied after one another.
    """

    def pack(b: pa.RecordBatch) -> dict[str, bytes]:
        flat = np.asarray(b.column(0).flatten().fill_null(-1)).astype(np.int8)
        return {"bed": encode(flat.reshape(b.num_rows, -1))[len(MAGIC) :]}

    folder = shared_path(markers.sparkSession, "bed")
    parts = write_parts(markers.orderBy("marker_idx").select("dosages"), folder, pack)
    join_parts(folder, parts, "bed", uri(path), MAGIC)
    remove(folder)


def encode(dosages: np.ndarray) -> bytes:
    """A whole BED file of dosages (marker by sample), -1 for missing."""
    table = np.array([3, 2, 0, 1], np.uint8)
    m, n = dosages.shape
    codes = np.zeros((m, -(-n // 4) * 4), np.uint8)
    codes[:, :n] = table[dosages]
    packed = (codes.reshape(m, -1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(2).astype(np.uint8)
    return MAGIC + packed.tobytes()


@dataclass
class _Range(InputPartition):
    start: int
    end: int


class BedReader(DataSourceReader):
    def __init__(self, path: str, n: int, samples: list[int] | None, columns: list[int] | None, block: int) -> None:
        self.path, self.n, self.samples, self.columns, self.block = uri(path), n, samples, columns, block

    def _markers(self) -> int:
        fs, file = pafs.FileSystem.from_uri(self.path)
        size, stride = fs.get_file_info(file).size - 3, -(-self.n // 4)
        if size < 0 or size % stride:
            raise ValueError(f"{self.path} does not hold whole markers of {self.n} samples")
        return size // stride

    def partitions(self) -> list[InputPartition]:
        m = len(self.columns) if self.columns is not None else self._markers()
        return [_Range(k, min(k + self.block, m)) for k in range(0, m, self.block)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        fs, file = pafs.FileSystem.from_uri(self.path)
        stride = -(-self.n // 4)
        with fs.open_input_file(file) as f:
            if f.read(3) != MAGIC:
                raise ValueError(f"{self.path} is not a SNP-major BED file")
            ids = list(range(partition.start, partition.end)) if self.columns is None else self.columns[partition.start : partition.end]
            runs = np.split(np.array(ids, np.int64), np.flatnonzero(np.diff(ids) != 1) + 1) if ids else []
            at = partition.start
            for run in runs:
                f.seek(3 + int(run[0]) * stride)
                raw = np.frombuffer(f.read(len(run) * stride), np.uint8).reshape(len(run), stride)
                g = decode(raw, self.n)
                if self.samples is not None:
                    g = g[:, self.samples]
                flat = g.ravel()
                values = pa.array(flat.astype(np.int32), mask=flat < 0)
                offsets = pa.array(np.arange(0, flat.size + 1, g.shape[1]), pa.int32())
                index = pa.array(np.arange(at, at + len(run)), pa.int32())
                at += len(run)
                yield pa.RecordBatch.from_arrays([index, pa.ListArray.from_arrays(offsets, values)], names=["marker_idx", "dosages"])


class BedDataSource(DataSource):
    """Options: path, n (samples in the file), samples and columns (0-based lists), block."""

    @classmethod
    def name(cls) -> str:
        return "plink_bed"

    def schema(self) -> str:
        return "marker_idx int, dosages array<int>"

    def reader(self, schema: StructType) -> DataSourceReader:
        numbers = lambda k: [int(x) for x in re.findall(r"\d+", self.options[k])] if k in self.options else None
        return BedReader(self.options["path"], int(self.options["n"]), numbers("samples"), numbers("columns"), int(self.options.get("block", "1000")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BedDataSource)
