"""Genotypes from a user's function, a chunk of markers at a time, as a data source."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "marker_idx int, marker_id string, dosages array<int>"


class _Chunk(InputPartition):
    def __init__(self, first: int, names: Sequence[str]) -> None:
        super().__init__(first)
        self.first, self.names = first, list(names)


def provider_panel(spark: SparkSession, fetch: Callable[[list[str]], tuple[Sequence[str], np.ndarray]], markers: Sequence[str], chunk: int = 256, name: str = "genotype_provider") -> DataFrame:
    """marker_idx, marker_id, dosages by sample, of markers that ``fetch`` gives.

    ``fetch`` takes names of markers and gives names, in any order, and a matrix of dosages, a row for
    each, negative or nan for missing.  It runs in the tasks, one call for ``chunk`` markers; rows are put
    in the order of ``markers`` by name, and a marker that is missing, comes twice or has another
    number of samples than the first of its chunk is an error.
    """
    if len(set(markers)) != len(markers):
        raise ValueError("markers are named once each")
    wanted = list(markers)

    class Reader(DataSourceReader):
        def partitions(self) -> list[_Chunk]:
            return [_Chunk(k, wanted[k : k + chunk]) for k in range(0, len(wanted), chunk)]

        def read(self, partition: _Chunk) -> Iterator[pa.RecordBatch]:
            names, table = fetch(partition.names)
            table = np.asarray(table, float)
            if sorted(names) != sorted(partition.names) or table.ndim != 2 or len(table) != len(names):
                raise ValueError(f"the provider gave other markers than those asked for from {partition.first} on")
            place = {n: k for k, n in enumerate(names)}
            g = table[[place[n] for n in partition.names]]
            none = np.isnan(g) | (g < 0)
            flat = pa.array(np.where(none, 0, g).astype(np.int32).ravel(), mask=none.ravel())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(partition.first, partition.first + len(g)), pa.int32()),
                    pa.array(partition.names, pa.string()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(g) + 1) * g.shape[1], pa.int32()), flat),
                ],
                names=["marker_idx", "marker_id", "dosages"],
            )

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    spark.dataSource.register(Source)
    return spark.read.format(name).load()
