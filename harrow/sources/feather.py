"""Arrow IPC (Feather V2) files as a PySpark data source.

One partition per file and range of record batches; only the columns of the read schema leave the file.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

BATCHES = 64


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _files(path: str) -> list[str]:
    fs, root = _open(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [root]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    return sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")))


@dataclass
class Batches(InputPartition):
    file: str
    first: int
    end: int


class FeatherReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]) -> None:
        self.path, self.columns = path, columns

    def partitions(self) -> list[Batches]:
        fs, _ = _open(self.path)
        out = []
        for file in _files(self.path):
            with fs.open_input_file(file) as f:
                n = ipc.open_file(f).num_record_batches
            out += [Batches(file, a, min(a + BATCHES, n)) for a in range(0, n, BATCHES)]
        return out or [Batches("", 0, 0)]

    def read(self, partition: Batches) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, _ = _open(self.path)
        with fs.open_input_file(partition.file) as f:
            names = ipc.open_file(f).schema.names
            reader = ipc.open_file(f, options=ipc.IpcReadOptions(included_fields=sorted(names.index(c) for c in self.columns)))
            for k in range(partition.first, partition.end):
                yield reader.get_batch(k).select(self.columns)


class FeatherDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feather"

    def schema(self) -> StructType:
        fs, _ = _open(self.options["path"])
        with fs.open_input_file(_files(self.options["path"])[0]) as f:
            return from_arrow_schema(ipc.open_file(f).schema)

    def reader(self, schema: StructType) -> FeatherReader:
        return FeatherReader(self.options["path"], schema.names)


def read_feather(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A file or folder; with ``columns`` the others are not read."""
    spark.dataSource.register(FeatherDataSource)
    if columns is None:
        return spark.read.format("feather").load(path)
    whole = spark.read.format("feather").load(path).schema
    return spark.read.format("feather").schema(StructType([whole[c] for c in columns])).load(path)
