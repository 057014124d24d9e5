"""Arrow files (feather, version 2) as a Spark data source: read in splits of record batches, written in two phases."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

NAME = "arrow_files"
ENDINGS = (".arrow", ".feather")
#: A split is about this many stored bytes, and one record batch at least.
SPLIT_BYTES = 64 * 2**20


def _data_files(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """Files of a folder, or the file itself, by name; names that begin with a dot or an underscore are not data."""
    filesystem, base = fs.FileSystem.from_uri(path)
    info = filesystem.get_file_info(base)
    if info.type == fs.FileType.File:
        return filesystem, [info]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [f for f in filesystem.get_file_info(fs.FileSelector(base)) if f.type == fs.FileType.File]
    wanted = [f for f in files if f.base_name.endswith(ENDINGS) and f.base_name[0] not in "._"]
    return filesystem, sorted(wanted, key=lambda f: f.path)


def _plain(schema: pa.Schema) -> pa.Schema:
    """The schema with dictionary-encoded columns as columns of their values."""
    kinds = [f.type.value_type if pa.types.is_dictionary(f.type) else f.type for f in schema]
    return pa.schema([pa.field(f.name, kind) for f, kind in zip(schema, kinds)])


@dataclass
class Split(InputPartition):
    """Record batches ``first`` to ``end`` (exclusive) of a file."""

    path: str
    first: int
    end: int


class ArrowReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, split_bytes: int):
        self.names, self.path, self.split_bytes = schema.names, path, split_bytes
        self.types = to_arrow_schema(schema)

    def partitions(self) -> Sequence[Split]:
        """Splits by the footers alone."""
        filesystem, files = _data_files(self.path)
        splits = []
        for info in files:
            with filesystem.open_input_file(info.path) as stored:
                batches = pa.ipc.open_file(stored).num_record_batches
            step = max(1, batches * self.split_bytes // max(info.size, 1))
            splits += [Split(info.path, first, min(first + step, batches)) for first in range(0, batches, step)]
        return splits or [Split("", 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        """Only the batches of the split and only the columns asked for leave the file. A column that the file lacks is null."""
        if split.first == split.end:
            return
        filesystem, _ = fs.FileSystem.from_uri(self.path)
        with filesystem.open_input_file(split.path) as stored:
            present = pa.ipc.open_file(stored).schema
            fields = [i for i, name in enumerate(present.names) if name in self.names]
            reader = pa.ipc.open_file(stored, options=pa.ipc.IpcReadOptions(included_fields=fields))
            for number in range(split.first, split.end):
                batch = reader.get_batch(number)
                columns = [
                    batch.column(f.name).cast(f.type) if f.name in batch.schema.names else pa.nulls(batch.num_rows, f.type)
                    for f in self.types
                ]
                yield pa.RecordBatch.from_arrays(columns, names=self.names)


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    rows: int


class ArrowWriter(DataSourceArrowWriter):
    """Each task writes a file under a temporary name; the commit gives the files of the attempts that count their names."""

    def __init__(self, schema: StructType, path: str, overwrite: bool):
        self.path, self.overwrite, self.types = path, overwrite, to_arrow_schema(schema)
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        filesystem, base = fs.FileSystem.from_uri(self.path)
        filesystem.create_dir(f"{base}/_temporary-{self.job}", recursive=True)
        temporary, rows = f"{base}/_temporary-{self.job}/{uuid.uuid4().hex}.arrow", 0
        options = pa.ipc.IpcWriteOptions(compression="lz4")
        with filesystem.open_output_stream(temporary, compression=None) as stream:
            with pa.ipc.new_file(stream, self.types, options=options) as file:
                for batch in iterator:
                    columns = [column.cast(field.type) for column, field in zip(batch.columns, self.types)]
                    file.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.types))
                    rows += batch.num_rows
        return Written(temporary, rows)

    def commit(self, messages: list[Written | None]) -> None:
        """Files with rows get names in task order; of a table without rows one file stays, for its schema."""
        filesystem, base = fs.FileSystem.from_uri(self.path)
        before = _data_files(self.path)[1] if self.overwrite else []
        done = [m for m in messages if m is not None]
        kept = [m for m in done if m.rows] or done[:1]
        for number, message in enumerate(kept):
            filesystem.move(message.temporary, f"{base}/part-{number:05d}-{self.job}.arrow")
        for old in before:
            filesystem.delete_file(old.path)
        self._clear(filesystem, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*fs.FileSystem.from_uri(self.path))

    def _clear(self, filesystem: fs.FileSystem, base: str) -> None:
        if filesystem.get_file_info(f"{base}/_temporary-{self.job}").type == fs.FileType.Directory:
            filesystem.delete_dir(f"{base}/_temporary-{self.job}")


class ArrowFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        """Schema of the first file's footer."""
        filesystem, files = _data_files(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no Arrow file in {self.options['path']}")
        with filesystem.open_input_file(files[0].path) as stored:
            return from_arrow_schema(_plain(pa.ipc.open_file(stored).schema))

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrowReader(schema, self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ArrowWriter(schema, self.options["path"], overwrite)


def read_arrow(spark: SparkSession, path: str, schema: StructType | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Rows of an Arrow file or of all Arrow files of a folder. A schema names the columns to read; others stay in the files."""
    spark.dataSource.register(ArrowFiles)
    reader = spark.read.format(NAME).option("splitBytes", split_bytes)
    return (reader if schema is None else reader.schema(schema)).load(path)


def write_arrow(df: DataFrame, path: str, mode: str = "append") -> None:
    """One Arrow file a task, LZ4-compressed, that any feather reader opens. ``overwrite`` removes the old files after the commit."""
    df.sparkSession.dataSource.register(ArrowFiles)
    df.write.format(NAME).mode(mode).save(path)
