"""Factor files as a data source: ``spark.read.format("lzfactors").load(uri)`` and ``df.write.format("lzfactors")
.mode("append").save(uri)`` after ``register(spark)``."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from weft.sources import factorfile


class _File(InputPartition):
    def __init__(self, uri: str, path: str):
        self.uri, self.path = uri, path


class FactorFileReader(DataSourceReader):
    def __init__(self, options):
        self.uri = options["path"]

    def partitions(self) -> list[_File]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.uri)
        if store.get_file_info(root).type == fs.FileType.File:
            return [_File(self.uri, root)]
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        return [_File(self.uri, x.path) for x in found if x.path.endswith(".bin")]

    def read(self, part: _File) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(part.uri)
        with store.open_input_file(part.path) as f:
            data = f.read()
        marks = set(factorfile.read_footer(data)["sentinels"])
        for k, factor in enumerate(factorfile.decode(data)):
            yield (part.path, k, *factor, k in marks)


@dataclass
class _Written(WriterCommitMessage):
    parts: list[tuple[str, str]]


class FactorFileWriter(DataSourceArrowWriter):
    """A file for each task, of the rows (start, length, ref[, is_rc, is_sentinel]) in the order they come.

    Files get their names when the job commits; until then they end in ``.part``, and an abort removes them.
    """

    def __init__(self, options, overwrite: bool):
        self.uri, self.overwrite = options["path"], overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.uri)
        store.create_dir(root, recursive=True)
        factors, marks = [], []
        for b in batches:
            have = b.schema.names
            rc = b.column("is_rc").to_pylist() if "is_rc" in have else [False] * b.num_rows
            if "is_sentinel" in have:
                marks += [len(factors) + k for k, x in enumerate(b.column("is_sentinel").to_pylist()) if x]
            factors += zip(*(b.column(c).to_pylist() for c in ("start", "length", "ref")), rc)
        if not factors:
            return _Written([])
        to = f"{root}/{uuid.uuid4().hex}.bin"
        with store.open_output_stream(f"{to}.part") as out:
            out.write(factorfile.encode(factors, sentinels=marks))
        return _Written([(f"{to}.part", to)])

    def commit(self, messages: list[_Written | None]) -> None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.uri)
        if self.overwrite:
            for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if x.path.endswith(".bin"):
                    store.delete_file(x.path)
        for m in messages:
            for part, to in m.parts if m else ():
                store.move(part, to)

    def abort(self, messages: list[_Written | None]) -> None:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.uri)
        for m in messages:
            for part, _ in m.parts if m else ():
                store.delete_file(part)


class FactorFileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lzfactors"

    def schema(self) -> str:
        return factorfile._FACTORS

    def reader(self, schema) -> FactorFileReader:
        return FactorFileReader(self.options)

    def writer(self, schema, overwrite: bool) -> FactorFileWriter:
        return FactorFileWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FactorFileSource)
