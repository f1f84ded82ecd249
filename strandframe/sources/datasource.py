"""Alignment and sequence files as formats of `spark.read`: `register(spark)`, then `spark.read.format("alignment").load(path)`.

A file is one partition and is parsed in its task; the paths go through Arrow's file systems, so
local, HDFS and object-store paths work. For sequence files larger than a task `sources.sequences`
splits them by records.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandframe.sources import alignments


@dataclass
class FilePartition(InputPartition):
    path: str


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    from pyarrow import fs

    system, inner = _system(path)
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted(head + f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")))


def _text(path: str) -> str:
    system, inner = _system(path)
    with system.open_input_stream(inner) as stream:
        return stream.read().decode("utf-8", "replace").replace("\r\n", "\n")


class _Files(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("a path is needed")
        self.path, self.form = options["path"], options.get("form")

    def partitions(self) -> list[InputPartition]:
        return [FilePartition(f) for f in _files(self.path)]


class _Alignments(_Files):
    def read(self, partition: FilePartition) -> Iterator[tuple]:
        text = _text(partition.path)
        for k, rows in enumerate(alignments.PARSERS[self.form or alignments.guess(partition.path, text)](text)):
            for i, (name, aseq) in enumerate(rows):
                yield partition.path, k, i, name, aseq


class _Sequences(_Files):
    def read(self, partition: FilePartition) -> Iterator[tuple]:
        for record in _text(partition.path).split("\n>"):
            head, _, rest = record.removeprefix(">").partition("\n")
            name, _, description = head.strip().partition(" ")
            if not name:
                if rest.strip():
                    raise alignments.FormatError("a record without a name")
                continue
            yield name, description.strip(), "".join(rest.split())


class AlignmentSource(DataSource):
    """Option `form` names the format; without it, it is guessed from the file."""

    @classmethod
    def name(cls) -> str:
        return "alignment"

    def schema(self) -> str:
        return alignments.SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Alignments(self.options)


class FastaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "name string, description string, seq string"

    def reader(self, schema) -> DataSourceReader:
        return _Sequences(self.options)


def register(spark: SparkSession) -> None:
    for source in (AlignmentSource, FastaSource):
        spark.dataSource.register(source)
