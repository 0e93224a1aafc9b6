"""Compressed files as streams of chunk rows, both ways, through Spark's Python data sources.

A reader's task holds one step of one file, whatever its size; a writer's holds one row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from posixpath import basename, join

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from codecframe import registry
from codecframe.options import Options
from codecframe.status import INVALID_ARG, OK, CodecError

SCHEMA = "path string, seq long, data binary, status string, detail string"


def _settings(options: dict) -> tuple[fs.FileSystem, str, str, Options]:
    if not options.get("path"):
        raise CodecError(INVALID_ARG, "no path")
    system, path = fs.FileSystem.from_uri(options["path"])
    method = options.get("method", "gzip")
    given = {k.removeprefix("option."): v for k, v in options.items() if k.startswith("option.")}
    if method == "gzip":
        given.setdefault("gzip.concat", "true")
    return system, path, method, registry.DEFAULT.schema(method).parse(given)


@dataclass
class FilePartition(InputPartition):
    path: str


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        """One a file; names that start with a dot or an underscore are left out."""
        system, path, *_ = _settings(self.options)
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        return [FilePartition(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and basename(f.path)[0] not in "._"]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        system, _, method, opts = _settings(self.options)
        coder, seq = registry.DEFAULT.create(method, "decoder", opts), 0
        try:
            with system.open_input_stream(partition.path, compression=None) as source:
                while chunk := source.read(registry.STEP):
                    data = coder.update(chunk)
                    if data:
                        yield partition.path, seq, data, OK, ""
                        seq += 1
            yield partition.path, seq, coder.finish(), OK, ""
        except CodecError as e:
            yield partition.path, seq, None, e.status, e.detail


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class Writer(DataSourceWriter):
    """Each partition is a file, each row's ``data`` a member of it; null rows are left out.

    Files get their names when all tasks have ended, so that a task may be run again.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = options, overwrite

    def write(self, rows: Iterator) -> Written:
        system, path, method, opts = _settings(self.options)
        system.create_dir(path, recursive=True)
        name = join(path, f"_part-{uuid.uuid4().hex}.{'gz' if method == 'gzip' else method}")
        with system.open_output_stream(name, compression=None) as sink:
            for row in rows:
                if row["data"] is None:
                    continue
                coder = registry.DEFAULT.create(method, "encoder", opts)
                for at in range(0, len(row["data"]), registry.STEP):
                    sink.write(coder.update(bytes(row["data"][at : at + registry.STEP])))
                sink.write(coder.finish())
        return Written([name])

    def commit(self, messages: list) -> None:
        system, path, *_ = _settings(self.options)
        new = [f for m in messages if m is not None for f in m.files]
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(path)):
                if old.type == fs.FileType.File and old.path not in new:
                    system.delete_file(old.path)
        for name in new:
            system.move(name, join(path, basename(name)[1:]))

    def abort(self, messages: list) -> None:
        system, *_ = _settings(self.options)
        for name in (f for m in messages if m is not None for f in m.files):
            system.delete_file(name)


class CodecFiles(DataSource):
    """Format ``codec``: ``path``, ``method`` (gzip), and options of the method as ``option.<key>``."""

    @classmethod
    def name(cls) -> str:
        return "codec"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(dict(self.options), overwrite)
