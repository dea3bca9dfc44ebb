"""A streaming source of the lines of files that are still being written.

Spark's file source reads a file once, when it is closed. This source keeps, for every file
of a folder, the byte behind the last whole line it has read: its offset is (file, byte). A
batch ends at the last line feed of each file, so a line that is being written waits for its
end. A file that has become shorter is read anew from its start. Offsets are in the stream's
checkpoint, so each line arrives once, also after a restart; the bytes between two offsets are
read by the tasks, in parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "tidemark_tail"
SCHEMA = "file string, at bigint, value string"

#: Bytes of a file that one task reads, and bytes that are in memory at once.
PART_BYTES = 64 << 20
PIECE_BYTES = 1 << 20


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def whole_bytes(handle, size: int) -> int:
    """The byte behind the last line feed before ``size``."""
    end = size
    while end > 0:
        start = max(0, end - PIECE_BYTES)
        found = handle.read_at(end - start, start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        end = start
    return 0


@dataclass
class Part(InputPartition):
    """The lines of a file that start in [start, end); ``first`` is where its batch starts."""

    file: str
    first: int
    start: int
    end: int

    def __init__(self, file: str, first: int, start: int, end: int):
        super().__init__(None)
        self.file, self.first, self.start, self.end = file, first, start, end


def lines(handle, first: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of each line that starts in [start, end), without its line feed."""
    # A line that starts before belongs to the part before: go behind its end.
    at = start if start == first else start - 1
    skip, rest, place = start > first, b"", at
    while place < end or rest:
        piece = handle.read_at(PIECE_BYTES, at)
        if not piece:
            return
        at += len(piece)
        *whole, rest = (rest + piece).split(b"\n")
        for line in whole:
            if place >= end:
                return
            if not skip:
                yield place, line
            skip = False
            place += len(line) + 1


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, part_bytes: int):
        self.path, self.part_bytes = path, part_bytes

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, path = _store(self.path)
        found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        out = {}
        for info in sorted(found, key=lambda i: i.base_name):
            if info.is_file and not info.base_name.startswith((".", "_")):
                with store.open_input_file(info.path) as handle:
                    out[info.base_name] = whole_bytes(handle, info.size)
        return out

    def partitions(self, start: dict, end: dict) -> list[Part]:
        parts = []
        for file, stop in end.items():
            first = start.get(file, 0)
            if stop < first:  # shorter than it was: another file
                first = 0
            parts += [Part(file, first, at, min(at + self.part_bytes, stop)) for at in range(first, stop, self.part_bytes)]
        return parts

    def read(self, part: Part) -> Iterator[tuple]:
        store, path = _store(self.path)
        with store.open_input_file(f"{path.rstrip('/')}/{part.file}") as handle:
            for at, line in lines(handle, part.first, part.start, part.end):
                try:
                    yield part.file, at, line.decode().removesuffix("\r")
                except UnicodeDecodeError:
                    continue  # no text, so no line of any kind

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], int(self.options.get("partBytes", PART_BYTES)))


def tail_lines(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """file, at, value: whole lines of the files in a folder as they grow.

    ``path`` is a local or mounted folder, or any that Arrow's file systems open by URI. A file
    whose name starts with a dot or an underscore is left out, as Spark does. A file that is
    cut and grows beyond its old length between two batches cannot be told from one that grew.
    """
    spark.dataSource.register(TailSource)
    return spark.readStream.format(NAME).option("partBytes", part_bytes).load(path)
