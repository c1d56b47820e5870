"""Files that grow while they are read: a streaming source whose offsets are file -> byte.

A batch takes each file's bytes from its last offset to its last line end, in ranges that are tasks of
their own. A line belongs to the range in which it begins. The checkpoint holds the offsets, so bytes
arrive once over restarts; only files that exist have one.

A file that is shorter than its offset has been written anew and is read from its beginning; one that is
deleted is forgotten, and lines that weren't read before are lost with it; a file replaced by a longer
one can't be told from one that has grown. Bytes that aren't UTF-8 are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a range by default, and bytes that are read at once.
RANGE_BYTES, BLOCK = 32 << 20, 1 << 20
SCHEMA = "file string, block long, line long, value string"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@dataclass
class Range(InputPartition):
    """Lines of a file that begin in [begin, end); the file's lines before ``floor`` are read already, those from ``limit`` on aren't whole."""

    file: str
    begin: int
    end: int
    floor: int
    limit: int

    def __post_init__(self):
        super().__init__(None)


def last_line_end(f, size: int) -> int:
    """The place behind the last newline of a file, 0 if it has none."""
    end = size
    while end > 0:
        begin = max(0, end - BLOCK)
        f.seek(begin)
        at = f.read(end - begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        end = begin
    return 0


def lines(f, r: Range) -> Iterator[tuple[list[bytes], list[int]]]:
    """A range's lines and where each begins, block by block."""
    at, rest, skipping = r.begin, b"", r.begin > r.floor
    if skipping:
        at -= 1  # a newline here means that a line begins with the range
    f.seek(at)
    while at < r.end:
        data = f.read(min(max(BLOCK, len(rest)), r.limit - at - len(rest)))
        if not data:
            return
        data = rest + data
        if skipping:
            first = data.find(b"\n") + 1
            at += first or len(data)
            data = data[first:] if first else b""
            skipping = not first
        cut = data.rfind(b"\n") + 1
        if cut:
            found, starts, place = data[: cut - 1].split(b"\n"), [], at
            for line in found:
                starts.append(place)
                place += len(line) + 1
            n = next((i for i, s in enumerate(starts) if s >= r.end), len(starts))
            if n:
                yield found[:n], starts[:n]
        at, rest = at + cut, data[cut:]


class Reader(DataSourceStreamReader):
    def __init__(self, path: str, pattern: str, size: int):
        self.path, self.pattern, self.size = path, pattern, size

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow.fs import FileSelector, FileType

        fs, root = _open(self.path)
        scheme = self.path[: -len(root)] if self.path.endswith(root) else ""
        out = {}
        for f in fs.get_file_info(FileSelector(root, allow_not_found=True, recursive=True)):
            if f.type != FileType.File or not fnmatch(f.base_name, self.pattern) or f.base_name.startswith((".", "_")):
                continue
            try:
                with fs.open_input_file(f.path) as opened:
                    if end := last_line_end(opened, f.size):
                        out[scheme + f.path] = end
            except FileNotFoundError:
                continue  # deleted meanwhile
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for file, limit in sorted(end.items()):
            floor = start.get(file, 0)
            floor = 0 if floor > limit else floor
            out += [Range(file, b, min(b + self.size, limit), floor, limit) for b in range(floor, limit, self.size)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, path = _open(partition.file)
        try:
            f = fs.open_input_file(path)
        except FileNotFoundError:
            return
        with f:
            for found, starts in lines(f, partition):
                texts = [x.decode("utf-8", "replace").rstrip("\r") for x in found]
                n = len(texts)
                yield pa.record_batch([pa.array([partition.file] * n), pa.array([partition.begin] * n), pa.array(starts), pa.array(texts)], names=["file", "block", "line", "value"])


class GrowingFiles(DataSource):
    """``growing_files``: options path, pattern (``*.raw``) and rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:
        return Reader(self.options["path"].rstrip("/"), self.options.get("pattern", "*.raw"), int(self.options.get("rangebytes", RANGE_BYTES)))


def read_growing(spark: SparkSession, path: str, pattern: str = "*.raw", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A stream ``(file, block, line, value)`` of whole lines of growing files; ``line`` is the byte at which a line begins.

    A line whose continuation comes later is put together by ``jobs.reassemble``.
    """
    spark.dataSource.register(GrowingFiles)
    return spark.readStream.format("growing_files").option("path", path).option("pattern", pattern).option("rangeBytes", str(range_bytes)).load()
