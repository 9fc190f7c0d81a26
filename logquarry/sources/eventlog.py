"""Event-log files as a Spark data source: `spark.read.format("eventlog").load(path)` gives a row for each 64 KiB chunk.

Partitions are ranges of chunks, so one large file is read by many tasks. Options: chunksPerPartition (64), chunkStart
and chunkEnd (prune by index). Filters aren't pushed into the source; give those options instead. Paths are plain, or
URIs of any store that pyarrow opens (file, s3, gs, hdfs).
"""

from __future__ import annotations

import fnmatch
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .encoder import CHUNK, HEADER

SCHEMA = "path string, chunk_index int, data binary"


class BadLog(ValueError):
    """A file whose header isn't an event log's."""


def header(raw: bytes, path: str = "") -> int:
    """The number of chunks; the signature and the header's checksum must hold."""
    if len(raw) < 128 or raw[:8] != b"ElfFile\0":
        raise BadLog(f"BadSignature: {path}")
    if zlib.crc32(raw[:120]) != struct.unpack_from("<I", raw, 124)[0]:
        raise BadLog(f"BadChecksum: {path}")
    return struct.unpack_from("<H", raw, 42)[0]


def store(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path or URI, the path in it, and what stands before that in the URI."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path, ""
    found, inner = fs.FileSystem.from_uri(path)
    return found, inner, path[: path.index(inner)] if inner in path else ""


def files_of(path: str) -> list[str]:
    """The files that a path names: itself, those of a folder, or those that its last part matches as a glob."""
    files, inner, scheme = store(path)
    info = files.get_file_info(inner)
    if info.type == fs.FileType.Directory:
        return sorted(scheme + i.path for i in files.get_file_info(fs.FileSelector(inner)) if i.type == fs.FileType.File)
    folder, _, last = inner.rpartition("/")
    if info.type == fs.FileType.NotFound and any(c in last for c in "*?["):
        listed = files.get_file_info(fs.FileSelector(folder or ".", allow_not_found=True))
        return sorted(scheme + i.path for i in listed if i.type == fs.FileType.File and fnmatch.fnmatchcase(i.base_name, last))
    return [path]


def exists(path: str) -> bool:
    files, inner, _ = store(path)
    return files.get_file_info(inner).type == fs.FileType.File


def count_chunks(path: str) -> int:
    files, inner, _ = store(path)
    with files.open_input_file(inner) as f:
        return header(f.read_at(min(HEADER, f.size()), 0), path)


def read_chunks(path: str, start: int, end: int) -> Iterator[tuple[str, int, bytes]]:
    files, inner, _ = store(path)
    with files.open_input_file(inner) as f:
        for k in range(start, end):
            at = HEADER + k * CHUNK
            data = f.read_at(CHUNK, at) if at < f.size() else b""
            if len(data) < CHUNK:
                raise BadLog(f"UnexpectedEof: {path}, chunk {k}")
            yield path, k, data


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def batches_of(part: Range, size: int = 16) -> Iterator[pa.RecordBatch]:
    """A range's chunks, a few at a time."""
    for k in range(part.start, part.end, size):
        rows = list(read_chunks(part.path, k, min(part.end, k + size)))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["path", "chunk_index", "data"])


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Range]:
        step, out = int(self.options.get("chunksPerPartition", 64)), []
        for path in files_of(self.options["path"]):
            n = count_chunks(path)
            first, last = int(self.options.get("chunkStart", 0)), min(n, int(self.options.get("chunkEnd", n)))
            out += [Range(path, k, min(last, k + step)) for k in range(first, last, step)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from batches_of(partition)


class Follower(DataSourceStreamReader):
    """New files, and new chunks of known files, since the last offset {path: next chunk}.

    The driver reads headers only; chunks are read where they are decoded.
    """

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {path: count_chunks(path) for path in files_of(self.options["path"]) if exists(path)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        step = int(self.options.get("chunksPerPartition", 64))
        return [Range(path, k, min(n, k + step)) for path, n in end.items() for k in range(start.get(path, 0), n, step)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from batches_of(partition)


class EventLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "eventlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> Follower:
        return Follower(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventLog)


def load_chunks(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("eventlog").options(**options).load(path)


def chunks_of_bytes(spark: SparkSession, data: bytes, path: str = "<bytes>") -> DataFrame:
    """The chunks of a log that is in memory."""
    n = header(data[:HEADER], path)
    if len(data) < HEADER + n * CHUNK:
        raise BadLog(f"UnexpectedEof: {path}")
    return spark.createDataFrame([(path, k, data[HEADER + k * CHUNK : HEADER + (k + 1) * CHUNK]) for k in range(n)], SCHEMA)
