"""A table of all chunks of some logs: where they are, and which record numbers, ids and times they span.

The driver only lists files and their sizes. Tasks read the chunks' headers and the heads of their first and last
records, some hundred bytes of 64 KiB each. Reads then choose rows of that table and open only the chunks they name; kept
as Parquet, it serves any number of them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoder import CHUNK, HEADER
from .eventlog import SCHEMA, files_of, store
from .scratch import table

NUMBERS = ("num_chunks", "first_number", "last_number", "first_id", "last_id", "first_ticks", "last_ticks")
INDEX = "path string, chunk_index int, sound boolean, " + ", ".join(f"{c} long" for c in NUMBERS)
#: Chunks whose headers a task reads for one opened file.
RANGE = 256
#: Chunks that a task reads and that are decoded there (4 MB; rows that only name them are too small to deal by their bytes).
STEP = 64


def sizes_of(path: str) -> list[tuple[str, int]]:
    """The files that a path names, and their sizes, by listing."""
    found = []
    for name in files_of(path):
        files, inner, _ = store(name)
        info = files.get_file_info(inner)
        if info.type == fs.FileType.File:
            found.append((name, info.size))
    return found


def signed(n: int) -> int | None:
    return n if n < 1 << 63 else None


def head(f, at: int) -> tuple:
    """Of a chunk: whether its signature and its header's checksum hold, and what it spans (null where it has no record)."""
    raw = f.read_at(512, at)
    if len(raw) < 512 or raw[:8] != b"ElfChnk\0":
        return (False, *[None] * 6)
    spans = [signed(n) for n in struct.unpack_from("<4Q", raw, 8)]
    times = []
    for place in (512, struct.unpack_from("<I", raw, 44)[0]):
        record = f.read_at(24, at + place) if 512 <= place <= CHUNK - 24 else b""
        times.append(signed(struct.unpack_from("<Q", record, 16)[0]) if len(record) == 24 and record[:4] == b"**\0\0" else None)
    sound = zlib.crc32(raw[128:512], zlib.crc32(raw[:120])) == struct.unpack_from("<I", raw, 124)[0]
    return (sound, *spans, *times)


def build(spark: SparkSession, path: str) -> DataFrame:
    """INDEX rows of a file, a folder or a glob: a row for each 64 KiB, those beyond the header's number of chunks too.

    A file with a wrong signature has num_chunks null; a part at the end that isn't a whole chunk has no row.
    """
    sizes = sizes_of(path)
    files = spark.createDataFrame(sizes, "path string, size long")
    chunks = F.floor((F.col("size") - HEADER) / CHUNK).cast("int")
    ranges = files.withColumn("n", chunks).where("n > 0").select("path", "n", F.explode(F.expr(f"sequence(0, n - 1, {RANGE})")).alias("start")).select("path", "start", F.least(F.col("start") + RANGE, F.col("n")).alias("end"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                opened, inner, _ = store(path)
                with opened.open_input_file(inner) as f:
                    top = f.read_at(128, 0)
                    n = struct.unpack_from("<H", top, 42)[0] if len(top) == 128 and top[:8] == b"ElfFile\0" else None
                    rows = [head(f, HEADER + k * CHUNK) for k in range(start, end)]
                columns = [pa.array([path] * len(rows)), pa.array(range(start, end), pa.int32()), pa.array([r[0] for r in rows], pa.bool_()), pa.array([n] * len(rows), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array([r[k] for r in rows], pa.int64()) for k in range(1, 7)], ["path", "chunk_index", "sound", *NUMBERS])

    parts = sum(max(0, size - HEADER) // (CHUNK * RANGE) + 1 for _, size in sizes)
    return ranges.repartition(tasks(spark, parts, 16), "path", "start").mapInArrow(read, INDEX)


def tasks(spark: SparkSession, items: int, step: int) -> int:
    """Tasks of `step` items at most, or as many as there are cores, if that are more; given as a number, since adaptive
    execution would put small rows into one task, however much is read for them."""
    return max(1, min(items, spark.sparkContext.defaultParallelism), -(-items // step))


def pruned(index: DataFrame, ids: tuple[int, int] | None = None, ticks: tuple[int, int] | None = None) -> DataFrame:
    """The chunks that may hold records of these ids and FILETIMEs (both ends included).

    Chunks whose spans aren't known stay. Times of records inside a chunk count as between its first and its last.
    """
    for low, high, span in (("first_id", "last_id", ids), ("first_ticks", "last_ticks", ticks)):
        if span:
            apart = (F.greatest(low, high) < span[0]) | (F.least(low, high) > span[1])
            index = index.where(~F.coalesce(apart & F.col(low).isNotNull() & F.col(high).isNotNull(), F.lit(False)))
    return index


def in_file(index: DataFrame) -> DataFrame:
    """The chunks that the files' headers count."""
    return index.where("chunk_index < num_chunks")


def with_extra(index: DataFrame) -> DataFrame:
    """The chunks that the headers count, and those after them that continue the file.

    A file that wasn't closed may have more chunks than its header says. After the last counted one, chunks belong to the
    file as long as they are sound and their record numbers go on rising; the first that doesn't ends it: what follows is
    left over from earlier use.
    """
    file = Window.partitionBy("path").orderBy("chunk_index")
    before = F.max(F.when(F.col("sound"), F.col("last_number"))).over(file.rowsBetween(Window.unboundedPreceding, -1))
    rises = F.col("sound") & (F.col("first_number") > F.coalesce(before, F.lit(-1))) & (F.col("last_number") >= F.col("first_number"))
    fits = F.when(F.col("chunk_index") < F.col("num_chunks"), F.lit(True)).otherwise(F.coalesce(rises, F.lit(False)))
    return index.withColumn("fits", F.min(fits).over(file.rowsBetween(Window.unboundedPreceding, 0))).where("fits AND num_chunks IS NOT NULL").drop("fits")


def read(index: DataFrame, partitions: int | None = None) -> DataFrame:
    """(path, chunk_index, data) of the rows of an index, in tasks; a chunk that is there no more fails with UnexpectedEof."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = None, None
        for batch in batches:
            for path, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if opened[0] != path:
                    files, inner, _ = store(path)
                    opened = path, files.open_input_file(inner)
                data = opened[1].read_at(CHUNK, HEADER + k * CHUNK)
                if len(data) < CHUNK:
                    raise ValueError(f"UnexpectedEof: {path}, chunk {k}")
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([k], pa.int32()), pa.array([data], pa.binary())], ["path", "chunk_index", "data"])

    # a table, as it is counted, sampled for its ranges and read
    places = table(index.select("path", "chunk_index"), "places")
    # ranges keep chunks of a file together, so that a task opens few files
    places = places.repartitionByRange(partitions or tasks(index.sparkSession, places.count(), STEP), "path", "chunk_index")
    return places.sortWithinPartitions("path", "chunk_index").mapInArrow(chunks, SCHEMA)


def load(spark: SparkSession, path: str, extra: bool = False, ids: tuple[int, int] | None = None, ticks: tuple[int, int] | None = None) -> DataFrame:
    """(path, chunk_index, data) of some logs, with the chunks that continue a file beyond its header's number if `extra`."""
    index = build(spark, path)
    return read(pruned(with_extra(index) if extra else in_file(index), ids, ticks))
