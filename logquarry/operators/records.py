"""From chunks to records: checksums, framing, offset and limit before decoding, decoding, expansion and projections."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formats import le_unsigned
from ..sources import binxml

RECORD = "path string, chunk_index int, ordinal int, event_record_id long, timestamp_filetime long, xml string, json string, provider string, channel string, computer string, event_id int, level int, data map<string,string>, error string"


def checksum_ok(data: Column | str = "data") -> Column:
    """Do the chunk's header and its events have the checksums that it states? Without Python."""
    d = F.col(data) if isinstance(data, str) else data
    head = F.crc32(F.concat(F.substring(d, 1, 120), F.substring(d, 129, 384))) == le_unsigned(d, 124, 4)
    free = F.least(le_unsigned(d, 48, 4), F.lit(65536)).cast("int")
    events = F.crc32(d.substr(F.lit(513), F.greatest(free - 512, F.lit(0)))) == le_unsigned(d, 52, 4)
    return (F.substring(d, 1, 8) == F.lit(bytearray(b"ElfChnk\0"))) & head & events


def valid_chunks(chunks: DataFrame, mode: str = "DROPMALFORMED") -> DataFrame:
    """DROPMALFORMED leaves damaged chunks out, FAILFAST raises on the first, PERMISSIVE keeps all."""
    if mode == "PERMISSIVE":
        return chunks
    if mode == "FAILFAST":
        return chunks.where(F.coalesce(checksum_ok(), F.lit(False)) | F.raise_error(F.concat(F.lit("ChecksumMismatch: "), "path", F.lit(" chunk "), F.col("chunk_index").cast("string"))).isNotNull())
    if mode != "DROPMALFORMED":
        raise ValueError(f"InvalidArgs: mode {mode}")
    return chunks.where(checksum_ok())


def frames(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(record id, FILETIME, payload start, payload end), up to the first place that isn't a whole record; none of a chunk
    that is too short for a header."""
    if len(data) < 512:
        return
    free, at = min(len(data), struct.unpack_from("<I", data, 48)[0]), 512
    while at + 28 <= free and data[at : at + 4] == b"**\0\0":
        size, record_id, written = struct.unpack_from("<IQQ", data, at + 4)
        if size < 32 or at + size > free or struct.unpack_from("<I", data, at + size - 4)[0] != size:
            return
        yield record_id, written, at + 24, at + size - 4
        at += size


def record_counts(chunks: DataFrame) -> DataFrame:
    """(path, chunk_index, n): how many records each chunk frames, without decoding them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([sum(1 for _ in frames(d.as_py())) for d in b.column(2)], pa.int64())], ["path", "chunk_index", "n"])

    return chunks.select("path", "chunk_index", "data").mapInArrow(count, "path string, chunk_index int, n long")


def slice_chunks(chunks: DataFrame, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Chunks with `low` and `high`, the records (by ordinal) of a global OFFSET and LIMIT in file order.

    Counts are summed per file, files by a window over one row a file, chunks by a window inside their file; chunks
    outside the slice are dropped before anything is decoded.
    """
    counts = record_counts(chunks)
    files = counts.groupBy("path").agg(F.sum("n").alias("file_n"))
    before = files.select("path", F.coalesce(F.sum("file_n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("file_before"))
    inside = Window.partitionBy("path").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("chunk_before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(before, "path")
    first = F.col("file_before") + F.col("chunk_before")
    end = F.lit(None).cast("long") if limit is None else F.lit(skip + limit)
    cut = placed.select("path", "chunk_index", F.greatest(F.lit(skip) - first, F.lit(0)).alias("low"), F.least(F.col("n"), F.coalesce(end - first, F.col("n"))).alias("high")).where("low < high")
    return chunks.join(cut, ["path", "chunk_index"])


def chunks_with_id(chunks: DataFrame, record_id: int) -> DataFrame:
    """The chunks whose header says that their record ids span this one. Without Python."""
    return chunks.where((le_unsigned("data", 24, 8) <= record_id) & (le_unsigned("data", 32, 8) >= record_id))


def valid_records(records: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """PERMISSIVE keeps records that can't be decoded (with `error`), DROPMALFORMED leaves them out, FAILFAST raises on the first."""
    if mode == "PERMISSIVE":
        return records
    if mode == "FAILFAST":
        return records.where(F.col("error").isNull() | F.raise_error(F.concat("error", F.lit(": "), "path", F.lit(" chunk "), F.col("chunk_index").cast("string"))).isNotNull())
    if mode != "DROPMALFORMED":
        raise ValueError(f"InvalidArgs: mode {mode}")
    return records.where("error IS NULL")


def decode(chunks: DataFrame, xml: bool = True, json: bool = True, record_id: int | None = None) -> DataFrame:
    """A row for each record of chunks (path, chunk_index, data, and low and high if sliced); one that can't be decoded has `error`.

    Null data and chunks without a whole header give no row. Only the asked texts are rendered, and only records of
    record_id if that is given. An id or FILETIME of 2 ** 63 or more is null, with error OutOfBounds. Of Data elements of
    one name the second is name.2 in `data`, and so on.
    """
    sliced = "low" in chunks.columns
    names = [f.split()[0] for f in RECORD.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string()]
        for batch in batches:
            for row in batch.to_pylist():
                part = (row["low"], row["high"]) if sliced else (0, None)
                out = [(row["path"], row["chunk_index"], *found) for found in chunk_records(row["data"], xml, json, record_id, *part)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds], names)

    return chunks.select("path", "chunk_index", "data", *(["low", "high"] if sliced else [])).mapInArrow(read, RECORD)


def chunk_records(data: bytes | None, xml: bool, json: bool, wanted: int | None = None, low: int = 0, high: int | None = None) -> Iterator[tuple]:
    """The decoded records of a chunk, from its `low`th to before its `high`th: RECORD's columns from ordinal on."""
    if data is None:
        return
    chunk = binxml.Chunk(data)
    for k, (record_id, written, start, end) in enumerate(frames(data)):
        if low <= k and (high is None or k < high) and wanted in (None, record_id):
            got = record(chunk, record_id, written, start, end, xml, json)
            if max(record_id, written) >= 1 << 63:
                record_id, written, got = *(v if v < 1 << 63 else None for v in (record_id, written)), (*got[:-1], got[-1] or "OutOfBounds")
            yield (k, record_id, written, *got)


def record(chunk: binxml.Chunk, record_id: int, written: int, start: int, end: int, xml: bool, json: bool) -> tuple:
    try:
        root = chunk.root(start, end)
        as_xml = binxml.to_xml(root) if xml else None
        as_json = f'{{"event_record_id":{record_id},"timestamp_filetime":{written},"Event":{binxml.to_json(root)}}}' if json else None
        return as_xml, as_json, *system(root), None
    except (ValueError, struct.error, IndexError, OverflowError, RecursionError) as e:  # BadRecord is a ValueError
        return None, None, None, None, None, None, None, None, str(e) if isinstance(e, binxml.BadRecord) else "UnexpectedEof"


def system(root: tuple) -> tuple:
    """The usual fields of an event: from System, and the named Data of EventData."""

    def text(nodes: list[tuple]) -> str:
        return "".join(n[1] for n in nodes if n[0] in (binxml.TEXT, binxml.CDATA))

    def number(value: str | None) -> int | None:
        return int(value) if value and value.isascii() and value.isdigit() and len(value) < 10 else None

    found, data = {}, {}
    for child in (c[1] for c in root[2] if c[0] == binxml.ELEMENT):
        for name, attributes, nodes in (c[1] for c in child[2] if c[0] == binxml.ELEMENT):
            keys = {k: text(v) for k, v in attributes}
            if child[0] == "System":
                found[name] = keys.get("Name") if name == "Provider" else text(nodes)
            elif name == "Data" or child[0] in ("EventData", "UserData"):
                key, k = keys.get("Name", f"{name}{len(data)}"), 1
                while (shown := key if k == 1 else f"{key}.{k}") in data:
                    k += 1
                data[shown] = text(nodes)
    return found.get("Provider"), found.get("Channel"), found.get("Computer"), number(found.get("EventID")), number(found.get("Level")), list(data.items())


def offset_limit(records: DataFrame, skip: int, limit: int) -> DataFrame:
    return records.orderBy("path", "chunk_index", "ordinal").offset(skip).limit(limit)


def expand_templates(tokens: DataFrame, values: DataFrame) -> DataFrame:
    """Template expansion as a join: tokens (template, place, text, subst) and values (record, template, position, value).

    -> (record, text): each record's template with its values in the substitutions' places; null values leave nothing.
    """
    records = values.select("record", "template").distinct()
    placed = records.join(tokens, "template").join(values.select("record", F.col("position").alias("subst"), "value"), ["record", "subst"], "left")
    piece = F.when(F.col("subst").isNull(), F.col("text")).otherwise(F.coalesce("value", F.lit("")))
    joined = placed.groupBy("record").agg(F.array_sort(F.collect_list(F.struct("place", piece.alias("piece")))).alias("pieces"))
    return joined.select("record", F.array_join(F.transform("pieces", lambda p: p.piece), "").alias("text"))
