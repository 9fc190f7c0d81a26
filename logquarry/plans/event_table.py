"""The events table as an event log: each row one record, dealt to files by ranges of event_id."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import EPOCH_TICKS, filetime_of
from ..sources.encoder import Element, chunks, log_file, value_bytes
from ..sources.eventlog import store
from ..sources.scratch import shared_folder

UINT16, INT64, REAL64, FILETIME, STRING = 0x06, 0x09, 0x0C, 0x11, 0x01
TEMPLATE = Element(
    "Event",
    {"xmlns": "http://schemas.microsoft.com/win/2004/08/events/event"},
    [
        Element("System", {}, [Element("Provider", {"Name": "logquarry"}), Element("EventID", {}, [(0, UINT16)]), Element("TimeCreated", {"SystemTime": (1, FILETIME)}), Element("Channel", {}, ["Application"]), Element("Computer", {}, ["host"])]),
        Element("EventData", {}, [Element("Data", {"Name": n}, [(k, t)]) for k, (n, t) in enumerate((("user_id", INT64), ("event_type", STRING), ("value", REAL64), ("props", STRING)), 2)]),
    ],
)
TYPES = ("click", "view", "purchase", "signup", "logout", "login", "error", "search")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", filetime_of("ts").alias("ticks"), "user_id", "event_type", "value", "props")


def event_values(r: dict) -> list[tuple[int, object]]:
    code = TYPES.index(r["event_type"]) + 1 if r["event_type"] in TYPES else 0
    return [(UINT16, code), (FILETIME, r["ticks"]), (INT64, r["user_id"]), (STRING, r["event_type"]), (REAL64, r["value"]), (STRING, r["props"])]


def encoded(rows: DataFrame, template: Element, values: Callable[[dict], list[tuple[int, object]]], spread: bool = True) -> DataFrame:
    """(path, chunk_index, data) of the rows as a log, a record each; files follow the order of event_id.

    `spread` makes as many files as a shuffle has partitions: rows are small, but what encodes and decodes them isn't idle.
    Else adaptive execution makes fewer and longer ones.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"events-{TaskContext.get().partitionId():06d}"

        def records() -> Iterator[tuple]:
            for batch in batches:
                for r in batch.to_pylist():
                    yield r["event_id"], r["ticks"] if r["ticks"] is not None else EPOCH_TICKS, [(k if v is not None else 0, v if isinstance(v, bytes) or callable(v) else value_bytes(k, v)) for k, v in values(r)]

        for k, data in enumerate(chunks(template, records())):
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([k], pa.int32()), pa.array([data], pa.binary())], ["path", "chunk_index", "data"])

    files = [int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))] if spread else []
    ordered = rows.repartitionByRange(*files, "event_id").sortWithinPartitions("event_id")
    return ordered.mapInArrow(write, "path string, chunk_index int, data binary")


def event_chunks(spark: SparkSession, sf_dir: str, spread: bool = True) -> DataFrame:
    """The events as a log that isn't written to files."""
    return encoded(event_rows(spark, sf_dir), TEMPLATE, event_values, spread)


def event_files(spark: SparkSession, sf_dir: str, dirty: bool = False) -> str:
    """Write the events as event-log files, in parallel, into a new folder of the shared one; -> the folder.

    `dirty` files count one chunk in their headers, however many they have.

    A task writes its file under another name first and then renames it, so a repeated task replaces what a lost one left.
    """
    folder = f"{shared_folder(spark)}/event-logs-{uuid.uuid4().hex}"
    if not folder.startswith("file:/") and "://" not in folder:
        folder = f"file://{folder}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, path = [], None
        for batch in batches:
            path = batch.column(0)[0].as_py()
            parts += [d.as_py() for d in batch.column(2)]
        if path is not None:
            files, inner, _ = store(f"{folder}/{path}")
            files.create_dir(inner.rpartition("/")[0])
            own = f"{inner}-{uuid.uuid4().hex}.part"
            with files.open_output_stream(own) as out:
                out.write(log_file(parts, 1 if dirty else None))
            files.move(own, inner)
            yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    event_chunks(spark, sf_dir).mapInArrow(write, "path string").count()
    return folder


def typed(records: DataFrame) -> DataFrame:
    """The events' own columns back from decoded records."""
    d = F.col("data")
    return records.select(
        "path", "chunk_index", "ordinal", "event_record_id", "timestamp_filetime", "error",
        d["user_id"].cast("long").alias("user_id"), d["event_type"].alias("event_type"), d["value"].cast("double").alias("value"), d["props"].alias("props"), "channel", "event_id",
    )
