"""Following a folder of event logs as a stream, and event-time windows over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import filetime_timestamp
from ..operators.records import decode, valid_chunks
from ..sources.eventlog import register


def stream_records(spark: SparkSession, path: str, mode: str = "DROPMALFORMED", **options) -> DataFrame:
    """Records of new files and of chunks appended to known ones; the offset is the next chunk of each file."""
    register(spark)
    chunks = spark.readStream.format("eventlog").options(**options).load(path)
    return decode(valid_chunks(chunks, mode), xml=False).withColumn("written", filetime_timestamp("timestamp_filetime"))


def windowed_counts(records: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Events per channel and tumbling window, with a watermark for late ones."""
    return records.withWatermark("written", lateness).groupBy(F.window("written", window), "channel").agg(F.count("*").alias("n"))


def user_sessions(records: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n, login, logout) of each session: events of a user at most `gap` apart, its first login and
    last logout, null where there is none. `end` is the last event's time and the gap.

    records: user_id, event_type, event_record_id and `written`, of a stream or a table. A record that comes again within
    `lateness` of itself counts once (by user, id and time); the stream drops what is later than that and gives a session
    once the watermark has passed its end, a table gives all. Records without user or time belong to no session.
    """
    rows = records.where("user_id IS NOT NULL AND written IS NOT NULL").select("user_id", "event_type", "event_record_id", "written").withWatermark("written", lateness)
    key = ["user_id", "event_record_id", "written"]
    once = rows.dropDuplicatesWithinWatermark(key) if rows.isStreaming else rows.dropDuplicates(key)
    at = lambda kind: F.when(F.col("event_type") == kind, F.col("written"))
    found = once.groupBy("user_id", F.session_window("written", gap).alias("w")).agg(F.count("*").alias("n"), F.min(at("login")).alias("login"), F.max(at("logout")).alias("logout"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "login", "logout")
