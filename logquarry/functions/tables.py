"""Table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.records import RECORD, chunk_records


class EventlogRecords:
    """The records of one chunk: the columns of `decode` without path and chunk_index, with both texts."""

    def eval(self, data: bytes | None) -> Iterator[tuple]:
        for *fields, pairs, error in chunk_records(bytes(data) if data is not None else None, xml=True, json=True):
            yield (*fields, dict(pairs) if pairs is not None else None, error)


def register_tables(spark: SparkSession) -> None:
    """SELECT c.path, r.* FROM chunks c, LATERAL eventlog_records(c.data) r. Null data gives no row."""
    spark.udtf.register("eventlog_records", udtf(EventlogRecords, returnType=RECORD.split(", ", 2)[2], useArrow=True))
