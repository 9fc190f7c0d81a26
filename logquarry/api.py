"""Reading and dumping event logs from Python, and the command line (`python -m logquarry.api dump FILE`)."""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.records import decode, slice_chunks, valid_chunks
from .sources.eventlog import chunks_of_bytes, load_chunks

FORMATS = ("xml", "json", "jsonl", "jsonlines")
log = logging.getLogger("logquarry")


def _format(name: str) -> str:
    if name not in FORMATS:
        raise ValueError(f"InvalidFormat: {name}")
    return "xml" if name == "xml" else "json"


def records_of(chunks: DataFrame, fmt: str = "xml", mode: str = "FAILFAST", checksums: bool = True, skip: int = 0, limit: int = 0) -> DataFrame:
    """Decoded records; skip and limit (0: none) count records in file order and are applied before decoding."""
    kind = _format(fmt)
    kept = valid_chunks(chunks, mode) if checksums else chunks
    if skip or limit:
        kept = slice_chunks(kept, skip, limit or None)
    return decode(kept, xml=kind == "xml", json=kind == "json")


def read_eventlog(spark: SparkSession, path: str, fmt: str = "xml", mode: str = "FAILFAST", checksums: bool = True, skip: int = 0, limit: int = 0, **options) -> DataFrame:
    """A DataFrame of the records of a file, a folder or a glob of event logs.

    mode says what becomes of chunks with wrong checksums: FAILFAST, DROPMALFORMED or PERMISSIVE. Records that can't be
    decoded have `error` and no text.
    """
    return records_of(load_chunks(spark, path, **options), fmt, mode, checksums, skip, limit)


def lines(records: DataFrame, fmt: str) -> DataFrame:
    """(text): each good record as it is written: XML with an empty line after it, or one JSON object a line."""
    kind = _format(fmt)
    return records.where("error IS NULL").select("path", "chunk_index", "ordinal", F.concat(F.col(kind), F.lit("\n")).alias("text"))


def iter_records(spark: SparkSession, path: str, fmt: str, **options) -> Iterator[str]:
    """The records' texts in file order, a partition at a time."""
    for row in lines(read_eventlog(spark, path, fmt, **options), fmt).orderBy("path", "chunk_index", "ordinal").toLocalIterator():
        yield row.text


def iter_bytes(spark: SparkSession, data: bytes, fmt: str, **options) -> Iterator[str]:
    for row in lines(records_of(chunks_of_bytes(spark, data), fmt, **options), fmt).orderBy("path", "chunk_index", "ordinal").toLocalIterator():
        yield row.text


def iter_io(spark: SparkSession, io, fmt: str, **options) -> Iterator[str]:
    """From an object with read()."""
    return iter_bytes(spark, io.read(), fmt, **options)


def dump_text(spark: SparkSession, path: str, fmt: str, **options) -> str:
    return "".join(iter_records(spark, path, fmt, **options))


def dump_file(spark: SparkSession, path: str, out_path: str, fmt: str, **options) -> int:
    """All records into one file; -> their number. For many records rather write `lines(...)` with Spark."""
    n = 0
    with open(out_path, "w", encoding="utf-8", errors="surrogatepass", newline="") as f:
        for text in iter_records(spark, path, fmt, **options):
            f.write(text)
            n += 1
    return n


def json_array(texts: Iterator[str]) -> Iterator[str]:
    """JSON lines as the pieces of one JSON array."""
    yield "["
    for k, text in enumerate(texts):
        yield ("," if k else "") + text.rstrip("\n")
    yield "]"


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="logquarry")
    p.add_argument("command", choices=["dump"])
    p.add_argument("file")
    p.add_argument("-o", dest="fmt", default="xml", choices=["xml", "json", "jsonl", "array"])
    p.add_argument("-n", dest="limit", type=int, default=0)
    p.add_argument("-s", dest="skip", type=int, default=0)
    p.add_argument("-t", dest="threads", type=int, default=0)
    p.add_argument("-v", dest="verbose", action="count", default=0)
    p.add_argument("--no-checks", dest="checks", action="store_false")
    a = p.parse_args(argv)
    logging.basicConfig(level=[logging.WARNING, logging.INFO, logging.DEBUG][min(a.verbose, 2)])
    master = f"local[{max(1, a.threads) if a.threads else '*'}]"
    spark = SparkSession.builder.master(master).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    texts = iter_records(spark, a.file, "json" if a.fmt == "array" else a.fmt, checksums=a.checks, skip=a.skip, limit=a.limit)
    try:
        for text in json_array(texts) if a.fmt == "array" else texts:
            sys.stdout.write(text)
    except BrokenPipeError:
        return 0
    return 0


if __name__ == "__main__":
    sys.exit(main())
