"""Token counts: the exact histogram of encoded lengths, whose suffix sums answer every context limit.

Documents are encoded whole where they lie; one row for each length and task is shuffled. Suffix sums run inside blocks
of LENGTHS lengths and over the blocks' totals, so no task holds more than a block or one row for each block.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, table

LENGTHS = 1024


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_lengths(docs: DataFrame, ranks: str, pattern: str, text_col: str = "text") -> DataFrame:
    """n_tokens of every row of docs, whatever its other columns; null and empty texts have none, long ones are read whole.

    `ranks` is a path that every executor has.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(ranks, pattern).encode_ordinary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(t)) if t else 0 for t in (x.as_py() for x in batch.column(0))], pa.int64())], ["n_tokens"])

    return docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(count, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """A row for each length that occurs, with its sums from there on; an empty table gives none, repeated rows each count.

    n_tokens, n_docs; docs_from and tokens_from: documents of at least that length, and their tokens; truncated_total:
    tokens of all documents, each cut at n_tokens; quantile: share of documents of at most that length.
    """
    counts = table(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "lengths").withColumn("block", F.expr("n_tokens div %d" % LENGTHS))
    sums = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    later = sums.select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_later"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_later"), F.sum("d").over(whole).alias("docs"), F.sum("t").over(whole).alias("tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    found = counts.join(later, "block").select(
        "n_tokens",
        "n_docs",
        (F.sum("n_docs").over(inside) + F.col("d_later")).alias("docs_from"),
        (F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside) + F.col("t_later")).alias("tokens_from"),
        "docs",
        "tokens",
    )
    return found.select(
        "n_tokens",
        "n_docs",
        "docs_from",
        "tokens_from",
        (F.col("tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_total"),
        ((F.col("docs") - F.col("docs_from") + F.col("n_docs")) / F.col("docs")).alias("quantile"),
    )


def totals_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context, n_docs_over, truncated_total) for any context limits, from the histogram alone."""
    spark = histogram.sparkSession
    sums = histogram.agg(*[f(F.col("n_docs")).alias(f"{k}{i}") for i, at in enumerate(limits) for k, f in (("o", lambda n, at=at: F.sum(F.when(F.col("n_tokens") > at, n).otherwise(0))), ("t", lambda n, at=at: F.sum(n * F.least("n_tokens", F.lit(at)))))])
    row = sums.first()
    return spark.createDataFrame([(at, row[f"o{i}"] or 0, row[f"t{i}"] or 0) for i, at in enumerate(limits)], "context long, n_docs_over long, truncated_total long")


def quantile(histogram: DataFrame, share: float) -> int | None:
    """The least length that at least that share of the documents doesn't exceed."""
    return histogram.where(F.col("quantile") >= share).agg(F.min("n_tokens")).first()[0]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return length_histogram(token_lengths(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLES: dict[str, str] = {}
