"""The corpus pipeline: five stages, each calling one operator of logquarry.llm on all that the stage before kept.

Every stage but the last returns the columns of documents; n_chars follows the text where a stage changes it. All stages
take null ids and texts, repeated rows, texts of any length (read whole), further columns of any name (kept, never
read) and empty tables (an empty result). A table of each stage stays in the shared folder till the session ends.
"""

from __future__ import annotations

from collections.abc import Callable

from logquarry.llm import bpe, decontamination, jaccard_join, language_id, line_dedup
from logquarry.llm.common import documents, table
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no letters, or a calibrated probability below one half) go: null and empty
    texts too. A table without labelled rows teaches no language, so all go. Repeated rows share their fate."""
    model = language_id.train(language_id.sample(docs))
    return language_id.identify(docs, model).where("NOT rejected").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; every document stays. A null text without such a line stays null; rows
    that repeat an id count as one document, and rows without id together as one."""
    cut = line_dedup.dedup_lines(docs)
    changed = {"text": F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("row.text")), "n_chars": F.when(F.col("n_dropped") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))}
    return cut.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of smallest id stays; empty and null texts are no copies of each other.
    Rows that repeat an id are one document and stay or go together; rows without id stay."""
    gone = jaccard_join.near_duplicates(docs).where("component < doc").select(F.col("doc").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go. Null and empty texts hold none and stay; repeated rows share
    their fate; an empty benchmark lets all stay."""
    found = decontamination.find_copies(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("copies") == 0).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: doc_id, n_tokens and the digests of its ids and of the text that they decode to; null and empty texts have
    no tokens. The tokenizer's file is opened on every executor, at the path where public_tokenizers has it."""
    return bpe.digests(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("language_id", language), ("line_dedup", lines), ("jaccard_join", near_copies), ("decontamination", decontaminate), ("bpe", tokens)]

#: The trained model, the alignment and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name)
    return docs
