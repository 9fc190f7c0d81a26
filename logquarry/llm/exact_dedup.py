"""Exact dedup by deterministic block naming, with DataFrame functions only.

A text without white space is cut into blocks of fixed size. Blocks are sorted into integers, their names; then adjacent
names are paired and the pairs sorted into names in turn, so that a level halves every sequence, until each document is
one integer. Equal names mean equal blocks at every level, so (level, last name) is an identity without collisions.

Blocks are told apart by their bytes: they are shuffled once, grouped by 128 bits, and a group that holds two different
blocks makes the naming start afresh with another seed. Later joins then carry those bits, not text. Copies of a block
are combined before that shuffle, and a frequent name meets a side with one row a name, so adaptive execution splits it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, table

SPACES = r"[\x20\x09-\x0D]+"
#: Bytes of a block, and how many seeds are tried.
BLOCK, SEEDS = 1024, 8


def prints(seed: int, block: Column) -> Column:
    return F.struct(F.xxhash64(F.lit(seed), block).alias("h1"), F.xxhash64(block, F.lit(seed)).alias("h2"))


def cut(docs: DataFrame, id_col: str, text_col: str, block: int) -> DataFrame:
    """doc_id, n_chars (code points of the whole text), norm (binary) and blocks (one empty block of an empty text)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    norm = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.length(text).cast("long").alias("n_chars"), F.regexp_replace(text, SPACES, "").cast("binary").alias("norm"))
    # bound to n, so that the text isn't normalised anew for each block
    places = f"sequence(0, CAST(greatest(octet_length(n) - 1, 0) div {block} AS INT))"
    return norm.withColumn("blocks", F.expr(f"transform(array(norm), n -> transform({places}, i -> substring(n, i * {block} + 1, {block})))[0]"))


def named(keys: DataFrame, name: str) -> DataFrame:
    """A table of the (distinct) keys with their names: places in the sorted partitions, fixed once they are written."""
    return table(keys.sortWithinPartitions(*keys.columns).withColumn("name", F.monotonically_increasing_id()), name)


def block_names(texts: DataFrame) -> tuple[DataFrame, int]:
    """(h1, h2, name) of the distinct blocks, and the seed under which no two of them share their 128 bits."""
    for seed in range(SEEDS):
        blocks = texts.select(F.explode_outer("blocks").alias("block")).select(prints(seed, F.col("block")).alias("h"), "block")
        # nearly always one block a group
        groups = blocks.groupBy("h").agg(F.sort_array(F.collect_set("block")).alias("same"))
        names = named(groups.select("h.*", F.posexplode("same").alias("rank", "block")).drop("block"), "block_names")
        if names.where("rank > 0").isEmpty():
            return names.select("h1", "h2", "name"), seed
    raise RuntimeError(f"block_names: blocks share their prints under each of {SEEDS} seeds")


def identities(names: DataFrame, rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(rid, level, name) of rows (rid, keys array<struct<h1, h2>>), and the tables that this rests on."""
    places = rows.select("rid", F.size("keys").alias("n"), F.posexplode_outer("keys").alias("pos", "h")).select("rid", "n", "pos", "h.*")
    level = table(places.join(names, ["h1", "h2"]).select("rid", "n", "pos", "name"), "level")
    levels = [level]
    while not (open_rows := level.where("n > 1")).isEmpty():
        odd = F.col("pos") % 2 == 1
        pairs = open_rows.groupBy("rid", "n", F.shiftright("pos", 1).alias("at")).agg(F.max(F.when(~odd, F.col("name"))).alias("first"), F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).alias("second"))
        pairs = table(pairs, "pairs")
        pair_names = named(pairs.select("first", "second").distinct(), "pair_names")
        level = table(pairs.join(pair_names, ["first", "second"]).select("rid", F.expr("(n + 1) div 2").cast("int").alias("n"), F.col("at").alias("pos"), "name"), "level")
        discard(pairs, pair_names)
        levels.append(level)
    found = levels[0].where("n = 1").select("rid", F.lit(0).alias("level"), "name")
    for k, part in enumerate(levels[1:], 1):
        found = found.unionAll(part.where("n = 1").select("rid", F.lit(k).alias("level"), "name"))
    return found, levels


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256 and identity (struct of level and name).

    Texts are equal when they are identical without white space. Of a group, the row with the most code points stays, of
    those the one of smallest id; rows without id come last, and of rows that share their id too one stays. Null text is
    empty, and empty texts are a group; an empty table gives no rows; other columns aren't read.
    """
    texts = cut(docs, id_col, text_col, block)
    names, seed = block_names(texts)
    keys = F.transform("blocks", lambda b: prints(seed, b)).alias("keys")
    # the row's number is fixed by this table, whatever is computed again later
    rows = table(texts.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "n_chars", F.sha2("norm", 256).alias("text_sha256"), keys), "rows")
    found, levels = identities(names, rows)
    whole = table(rows.drop("keys").join(found, "rid"), "identities")
    order = F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")
    # as a table, so that adaptive execution can split the members of a large group
    groups = table(whole.groupBy("level", "name").agg(F.min(order).alias("best"), F.count("*").alias("group_size")), "groups")
    out = whole.join(groups, ["level", "name"])
    out = out.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), "text_sha256", F.struct("level", "name").alias("identity"))
    out = table(out, "exact_duplicates")
    discard(rows, whole, groups, *levels)
    return out


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP12_SQL = r"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM texts
WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
"""

QUERIES = {"op12_exact_dedup": op12_exact_dedup}
ORACLES = {"op12_exact_dedup": OP12_SQL}
