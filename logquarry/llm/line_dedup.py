"""Line dedup with DataFrame functions only.

Every line's key is hashed; the hashes are range-partitioned and sorted by document and position, which splits a hot
key over many partitions; a window streams the first occurrence of each key in each document; their counts (summed in
part before the shuffle) tell the frequent keys. What returns to the documents is a bitmap of dropped lines, kept as a
sparse list of 64-line words, never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, table

STRIPPED = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """All lines; null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIPPED)), UPPER, LOWER)


def row_key(id_col: str, text_col: str) -> list[Column]:
    """128 bits of id and text: rows with one id and different texts stay apart, equal rows share one bitmap."""
    return [F.xxhash64(F.lit(k), F.col(f"`{id_col}`").cast("string"), F.col(f"`{id_col}`").isNull(), F.col(f"`{text_col}`")).alias(f"r{k}") for k in (1, 2)]


def drop_bitmaps(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (r1, r2, bitmap array<struct<word, bits>>) of the documents that lose a line.

    A key of at least one code point found in `min_docs` documents loses all its lines; with `keep_first` its first line
    (smallest id, then position) stays. Bit p % 64 of word p / 64 stands for line p; words without a bit are left out.
    Null text is one empty line, an empty table gives no row, rows without id count as one document, equal rows as one.
    """
    found = docs.select(
        F.col(f"`{id_col}`").alias("doc"),
        *row_key(id_col, text_col),
        F.posexplode(F.transform(lines_of(F.col(f"`{text_col}`")), line_key)).alias("pos", "key"),
    ).where("key <> ''")
    lines = found.select("doc", "r1", "r2", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    by_doc = Window.partitionBy("h1", "h2", "doc").orderBy("pos", "r1", "r2")
    firsts = lines.repartitionByRange("h1", "h2", "doc").withColumn("first", F.row_number().over(by_doc) == 1)
    firsts = table(firsts, "lines")
    head = [F.min(F.struct("doc", "pos", "r1", "r2")).alias("head")] if keep_first else []
    frequent = firsts.where("first").groupBy("h1", "h2").agg(F.count("*").alias("n"), *head)
    # as a table, so that adaptive execution can broadcast it where it is small, and else split the lines of a hot key
    frequent = table(frequent.where(F.col("n") >= min_docs).drop("n"), "frequent")
    hit = firsts.join(frequent, ["h1", "h2"])
    if keep_first:
        hit = hit.where(~F.struct("doc", "pos", "r1", "r2").eqNullSafe(F.col("head")))
    words = hit.groupBy("r1", "r2", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits"))
    return words.groupBy("r1", "r2").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("bitmap"))


#: The sparse words as a plain array with zeros between, so that a line finds its word by index.
DENSE = "flatten(transform(bitmap, (w, i) -> concat(array_repeat(0L, w.word - if(i = 0, -1, bitmap[i - 1].word) - 1), array(w.bits))))"


def dedup_lines(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs as `row` (struct of all its columns), with n_lines, n_dropped, bitmap and kept (string)."""
    bitmaps = drop_bitmaps(docs, min_docs, keep_first, id_col, text_col)
    rows = docs.select(*row_key(id_col, text_col), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(bitmaps.hint("shuffle_hash"), ["r1", "r2"], "left")
    lines = joined.select("row", "bitmap", lines_of(F.col(f"row.`{text_col}`")).alias("lines"), F.coalesce(F.expr(DENSE), F.array().cast("array<bigint>")).alias("dense"))
    kept = F.when(F.size("dense") == 0, F.col("lines")).otherwise(F.expr("filter(lines, (line, p) -> (shiftrightunsigned(coalesce(try_element_at(dense, shiftright(p, 6) + 1), 0L), p & 63) & 1L) = 0)"))
    cut = lines.select("row", "bitmap", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept_lines"))
    return cut.select("row", "bitmap", "n_lines", (F.col("n_lines") - F.size("kept_lines")).alias("n_dropped"), F.array_join("kept_lines", "\n").alias("kept"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return dedup_lines(docs).select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = f"""
WITH lines AS (
  SELECT doc_id, u.pos AS pos, u.line AS line,
         translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
  FROM documents, LATERAL (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos) u),
frequent AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT l.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN frequent f ON l.key = f.key
GROUP BY l.doc_id
"""

QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLES = {"op4_line_dedup": OP4_SQL}
