"""Comparing logs whatever the order of their records and keys: canonical texts, 128-bit digests, counts per digest.

Nothing is sorted: equal records meet by digest, and only digests, counts and ids are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Markup (attribute values may hold >), or text up to the next markup.
PIECE = r"""<(?:[^>"']|"[^"]*"|'[^']*')*>|[^<]+"""
ATTRIBUTE = r"""[^\s=<>/"']+\s*=\s*(?:"[^"]*"|'[^']*')"""


def canonical_json(text: Column) -> Column:
    """The JSON with keys in order at all depths and without white space; arrays keep theirs. What isn't JSON stays as it is."""
    # by an array of one, so that a text that is itself a long expression isn't computed twice
    return F.transform(F.array(text), lambda t: F.coalesce(F.to_json(F.try_parse_json(t)), t))[0]


def canonical_xml(text: Column) -> Column:
    """The XML without prolog, "Record N" lines and white space between tags, attributes by name, <a></a> as <a/>.

    Comments and CDATA sections with markup in them aren't told from markup.
    """
    bare = F.regexp_replace(text, r"(?m)^(?:<\?xml [^>]*\?>|Record\s+\d+\s*$)", "")
    closed = F.regexp_replace(bare, r"""<([^\s/>!?]+)((?:\s(?:[^>"'/]|"[^"]*"|'[^']*')*)?)></\1\s*>""", "<$1$2/>")

    def tidy(piece: Column) -> Column:
        name = F.regexp_extract(piece, r"^</?[^\s/>]+", 0)
        attributes = F.array_sort(F.transform(F.regexp_extract_all(piece, F.lit(f"({ATTRIBUTE})"), F.lit(1)), lambda a: F.regexp_replace(a, r"^([^\s=]+)\s*=\s*", "$1=")))
        end = F.when(F.regexp_like(piece, F.lit(r"/\s*>$")), "/>").otherwise(">")
        whole = F.concat(name, F.when(F.size(attributes) > 0, F.concat(F.lit(" "), F.array_join(attributes, " "))).otherwise(""), end)
        return F.when(F.regexp_like(piece, F.lit(r"^</?[^!?]")), whole).otherwise(F.when(F.trim(F.regexp_replace(piece, r"\s+", " ")) == "", "").otherwise(piece))

    return F.array_join(F.transform(F.regexp_extract_all(closed, F.lit(f"({PIECE})"), F.lit(1)), tidy), "")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(path, xml) of each Event element of XML dumps; long files are read in splits, by the element's end."""
    texts = spark.read.text(path, lineSep="</Event>").select(F.col("_metadata.file_path").alias("path"), "value")
    return texts.select("path", F.regexp_extract("value", r"(?s)<Event(?:\s[^>]*)?>.*", 0).alias("xml")).where("xml <> ''").withColumn("xml", F.concat("xml", F.lit("</Event>")))


def log_diff(left: DataFrame, right: DataFrame, canonical: str, id_col: str) -> DataFrame:
    """(digest, id, left_n, right_n) of the records that one side holds more often: a multiset difference.

    `canonical` is the column of canonical texts in both; id is the smallest of id_col among equal records. Null texts are
    equal to each other; other columns aren't read. Equal logs, and empty ones, give no row.
    """

    def counted(side: DataFrame, mark: int) -> DataFrame:
        digest = F.coalesce(F.md5(F.col(canonical).cast("binary")), F.lit("null"))
        return side.select(digest.alias("digest"), F.col(id_col).alias("id"), F.lit(1 - mark).cast("long").alias("l"), F.lit(mark).cast("long").alias("r"))

    both = counted(left, 0).unionByName(counted(right, 1))
    return both.groupBy("digest").agg(F.min("id").alias("id"), F.sum("l").alias("left_n"), F.sum("r").alias("right_n")).where("left_n <> right_n")
