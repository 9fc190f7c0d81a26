"""As-of and interval joins of events, linear also where one key has most of the rows.

Time is cut into buckets, so that (key, bucket) spreads a hot key over tasks. An as-of join needs from earlier buckets only
the last row of each, a summary of one row a bucket. An interval join puts an interval on the level whose buckets are as
long as itself, where it lies in two at most, and a point once on each level that is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, tie: str, bucket: int) -> DataFrame:
    """Each row of left with `match`, the last row of right (a struct) of the same key at or before it, or null.

    `at` is an integer time in both; of rows of right at one time the one of largest `tie` counts. Rows of left repeat as
    they are, those without key or time have no match; rows of right without them match nothing. `bucket` is the length of
    a bucket: one (key, bucket) is sorted in one task.
    """
    names = left.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in names])
    rows = left.select(F.col(key).alias("k"), F.col(at).alias("t"), F.lit(1).alias("side"), whole.alias("row"), F.lit(None).cast(right.select(F.struct("*")).schema[0].dataType).alias("found"), F.lit(None).cast(right.schema[tie].dataType).alias("tie"))
    given = right.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    given = given.select(F.col(key).alias("k"), F.col(at).alias("t"), F.lit(0).alias("side"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"), F.struct(*[F.col(f"`{c}`") for c in right.columns]).alias("found"), F.col(tie).alias("tie"))
    merged = rows.unionByName(given).withColumn("bucket", F.floor(F.col("t") / bucket))
    # equal times: right before left
    inside = Window.partitionBy("k", "bucket").orderBy("t", "side", "tie").rowsBetween(Window.unboundedPreceding, 0)
    seen = merged.withColumn("here", F.last("found", ignorenulls=True).over(inside)).where("side = 1")
    buckets = merged.groupBy("k", "bucket").agg(F.max_by("found", F.when(F.col("side") == 0, F.struct("t", "tie"))).alias("last"), F.max("side").alias("asks"))
    earlier = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.withColumn("carried", F.last("last", ignorenulls=True).over(earlier)).where("asks = 1").select(F.col("k").alias("of"), F.col("bucket").alias("in"), "carried")
    joined = seen.join(carried, (F.col("k") == F.col("of")) & (F.col("bucket") == F.col("in")), "left")
    return joined.select("row.*", F.coalesce("here", "carried").alias("match"))


def interval_join(intervals: DataFrame, points: DataFrame, key: str, start: str, end: str, at: str) -> DataFrame:
    """All columns of both for each interval and point of one key with start <= at <= end (integers).

    Names must differ but for the key's. Intervals that end before they start, and rows with nulls, match nothing.
    """
    length = F.col(end) - F.col(start)
    level = F.when(length > 0, F.ceil(F.log2(length.cast("double")))).otherwise(0).cast("int")
    placed = intervals.where(length >= 0).withColumn("level", level)

    def bucket(time: Column, level: Column) -> Column:
        return F.floor(time / F.pow(F.lit(2.0), level)).cast("long")

    cells = F.array_distinct(F.array(bucket(F.col(start), F.col("level")), bucket(F.col(end), F.col("level"))))
    placed = placed.withColumn("cell", F.explode(cells))
    # at most 64 levels
    levels = placed.agg(F.array_sort(F.collect_set("level"))).first()[0]
    spread = points.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")))
    spread = spread.withColumn("cell", bucket(F.col(at), F.col("level")))
    return placed.join(spread, [key, "level", "cell"]).where((F.col(start) <= F.col(at)) & (F.col(at) <= F.col(end))).drop("level", "cell")
