"""Connected components by DataFrame joins: hooking to the smallest neighbouring label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, table


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b) of longs in any direction -> (id, component) for every id on an edge; component is the smallest id.

    Each round, a label takes the smallest label next to it (summed in part before the shuffle) and then its own label's
    label; labels shrink along paths as powers of two. Each round is a table in the shared folder, the round before is
    deleted. The joins by a hub or a root have one row a key on their other side, so adaptive execution can split them.
    No edges give no rows. Labels that still change after max_rounds raise: 2 ** 60 ids on one path are out of reach.
    """
    both = table(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = table(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("near"))
        seen = labels.join(near, F.col("id") == F.col("a")).select("id", "label", F.least("label", "near").alias("best"))
        # the root that a label names learns of the best label that any of its own has seen
        hooks = seen.where("best < label").groupBy(F.col("label").alias("root")).agg(F.min("best").alias("hook"))
        hooked = seen.join(hooks, F.col("id") == F.col("root"), "left").select("id", "label", F.least("best", F.coalesce("hook", "best")).alias("best"))
        hooked = table(hooked, "hooked")
        jump = hooked.select(F.col("id").alias("to"), F.col("best").alias("further"))
        step = hooked.join(jump, F.col("best") == F.col("to")).select("id", F.col("label").alias("was"), F.least("best", "further").alias("label"))
        step = table(step, "labels")
        discard(hooked, labels)
        labels = step
        if step.where("was <> label").isEmpty():
            discard(both)
            found = labels.select("id", F.col("label").alias("component"))
            found._scratch = labels._scratch
            return found
    raise RuntimeError(f"components: labels still change after {max_rounds} rounds")
