"""Connected components and numbering by group, for tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, label`` (the smallest node reachable) for every node of ``edges(a, b)``.

    Rounds of two joins: every node takes the smallest label among its neighbours, then the
    label of its label, so long paths halve. The state is written to the shared folder each
    round; only a count reaches the driver. Raises if ``max_rounds`` don't suffice."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                   .where("a <> b").distinct(), "cc-edges")
    state = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "cc-labels")
    for _ in range(max_rounds):
        near = (both.join(state, both.b == state.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("other")))
        step = (state.join(near, "node", "left")
                .select("node", F.col("label").alias("old"), F.least("label", "other").alias("label")))
        jump = state.select(F.col("node").alias("label"), F.col("label").alias("onward"))
        new = written(step.join(jump, "label", "left")
                      .select("node", "old", F.least("label", "onward").alias("label")), "cc-labels")
        state = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return state
    raise RuntimeError(f"labels still change after {max_rounds} rounds")


def numbered(df: DataFrame, group: str, order: list, name: str) -> DataFrame:
    """Adds ``rank``, the row's place (from 0) in its group in the given order, and writes the
    table. Rows are sorted by range over all tasks, so no group has to fit in one of them;
    per (task, group) offsets are as many rows as tasks and groups together."""
    rows = written(df.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
                   .withColumn("idx", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("task", F.shiftright("idx", 33))
    tasks = rows.groupBy("task", group).agg(F.min("idx").alias("lo"), F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.partitionBy(group).orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    tasks = tasks.select("task", group, (F.coalesce(before, F.lit(0)) - F.col("lo")).alias("shift"))
    return rows.join(tasks, ["task", group]).withColumn("rank", F.col("idx") + F.col("shift")).drop("idx", "task", "shift")
