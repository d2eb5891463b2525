"""Places of rows within groups of any size, without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.llm.common import dropped, stored


def ranked(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """The rows with `place`: how many rows of their group come before them, nulls first.

    Rows are dealt out by ranges of (group, order), so a large group lies in many tasks;
    a place is the place within the task plus the rows of the group in earlier tasks.
    Rows that are equal in group and order get places in any order, each its own. The
    frame should be a stored one, as it is read twice. Nulls in `group` get no rows.
    """
    keys = [group, *order, "tie"]  # equal rows must not all go to one task either
    dealt = df.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = stored(dealt.drop("tie").withColumn("row", F.monotonically_increasing_id()), name)
    dealt = dealt.withColumn("task", F.shiftright("row", 33))
    runs = dealt.groupBy(group, "task").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy(group).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    origin = F.col("first") - F.coalesce(F.sum("n").over(earlier), F.lit(0))
    starts = runs.select(group, "task", origin.alias("origin"))
    made = dealt.join(starts, [group, "task"]).withColumn("place", F.col("row") - F.col("origin")).drop("row", "task", "origin")
    out = stored(made, name)
    dropped(dealt)
    return out
