"""Running numbers within groups of any size: rows are dealt by ranges of (group, order), so no task holds a whole group.

A range's rows are numbered where they are. What a group's earlier ranges add comes from one row for each group and
range. The dealt rows are written, so that the ranges stay what they were when a task runs again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framehouse.plans.lineage import written

#: Rows of a stretch as a power of two.
STRETCH_BITS = 16


def spread(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows with __at, which grows along (group, order), and __part, the range that a row fell in."""
    dealt = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("__at", F.monotonically_increasing_id())
    return written(dealt, "ranges").withColumn("__part", F.shiftright("__at", 33))


def cut(dealt: DataFrame, bits: int = STRETCH_BITS) -> DataFrame:
    """Spread rows with ranges cut into stretches: __at counts a range's rows from 0 in its lower bits, so its upper ones name a stretch.

    For Python, which holds all rows of a (group, __part): at most 2**bits of them, however long the ranges are.
    """
    return dealt.withColumn("__part", F.shiftright("__at", bits))


def earlier(group: list[str], value: Column) -> Column:
    """The sum of value over a group's earlier ranges, on a table of one row for each group and range."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows with __n, their number from 1 within their group, and __all, how many the group has. No group column is null."""
    dealt = spread(rows, group, order)
    parts = dealt.groupBy(*group, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__count"))
    before = parts.select(*group, "__part", "__first", earlier(group, F.col("__count")).alias("__before"), F.sum("__count").over(Window.partitionBy(*group)).alias("__all"))
    return dealt.join(before, [*group, "__part"]).withColumn("__n", F.col("__at") - F.col("__first") + F.col("__before") + 1).drop("__at", "__part", "__first", "__before")


def breaks(rows: DataFrame, group: str, t: str, order: list[str], gap: int) -> DataFrame:
    """rows with __n, the number from 1 of the stretch within their group that no step of t above gap parts."""
    dealt = spread(rows, [group], [t, *order])
    here = Window.partitionBy(group, "__part").orderBy("__at")
    local = dealt.withColumn("__new", (F.col(t) - F.lag(t).over(here) > gap).cast("int"))
    parts = local.groupBy(group, "__part").agg(F.min_by(t, "__at").alias("__t0"), F.max_by(t, "__at").alias("__t1"), F.coalesce(F.sum("__new"), F.lit(0)).alias("__breaks"))
    first = F.coalesce((F.col("__t0") - F.lag("__t1").over(Window.partitionBy(group).orderBy("__part")) > gap).cast("int"), F.lit(1))
    opened = parts.withColumn("__first", first)
    before = opened.select(group, "__part", (earlier([group], F.col("__breaks") + F.col("__first")) + F.col("__first")).alias("__before"))
    inside = F.sum(F.coalesce("__new", F.lit(0))).over(here.rowsBetween(Window.unboundedPreceding, 0))
    return local.withColumn("__inside", inside).join(before, [group, "__part"]).withColumn("__n", F.col("__before") + F.col("__inside")).drop("__at", "__part", "__new", "__inside", "__before")
