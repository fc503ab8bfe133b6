"""The innermost interval around each point, in one sort of bounds, with nothing paired.

Intervals of a key are nested or apart, as spans of source code are. Bounds are sorted; the depth
at a bound is a running sum, and the innermost open interval at a point is the last one that began
at the point's depth: of intervals that began at that depth the latest is still open, since another
can only begin at a depth once the one before has ended. So it is the last beginning of the
same key and depth before the point, a running maximum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of one window; larger keys are dealt over several.
CELL = 1 << 17


def innermost(points: DataFrame, intervals: DataFrame, key: list[str], at: str, first: str, last: str, keep: list[str]) -> DataFrame:
    """``points`` with the columns ``keep`` of the innermost interval that begins before ``at`` and ends at it or later; null without one.

    Bounds are whole numbers. Keys with many bounds are cut into cells of ``CELL`` numbers; what is open
    where a cell begins comes from sums over the cells before.
    """
    start = F.struct(F.col(first).alias("first"), (-F.col(last)).alias("last"), *keep)
    cell = lambda c: F.floor(F.col(c) / CELL).cast("long")
    none = F.lit(None)
    intervals = intervals.where(F.col(first) < F.col(last))  # others hold no point
    opened = intervals.select(*key, F.col(first).alias("_at"), F.lit(2).alias("_order"), (-F.col(last)).cast("long").alias("_then"), F.lit(1).alias("_step"), start.alias("_start"), none.alias("_point"))
    closed = intervals.select(*key, F.col(last).alias("_at"), F.lit(1).alias("_order"), (-F.col(first)).cast("long").alias("_then"), F.lit(-1).alias("_step"), none.alias("_start"), none.alias("_point"))
    asked = points.select(*key, F.col(at).alias("_at"), F.lit(0).alias("_order"), F.lit(0).cast("long").alias("_then"), F.lit(0).alias("_step"), none.alias("_start"), F.struct(*points.columns).alias("_point"))
    rows = opened.unionByName(closed).unionByName(asked).withColumn("_cell", cell("_at"))
    whole = Window.partitionBy(*key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*key, "_cell").orderBy("_at", "_order", "_then").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.groupBy(*key, "_cell").agg(F.sum("_step").alias("_s"))
    carried = sums.select(*key, "_cell", F.coalesce(F.sum("_s").over(whole), F.lit(0)).alias("_before"))
    deep = rows.join(carried, [*key, "_cell"]).withColumn("_depth", F.col("_before") + F.sum("_step").over(inside))
    place = F.struct("_at", "_order", "_then", "_start").alias("_p")
    begun = deep.where("_step = 1").groupBy(*key, "_cell", "_depth").agg(F.max(place).alias("_p"))
    earlier = Window.partitionBy(*key, "_depth").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    of_depth = Window.partitionBy(*key, "_cell", "_depth").orderBy("_at", "_order", "_then").rowsBetween(Window.unboundedPreceding, -1)
    cells = deep.select(*key, "_cell", "_depth").distinct().join(begun, [*key, "_cell", "_depth"], "left").withColumn("_from", F.max("_p").over(earlier)).select(*key, "_cell", "_depth", "_from")
    found = deep.join(cells, [*key, "_cell", "_depth"]).withColumn("_own", F.max(F.when(F.col("_step") == 1, F.struct("_at", "_order", "_then", "_start"))).over(of_depth))
    held = F.when(F.col("_depth") > 0, F.coalesce("_own", "_from")["_start"])
    return found.where("_point IS NOT NULL").select("_point.*", *(held[c].alias(c) for c in keep))
