"""Population statistics: exact figures, automatic bins, winners, outliers, shares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.operators.kept import kept

QUANTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
MOST_BINS = 10
#: Ranges of values that a population is split into to order it.
SLICES = 64


def finite(value: Column) -> Column:
    x = value.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def describe(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation (0 of one value), extremes and exact quantiles, without non-finite values.

    Quantiles interpolate linearly. An empty population has zeros throughout. Values are
    counted first; their counts are summed up in order, in ``SLICES`` ranges of values that
    approximate quantiles cut, so that no task holds a population. The order statistics that
    the quantiles lie between are then read from the sums. The cuts depend on the order in which
    parts of the data meet, so they are taken once and kept: values and sums are ranged alike.
    """
    keys = by or []
    rows = df.select(*keys, finite(F.col(value)).alias("_v")).where("_v IS NOT NULL")
    cuts = F.percentile_approx("_v", F.array(*(F.lit(i / SLICES) for i in range(1, SLICES))), F.lit(1000))
    figures = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"), F.min("_v").alias("low"), F.max("_v").alias("high"), cuts.alias("_cuts"))
    figures = kept(figures)  # one row for each group
    marks = figures.select(*(F.col(k).alias(f"_by{i}") for i, k in enumerate(keys)), F.col("n").alias("_all"), "_cuts")
    same = [F.col(k).eqNullSafe(F.col(f"_by{i}")) for i, k in enumerate(keys)]
    counts = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    paired = counts.join(marks, same) if keys else counts.crossJoin(F.broadcast(marks))  # one row for each group
    paired = paired.select(*keys, "_v", "_n", "_all", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_slice"))
    sums = paired.groupBy(*keys, "_slice").agg(F.sum("_n").alias("_in"))
    up = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # SLICES rows for each group
    sums = sums.select(*(F.col(k).alias(f"_by{i}") for i, k in enumerate(keys)), F.col("_slice").alias("_s"), F.coalesce(F.sum("_in").over(up), F.lit(0)).alias("_before"))
    placed = paired.join(sums, [*same, F.col("_slice") == F.col("_s")])
    within = Window.partitionBy(*keys, "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("_upto", F.col("_before") + F.sum("_n").over(within))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto")), F.col("_v")))

    picked = placed.groupBy(*keys).agg(*(at(f((F.col("_all") - 1) * q)).alias(f"_{k}_{side}") for k, q in QUANTILES.items() for side, f in (("lo", F.floor), ("hi", F.ceil))))
    picked = picked.select(*(F.col(k).alias(f"_by{i}") for i, k in enumerate(keys)), *(c for c in picked.columns if c not in keys))
    joined = figures.join(picked, same, "left") if keys else figures.crossJoin(F.broadcast(picked))  # one row each

    def quantile(k: str, q: float) -> Column:
        part = (F.col("n") - 1) * q - F.floor((F.col("n") - 1) * q)
        return F.col(f"_{k}_lo") * (1 - part) + F.col(f"_{k}_hi") * part

    columns = [*keys, "n", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "std", "low")), *(F.coalesce(quantile(k, q), F.lit(0.0)).alias(k) for k, q in QUANTILES.items()), F.coalesce("high", F.lit(0.0)).alias("high")]
    return joined.select(*columns)


def bins(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(bin, low, high, n) of automatic bins, at most ten, by Sturges' rule; empty bins have a row.

    Whole numbers get ranges that hold both ends; others half-open ones, the last closed.
    Two passes: one row of extremes for each group, then one aggregation by bin number.
    """
    keys = by or []
    rows = df.select(*keys, finite(F.col(value)).alias("_v")).where("_v IS NOT NULL")
    extent = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.bool_and(F.col("_v") == F.floor("_v")).alias("_whole"))
    wanted = F.least(F.lit(MOST_BINS), F.ceil(F.log2(F.col("_n").cast("double")) + 1))
    span = F.col("_hi") - F.col("_lo") + F.col("_whole").cast("int")
    extent = extent.where("_n > 0").withColumn("_w", F.when(F.col("_lo") == F.col("_hi"), 1.0).when(F.col("_whole"), F.ceil(span / wanted).cast("double")).otherwise(span / wanted))
    extent = extent.withColumn("_k", F.when(F.col("_lo") == F.col("_hi"), 1).when(F.col("_whole"), F.ceil(span / F.col("_w"))).otherwise(wanted).cast("int"))
    number = F.least(F.col("_k") - 1, F.floor((F.col("_v") - F.col("_lo")) / F.col("_w"))).cast("int")
    paired = rows.join(extent, [*keys]) if keys else rows.crossJoin(F.broadcast(extent))  # one row for each group
    counts = paired.withColumn("bin", number).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    frame = extent.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    low = F.col("_lo") + F.col("bin") * F.col("_w")
    high = F.when(F.col("bin") == F.col("_k") - 1, F.col("_hi")).otherwise(low + F.col("_w") - F.col("_whole").cast("int"))
    return frame.join(counts, [*keys, "bin"], "left").select(*keys, "bin", low.alias("low"), high.alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def best_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def first_n_per_key(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def upper_outliers(df: DataFrame, value: str) -> DataFrame:
    """Rows at a sample deviation or more above the mean; none where all are equal."""
    line = df.agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return df.crossJoin(F.broadcast(line)).where((F.col("_s") > 0) & (F.col(value) >= F.col("_m") + F.col("_s"))).drop("_m", "_s")  # one row is broadcast


def unique_winner(df: DataFrame, breadth: str, weight: str) -> DataFrame:
    """The row of largest breadth, then weight; none on a tie."""
    top = df.agg(F.max(F.struct(F.col(breadth).alias("b"), F.col(weight).alias("w"))).alias("_t"))
    best = df.crossJoin(F.broadcast(top)).where((F.col(breadth) == F.col("_t.b")) & (F.col(weight) == F.col("_t.w"))).drop("_t")
    return _single(best)


def _single(df: DataFrame) -> DataFrame:
    """``df`` where it has one row, else nothing."""
    n = df.agg(F.count("*").alias("_n"))
    return df.crossJoin(F.broadcast(n)).where("_n = 1").drop("_n")


def shares(df: DataFrame, key: str, weight: Column) -> DataFrame:
    """(key, weight, share): sums and their part of the whole."""
    sums = df.groupBy(key).agg(F.sum(weight).alias("weight"))
    return sums.crossJoin(F.broadcast(sums.agg(F.sum("weight").alias("_all")))).select(key, "weight", (F.col("weight") / F.col("_all")).alias("share"))


def ordered_distinct(df: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with the place at which each is first seen."""
    return df.groupBy(value).agg(F.min(order).alias(order))


def ancestor_counts(df: DataFrame, ancestors: Column) -> DataFrame:
    """(prefix, n): rows below each ancestor directory."""
    return df.select(F.explode(ancestors).alias("prefix")).where("prefix <> ''").groupBy("prefix").agg(F.count("*").alias("n"))


def skyline(df: DataFrame, measures: list[str]) -> DataFrame:
    """Rows that no other row reaches in all measures and passes in one; rows with a null measure go.

    Each task first keeps only the points that no point of its own dominates. The fronts of
    all tasks, small unless measures oppose one another, are then held against each other.
    """
    points = df.select(*(F.col(m).cast("double").alias(m) for m in measures)).dropna().distinct()

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        front = np.empty((0, len(measures)))
        for frame in frames:
            for point in frame.to_numpy()[np.argsort(-frame.to_numpy().sum(axis=1))]:
                if not ((front >= point).all(axis=1) & (front > point).any(axis=1)).any():
                    front = np.vstack([front[~((front <= point).all(axis=1))], point])
        yield pd.DataFrame(front, columns=measures)

    few = points.mapInPandas(local, ", ".join(f"`{m}` double" for m in measures))
    other = few.select(*(F.col(m).alias(f"_{m}") for m in measures))
    reaches, passes = F.lit(True), F.lit(False)
    for m in measures:
        reaches = reaches & (F.col(f"_{m}") >= F.col(m))
        passes = passes | (F.col(f"_{m}") > F.col(m))
    front = few.join(other, reaches & passes, "left_anti")
    return df.join(front.select(*(F.col(m).alias(f"_{m}") for m in measures)), [F.col(m).cast("double") == F.col(f"_{m}") for m in measures], "left_semi")


def adjacent_groups(df: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """(key, block, value, rows): neighbours of one value as one block, numbered from 1."""
    w = Window.partitionBy(*key).orderBy(order)
    before = F.lag(value).over(w)
    new = F.when((F.row_number().over(w) == 1) | ~before.eqNullSafe(F.col(value)), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("block", F.sum("_new").over(w)).groupBy(*key, "block").agg(F.first(value).alias(value), F.count("*").alias("rows"))


def capped(df: DataFrame, flag: str, order: list[Column], cap: int, limit: int) -> DataFrame:
    """The ``limit`` best rows with at most ``cap`` flagged ones, unless others run out."""
    few = df.where(flag).orderBy(*order).limit(limit).unionByName(df.where(f"NOT {flag}").orderBy(*order).limit(limit))  # as many of each kind fill all places
    later = F.col(flag) & (F.row_number().over(Window.partitionBy(flag).orderBy(*order)) > cap)
    return few.withColumn("_later", later).orderBy("_later", *order).limit(limit).drop("_later")


def innermost_spans(points: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """(id, span): for each point (id, key, at) the latest span (span, key, start, stop) that strictly holds it.

    Spans of up to ``width`` units lie in the cells of that width that they touch, points in one;
    they meet in cells, so a busy key is split over time.
    """
    cell = lambda c: F.floor(F.col(c) / width)
    held = spans.withColumn("_cell", F.explode(F.sequence(cell("start"), cell("stop"))))
    rows = points.withColumn("_cell", cell("at")).join(held, ["key", "_cell"]).where("start < at AND at < stop")
    return rows.groupBy("id").agg(F.max_by("span", F.struct("start", "span")).alias("span"))


def unseen(df: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys of ``df`` that ``seen`` lacks."""
    return df.select(*key).distinct().join(seen.select(*key), key, "left_anti")


def in_all(key: list[str], first: DataFrame, *others: DataFrame) -> DataFrame:
    """Distinct keys that every relation has."""
    out = first.select(*key).distinct()
    for other in others:
        out = out.join(other.select(*key), key, "left_semi")
    return out
