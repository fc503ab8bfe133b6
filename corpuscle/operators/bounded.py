"""Answers over a part of the corpus, which say what part: tiers read until enough, the largest files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import paths

LANGUAGES = ("javascript", "jsx", "python", "tsx", "typescript")


def leading_tiers(candidates: DataFrame, tier: list[str], limit: int, most: int = 1000) -> DataFrame:
    """The candidates of the best tiers, as many whole ones as ``limit`` needs, with ``bounded``.

    Tiers are groups of equal values of the columns ``tier``, smaller first. Only their counts
    are ordered. Up to ``most`` rows are taken, by path; ``bounded`` says that a tier was cut.
    """
    sizes = candidates.groupBy(*tier).agg(F.count("*").alias("_n"))
    order = Window.orderBy(*tier)  # one row for each tier
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    wanted = before.where((F.col("_before") < limit) & (F.col("_before") < most))
    joined = candidates.join(F.broadcast(wanted.limit(limit)), tier)  # each tier has a row, so no more than limit of them
    cut = F.col("_before") + F.col("_n") > most
    ranked = joined.withColumn("_r", F.row_number().over(Window.partitionBy(*tier).orderBy("path")))
    return ranked.where(F.col("_before") + F.col("_r") <= most).withColumn("bounded", F.max(cut.cast("int")).over(Window.partitionBy(F.lit(1))) == 1).drop("_n", "_before", "_r")


def is_light(inventory: DataFrame, include_tests: bool = False) -> DataFrame:
    """Files that a bounded scan may read: code of the scanned languages, not generated, tests only if asked for."""
    p = F.col("path")
    keep = (F.col("category") == "code") & F.col("language").isin(*LANGUAGES) & ~paths.is_generated(p) & (F.lit(include_tests) | ~paths.is_test(p))
    return inventory.where(F.coalesce(keep, F.lit(False)))


def largest(inventory: DataFrame, most: int = 100) -> DataFrame:
    """(path, n_lines, eligible, parsed): the longest files to parse, and the coverage that leaves."""
    eligible = inventory.agg(F.count("*").alias("eligible"))
    chosen = inventory.select("path", "n_lines").orderBy(F.desc("n_lines"), "path").limit(most)
    return chosen.crossJoin(F.broadcast(eligible)).withColumn("parsed", F.least(F.col("eligible"), F.lit(most)).cast("long"))  # one row is broadcast
