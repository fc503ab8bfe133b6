"""Places in a total order over all rows, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.cut import Scratch

#: ``monotonically_increasing_id`` keeps the number of the task above these bits.
_BITS = 33


def placed(rows: DataFrame, order: list[Column], scratch: Scratch) -> DataFrame:
    """``rows``, a written table, sorted in ranges by ``order`` and written, with ``part`` and ``pos`` in the part.

    Parts follow each other in the order. Rows that tie in all of ``order`` are told apart by
    their place in the table, so that many copies of a row fall into several ranges.
    """
    order = [*order, F.col("_tie")]
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a stated number, so that small ranges are not joined into one
    sorted_rows = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop("_tie")
    out = scratch.table(sorted_rows.withColumn("_at", F.monotonically_increasing_id()))
    return out.withColumn("part", F.shiftright("_at", _BITS)).withColumn("pos", F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1))).drop("_at")


def ranked(rows: DataFrame, order: list[Column], scratch: Scratch, name: str = "rank") -> DataFrame:
    """``rows``, a written table, with their number in ``order``, from 1."""
    out = placed(rows, order, scratch)
    sizes = sorted(out.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row a shuffle partition
    before, total = [], 0
    for r in sizes:
        before.append((r.part, total))
        total += r.n
    offsets = rows.sparkSession.createDataFrame(before, "part long, _before long")
    return out.join(F.broadcast(offsets), "part").withColumn(name, F.col("_before") + F.col("pos") + 1).drop("part", "pos", "_before")
