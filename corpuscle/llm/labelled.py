"""Bounded, documented samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, text, y, n_class): at most ``per_class`` labelled rows of each class, none held out.

    Rows are taken in the order of a hash of the id, so the sample is the same at every
    run. An id with several labels takes the largest, one with several texts the text of the smallest
    hash; null ids and labels are left out.
    ``n_class`` counts all rows of the class that may be learned from.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("y"))
    )
    counts = known.groupBy("y").agg(F.count("*").alias("n_class"))
    taken = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        taken = part if taken is None else taken.unionByName(part)
    taken = taken.join(F.broadcast(counts), "y")
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(taken), "doc_id")  # at most 2 * per_class rows are broadcast
    first = F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text")
    return found.groupBy("doc_id", "y", "n_class").agg(first).select("doc_id", "text", "y", "n_class")
