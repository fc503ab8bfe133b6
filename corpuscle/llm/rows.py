"""Rows of documents by id and text, so that rows which repeat an id are told apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.cut import within


def row_hash() -> Column:
    """Names a row, among those of its id, by its text; rows that repeat both are one document."""
    return F.xxhash64(F.col("doc_id").cast("string"), "text")


def without(documents: DataFrame, gone: DataFrame) -> DataFrame:
    """``documents`` less the rows that ``gone`` (doc_id, row; a table or checkpoint) names."""
    rows = documents.select(F.struct("*").alias("_d"), F.col("doc_id").alias("_id"), row_hash().alias("_row"))
    named = within(gone.select(F.struct("doc_id", "row").alias("_g")))
    left = rows.join(named, (F.col("_row") == F.col("_g.row")) & F.col("_id").eqNullSafe(F.col("_g.doc_id")), "left_anti")
    return left.select("_d.*")
