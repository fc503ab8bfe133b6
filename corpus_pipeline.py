"""A corpus pipeline of five stages; each calls one operator of ``corpuscle.llm``.

``STAGES`` lists (name, function). A function takes (spark, docs, sf_dir) and returns a
DataFrame; what it returns is written as Parquet and reread as the next one's docs. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import op2_toxicity, op4_packing, op8_neardup, op9_lines, op10_decontaminate
from corpuscle.llm.cut import Scratch, cut, read
from corpuscle.llm.rows import row_hash, without


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    model = op2_toxicity.fit(docs, read(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", "text", row_hash().alias("row"))
    rejected = model.score(rows, keep=["doc_id", "row"]).where("predicted = 1").select("kept.doc_id", "kept.row")
    return without(docs, cut(rejected.distinct()))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and similar lines the first stays; documents that lost lines and have no words left go."""
    out = op9_lines.dedup_lines(docs, counts=("_lines", "_removed"))
    return out.where((F.col("_removed") == 0) | F.col("text").rlike(r"\S")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the first document stays, judged row by row."""
    return without(docs, op8_neardup.near_duplicates(docs, words=5, percent=80).where("NOT kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go, judged row by row."""
    hits = op10_decontaminate.contaminated(docs, read(spark, sf_dir, "benchmark"))
    return without(docs, cut(hits.select("doc_id", "row").distinct()))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces, each with its bin and the bin's capacity."""
    return op4_packing.pack_documents(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: No SQL states a trained model or a packing; ``tests/llm`` holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what is written between them goes at the end."""
    with Scratch(spark) as scratch:
        docs = read(spark, sf_dir, "documents")
        for _, stage in STAGES[:-1]:
            docs = scratch.table(stage(spark, docs, sf_dir))
        return cut(STAGES[-1][1](spark, docs, sf_dir))
