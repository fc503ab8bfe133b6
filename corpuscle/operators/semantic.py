"""Semantic lane: hashed term vectors with inverse document frequencies, cosine over sparse lists.

A document's vector has a weight for each of ``DIM`` buckets that its terms hash to:
(1 + ln tf) * idf, scaled to length 1. Vectors are kept as lists, one row for a bucket and
document, dealt by bucket, so that a query of a few keywords reads the lists of its own
buckets and adds products; no vector is dense, and no document without a term is read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of terms; documents frequencies of them, at most so many rows, are broadcast.
DIM = 1 << 18
#: Keywords of a query, and the least score that counts as related.
KEYWORDS, LEAST = 8, 0.5


def bucket(term: Column, dim: int = DIM) -> Column:
    """A term's bucket, from six hexadecimal digits of its md5."""
    return (F.conv(F.substring(F.md5(term), 1, 6), 16, 10).cast("long") % dim).cast("int")


def idf(documents: Column, frequency: Column) -> Column:
    return F.log((documents + 1) / (frequency + 1)) + 1


@dataclass
class SemanticLists:
    """``lists``: bucket, id, weight of unit vectors; ``idf``: bucket, idf of all buckets in use; ``documents`` with terms."""

    lists: DataFrame
    idf: DataFrame
    documents: int
    dim: int = DIM

    def query(self, keywords: list[str]) -> list[tuple[int, float]]:
        """(bucket, weight) of the unit vector of a query's first keywords."""
        spark = self.lists.sparkSession
        terms = spark.createDataFrame([(t,) for t in dict.fromkeys(keywords[:KEYWORDS])], "term string")
        rows = terms.groupBy(bucket(F.col("term"), self.dim).alias("bucket")).agg(F.count("*").alias("tf"))
        weighed = rows.join(self.idf, "bucket").select("bucket", ((1 + F.log("tf")) * F.col("idf")).alias("w")).collect()  # at most KEYWORDS rows
        norm = sum(r.w * r.w for r in weighed) ** 0.5
        return sorted((r.bucket, r.w / norm) for r in weighed)

    def search(self, keywords: list[str], least: float = LEAST) -> DataFrame:
        """(id, score): the cosine with a query of keywords, of documents that reach ``least``; higher is closer."""
        weights = self.query(keywords)
        weight = F.lit(0.0)
        for b, w in weights:
            weight = F.when(F.col("bucket") == b, w).otherwise(weight)
        rows = self.lists.where(F.col("bucket").isin([b for b, _ in weights]))
        return rows.groupBy("id").agg(F.sum(F.col("weight") * weight).alias("score")).where(F.col("score") >= least)


def semantic_lists(documents: DataFrame, tokens: Column, keep: Callable[[DataFrame], DataFrame] = lambda df: df, dim: int = DIM) -> SemanticLists:
    """The lists of ``documents`` (id, and what ``tokens`` reads); ``keep`` materialises what is read again."""
    terms = documents.select("id", F.explode(tokens).alias("term"))
    counts = keep(terms.groupBy("id", bucket(F.col("term"), dim).alias("bucket")).agg(F.count("*").alias("tf")))
    n = counts.agg(F.count_distinct("id")).first()[0]
    frequencies = counts.groupBy("bucket").agg(F.count("*").alias("df"))
    weights = keep(frequencies.select("bucket", idf(F.lit(n), F.col("df")).alias("idf")))
    raw = counts.join(F.broadcast(weights), "bucket").select("id", "bucket", ((1 + F.log("tf")) * F.col("idf")).alias("w"))  # at most dim rows are broadcast
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))  # a document's rows meet once, not twice for a join
    unit = raw.select("bucket", "id", (F.col("w") / norm).alias("weight"))
    return SemanticLists(keep(unit.repartition("bucket").sortWithinPartitions("bucket")), weights, n, dim)
