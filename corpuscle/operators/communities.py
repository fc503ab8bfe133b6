"""Communities by modularity: moves of nodes in parallel, and contraction of the graph (Louvain).

Nodes, degrees and weights between nodes and communities are rows; a round is joins and
grouped sums, and only the modularity of a round, one number, comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Keep = Callable[[DataFrame], DataFrame]

#: Rounds of moves in a graph, graphs contracted one after the other, and the least gain that goes on.
ROUNDS, LEVELS, GAIN = 3, 6, 1e-4
#: Parts of the nodes that move one after the other, so that two neighbours seldom move at once.
TURNS = 2


def symmetric(edges: DataFrame) -> DataFrame:
    """(source, target, weight): both directions of each edge, summed; an edge of a node with itself counts twice."""
    both = edges.select("source", "target", "weight").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight"))
    return both.groupBy("source", "target").agg(F.sum("weight").cast("double").alias("weight"))


def modularity(links: DataFrame, labels: DataFrame) -> float:
    """Of symmetric ``links`` and ``labels`` (node, cluster): the share of inner weight above what degrees alone give."""
    total = links.agg(F.sum("weight")).first()[0]
    if not total:
        return 0.0
    at = lambda c: labels.select(F.col("node").alias(c), F.col("cluster").alias(f"_{c}"))
    rows = links.join(at("source"), "source").join(at("target"), "target")
    sums = rows.groupBy(F.col("_source").alias("cluster")).agg(F.sum(F.when(F.col("_source") == F.col("_target"), F.col("weight")).otherwise(0.0)).alias("inner"), F.sum("weight").alias("degree"))
    return sums.agg(F.sum(F.col("inner") / total - (F.col("degree") / total) * (F.col("degree") / total))).first()[0]


def moved(links: DataFrame, degrees: DataFrame, labels: DataFrame, total: float, turn: int) -> DataFrame:
    """``labels`` after the nodes of a turn each went to the neighbouring cluster of the largest gain, the smaller of equals.

    Gains are those of moving one node alone. A node by itself joins another one only if that has the smaller
    label, so that two don't change places.
    """
    far = links.where("source <> target").join(labels.select(F.col("node").alias("target"), F.col("cluster").alias("to")), "target")
    joined = far.groupBy(F.col("source").alias("node"), F.col("to")).agg(F.sum("weight").alias("w"))
    sizes = labels.join(degrees, "node").groupBy("cluster").agg(F.sum("degree").alias("sum"), F.count("*").alias("members"))
    own = labels.join(degrees, "node").join(sizes, "cluster").select("node", "cluster", "degree", "members", (F.col("sum") - F.col("degree")).alias("rest"))
    other = sizes.select(F.col("cluster").alias("to"), F.col("sum").alias("to_sum"), F.col("members").alias("to_members"))
    stays = joined.select("node", F.col("to").alias("cluster"), F.col("w").alias("stay"))
    rows = joined.join(own.where(F.pmod(F.xxhash64("node"), F.lit(TURNS)) == turn), "node").where("to <> cluster").join(other, "to").join(stays, ["node", "cluster"], "left")
    gain = (F.col("w") - F.coalesce("stay", F.lit(0.0))) - F.col("degree") * (F.col("to_sum") - F.col("rest")) / total
    swap = (F.col("members") == 1) & (F.col("to_members") == 1) & (F.col("to") > F.col("cluster"))
    best = rows.withColumn("gain", gain).where((F.col("gain") > 1e-12) & ~swap).groupBy("node").agg(F.min_by("to", F.struct(-F.round("gain", 12), F.col("to"))).alias("to"))
    return labels.join(best, "node", "left").select("node", F.coalesce("to", "cluster").alias("cluster"))


def louvain(edges: DataFrame, keep: Keep) -> DataFrame:
    """(node, cluster) of an undirected weighted graph; a cluster is named by one of its nodes.

    A round that doesn't raise the modularity is taken back and ends the moves of its graph;
    then clusters become the nodes of the next, smaller graph, until none gains.
    """
    links = keep(symmetric(edges))
    labels = keep(links.select(F.col("source").alias("node")).distinct().withColumn("cluster", F.col("node")))
    total = links.agg(F.sum("weight")).first()[0]
    if not total:
        return labels
    for _ in range(LEVELS):
        degrees = keep(links.groupBy(F.col("source").alias("node")).agg(F.sum("weight").alias("degree")))
        own = keep(degrees.select("node", F.col("node").alias("cluster")))
        start = best = modularity(links, own)
        for _ in range(ROUNDS):
            new = own
            for turn in range(TURNS):
                new = keep(moved(links, degrees, new, total, turn))
            value = modularity(links, new)
            if value <= best + GAIN:
                break
            own, best = new, value
        if best <= start + GAIN:
            break
        labels = keep(labels.join(own.select(F.col("node").alias("cluster"), F.col("cluster").alias("_to")), "cluster").select("node", F.col("_to").alias("cluster")))
        at = lambda c, own=own: own.select(F.col("node").alias(c), F.col("cluster").alias(f"_{c}"))
        links = keep(links.join(at("source"), "source").join(at("target"), "target").groupBy(F.col("_source").alias("source"), F.col("_target").alias("target")).agg(F.sum("weight").alias("weight")))
    return labels
