"""Graphs of edges (source, target, weight): degrees, neighbourhoods, reach, roles, ranking."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.operators import stats


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, other, outgoing): each edge from both its ends; a self-loop once."""
    out = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), F.lit(True).alias("outgoing"))
    back = edges.where("source <> target").select(F.col("target").alias("node"), F.col("source").alias("other"), F.lit(False).alias("outgoing"))
    return out.union(back)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, fan_in, fan_out) over edges."""
    rows = adjacency(edges).groupBy("node").agg(F.count("*").alias("degree"), F.count_if(~F.col("outgoing")).alias("_in"), F.count_if("outgoing").alias("fan_out"))
    loops = edges.where("source = target").groupBy(F.col("source").alias("node")).agg(F.count("*").alias("_loops"))
    return rows.join(loops, "node", "left").select("node", "degree", (F.col("_in") + F.coalesce("_loops", F.lit(0))).alias("fan_in"), "fan_out")


def fan_in(edges: DataFrame) -> DataFrame:
    """(node, importers): distinct sources of each target."""
    return edges.select("source", "target").distinct().groupBy(F.col("target").alias("node")).agg(F.count("*").alias("importers"))


def two_hop(edges: DataFrame) -> DataFrame:
    """(node, reach): distinct nodes within two steps; a cycle brings the start back in."""
    one = edges.select("source", "target").distinct()
    two = one.alias("a").join(one.alias("b"), F.col("a.target") == F.col("b.source")).select(F.col("a.source").alias("source"), F.col("b.target").alias("target"))
    return one.union(two).distinct().groupBy(F.col("source").alias("node")).agg(F.count("*").alias("reach"))


def k_hops(edges: DataFrame, start: DataFrame, hops: int | None, cut=None) -> DataFrame:
    """(node, hop): nodes reached from ``start`` (column node) by directed steps, with the fewest; starts are left out.

    Without a number of ``hops`` until nothing new is reached; ``cut`` materialises a round.
    """
    step = edges.select(F.col("source").alias("node"), F.col("target").alias("to")).distinct()
    seen = start.select("node").distinct().withColumn("hop", F.lit(0))
    frontier = seen
    for hop in count(1) if hops is None else range(1, hops + 1):
        frontier = frontier.select("node").join(step, "node").select(F.col("to").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop))
        if cut is not None:
            frontier = cut(frontier)
            if frontier.isEmpty():
                break
        seen = seen.union(frontier)
    return seen.where("hop > 0")


def reach(edges: DataFrame, start: DataFrame, cut) -> DataFrame:
    """(node, hop): all nodes reached, however far; ``cut`` materialises a round."""
    return k_hops(edges, start, None, cut)


def schema_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, name, n): nodes (column type) of each label, and edges of each type."""
    labels = nodes.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).withColumn("part", F.lit("labels"))
    types = edges.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).withColumn("part", F.lit("types"))
    return labels.unionByName(types).select("part", "name", "n")


def trace(edges: DataFrame, name: str, hops: int = 2) -> DataFrame:
    """(node, direction, hop): callers and callees of a node, the nearest hop each."""
    start = edges.sparkSession.createDataFrame([(name,)], "node string")
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    both = k_hops(edges, start, hops).withColumn("direction", F.lit("callee")).union(k_hops(back, start, hops).withColumn("direction", F.lit("caller")))
    return both.select("node", "direction", "hop")


def change_impact(before: DataFrame, after: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(node, hop): changed nodes (hop 0) and what depends on them, up to ``hops`` steps back.

    ``before`` and ``after`` have columns node and digest.
    """
    changed = after.exceptAll(before).select("node").union(before.exceptAll(after).select("node")).distinct()
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return changed.withColumn("hop", F.lit(0)).union(k_hops(back, changed, hops))


def owning_boundary(files: DataFrame, boundaries: DataFrame, ancestors: Column) -> DataFrame:
    """``files`` with the deepest boundary that holds each: ancestors join boundaries by equality."""
    rows = files.select("path", F.explode(F.concat(ancestors, F.array("path"), F.array(F.lit("")))).alias("boundary")).join(boundaries.select("boundary"), "boundary")
    deepest = rows.groupBy("path").agg(F.max_by("boundary", F.length("boundary")).alias("boundary"))
    return files.join(deepest, "path", "left")


def boundary_edges(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """(source, target, weight) between boundaries; ``owners`` maps node to boundary. Inner edges go."""
    one = edges.join(owners.select(F.col("node").alias("source"), F.col("boundary").alias("_s")), "source")
    both = one.join(owners.select(F.col("node").alias("target"), F.col("boundary").alias("_t")), "target").where("_s <> _t")
    return both.groupBy(F.col("_s").alias("source"), F.col("_t").alias("target")).agg(F.sum("weight").alias("weight"))


def roles(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(role, node, share): entry, coordination and foundation of boundary edges; core where the last two are one.

    Entry is the declared boundary (``entries``: node) of widest two-hop reach; coordination
    has most targets, foundation most importers, two at least; ties give no winner.
    """
    out = edges.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("breadth"), F.sum("weight").alias("w"))
    back = edges.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("breadth"), F.sum("weight").alias("w"))
    wide = two_hop(edges).withColumnRenamed("reach", "breadth").join(entries.select("node").distinct(), "node", "left_semi").join(out.select("node", "w"), "node")
    connected = edges.select("source").union(edges.select("target")).distinct().agg(F.count("*").alias("connected"))
    none = F.lit(None).cast("double")
    entry = stats.unique_winner(wide, "breadth", "w").select(F.lit("entry").alias("role"), "node", none.alias("share"))
    coordination = stats.unique_winner(out.where("breadth >= 2"), "breadth", "w").select("node")
    foundation = stats.unique_winner(back.where("breadth >= 2"), "breadth", "w").crossJoin(F.broadcast(connected)).select("node", F.when(F.col("connected") > 1, F.col("breadth") / (F.col("connected") - 1)).alias("share"))
    rest = coordination.withColumn("c", F.lit(True)).join(foundation.withColumn("f", F.lit(True)), "node", "full")
    role = F.when(F.col("c") & F.col("f"), "core").when(F.col("c"), "coordination").otherwise("foundation")
    return entry.union(rest.select(role.alias("role"), "node", "share"))


def import_boundary(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(source, target, direction) of distinct edges that cross a set of files (column node)."""
    inside = files.select("node").distinct()
    src, dst = inside.withColumnRenamed("node", "source"), inside.withColumnRenamed("node", "target")
    pairs = edges.select("source", "target").distinct()
    going = pairs.join(src, "source", "left_semi").join(dst, "target", "left_anti").select("source", "target", F.lit("out").alias("direction"))
    coming = pairs.join(dst, "target", "left_semi").join(src, "source", "left_anti").select("source", "target", F.lit("in").alias("direction"))
    return going.union(coming)


def widened(edges: DataFrame, files: DataFrame) -> DataFrame:
    """A set of nodes, what it imports, and what imports it."""
    inside = files.select("node").distinct()
    out = edges.join(inside.withColumnRenamed("node", "source"), "source", "left_semi").select(F.col("target").alias("node"))
    back = edges.join(inside.withColumnRenamed("node", "target"), "target", "left_semi").select(F.col("source").alias("node"))
    return inside.union(out).union(back).distinct()


def bm25(docs: DataFrame, query: list[str], tokens: Column, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score): Okapi BM25 of rows (column id) that hold a query term; higher is better.

    Only the query's terms are exploded; document frequencies are one row.
    """
    terms = list(dict.fromkeys(query))

    def frequency(term: str) -> Column:
        return F.size(F.filter("_t", lambda x: x == term))

    counted = docs.select("id", tokens.alias("_t")).select("id", F.size("_t").alias("_n"), *(frequency(t).alias(f"tf{i}") for i, t in enumerate(terms)))
    facts = counted.agg(F.count("*").alias("_docs"), F.avg("_n").alias("_avg"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    rows = counted.where(reduce(lambda x, y: x | y, [F.col(f"tf{i}") > 0 for i in range(len(terms))])).crossJoin(F.broadcast(facts))
    norm = F.lit(k1) * (1 - b + b * F.col("_n") / F.col("_avg"))
    parts = [F.log(1 + (F.col("_docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + norm) for i in range(len(terms))]
    return rows.select("id", reduce(lambda x, y: x + y, parts).alias("score"))


def cosine(vectors: DataFrame, query: list[float]) -> DataFrame:
    """(id, score): cosine with a query vector; rows of another length or of norm 0 go."""
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = F.aggregate(F.zip_with("vector", q, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    length = sum(float(x) ** 2 for x in query) ** 0.5
    return vectors.where(F.size("vector") == len(query)).select("id", F.try_divide(dot, norm * F.lit(length)).alias("score")).where("score IS NOT NULL")


def clusters(edges: DataFrame, rounds: int = 5, keep=lambda df: df) -> DataFrame:
    """(node, cluster) by label propagation: each round takes the neighbours' weightiest label, the smaller of equals.

    ``keep`` materialises a round, so that plans stay short.
    """
    both = edges.select("source", "target", "weight").union(edges.select(F.col("target"), F.col("source"), F.col("weight"))).groupBy("source", "target").agg(F.sum("weight").alias("weight"))
    both = keep(both)
    labels = both.select(F.col("source").alias("node")).distinct().withColumn("cluster", F.col("node"))
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("node").alias("target"), "cluster"), "target").groupBy("source", "cluster").agg(F.sum("weight").alias("v"))
        labels = keep(votes.groupBy(F.col("source").alias("node")).agg(F.min_by("cluster", F.struct(-F.col("v"), F.col("cluster"))).alias("cluster")))
    return labels


def cluster_summary(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster, members, cohesion): inner edges as a part of all edges that touch a cluster."""
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("members"))
    pairs = edges.join(labels.select(F.col("node").alias("source"), F.col("cluster").alias("_s")), "source").join(labels.select(F.col("node").alias("target"), F.col("cluster").alias("_t")), "target")
    touching = pairs.select(F.explode(F.array_distinct(F.array("_s", "_t"))).alias("cluster"), (F.col("_s") == F.col("_t")).alias("inner"))
    return touching.groupBy("cluster").agg((F.count_if("inner") / F.count("*")).alias("cohesion")).join(sizes, "cluster", "right").select("cluster", "members", F.coalesce("cohesion", F.lit(0.0)).alias("cohesion"))


def search_nodes(nodes: DataFrame, edges: DataFrame, query: str) -> DataFrame:
    """(id, score): nodes whose text, or whose first 20 edges' text, holds the query or all its terms.

    The whole phrase scores 100 and its length; else 20 a term of the node and 5 a term of the edges.
    """
    from corpuscle.functions import text

    q, terms = query.lower(), text.search_terms(query)
    near = adjacency(edges).groupBy(F.col("node").alias("id")).agg(F.slice(F.array_sort(F.collect_set(F.lower("other"))), 1, 20).alias("_o")).select("id", F.array_join("_o", " ").alias("edge_text"))
    own = F.lower(F.concat_ws(" ", "id", "name", "summary", F.array_join("tags", " ")))
    rows = nodes.select("id", "file_path", own.alias("node_text")).join(near, "id", "left").withColumn("edge_text", F.coalesce("edge_text", F.lit("")))
    both = F.concat_ws(" ", "node_text", "edge_text")
    if terms:
        hit = lambda c: reduce(lambda a, b: a + b, [F.contains(c, F.lit(t)).cast("int") for t in terms])
        all_in = hit(both) == len(terms)
        partial = F.when(all_in, 20 * hit(F.col("node_text")) + 5 * hit(F.col("edge_text")))
    else:
        partial = F.lit(None).cast("int")
    score = F.when(F.contains(both, F.lit(q)), 100 + len(q)).otherwise(partial)
    return rows.select("id", "file_path", score.alias("score")).where("score IS NOT NULL")
