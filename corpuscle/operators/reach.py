"""Reach and depth over large graphs: sketched neighbourhoods, strongly connected components, weighted depth.

Edges are (source, target, weight). ``keep`` materialises a round, so that plans stay short;
nothing but counts comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.operators import blocks
from corpuscle.operators.kept import kept

Keep = Callable[[DataFrame], DataFrame]

#: Base-2 logarithm of a sketch's registers; the relative standard error is 1.04 / 2**(LG_K / 2).
LG_K = 12


def error_bound(lg_k: int = LG_K, deviations: float = 3.0) -> float:
    """The relative error of a sketched count that is exceeded with the chance of so many deviations."""
    return deviations * 1.04 / 2 ** (lg_k / 2)


def sketched_reach(edges: DataFrame, hops: int, keep: Keep, lg_k: int = LG_K) -> DataFrame:
    """(node, hops, reach): about how many distinct nodes lie 1 to ``hops`` directed steps ahead; a cycle brings the start back in."""
    step, nodes = blocks.numbered(edges, keep)
    of, one, onward = blocks.folded(step, keep)
    n = onward.count()
    return of_nodes(sketched(one, blocks.in_blocks(onward, n, keep), n, hops, keep, lg_k), of, nodes).select("node", "hops", "reach")


def counted_reach(edges: DataFrame, keep: Keep) -> DataFrame:
    """(node, reach): distinct nodes within two steps, as ``graph.two_hop``; pairs are met in blocks and never written."""
    step, nodes = blocks.numbered(edges, keep)
    of, one, onward = blocks.folded(step, keep)
    n = onward.count()
    return of_nodes(counted(one, blocks.in_blocks(onward, n, keep), n, keep), of, nodes).select("node", "reach")


def of_nodes(found: DataFrame, of: DataFrame, nodes: DataFrame) -> DataFrame:
    """``found``, of the twins that ``blocks.folded`` gives, for each of ``nodes``."""
    return found.withColumnRenamed("node", "twin").join(of.withColumnRenamed("source", "id"), "twin").join(nodes, "id")


def counted(step: DataFrame, lists: DataFrame, edges: int, keep: Keep = kept) -> DataFrame:
    """``counted_reach`` of numbered nodes; ``lists`` are ``step``'s ``edges`` edges, as ``blocks.in_blocks`` gives them.

    Targets of the same sources lie in the same unions, so that one of them stands for all.
    """
    _, each = blocks.twins(step, "target", "source", keep)
    members = step.join(each, "target").select(F.col("source").alias("node"), F.col("twin").alias("member"), "weight")
    sets = blocks.in_chunks(members, F.pmod(F.xxhash64("member"), F.lit(1 + edges // blocks.CHUNK)))
    return blocks.unions(lists, sets, blocks.counted, "node bigint, chunk int, n bigint").groupBy("node").agg(F.sum("n").alias("reach"))


def sketched(step: DataFrame, lists: DataFrame, edges: int, hops: int, keep: Keep, lg_k: int = LG_K) -> DataFrame:
    """``sketched_reach`` of numbered nodes.

    A node's sketch is a HyperLogLog of 2**``lg_k`` slots: the largest number of leading zeros, and one, among
    the hashes that fall into a slot. A hop takes the largest of the sketches of a node and its targets, slots
    in chunks. The estimate is Ertl's (2017), which needs no correction of middle counts; up to an eighth of the
    slots, hashes are kept and counted themselves.
    """
    slots, bits = 2**lg_k, 64 - lg_k
    few = slots // 8
    wanted = 1 + max(edges // blocks.CHUNK, lists.count() * slots // (64 * blocks.CHUNK))
    width = max(1, slots // 2 ** (wanted - 1).bit_length())
    members = step.select(F.col("source").alias("node"), F.xxhash64(F.lit("sketch"), "target").alias("member"))
    sets = blocks.in_chunks(members, F.floor(F.shiftrightunsigned("member", bits) / width))
    own = lists.select("block", "node", F.array("node").alias("ids"))
    for hop in range(max(1, hops - 1)):
        last = hop == hops - 2 or hops == 1
        schema = "node bigint, chunk int, " + ("filled bigint, part double, n bigint" if last else "ids array<bigint>")
        sets = blocks.unions(lists if hops > 1 else own, sets, blocks.registers(width, bits, few, last), schema)
        sets = sets if last else keep(sets)
    empty = (slots - F.sum("filled")) / F.lit(slots)
    doubled = sum((F.pow(empty, F.lit(2.0**k)) * 2.0 ** (k - 1) for k in range(1, lg_k + 7)), empty)
    estimate = F.round(slots * slots / (2 * math.log(2)) / (slots * doubled + F.sum("part"))).cast("long")
    sums = sets.groupBy("node").agg(F.when(F.sum("n") <= few, F.sum("n")).otherwise(estimate).alias("reach"))
    return sums.select("node", F.lit(hops).alias("hops"), "reach")


def strong_components(edges: DataFrame, keep: Keep) -> DataFrame:
    """(node, component): strongly connected components, named by their largest node; a node without a cycle is its own.

    Nodes that nothing leads to, or that lead nowhere, are no part of a cycle and go first, over
    and over. What is left takes the largest node that reaches it as colour; of each colour, the
    nodes that reach back to that node are its component. Rounds grow with the longest path.
    """
    pairs = keep(edges.select("source", "target").where("source <> target").distinct())
    nodes = keep(edges.select(F.explode(F.array("source", "target")).alias("node")).distinct())
    done = None
    left = pairs
    while not left.isEmpty():
        before = left.count()
        while True:  # trim
            left = keep(left.join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(left.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"))
            after = left.count()
            if after == before:
                break
            before = after
        if not after:
            break
        colours = keep(left.select(F.explode(F.array("source", "target")).alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:
            sent = left.join(colours, left["source"] == colours["node"]).select(left["target"].alias("node"), "colour")
            new = keep(colours.unionByName(sent).groupBy("node").agg(F.max("colour").alias("colour")))
            changed = new.join(colours.withColumnRenamed("colour", "_old"), "node").where("colour <> _old").isEmpty()
            colours = new
            if changed:
                break
        own = lambda c: colours.select(F.col("node").alias(c), F.col("colour").alias(f"_{c}"))
        inner = keep(left.join(own("source"), "source").join(own("target"), "target").where("_source = _target").select("source", "target"))
        found = keep(colours.where("node = colour"))
        edge = found
        while True:  # back from each colour's first node
            back = inner.join(edge, inner["target"] == edge["node"]).select(inner["source"].alias("node"), "colour").distinct()
            edge = keep(back.join(found.select("node"), "node", "left_anti"))
            if edge.isEmpty():
                break
            found = keep(found.unionByName(edge))
        done = found if done is None else keep(done.unionByName(found))
        gone = found.select("node")
        left = keep(left.join(gone.withColumnRenamed("node", "source"), "source", "left_anti").join(gone.withColumnRenamed("node", "target"), "target", "left_anti").select("source", "target"))
    if done is None:
        return nodes.withColumn("component", F.col("node"))
    return nodes.join(done, "node", "left").select("node", F.coalesce("colour", "node").alias("component"))


def weighted_depth(edges: DataFrame, own: DataFrame, keep: Keep) -> DataFrame:
    """(node, depth, recursive): the heaviest chain of edges from each node, and the last node's own weight.

    ``own``: node, weight. Calls of loops say how deep loops nest across functions: an
    edge's weight is the number of loops around the call, a node's that within the function. A cycle counts once: of the
    edges inside a component the heaviest one. Each round settles the components all of
    whose targets are settled.
    """
    of = keep(strong_components(edges, keep))
    at = lambda c: of.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    placed = keep(edges.groupBy("source", "target").agg(F.max("weight").alias("weight")).join(at("source"), "source").join(at("target"), "target"))
    inside = placed.where("_source = _target").groupBy(F.col("_source").alias("component")).agg(F.max("weight").alias("inside"))
    base = of.join(own.select("node", F.col("weight").alias("_own")), "node", "left").groupBy("component").agg(F.max(F.coalesce("_own", F.lit(0))).alias("base"))
    state = keep(base.join(inside, "component", "left").select("component", "base", F.coalesce("inside", F.lit(0)).alias("inside"), F.col("inside").isNotNull().alias("recursive")))
    ahead = keep(placed.where("_source <> _target").groupBy(F.col("_source").alias("component"), F.col("_target").alias("next")).agg(F.max("weight").alias("weight")))
    settled, waiting = None, state
    while not waiting.isEmpty():
        blocked = ahead if settled is None else ahead.join(settled.select(F.col("component").alias("next")), "next", "left_anti")
        ready = waiting.join(blocked.select("component").distinct(), "component", "left_anti")
        if settled is None:
            new = ready.select("component", (F.col("base") + F.col("inside")).alias("depth"))
        else:
            best = ahead.join(settled.select(F.col("component").alias("next"), "depth"), "next").groupBy("component").agg(F.max(F.col("weight") + F.col("depth")).alias("_best"))
            new = ready.join(best, "component", "left").select("component", (F.greatest("base", F.coalesce("_best", F.lit(0))) + F.col("inside")).alias("depth"))
        new = keep(new)
        waiting = keep(waiting.join(new.select("component"), "component", "left_anti"))
        settled = new if settled is None else keep(settled.unionByName(new))
    if settled is None:
        return of.select("node", F.lit(0).alias("depth"), F.lit(False).alias("recursive"))
    return of.join(settled, "component").join(state.select("component", "recursive"), "component").select("node", "depth", "recursive")
