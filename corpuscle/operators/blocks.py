"""Unions of the sets of each node's neighbours, in blocks: what a join would make a row a pair is met inside tasks of bounded memory.

Sources are dealt in blocks of about ``BLOCK`` edges, the members of sets in chunks. A block's task
keeps its sources' edges and sees, chunk by chunk, the sets of the nodes they lead to. So each set is
written once a block that needs it, and nothing is written a pair.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Keep = Callable[[DataFrame], DataFrame]
#: (edges' sources, edges' rows in the chunk, rows' members as offsets and values, number of sources) -> arrays of results a source.
Measure = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], list[pa.Array]]

#: Edges of a block, and members of a chunk, that a task holds at once (a node's own edges are never parted).
BLOCK = CHUNK = 8_000_000
#: Edges of a block below which a graph is not dealt over more tasks.
LEAST = 50_000
#: Pairs, marks and slots that are worked on at once; small, so that they stay in a core's cache.
PAIRS, MARKS, SLOTS = 1 << 16, 1 << 20, 1 << 22


def numbered(edges: DataFrame, keep: Keep) -> tuple[DataFrame, DataFrame]:
    """(source, target) as distinct pairs of numbers, and (id, node): hashes, with a salt for which no two nodes share one."""
    every = keep(edges.select(F.explode(F.array("source", "target")).alias("node")).distinct())
    for salt in count():
        named = lambda c: F.xxhash64(F.lit(salt), c)  # noqa: B023, E731
        nodes = keep(every.select(named("node").alias("id"), "node"))
        if nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return keep(edges.select(named("source").alias("source"), named("target").alias("target")).distinct()), nodes


def twins(step: DataFrame, node: str, other: str, keep: Keep) -> tuple[DataFrame, DataFrame]:
    """(``node``, twin): nodes of the same set of ``other`` are twins; and of each twin (twin, one ``node``, how many).

    Sets are told apart by two hashes of 64 bits, which are exclusive ors of their members'; a twin is named by the first, with
    a salt for which no two of them share it.
    """
    for salt in count():
        mixed = lambda k: F.bit_xor(F.xxhash64(F.lit(salt), F.lit(k), other))  # noqa: B023, E731
        of = keep(step.groupBy(node).agg(mixed(0).alias("twin"), mixed(1).alias("_second")))
        each = keep(of.groupBy("twin").agg(F.min(node).alias(node), F.count("*").alias("weight"), F.min("_second").alias("_low"), F.max("_second").alias("_high")))
        if each.where("_low <> _high").isEmpty():
            return of.select(node, "twin"), each.select("twin", node, "weight")


def folded(step: DataFrame, keep: Keep) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of distinct (source, target): (source, twin), then (source, target) of one source of each twin, by its twin's name, and the same with targets
    that are sources by theirs, in which pairs repeat.

    What lies ahead of a source depends on its targets only, so that sources with the same targets need it once.
    """
    of, each = twins(step, "source", "target", keep)
    one = keep(step.join(each, "source").select(F.col("twin").alias("source"), "target"))
    onward = one.join(of.select(F.col("source").alias("target"), "twin"), "target").select("source", F.col("twin").alias("target"))
    return of, one, keep(onward.unionByName(each.select(F.col("twin").alias("source"), F.col("twin").alias("target"))))


def in_blocks(step: DataFrame, edges: int, keep: Keep) -> DataFrame:
    """(block, node, ids): every source with its targets and itself; sources of the same smallest target lie together."""
    own = step.select("source", "target").unionByName(step.select("source", F.col("source").alias("target")).distinct())
    lists = keep(own.groupBy(F.col("source").alias("node")).agg(F.collect_set("target").alias("ids")))
    rows = lists.select(F.array_min("ids").alias("low"), "node", F.explode("ids").alias("to"))
    tasks = max(1 + edges // BLOCK, min(step.sparkSession.sparkContext.defaultParallelism, 1 + edges // LEAST))
    dealt = rows.repartitionByRange(tasks, "low", "node").withColumn("block", F.spark_partition_id())
    return keep(dealt.groupBy("low", "node", "block").agg(F.collect_list("to").alias("ids")).select("block", "node", "ids"))


def in_chunks(members: DataFrame, chunk: Column) -> DataFrame:
    """(node, chunk, ids) of (node, member); if members have weights, each one's follows it."""
    ids = F.flatten(F.collect_set(F.array("member", "weight"))) if "weight" in members.columns else F.collect_set("member")
    return members.groupBy("node", chunk.cast("int").alias("chunk")).agg(ids.alias("ids"))


def unions(blocks: DataFrame, sets: DataFrame, measure: Measure, schema: str) -> DataFrame:
    """(node, chunk, ...) of ``schema``: ``measure`` of the union, in each chunk, of the sets of the nodes that a source's list names."""
    needed = blocks.select("block", F.explode("ids").alias("node")).distinct()
    right = needed.join(sets, "node").select("block", "chunk", "node", "ids")
    rows = blocks.select("block", F.lit(-1).alias("chunk"), "node", "ids").unionByName(right)
    names = [part.split()[0] for part in schema.split(", ")]
    dealt = 1 + (blocks.agg(F.max("block")).first()[0] or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, left = None, None
        for (own, chunk), nodes, lengths, values in groups(batches):
            if chunk < 0:
                b, to = np.unique(values, return_inverse=True)
                block, left = own, (nodes, np.repeat(np.arange(len(nodes)), lengths), b, to.astype(np.int32))
                continue
            if own != block:
                raise RuntimeError("a block's sets come without its sources")
            sources, source_of, b, to = left
            place = np.full(len(b), -1, dtype=np.int32)
            place[np.searchsorted(b, nodes)] = np.arange(len(nodes), dtype=np.int32)
            row = place[to]
            met = row >= 0
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            some, source = np.unique(source_of[met], return_inverse=True)
            if len(some):
                found = measure(source, row[met], offsets, values, len(some))
                out = pa.RecordBatch.from_arrays([pa.array(sources[some]), pa.array(np.full(len(some), chunk, dtype=np.int32)), *found], names)
                for at in range(0, len(some), 10_000):
                    yield out.slice(at, 10_000)

    return rows.repartitionById(dealt, "block").sortWithinPartitions("block", "chunk").mapInArrow(run, schema)


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray, np.ndarray]]:
    """((block, chunk), nodes, lengths, values) of rows that come in this order."""

    def whole(held):
        return tuple(np.concatenate(x) for x in zip(*held, strict=True))

    key, held = None, []
    for batch in batches:
        block, chunk = (batch.column(k).to_numpy() for k in (0, 1))
        cuts = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (chunk[1:] != chunk[:-1])) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if low == high:
                continue
            now = (int(block[low]), int(chunk[low]))
            if now != key and held:
                yield key, *whole(held)
                held = []
            key, ids = now, batch.column(3).slice(low, high - low)
            held.append((batch.column(2).slice(low, high - low).to_numpy(), np.diff(ids.offsets.to_numpy()), ids.flatten().to_numpy()))
    if held:
        yield key, *whole(held)


def slices(source: np.ndarray, cost: np.ndarray, n: int, most: int) -> Iterator[tuple[int, int, int, int]]:
    """(first source, end source, first edge, end edge) of about ``most`` cost each, one source at least and ``n`` at most."""
    edge = np.searchsorted(source, np.arange(source[-1] + 2))
    before = np.concatenate([[0], np.cumsum(cost)])[edge]
    first = 0
    while first <= source[-1]:
        end = max(first + 1, int(np.searchsorted(before, before[first] + most, side="right")) - 1)
        end = min(end, first + max(1, n), int(source[-1]) + 1)
        yield first, end, int(edge[first]), int(edge[end])
        first = end


def counted(source: np.ndarray, row: np.ndarray, offsets: np.ndarray, values: np.ndarray, n: int) -> list[pa.Array]:
    """The sum of the weights of distinct members of each source's union; every second value is the weight of the one before."""
    offsets, values, weights = offsets // 2, values[::2], values[1::2]
    distinct, first_at, member = np.unique(values, return_index=True, return_inverse=True)
    member, weight, wide = member.astype(np.int64), weights[first_at], len(distinct)
    out = np.zeros(n, dtype=np.int64)
    lengths = np.diff(offsets)[row]
    for first, end, low, high in slices(source, lengths, n, MARKS):
        if 8 * lengths[low:high].sum() < (end - first) * wide:  # few of the places: their numbers are sorted
            parts = [owner * wide + member[places] for owner, places in met_by(source[low:high] - first, row[low:high], offsets)]
            spans = [(first, end, np.unique(np.concatenate(parts)))]
        else:
            spans = marked(source[low:high], row[low:high], offsets, member, wide)
        for begin, stop, met in spans:
            out[begin:stop] = np.add.reduceat(np.append(weight[met % wide], 0), np.searchsorted(met, np.arange(stop - begin) * wide))
    return [pa.array(out)]


def marked(source: np.ndarray, row: np.ndarray, offsets: np.ndarray, member: np.ndarray, wide: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first source, end source, places of the members met, ``wide`` a source), by marks."""
    begin = int(source[0])
    for first, end, low, high in slices(source - begin, np.diff(offsets)[row], MARKS // wide, PAIRS):
        marks = np.zeros((end - first) * wide, dtype=bool)
        for owner, places in met_by(source[low:high] - begin - first, row[low:high], offsets):
            marks[member[places] + owner * wide] = True
        yield begin + first, begin + end, np.flatnonzero(marks)


def met_by(source: np.ndarray, row: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sources, places of members) of all pairs that edges make, about PAIRS at once."""
    lengths = np.diff(offsets)[row]
    for at, to in edge_runs(lengths):
        size = lengths[at:to]
        begin = offsets[row[at:to]] - (np.cumsum(size) - size)
        yield np.repeat(source[at:to], size), np.repeat(begin, size) + np.arange(int(size.sum()))


def edge_runs(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of edges of about PAIRS members, one edge at least."""
    before, at = np.concatenate([[0], np.cumsum(lengths)]), 0
    while at < len(lengths):
        to = max(at + 1, int(np.searchsorted(before, before[at] + PAIRS, side="right")) - 1)
        yield at, to
        at = to


def tops(ranks: np.ndarray, row: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """The largest of each source's rows of ``ranks``, its edges being ``row[edge[k]:edge[k + 1]]``: all first edges, all second ones, and so on."""
    many = np.diff(edge)
    order = np.argsort(-many, kind="stable")
    begin, falling = edge[:-1][order], -many[order]
    top = ranks[row[begin]]
    for k in range(1, int(many.max())):
        more = int(np.searchsorted(falling, -k))
        np.maximum(top[:more], ranks[row[begin[:more] + k]], out=top[:more])
    out = np.empty_like(top)
    out[order] = top
    return out


def registers(width: int, bits: int, few: int, last: bool) -> Measure:
    """Largest rank of each slot over a source's union, of members that are hashes: ``bits`` below the slot, ``width`` slots a chunk.

    As hashes again; of the ``last`` union the number of filled slots, the sum of 2**-rank over them,
    and the number of members. Of at most ``few`` slots the members themselves are kept and counted, else
    one of each slot, and a number above ``few``. A chunk decides for itself, by its share of ``few`` slots and five deviations.
    """
    share = few * width >> (64 - bits)
    here = min(few, share + 5 * math.isqrt(share) + 1)
    power = 2.0 ** -np.arange(66)
    power[0] = 0

    def run(source: np.ndarray, row: np.ndarray, offsets: np.ndarray, values: np.ndarray, n: int) -> list[pa.Array]:
        hashes = values.view(np.uint64)
        slots, rest = (hashes >> np.uint64(bits)).astype(np.int64), hashes & np.uint64(2**bits - 1)
        rank = bits + 1 - np.frexp(rest.astype(np.float64))[1]
        order, owner = np.argsort(rank), np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        ranks = np.zeros((len(offsets) - 1, width), dtype=np.uint8)
        ranks[owner[order], slots[order] % width] = rank[order]  # of one slot's ranks the largest is set last
        distinct, member = np.unique(values, return_inverse=True)
        base, most = int(slots[0]) // width * width, max(1, SLOTS // width)
        filled, sums, counts, held = np.zeros(n, dtype=np.int64), np.zeros(n), np.full(n, few + 1, dtype=np.int64), []
        for first, end, low, high in slices(source, np.ones(len(source), dtype=np.int64), n, most):
            if high - low <= most:
                top = tops(ranks, row[low:high], np.searchsorted(source[low:high], np.arange(first, end + 1)))
            else:  # one source of many edges
                top = np.zeros((1, width), dtype=np.uint8)
                for at in range(low, high, most):
                    top = np.maximum(top, ranks[row[at : min(high, at + most)]].max(axis=0))
            filled[first:end] = np.count_nonzero(top, axis=1)
            small = filled[first:end] <= here
            if last:
                sums[first:end] = power[top].sum(axis=1)
            else:
                at, slot = np.nonzero(top * ~small[:, None])
                held.append((first + at, ((base + slot).astype(np.uint64) << np.uint64(bits) | np.uint64(2**bits) >> top[at, slot].astype(np.uint64)).view(np.int64)))
            if small.any():
                own, keys = small[source[low:high] - first], np.empty(0, dtype=np.int64)
                for whose, places in met_by(source[low:high][own], row[low:high][own], offsets):
                    keys = np.union1d(keys, whose * len(distinct) + member[places])
                held.append((keys // len(distinct), distinct[keys % len(distinct)]))
                counts[first:end][small] = np.bincount(held[-1][0] - first, minlength=end - first)[small]
        if last:
            return [pa.array(filled), pa.array(sums), pa.array(counts)]
        whose, found = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(whose, kind="stable")
        cuts = np.searchsorted(whose[order], np.arange(n + 1))
        return [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(found[order]))]

    return run
