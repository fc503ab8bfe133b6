"""Best-fit packing into bins of several permitted capacities.

Texts are cut into pieces of at most the largest capacity (none is dropped), and pieces
go, longest first, each into the open bin with the least room that still takes it. If
none does, a new bin of the permitted capacity with the least cost is opened. In the end
each bin shrinks to the smallest permitted capacity that holds its contents.

The plan needs only how many pieces have each length: bins in one state are one group
with a count, so the plan's size depends on the capacities and not on the rows. It is
made on the driver from at most ``max(capacities)`` counts; rows then find their bins by
their rank among the pieces of their length. Ranks come from counts for each salted
shard of about ``SHARD`` pieces of a length, so no task holds all pieces of one length,
however common (full pieces are).

Opening a bin, all permitted capacities are compared for the pieces still to come: a
bin of capacity c costs ``c + overhead``; of its room, what the pieces of this length
leave is worth as much as shorter pieces can fill. The capacity with the least cost for
each filled token is opened.

Defined cases: a null or empty text has no tokens and goes in no bin (it has one row
with a null bin); a null doc_id is packed like any other; rows that repeat are packed
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.llm.cut import cut

# Permitted sequence lengths in tokens, and the cost of a bin besides its length.
CAPACITIES, OVERHEAD = (512, 1024, 2048, 4096), 32
#: Pieces of one length that are ranked together, about.
SHARD = 200_000


class Plan:
    """Segments (length, first rank, pieces, first bin, pieces a bin) and the bins' groups."""

    def __init__(self, counts: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD):
        self.capacities, self.overhead = tuple(sorted(capacities)), overhead
        self.segments: list[tuple[int, int, int, int, int]] = []
        self.n_bins = 0
        self.free: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # room -> heap of (first bin, bins, capacity)
        self.rooms: list[int] = []
        rest = sum(n * k for n, k in counts.items())
        for length in sorted(counts, reverse=True):
            rest -= length * counts[length]
            self._place(length, counts[length], rest)
        used = [(first, bins, capacity, capacity - room) for room, groups in self.free.items() for first, bins, capacity in groups]
        #: (first bin, bins, final capacity, tokens in each)
        self.groups = sorted((first, bins, next(c for c in self.capacities if c >= filled), filled) for first, bins, _, filled in used)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Search keys of the segments, the segments, first bins of the groups, their capacities."""
        segments = np.array(sorted(self.segments), dtype=np.int64).reshape(-1, 5)
        groups = np.array(self.groups, dtype=np.int64).reshape(-1, 4)
        return segments[:, 0] << 44 | segments[:, 1], segments, groups[:, 0], groups[:, 2]

    def _put(self, room: int, group: tuple[int, int, int]) -> None:
        if not self.free[room]:
            at = bisect_left(self.rooms, room)
            self.rooms.insert(at, room)
        heapq.heappush(self.free[room], group)

    def _take(self, room: int) -> tuple[int, int, int]:
        group = heapq.heappop(self.free[room])
        if not self.free[room]:
            self.rooms.pop(bisect_left(self.rooms, room))
        return group

    def best_capacity(self, length: int, left: int, rest: int) -> int:
        """The capacity to open for ``left`` pieces of ``length`` when ``rest`` shorter tokens follow."""

        def cost(c: int) -> tuple[float, int]:
            each = min(c // length, left)
            bins = -(-left // each)
            filled = each * length + min(c - each * length, rest / bins)
            return (c + self.overhead) / filled, c

        return min((c for c in self.capacities if c >= length), key=cost)

    def _place(self, length: int, left: int, rest: int) -> None:
        rank = 0
        while left:
            at = bisect_left(self.rooms, length)
            if at < len(self.rooms):
                room = self.rooms[at]
                first, bins, capacity = self._take(room)
            else:
                capacity = room = self.best_capacity(length, left, rest)
                each = room // length
                first, bins = self.n_bins, -(-left // each)
                self.n_bins += bins
            each = room // length
            full = min(bins, left // each)
            if full:
                self.segments.append((length, rank, full * each, first, each))
                self._put(room - each * length, (first, full, capacity))
                rank, left = rank + full * each, left - full * each
            if full < bins:
                if left:  # too few for all that such a bin takes
                    self.segments.append((length, rank, left, first + full, left))
                    self._put(room - left * length, (first + full, 1, capacity))
                    rank, left, full = rank + left, 0, full + 1
                if full < bins:
                    self._put(room, (first + full, bins - full, capacity))


def token_count(text: Column) -> Column:
    """Tokens of a text by white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def pieces(documents: DataFrame, n_tokens: Column, largest: int) -> DataFrame:
    """(doc_id, piece, n_tokens): each document cut into pieces of at most ``largest``; none for no tokens."""
    counted = documents.select("doc_id", n_tokens.cast("long").alias("all"))
    last = F.ceil(F.col("all") / largest).cast("long") - 1
    rows = counted.select("doc_id", "all", F.explode(F.when(F.col("all") > 0, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array(F.lit(0).cast("long")))).alias("piece"))
    return rows.select("doc_id", "piece", F.least(F.lit(largest), F.col("all") - F.col("piece") * largest).cast("int").alias("n_tokens"))


def pack(rows: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """``rows`` (doc_id, piece, n_tokens) with bin, slot in the bin's run of its length, and the bin's final capacity.

    A longer row than the largest capacity is an error.
    """
    spark = rows.sparkSession
    rows = cut(rows)
    lengths = rows.where("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("n")).collect()  # at most max(capacities) rows
    shards = spark.createDataFrame([(r.n_tokens, -(-r.n // SHARD)) for r in lengths], "n_tokens int, shards long")
    empty = rows.where("n_tokens <= 0").withColumn("rank", F.lit(None).cast("long"))  # in no bin, so without a rank
    number = F.coalesce(F.col("shards"), F.lit(1))
    rows = rows.where("n_tokens > 0").withColumn("_at", F.monotonically_increasing_id()).join(F.broadcast(shards), "n_tokens", "left").withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "_at"), number).cast("int"))
    sizes = rows.groupBy("n_tokens", "shard").agg(F.count("*").alias("n")).collect()  # one row for SHARD pieces, and one for each length
    counts: dict[int, int] = defaultdict(int)
    before = []
    for r in sorted(sizes):
        before.append((r.n_tokens, r.shard, counts[r.n_tokens]))
        counts[r.n_tokens] += r.n
    if counts and max(counts) > max(capacities):
        raise ValueError(f"a piece of {max(counts)} tokens is longer than the largest capacity")
    plan = Plan(dict(counts), capacities, overhead)
    offsets = spark.createDataFrame(before, "n_tokens int, shard int, before long")
    order = Window.partitionBy("n_tokens", "shard").orderBy("doc_id", "piece")
    ranked = rows.join(F.broadcast(offsets), ["n_tokens", "shard"]).withColumn("rank", F.col("before") + F.row_number().over(order) - 1)
    ranked = ranked.select("doc_id", "piece", "n_tokens", "rank").unionByName(empty.select("doc_id", "piece", "n_tokens", "rank"))
    shared = spark.sparkContext.broadcast(plan.arrays())

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, segments, firsts, capacity = shared.value
        for frame in frames:
            filled = (frame["n_tokens"] > 0).to_numpy()
            out = frame[["doc_id", "piece", "n_tokens"]].assign(bin=pd.array([pd.NA] * len(frame), "Int64"), slot=pd.array([pd.NA] * len(frame), "Int32"), capacity=pd.array([pd.NA] * len(frame), "Int32"))
            if filled.any():
                rank = frame["rank"].to_numpy(dtype=float, na_value=0).astype(np.int64)[filled]
                length = frame["n_tokens"].to_numpy(np.int64)[filled]
                _, low, _, first_bin, each = segments[np.searchsorted(keys, length << 44 | rank, side="right") - 1].T
                bins = first_bin + (rank - low) // each
                out.loc[filled, "bin"] = bins
                out.loc[filled, "slot"] = ((rank - low) % each).astype(np.int32)
                out.loc[filled, "capacity"] = capacity[np.searchsorted(firsts, bins, side="right") - 1].astype(np.int32)
            yield out

    kind = dict(rows.dtypes)["doc_id"]
    return ranked.select("doc_id", "piece", "n_tokens", "rank").mapInPandas(place, f"doc_id {kind}, piece bigint, n_tokens int, bin bigint, slot int, capacity int")


def pack_documents(documents: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """(doc_id, piece, n_tokens, bin, slot, capacity) of every document's pieces."""
    return pack(pieces(documents, token_count(F.col("text")), max(capacities)), capacities, overhead)
