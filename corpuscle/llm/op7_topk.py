"""Exact top-k search by a vector-approximation file.

A first pass writes the cell file: blocks of up to ``ROWS_BLOCK`` vectors, each block
with a grid of ``2**BITS`` cells a dimension and one byte a component; exact vectors are
not in it. Searching scans cells alone. They bound each inner product from below and
above; a row whose upper bound is under the k-th largest lower bound of its query is out.
Exact vectors are then read of the rest only, in the order of their upper bounds: first
the ``FIRST`` * k best, then those whose upper bound is at least the k-th score so far
(ties included); nothing beyond can enter the result.

Queries come in blocks of ``QUERY_BLOCK``, collected and broadcast one block at a time,
some MB at any input size, and the broadcast goes when its block is done.

Of rows with the same vector a block keeps those of the smallest ids, twice k (an id
counts k times at most): no more can be among k results of ties by id, even without the
query's own id.

Defined cases: vectors that are null, empty or hold a null or non-finite component
take no part, as query or candidate, nor do null ids; vectors whose length differs
from the query's are no candidates of it; of repeated ids each row counts, but a
query's own id never; query rows of one id with different vectors are queries of their
own, equal ones are one; ties go to the smaller id; integers and scores beyond 64 bits count as
the nearest number of 64 bits (components of 2**53 or more, that is); fewer than k candidates give them
all; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.llm.cut import Scratch, cut, within

BITS = 8
ROWS_BLOCK = 4096
QUERY_BLOCK = 8192
#: Rows of cells times queries that are bounded at once.
TILE = 512
FIRST = 4
_CELLS = "d int, n int, ids binary, hashes binary, low binary, width binary, cells binary"
_WIDE = "decimal(38,0)"
_MOST = 2**63 - 1
_BOUNDS = "q int, vec_id bigint, hash bigint, lower double, upper double"


def to_integers(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component x, only of whole finite vectors."""
    good = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return embeddings.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.greatest(F.lit(-_MOST), F.floor(x.cast("double") * scale).cast("long"))).alias("v"))


def smallest_of_equals(ids: np.ndarray, hashes: np.ndarray, k: int) -> np.ndarray:
    """Rows to keep: of each hash the 2k smallest ids, an id k times at most."""
    order = np.lexsort((ids, hashes))
    i, h = ids[order], hashes[order]
    at = np.arange(len(i))
    new_pair = np.concatenate([[True], (i[1:] != i[:-1]) | (h[1:] != h[:-1])])
    keep = at - np.maximum.accumulate(np.where(new_pair, at, 0)) < k
    order, h = order[keep], h[keep]
    at = np.arange(len(h))
    new = np.concatenate([[True], h[1:] != h[:-1]])
    return np.sort(order[at - np.maximum.accumulate(np.where(new, at, 0)) < 2 * k])


class Cells:
    """A block of the cell file, and bounds of inner products from it."""

    def __init__(self, low: np.ndarray, width: np.ndarray, cells: np.ndarray):
        self.low, self.width, self.cells = low, width, cells

    @staticmethod
    def of(x: np.ndarray, bits: int = BITS) -> Cells:
        low = x.min(axis=0)
        above = x.view(np.uint64) - low.view(np.uint64)  # distances of up to 2**64, without a sign
        width = above.max(axis=0) // np.uint64(2**bits) + np.uint64(1)
        return Cells(low, width.astype(np.int64), (above // width).astype(np.uint8))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds, (queries, rows)."""
        half = (self.width - 1) / 2
        middle = self.low + self.cells * self.width.astype(float) + half
        centre = q.astype(float) @ middle.T
        reach = (np.abs(q) * half).sum(axis=1)[:, None]
        slack = 1e-9 * (np.abs(q).astype(float) @ np.abs(middle).T + reach) + 1e-3  # what rounding can add
        return tuple(np.clip(b, -(2.0**63), 2.0**63) for b in (centre - reach - slack, centre + reach + slack))  # as scores are


def cell_file(vectors: DataFrame, k: int) -> DataFrame:
    """Blocks of cells of ``vectors`` (vec_id, hash, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            ids, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            sizes, out = np.diff(at), []
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                rows = rows[smallest_of_equals(ids[rows], hashes[rows], k)]
                for s in range(0, len(rows), ROWS_BLOCK):
                    own = rows[s : s + ROWS_BLOCK]
                    c = Cells.of(flat[at[own][:, None] + np.arange(d)])
                    out.append((int(d), len(own), ids[own].tobytes(), hashes[own].tobytes(), c.low.tobytes(), c.width.tobytes(), c.cells.tobytes()))
            kinds = (pa.int32(), pa.int32(), *(pa.binary(),) * 5)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["d", "n", "ids", "hashes", "low", "width", "cells"])

    return vectors.mapInArrow(run, _CELLS)


class Best:
    """What a scan keeps of one query: its k largest lower bounds and the rows still possible."""

    def __init__(self, k: int):
        self.k, self.top, self.parts = k, np.empty(0), []

    def add(self, lower: np.ndarray, upper: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> None:
        top = np.concatenate([self.top, lower])
        self.top = np.partition(top, -self.k)[-self.k :] if len(top) > self.k else top
        keep = np.flatnonzero(upper >= self.floor())
        if len(keep):
            self.parts.append((ids[keep], hashes[keep], lower[keep], upper[keep]))
        if sum(len(p[0]) for p in self.parts) > 8 * ROWS_BLOCK:
            self.parts = [self.rows()]

    def floor(self) -> float:
        return float(self.top.min()) if len(self.top) >= self.k else -np.inf

    def rows(self) -> tuple[np.ndarray, ...]:
        ids, hashes, lower, upper = (np.concatenate([p[i] for p in self.parts]) for i in range(4))
        keep = np.flatnonzero(upper >= self.floor())
        keep = keep[smallest_of_equals(ids[keep], hashes[keep], self.k)] if len(keep) else keep
        return ids[keep], hashes[keep], lower[keep], upper[keep]


def scan(cells: DataFrame, shared, k: int) -> DataFrame:
    """(q, vec_id, hash, lower, upper): the rows that each task can't rule out for query number q."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, query_ids, offsets, values = shared.value
        lengths = np.diff(offsets)
        best: dict[int, Best] = {}
        for batch in batches:
            for d, n, ids, hashes, low, width, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                asked = np.flatnonzero(lengths == d)
                ids, hashes, low, width = (np.frombuffer(x, dtype=np.int64) for x in (ids, hashes, low, width))
                block = Cells(low, width, np.frombuffer(cells, dtype=np.uint8).reshape(n, d))
                for s in range(0, len(asked), TILE):
                    mine = asked[s : s + TILE]
                    lower, upper = block.bounds(values[offsets[mine][:, None] + np.arange(d)])
                    for j, q in enumerate(mine):
                        others = ids != query_ids[q]
                        best.setdefault(int(q), Best(k)).add(lower[j][others], upper[j][others], ids[others], hashes[others])
        for q, b in best.items():
            if b.parts:
                ids, hashes, lower, upper = b.rows()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), first + q, dtype=np.int32)), *map(pa.array, (ids, hashes, lower, upper))], ["q", "vec_id", "hash", "lower", "upper"])

    return cells.mapInArrow(run, _BOUNDS)


def product(one: str, two: str) -> Column:
    """Exact inner product of two arrays of longs; beyond 64 bits the nearest number of 64 bits."""
    largest = lambda v: F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    low = lambda x: x.bitwiseAND(F.lit(2**32 - 1)).cast(_WIDE)
    high = lambda x: F.shiftright(x, 32).cast(_WIDE)

    def total(f) -> Column:
        return F.aggregate(F.zip_with(one, two, f), F.lit(0).cast(_WIDE), lambda a, x: (a + x).cast(_WIDE))

    # halves of 32 bits, so that no sum leaves 38 digits
    top, middle, rest = total(lambda x, y: high(x) * high(y)), total(lambda x, y: high(x) * low(y) + low(x) * high(y)), total(lambda x, y: low(x) * low(y))
    about = top.cast("double") * 2.0**64 + middle.cast("double") * 2.0**32 + rest.cast("double")
    exact = (top * F.lit(str(2**64)).cast(_WIDE)).cast(_WIDE) + (middle * F.lit(2**32).cast(_WIDE)).cast(_WIDE) + rest
    held = F.greatest(F.lit(-(2**63)).cast(_WIDE), F.least(F.lit(_MOST).cast(_WIDE), exact)).cast("long")
    wide = F.when(about > 2.0**64, F.lit(_MOST)).when(about < -(2.0**64), F.lit(-(2**63))).otherwise(held)
    short = F.aggregate(F.zip_with(one, two, lambda x, y: x * y), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(largest(one) * largest(two) * F.size(one) < 2.0**62, short).otherwise(wide)


def scored(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, scratch: Scratch) -> DataFrame:
    """``candidates`` (q, vec_id, hash, copy) with their exact scores; only their vectors are read."""
    wanted = scratch.table(candidates.select("vec_id", "hash").distinct())
    read = vectors.join(within(wanted), ["vec_id", "hash"], "left_semi").dropDuplicates(["vec_id", "hash"])
    return candidates.join(read, ["vec_id", "hash"]).join(queries.select("q", "qv"), "q").select("q", "vec_id", product("v", "qv").alias("score"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k rows of largest inner product."""
    spark = vectors.sparkSession
    with Scratch(spark) as scratch:
        vectors = scratch.table(vectors.select("vec_id", F.xxhash64("v").alias("hash"), "v"))
        asked = scratch.table(vectors.where(is_query).select("vec_id", "v").distinct())
        cells = scratch.table(cell_file(vectors, k))
        blocks, first, results = max(1, -(-asked.count() // QUERY_BLOCK)), 0, None
        for b in range(blocks):
            mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == b)
            rows = sorted((r.vec_id, tuple(r.v)) for r in mine.collect())  # about QUERY_BLOCK rows
            if not rows:
                continue
            offsets = np.concatenate([[0], np.cumsum([len(v) for _, v in rows])])
            shared = spark.sparkContext.broadcast((first, np.array([i for i, _ in rows]), offsets, np.array([x for _, v in rows for x in v], dtype=np.int64)))
            queries = spark.createDataFrame([(first + j, i, list(v)) for j, (i, v) in enumerate(rows)], "q int, query_id long, qv array<bigint>")
            bounded = scratch.table(scan(cells, shared, k))
            shared.destroy()
            best, by_bound, by_score = (Window.partitionBy("q").orderBy(*o) for o in ((F.desc("lower"),), (F.desc("upper"), "vec_id"), (F.desc("score"), "vec_id")))
            floors = bounded.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("q", F.col("lower").alias("floor"))
            left = bounded.join(F.broadcast(floors), "q", "left").where("floor IS NULL OR upper >= floor")
            left = scratch.table(left.select("q", "vec_id", "hash", "upper", F.row_number().over(by_bound).alias("r")))
            early = scratch.table(scored(left.where(F.col("r") <= FIRST * k), vectors, queries, scratch))
            kth = early.withColumn("r", F.row_number().over(by_score)).where(F.col("r") == k).select("q", F.col("score").alias("kth"))
            late = left.where(F.col("r") > FIRST * k).join(F.broadcast(kth), "q").where("upper >= kth")  # a query with more than FIRST * k rows has a k-th score
            found = early.unionByName(scored(late, vectors, queries, scratch)).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
            done = scratch.table(found.join(F.broadcast(queries.select("q", "query_id")), "q").select("query_id", "rank", "vec_id", "score"))
            results, first = done if results is None else results.unionByName(done), first + len(rows)
        if results is None:
            return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
        return cut(results)
