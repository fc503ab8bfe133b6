"""MinHash near-duplicates: bottom-k sketches of one hash, inverted lists, exact Jaccard.

A document's set holds the hashes of its distinct word shingles; one hash function
serves sketch and sets. Equal sets collapse to one class first, so copies cost nothing
further. A sketch retains the ``RETAINED`` smallest values of a set. Two sets of
similarity p or more have sketches that share ``least_shared`` values or more (missed
with probability 1e-6 at the threshold, and less above it).

Inverted lists hold single retained values. Values are ordered by the number of sketches
that retain them, rarest first, and a sketch enters the lists of so many of its first
values that two sketches of enough overlap share a list for certain; values that a third
of all documents share are the last and seldom list anything.

No list is expanded into all its pairs. Each member meets the list's smallest one; the
pair's overlap is counted, the sketch of their union estimates the similarity, and what
the estimate can't rule out is confirmed on the full sets. Components of the links
follow, and ``close_buckets`` compares what is left: pair by pair where members of
different components are few, else by prefix filtering over the full sets, which loses no
pair.

Defined cases: a null text has an empty set, which links with nothing; a null doc_id
is its own document with a null component and is kept; rows that repeat an id are each
returned and judged by their own text; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.components import labelled
from corpuscle.llm.cut import Scratch, cut, within
from corpuscle.llm.grams import mix, pieces, shingle_sets
from corpuscle.llm.prefix import close_buckets
from corpuscle.llm.rows import row_hash

RETAINED, MISSED = 32, 1e-6
#: Ordered pairs of different components a member up to which a list's are compared one by one.
FEW = 64
_TOP = np.uint64(1 << 63)


def least_shared(percent: int) -> int:
    """Values that two full sketches share at least, at this similarity, but with probability MISSED."""
    p, below = percent / 100, 0.0
    for t in range(RETAINED + 1):
        below += comb(RETAINED, t) * p**t * (1 - p) ** (RETAINED - t)
        if below > MISSED:
            return max(1, t)
    return RETAINED


def _ordered(values: np.ndarray) -> np.ndarray:
    """Hashes as signed numbers of the same order."""
    return (values ^ _TOP).view(np.int64)


def features(documents: DataFrame, words: int) -> DataFrame:
    """(doc_id, row, n, d1, d2, sketch): set size, a 128-bit digest of the set, its smallest values in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            n, digest, kept, cuts = [], [], [], [0]
            for s in shingle_sets(batch.column(2), words):
                n.append(len(s))
                digest.append((int(s.sum(dtype=np.uint64)), int(mix(s ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64))))
                kept.append(_ordered(s[:RETAINED]))
                cuts.append(cuts[-1] + len(kept[-1]))
            d = np.array(digest, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            flat = np.concatenate(kept) if kept else np.empty(0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), lists], ["doc_id", "row", "n", "d1", "d2", "sketch"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", row_hash().alias("row"), "text")
    return rows.mapInArrow(run, "doc_id bigint, row bigint, n bigint, d1 bigint, d2 bigint, sketch array<bigint>")


def full_sets(documents: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, grams): the whole sets of the documents ``nodes`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            sets = [_ordered(s) for s in shingle_sets(batch.column(2), words)]
            cuts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            lists = pa.LargeListArray.from_arrays(pa.array(cuts, pa.int64()), pa.array(np.concatenate(sets))).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["doc_id", "row", "grams"])

    wanted = nodes.select("node.doc_id", "node.row")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", row_hash().alias("row"), "text")
    found = rows.join(wanted, ["doc_id", "row"], "left_semi").mapInArrow(run, "doc_id bigint, row bigint, grams array<bigint>")
    return found.select(F.struct("doc_id", "row").alias("node"), "grams").dropDuplicates(["node"])


def inverted_lists(classes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(value, node): the lists that sketches enter, of values that two of them or more retain."""
    entries = classes.select("node", F.size("sketch").alias("s"), F.explode("sketch").alias("value"))
    common = scratch.table(entries.groupBy("value").agg(F.count("*").alias("sketches")).where("sketches > 1"))
    met = entries.join(within(common), "value").groupBy("node").agg(F.max("s").alias("s"), F.array_sort(F.collect_list(F.struct("sketches", "value"))).alias("met"))
    shared = F.greatest(F.lit(1), F.floor(F.lit(least_shared(percent)) * F.col("s") / RETAINED))
    own = F.col("s") - F.size("met")  # values that no other sketch retains are the rarest
    listed = F.greatest(F.lit(0), F.col("s") - shared + 1 - own).cast("int")
    return met.select("node", F.explode(F.slice("met", F.lit(1), listed)).alias("x")).select("x.value", "node")


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of (a, b) those whose sizes, overlap and union sketch leave the similarity possible."""
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}")), side)
    sized = pairs.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    counted = sized.withColumn("both", F.array_intersect("sa", "sb")).withColumn("union", F.slice(F.array_sort(F.array_union("sa", "sb")), 1, RETAINED))
    need = F.greatest(F.lit(1), F.floor(F.lit(least_shared(percent)) * F.least(F.size("sa"), F.size("sb")) / RETAINED))
    p, u = percent / 100, F.size("union")
    estimate = F.size(F.array_intersect("union", "both")) >= u * (p - 5 * F.sqrt(p * (1 - p) / u))
    return counted.where((F.size("both") >= need) & estimate).select("a", "b")


def exact(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (a, b) those whose full sets are similar."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("grams").alias(f"v{side}")), side)
    sizes = pairs.select("a", "b", F.size("va").alias("na"), F.size("vb").alias("nb"), F.size(F.array_intersect("va", "vb")).alias("both"))
    return sizes.where(f"100 * both >= {percent} * (na + nb - both)").select("a", "b")


def linked(documents: DataFrame, classes: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame | None:
    """(node, component) of the classes, as ``components`` gives them; None where no list has two members."""
    lists = scratch.table(inverted_lists(classes, percent, scratch))
    heads = scratch.table(lists.groupBy("value").agg(F.min("node").alias("head"), F.count("*").alias("members")).where("members > 1").drop("members"))
    members = scratch.table(lists.join(within(heads), "value").select(F.col("value").alias("key"), "node", "head"))
    if members.isEmpty():
        return None

    def confirmed(pairs: DataFrame) -> DataFrame:
        near = scratch.table(likely(pairs, classes, percent))
        ids = scratch.table(near.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        sets = scratch.table(full_sets(documents, within(ids), words))
        return scratch.table(exact(near, sets, percent))

    links = confirmed(members.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct())
    sets = lambda nodes: full_sets(documents, within(scratch.table(nodes)), words)
    return close_buckets(members.select("key", "node"), links, percent, FEW, confirmed, sets, scratch)


def near_duplicates(documents: DataFrame, words: int = 3, percent: int = 85) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, kept) of every document; ``row`` is of ``row_hash``."""
    with Scratch(documents.sparkSession) as scratch:
        facts = scratch.table(features(documents, words))
        filled = facts.where("n > 0 AND doc_id IS NOT NULL")
        first = F.min(F.struct("doc_id", "row")).alias("node")
        classes = scratch.table(filled.groupBy("n", "d1", "d2").agg(first, F.first("sketch").alias("sketch")))
        labels = linked(documents, classes, words, percent, scratch)
        named = classes.withColumn("component", F.col("node")) if labels is None else labelled(classes, labels)
        found = scratch.table(named.select("n", "d1", "d2", F.col("component.doc_id").alias("component_id")))
        linked_rows = filled.join(within(found), ["n", "d1", "d2"]).select("doc_id", "row", "n", "component_id")
        others = facts.where("n = 0 OR doc_id IS NULL").select("doc_id", "row", "n", F.col("doc_id").alias("component_id"))  # empty sets are no key
        out = linked_rows.unionByName(others).withColumnRenamed("n", "n_shingles")
        return cut(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
