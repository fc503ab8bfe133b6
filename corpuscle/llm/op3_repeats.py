"""Repeated byte strings: parsing by rolling-hash triggers, classes of phrase sequences.

Every byte that lies in a string of ``LENGTH`` bytes which also starts anywhere else in
the corpus is removed. As in prefix-free parsing, local minima of a rolling hash are
triggers that cut texts into phrases at places which depend on content alone, so equal
strings are cut alike wherever they stand, and all further work is on phrases, not on
bytes. Two parsings are used, a coarse one to find candidates and a fine one:

1. Coarse: each window of LENGTH bytes has the smallest of its ``COARSE`` -byte hashes
   as trigger. Equal windows have equal triggers; triggers met once rule out most text.
2. Fine, only where a coarse trigger repeats: the windows that share first and last
   trigger form a run; its core is the phrase sequence between the two triggers, its
   cover all bytes of its windows. A cover met twice settles all windows of the run.
3. Runs whose core is met with other covers, at the ends of repeats, are settled window
   by window, by hashes of the window.

Classes of equal phrase sequences stand for the ranks of a suffix array: for a fixed
length only equality of neighbours matters, and classes can be counted with partial
aggregation where a hot passage would fill one range of a sorted array (see README).
Occurrences are counted, never paired. Equal texts are one text with a count: with two
or more, each string of the text starts elsewhere too.

Defined cases: a null text is empty; texts under LENGTH bytes keep all; rows that repeat
an id are separate texts; a null id is kept; an empty table gives an empty result; other
columns are ignored. A single text is worked on whole, at about 60 bytes a byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm import grams
from corpuscle.llm.cut import Scratch, cut

LENGTH = 400
#: Bytes of the coarse and the fine rolling hash, and positions in which a fine trigger is the smallest.
COARSE, FINE, REACH = 128, 8, 64
#: Candidate texts up to which their ids are broadcast (24 MB) rather than shuffled.
BROADCAST_IDS = 1_000_000
#: Places that are told apart at once; a longer text is worked on in pieces.
PLACES = 1 << 28
_PLACE = np.uint64(PLACES - 1)


def smallest(hashes: np.ndarray, reach: int) -> np.ndarray:
    """For each i the place of the smallest of hashes[i : i + reach], the first of equals (by their upper 36 bits)."""
    if len(hashes) > PLACES:  # pieces that overlap by a reach, so that a place fits its bits
        step = PLACES // 2
        return np.concatenate([smallest(hashes[s : s + step + reach - 1], reach) + s for s in range(0, len(hashes) - reach + 1, step)])
    key = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while 2 * width <= reach:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < reach:
        key = np.minimum(key[: len(key) - (reach - width)], key[reach - width :])
    return (key & _PLACE).astype(np.int64)


def gram_hashes(prefix: np.ndarray, width: int) -> np.ndarray:
    n = len(prefix) - width
    return grams.mix((prefix[width:] - prefix[:-width]) * grams.powers(len(prefix))[1][:n])


def coarse(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, trigger hash, times in the text) of the coarse triggers of many texts."""
    none = np.empty(0, dtype=np.int64)
    width = min(COARSE, length)
    if len(data) < length:
        return none, none.astype(np.uint64), none
    hashes = gram_hashes(grams.prefix_hashes(grams._BYTE[data]), width)
    place = smallest(hashes, length - width + 1)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(place)]
    whole = np.arange(len(place)) + length <= at[text + 1]
    text, place = text[whole], place[whole]
    if not len(text):
        return none, none.astype(np.uint64), none
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (place[1:] != place[:-1])])
    text, value = text[new], hashes[place[new]]
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (value[1:] != value[:-1])]))
    return text[new], value[new], np.diff(np.append(new, len(text)))


class Runs:
    """The fine runs of one text of at least ``length`` bytes."""

    def __init__(self, data: np.ndarray, length: int, wanted: np.ndarray | None = None):
        self.length, n = length, len(data)
        fine = min(FINE, length)
        reach = min(REACH, length - fine + 1)
        self.prefix = grams.prefix_hashes(grams._BYTE[data])
        place = smallest(gram_hashes(self.prefix, fine), reach)
        starts = n - length + 1
        first, last = place[:starts], place[length - fine + 1 - reach :][:starts]
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (last[1:] != last[:-1])])
        self.s0 = np.flatnonzero(new)
        self.s1 = np.append(self.s0[1:], starts) - 1
        self.t = first[self.s0]
        self.core = grams.span_hashes(self.prefix, self.t, last[self.s0] + fine)
        whole = grams.span_hashes(self.prefix, self.s0, self.s1 + length)
        self.cover = grams.mix(whole + (self.t - self.s0).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (self.s1 - self.s0).astype(np.uint64))
        self.kept = np.arange(len(self.s0))
        if wanted is not None:  # only runs with a window whose coarse trigger repeats
            width = min(COARSE, length)
            hashes = gram_hashes(self.prefix, width)
            good = np.isin(hashes[smallest(hashes, length - width + 1)], wanted)
            sums = np.concatenate([[0], np.cumsum(good)])
            self.kept = np.flatnonzero(sums[self.s1 + 1] > sums[self.s0])

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of each window of run k; the hash holds the trigger's place in it."""
        s = np.arange(self.s0[k], self.s1[k] + 1)
        return s, grams.mix(grams.span_hashes(self.prefix, s, s + self.length) + (self.t[k] - s).astype(np.uint64))


def _bytes(value: str | None) -> np.ndarray:
    return np.frombuffer((value or "").encode(), dtype=np.uint8)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values, dtype=np.uint64).view(np.int64))


def _rows(batch: pa.RecordBatch, out: list[tuple], names: tuple[str, str, str]) -> pa.RecordBatch:
    """Rows of (row of ``batch``, place, hash, hash), with the digest of the row's text."""
    row, place, one, two = (np.concatenate([x[i] for x in out]) for i in range(4)) if out else (np.empty(0, dtype=np.int64),) * 4
    take = pa.array(row)
    return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(place.astype(np.int32)), _signed(one), _signed(two)], ["d1", "d2", *names])


def remove(data: bytes, length: int, starts: np.ndarray) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs, remaining bytes) where the windows at ``starts`` go."""
    edge = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    gone = np.cumsum(edge)[:-1] > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return int(gone.sum()), spans, np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()


def repeated_strings(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    with Scratch(documents.sparkSession) as scratch:
        return _repeated_strings(documents, length, scratch)


def _repeated_strings(documents: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    keyed = documents.select("doc_id", text.alias("text")).select("doc_id", "text", F.xxhash64("text").alias("d1"), F.xxhash64(F.lit("second"), "text").alias("d2"))
    long_texts = keyed.where(F.octet_length("text") >= length)

    def triggers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in grams.chunks(batch.column(2)):
                owner, value, times = coarse(data, at, length)
                rows = pa.array(first + owner)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), _signed(value), pa.array(times.astype(np.int32))], ["d1", "d2", "core", "times"])

    coarse_rows = long_texts.select("d1", "d2", "text").mapInArrow(triggers, "d1 bigint, d2 bigint, core bigint, times int")
    met = scratch.table(coarse_rows.groupBy("d1", "d2", "core").agg(F.max("times").alias("times")))
    repeated = met.groupBy("core").agg(F.min("d1").alias("low"), F.max("d1").alias("high"), F.max("times").alias("times")).where("low <> high OR times > 1").select("core")
    wanted = met.join(repeated, "core").groupBy("d1", "d2").agg(F.collect_list("core").alias("cores"))
    copies = cut(keyed.groupBy("d1", "d2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("one")))
    wanted = scratch.table(wanted.join(copies.select("d1", "d2", "one"), ["d1", "d2"]))
    few = wanted.count() <= BROADCAST_IDS
    ids = wanted.select("d1", "d2", "one")
    one_each = long_texts.join(F.broadcast(ids) if few else ids, ["d1", "d2"]).where(F.col("doc_id").eqNullSafe(F.col("one"))).select("d1", "d2", "text")
    texts = scratch.table(one_each.join(wanted.select("d1", "d2", "cores"), ["d1", "d2"]))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, (value, cores) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                r = Runs(_bytes(value), length, np.array(cores, dtype=np.int64).view(np.uint64))
                out.append((np.full(len(r.kept), i), r.kept, r.core[r.kept], r.cover[r.kept]))
            yield _rows(batch, out, ("k", "core", "cover"))

    run_rows = scratch.table(texts.mapInArrow(runs, "d1 bigint, d2 bigint, k int, core bigint, cover bigint"))
    place = F.struct("d1", "d2", "k")
    covers = scratch.table(run_rows.groupBy("core", "cover").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.min("d1").alias("low"), F.max("d1").alias("high"), F.min("k").alias("k0"), F.max("k").alias("k1")))
    # a text that is there twice gives its rows once or twice; either way its place is one
    covers = covers.withColumn("twice", (F.col("low") != F.col("high")) | (F.col("k0") != F.col("k1")))
    several = covers.groupBy("core").agg(F.count("*").alias("covers")).where("covers > 1").select("core")
    whole = run_rows.join(covers.where("twice").select("core", "cover"), ["core", "cover"]).select("d1", "d2", "k")
    ends = covers.join(several, "core").select("first.d1", "first.d2", "first.k")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, (value, ks) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                r = Runs(_bytes(value), length)
                for k in ks:
                    s, h = r.windows(k)
                    out.append((np.full(len(s), i), s, np.full(len(s), r.core[k]), h))
            yield _rows(batch, out, ("s", "core", "h"))

    pure = texts.select("d1", "d2", "text")
    listed = ends.groupBy("d1", "d2").agg(F.collect_set("k").alias("ks"))
    window_rows = scratch.table(pure.join(listed, ["d1", "d2"]).mapInArrow(windows, "d1 bigint, d2 bigint, s int, core bigint, h bigint"))
    twice = window_rows.groupBy("core", "h").agg(F.min(F.struct("d1", "s")).alias("low"), F.max(F.struct("d1", "s")).alias("high")).where("low <> high").select("core", "h")
    singles = window_rows.join(twice, ["core", "h"]).select("d1", "d2", "s")
    decided = whole.groupBy("d1", "d2").agg(F.collect_set("k").alias("ks")).join(singles.groupBy("d1", "d2").agg(F.collect_set("s").alias("ss")), ["d1", "d2"], "full")

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d1, d2, value, ks, ss in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                data = (value or "").encode()
                r = Runs(np.frombuffer(data, dtype=np.uint8), length)
                starts = [np.arange(r.s0[k], r.s1[k] + 1) for k in ks or ()] + [np.array(ss or (), dtype=np.int64)]
                gone, spans, rest = remove(data, length, np.concatenate(starts))
                out.append((d1, d2, gone, spans, hashlib.sha256(rest).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["d1", "d2", "gone", "spans", "rest"])

    results = cut(pure.join(decided, ["d1", "d2"]).mapInArrow(cleaned, "d1 bigint, d2 bigint, gone bigint, spans bigint, rest string").dropDuplicates(["d1", "d2"]))
    facts = copies.select("d1", "d2", "copies").join(results, ["d1", "d2"], "left")
    own = keyed.select("doc_id", "d1", "d2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    all_gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return own.join(facts, ["d1", "d2"]).select(
        "doc_id",
        "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_gone, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("rest", "sha")).alias("kept_sha256"),
    )
