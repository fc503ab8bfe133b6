"""Importance resampling to a target: hashed n-gram counts from suffix arrays over word ids.

Texts are worked on in pieces of about ``PIECE`` bytes. Words of a piece get numbers, and a
suffix array orders its word positions by the words that follow within their text, by
prefix doubling up to the longest feature (deeper order moves no run of such n-grams).
Neighbours' common prefixes part the array in runs: all occurrences of one n-gram. Each run
is hashed once (its crc32 goes on from that of its first n - 1 words), and the bucket goes
back to all its occurrences. A text's row keeps the buckets of its features, two bytes
each, so texts are read once: counts of all rows give each bucket's gain, a table of fixed
length, and a second pass over the rows adds the gains.

A text's score is its floored mean gain plus Gumbel noise drawn from its id, so that the
highest scores are a sample without replacement with chances by importance. They get their
ranks by a range sort; no task sees all of them.

Defined cases: a null or empty text has no words, no features and weight 0; a null id takes
part with the empty text for an id in its noise and comes last in ties; rows that repeat an
id are documents each, and have the noise of the id; equal rows tie in any order; without
target texts, or without documents, counts are 0; an empty table gives an empty result;
other columns are ignored. A piece holds one text at least, at about 100 bytes of memory a byte.
Words of a piece are told apart by hashes of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.cut import Scratch, cut
from corpuscle.llm.grams import LOWER, NOT_WORD, buffers, words
from corpuscle.llm.order import ranked
from corpuscle.llm.rows import row_hash

LONGEST, BUCKETS = 2, 10_000
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
#: Bytes of text in one suffix array.
PIECE = 1 << 21


def suffix_order(ids: np.ndarray, left: np.ndarray, longest: int) -> np.ndarray:
    """Positions ordered by the next ``longest`` words of their text; ``left`` counts a text's words from each on."""
    rank, have = ids + 1, 1  # 0 stands for the text's end
    order = np.argsort(rank, kind="stable")
    while have < longest:
        after = np.zeros(len(ids), dtype=np.int64)
        more = np.flatnonzero(left > have)
        after[more] = rank[more + have]
        key = rank * (int(rank.max()) + 1) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[order] = 1 + np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
        have *= 2
    return order


def common_prefixes(order: np.ndarray, ids: np.ndarray, left: np.ndarray, longest: int) -> np.ndarray:
    """For each place of the order but the first how many words it shares with the one before, ``longest`` at most."""
    a, b = order[:-1], order[1:]
    shared, same = np.zeros(len(a), dtype=np.int64), np.ones(len(a), dtype=bool)
    for k in range(longest):
        same = same & (np.minimum(left[a], left[b]) > k)
        some = np.flatnonzero(same)
        same[some] = ids[a[some] + k] == ids[b[some] + k]
        shared += same
    return shared


def occurrences(data: np.ndarray, at: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, text of each feature, bucket of each feature) of texts as bytes and offsets; features by text."""
    text, starts, ends, hashes = words(data, at, NOT_WORD)
    n_words = np.bincount(text, minlength=len(at) - 1)
    if not len(text):
        return n_words, text, text
    _, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
    lower = LOWER[data].tobytes()
    spelled = [lower[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    left = np.cumsum(n_words)[text] - np.arange(len(text))
    order = suffix_order(ids, left, longest)
    shared = common_prefixes(order, ids, left, longest)
    state, owners, found = np.zeros(len(text), dtype=np.int64), [], []
    for n in range(1, longest + 1):
        begins = np.concatenate([[True], shared < n]) & (left[order] >= n)
        heads = order[begins]
        last = ids[heads + n - 1].tolist()
        if n == 1:
            run = [crc32(spelled[w]) for w in last]
        else:
            run = [crc32(spelled[w], crc32(b" ", before)) for w, before in zip(last, state[heads].tolist(), strict=True)]
        whole = left[order] >= n
        own = order[whole]
        state[own] = np.array(run, dtype=np.int64)[np.cumsum(begins)[whole] - 1]
        owners.append(text[own])
        found.append(state[own] % buckets)
    owner, bucket = np.concatenate(owners), np.concatenate(found)
    by_text = np.argsort(owner, kind="stable")
    return n_words, owner[by_text], bucket[by_text]


def features(texts: DataFrame, keep: list[str], longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """The ``keep`` columns, n_words and the buckets of all features of each ``text``, as bytes of two (or four) each."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column(batch.num_columns - 1))
            row = 0
            while row < batch.num_rows:
                end = max(row + 1, int(np.searchsorted(at, at[row] + PIECE, side="right")) - 1)
                n_words, owner, bucket = occurrences(data[at[row] : at[end]], at[row : end + 1] - at[row], longest, buckets)
                cuts = np.searchsorted(owner, np.arange(end - row + 1)) * kind.itemsize
                packed = bucket.astype(kind).tobytes()
                lists = [packed[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                own = [c.slice(row, end - row) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n_words, pa.int64()), pa.array(lists, pa.binary())], [*keep, "n_words", "buckets"])
                row = end

    kinds = dict(texts.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_words bigint, buckets binary"])
    return texts.select(*keep, "text").mapInArrow(run, schema)


def _flat(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a binary column and each row's end in them."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), dtype=kind), np.cumsum([len(p) // kind.itemsize for p in parts], dtype=np.int64)


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all ``rows`` each bucket holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column(0), buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in rows.select("buckets").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares in each bucket, floored."""
    s, t, b = source.astype(float), target.astype(float), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


def weighed(rows: DataFrame, gain: np.ndarray, keep: list[str]) -> DataFrame:
    """The ``keep`` columns with n_features and weight, the floored mean gain of a row's features."""
    shared = rows.sparkSession.sparkContext.broadcast(gain)
    n = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = _flat(batch.column(batch.num_columns - 1), n)
            sums = np.concatenate([[0], np.cumsum(shared.value[flat])])
            sizes = np.diff(ends, prepend=0)
            weight = (sums[ends] - sums[ends - sizes]) // np.maximum(1, sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(weight, pa.int64())], [*keep, "n_features", "weight"])

    kinds = dict(rows.dtypes)
    return rows.select(*keep, "buckets").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_features bigint, weight bigint"]))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise drawn from the id, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    documents: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED
) -> DataFrame:
    """(doc_id, row, n_features, weight, score, rank) of every document; ``row`` is of ``row_hash``.

    ``target`` has texts to resemble. ``rank`` numbers the drawn ones: of the documents with
    ``least_words`` words or more ``percent`` of a hundred, rounded down.
    """
    with Scratch(documents.sparkSession) as scratch:
        rows = scratch.table(features(documents.select("doc_id", row_hash().alias("row"), "text"), ["doc_id", "row"], longest, buckets))
        gain = gains(bucket_counts(rows, buckets), bucket_counts(features(target, [], longest, buckets), buckets))
        scored = scratch.table(weighed(rows, gain, ["doc_id", "row", "n_words"]).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
        drawn = scored.where(F.col("n_words") >= least_words).count() * percent // 100
        able = F.col("n_words") >= least_words
        out = ranked(scored, [able.desc(), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")], scratch)
        return cut(out.select("doc_id", "row", "n_features", "weight", "score", F.when(able & (F.col("rank") <= drawn), F.col("rank")).alias("rank")))


def draw(documents: DataFrame, target: DataFrame, **options: int) -> DataFrame:
    """The drawn documents with all their columns; rows that repeat id and text are drawn together."""
    found = resample(documents, target, **options).where("rank IS NOT NULL").select(F.struct("doc_id", "row").alias("_g")).distinct()
    rows = documents.select(F.struct("*").alias("_d"), F.col("doc_id").alias("_id"), row_hash().alias("_row"))
    return rows.join(found, (F.col("_row") == F.col("_g.row")) & F.col("_id").eqNullSafe(F.col("_g.doc_id")), "left_semi").select("_d.*")
