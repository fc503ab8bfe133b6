"""Benchmark decontamination by spaced seeds.

Texts are compared as sequences of words (runs of letters and digits, A-Z as a-z). A
fixed mask of words that count and words that don't slides along them; the hash of the
words that count is a seed. Several masks, so that a substituted word spoils few seeds.
Equal seeds of a benchmark item and a document give a place where both may run
alongside; there the words are compared one by one, and the stretch around the hit that
agrees best is taken. It counts from ``LEAST`` words (a shorter item: all of it) with at
most a share ``WRONG`` of substituted words.

Benchmark items are indexed by seed and the index is broadcast. Its size is checked: a
benchmark of more than about ``BROADCAST_SEEDS`` seeds is worked off in parts of that
size, each with its own pass over the texts.

Defined cases: null texts are empty; items of fewer words than the widest mask are
indexed whole too, besides by the masks that fit (under eight words, whole only); items without words match nothing; an empty
benchmark leaves all documents; a null doc_id or item_id is kept as null and works as
an id; rows that repeat an id are judged each by their own text; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm import grams
from corpuscle.llm.cut import cut
from corpuscle.llm.rows import row_hash

# The masks, 1 for a word that counts.
MASKS = ("11101111", "1101100111", "110010110111", "1110110101")
LEAST, WRONG = 13, 0.2
BROADCAST_SEEDS = 2_000_000
#: Hits of seeds that are made at once, if no single seed has more.
HITS = 1 << 20
_WEIGHTS = np.random.default_rng(10).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def seeds(text: np.ndarray, hashes: np.ndarray, mask: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, seed) of each place of ``mask`` within one text."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    out = np.full(n, number + 1, dtype=np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            out += hashes[k : k + n] * _WEIGHTS[k]
    same = np.flatnonzero(text[:n] == text[len(mask) - 1 :])
    return same, grams.mix(out[same])


#: What stands for the seed before the first place of an item, and of a text: never the same.
NO_ITEM, NO_TEXT = np.uint64(1), np.uint64(2)


def previous(place: np.ndarray, seed: np.ndarray, none: np.uint64) -> np.ndarray:
    """The seed one word before each place; its own with a bit turned where there is none."""
    out = seed ^ none
    after = np.flatnonzero(place[1:] == place[:-1] + 1)
    out[after + 1] = seed[after]
    return out


class Index:
    """Items as word hashes, and their seeds in order."""

    def __init__(self, items: list[tuple[object, str]]):
        self.ids = [i for i, _ in items]
        data = pa.array([t or "" for _, t in items], pa.large_string())
        words: list[np.ndarray] = []
        for first, end, chunk, at in grams.chunks(data):
            text, _, _, hashes = grams.words(chunk, at, grams.NOT_WORD)
            cuts = np.searchsorted(text, np.arange(end - first + 1))
            words += [hashes[cuts[i] : cuts[i + 1]] for i in range(end - first)]
        self.words = words
        rows = []
        widest = max(map(len, MASKS))
        for item, h in enumerate(words):
            text = np.zeros(len(h), dtype=np.int64)
            if 0 < len(h) < widest:  # a mask of its own: all words
                _, s = seeds(text, h, "1" * len(h), len(MASKS) + len(h))
                rows.append((s, np.full(1, item), np.zeros(1, dtype=np.int64), s ^ NO_ITEM))
            for number, mask in enumerate(MASKS):
                at, s = seeds(text, h, mask, number)
                rows.append((s, np.full(len(at), item), at, previous(at, s, NO_ITEM)))
        self.short = sorted({len(h) for h in words if 0 < len(h) < widest})
        none = np.empty(0, dtype=np.int64)
        seed, item, at, before = (np.concatenate([r[k] for r in rows]) if rows else none for k in range(4))
        order = np.argsort(seed.astype(np.uint64), kind="stable")
        self.seed, self.item, self.at, self.before = seed.astype(np.uint64)[order], item[order], at[order], before.astype(np.uint64)[order]
        self.some = np.zeros(1 << 22, dtype=bool)  # leading bits of seeds, to pass over most places
        self.some[self.seed >> np.uint64(42)] = True

    def masks(self) -> list[tuple[str, int]]:
        return [*((m, i) for i, m in enumerate(MASKS)), *(("1" * n, len(MASKS) + n) for n in self.short)]


def aligned(document: np.ndarray, item: np.ndarray, shift: int, place: int, least: int, wrong: float) -> tuple[int, int, int]:
    """(first word, end word in the document, equal words) of the best stretch around ``place``.

    Item word i lies at document word i + shift. Of all stretches that hold ``place`` and
    keep the share of substitutions, the longest; (0, 0, 0) if under ``least`` words.
    """
    low, high = max(0, shift), min(len(document), shift + len(item))
    equal = document[low:high] == item[low - shift : high - shift]
    value = np.concatenate([[0.0], np.cumsum(np.where(equal, wrong, wrong - 1.0))])
    p = place - low
    best = (0, 0, 0)
    left = np.arange(p + 1)
    ends = np.arange(p + 1, len(value))
    if not len(ends):
        return best
    top = np.maximum.accumulate(value[ends][::-1])[::-1]  # the last end with at least a value
    for i in left:
        if not equal[i] or len(value) - 1 - i < max(least, best[1] - best[0]):
            continue
        k = int(np.searchsorted(-top, -(value[i] - 1e-9), side="right")) - 1
        if k < 0:
            continue
        e = int(ends[k])
        while e > i and not equal[e - 1]:
            e -= 1
        if e - i > best[1] - best[0]:
            best = (low + int(i), low + e, int(equal[i:e].sum()))
    return best if best[1] - best[0] >= least else (0, 0, 0)


class Finder:
    """Contaminated stretches of texts."""

    def __init__(self, index: Index, least: int = LEAST, wrong: float = WRONG):
        self.index, self.least, self.wrong = index, least, wrong

    def find(self, column: pa.Array) -> Iterator[list[tuple[object, int, int, int]]]:
        """For each text (item id, first word, end word, equal words) of each verified stretch."""
        index = self.index
        for first, end, data, at in grams.chunks(column):
            text, _, _, hashes = grams.words(data, at, grams.NOT_WORD)
            cuts = np.searchsorted(text, np.arange(end - first + 1))
            hits: dict[int, list[tuple[int, int, int]]] = {}
            for mask, number in index.masks() if len(index.seed) else ():
                place, seed = seeds(text, hashes, mask, number)
                before = previous(np.where(np.diff(text[place], prepend=-1) != 0, -2 - place, place), seed, NO_TEXT) if len(place) else seed
                likely = index.some[seed >> np.uint64(42)]
                place, seed, before = place[likely], seed[likely], before[likely]
                low, high = np.searchsorted(index.seed, seed), np.searchsorted(index.seed, seed, side="right")
                ends = np.cumsum(high - low)
                first_seed = 0
                while first_seed < len(seed):
                    done = ends[first_seed - 1] if first_seed else 0
                    last_seed = max(first_seed + 1, int(np.searchsorted(ends, done + HITS, side="right")))
                    part = slice(first_seed, last_seed)
                    n = high[part] - low[part]
                    i = np.repeat(np.arange(first_seed, last_seed), n)
                    j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + low[i]
                    new = index.before[j] != before[i]  # else the place before is a hit of the same stretch
                    i, j = i[new], j[new]
                    owner = text[place[i]]
                    at_word = place[i] - cuts[owner]
                    for row, *hit in zip(owner.tolist(), index.item[j].tolist(), (at_word - index.at[j]).tolist(), at_word.tolist(), strict=True):
                        hits.setdefault(row, []).append(tuple(hit))
                    first_seed = last_seed
            for i in range(end - first):
                yield self._verified(hashes[cuts[i] : cuts[i + 1]], hits.get(i, []))

    def _verified(self, document: np.ndarray, hits: list[tuple[int, int, int]]) -> list[tuple[object, int, int, int]]:
        out, done = {}, {}
        for item, shift, place in sorted(hits):
            if place < done.get((item, shift), -1):
                continue  # within the stretch that was found
            words = self.index.words[item]
            a, b, equal = aligned(document, words, shift, place, min(self.least, len(words)), self.wrong)
            if b > a:
                done[item, shift] = b
                out[item, a, b] = equal
        return [(self.index.ids[item], a, b, equal) for (item, a, b), equal in sorted(out.items())]


def contaminated(documents: DataFrame, benchmark: DataFrame, least: int = LEAST, wrong: float = WRONG) -> DataFrame:
    """(doc_id, row, item_id, first_word, end_word, equal_words): each verified stretch; ``row`` is of ``row_hash``."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    words = items.agg(F.sum(F.length("text"))).first()[0] or 0
    spark = documents.sparkSession
    kinds = dict(documents.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kinds[0]}, row bigint, item_id {kinds[1]}, first_word int, end_word int, equal_words int"
    n_parts = max(1, -(-words * len(MASKS) // (4 * BROADCAST_SEEDS)))  # a word with its space has 4 characters or more
    parts = None
    for part in range(n_parts):
        own = items if n_parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_parts)) == part)
        shared = spark.sparkContext.broadcast(sorted(((r.item_id, r.text) for r in own.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = Finder(Index(shared.value), least, wrong)
            for batch in batches:
                rows = [(i, *hit) for i, found in enumerate(finder.find(batch.column(2))) for hit in found]
                take = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array([r[1] for r in rows], pa.int64() if kinds[1] == "bigint" else None), *(pa.array([r[k] for r in rows], pa.int32()) for k in (2, 3, 4))],
                    ["doc_id", "row", "item_id", "first_word", "end_word", "equal_words"],
                )

        found = documents.select("doc_id", row_hash().alias("row"), "text").mapInArrow(run, schema)
        parts = found if parts is None else parts.unionByName(found)
    return parts


def judge(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_items, n_words) of every document: verified stretches of benchmark items in it."""
    found = cut(contaminated(documents, benchmark).distinct())
    hits = found.groupBy("doc_id", "row").agg(F.countDistinct("item_id").alias("n_items"), F.sum("equal_words").alias("n_words"))
    rows = documents.select("doc_id", row_hash().alias("row"))
    named = hits.select(F.struct("doc_id", "row").alias("_hit"), "n_items", "n_words")
    joined = rows.join(named, (F.col("row") == F.col("_hit.row")) & F.col("doc_id").eqNullSafe(F.col("_hit.doc_id")), "left")
    return joined.select("doc_id", F.col("n_words").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"))
