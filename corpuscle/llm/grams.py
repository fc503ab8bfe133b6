"""Words and hashes of whole texts, over many texts at once with numpy.

Texts come as one byte buffer and offsets, as Arrow keeps them. Hashes have 64 bits:
a polynomial over per-byte random constants, modulo 2**64, from prefix sums, mixed at
the end, so a word of any length costs the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once, if no single text is longer.
CHUNK = 1 << 20

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_POWERS: list[np.ndarray] = []

#: Bytes that part words: of white space, and of all ASCII but letters and digits.
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
NOT_WORD = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads each bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table, step = np.ones(1, dtype=np.uint64), base
            while len(table) < size:
                table, step = np.concatenate([table, table * np.uint64(step)]), step * step & _MASK
            out.append(table)
        _POWERS[:] = out
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hashes`` takes the hash of any run of ``values``."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the runs [start, end), wherever they lie."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)), at


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0): pieces of about CHUNK bytes, of whole texts."""
    data, at = buffers(column)
    row, n = 0, len(column)
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK, side="right")) - 1)
        end = min(end, n)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of about CHUNK bytes of text in ``column``, one text at least."""
    for batch in batches:
        _, at = buffers(batch.column(column))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK, side="right")) - 1)
            yield batch.slice(row, min(end, batch.num_rows) - row)
            row = end


def words(data: np.ndarray, at: np.ndarray, part: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, end, hash) of each word; letters A-Z count as a-z."""
    if not len(data):
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, empty, np.empty(0, dtype=np.uint64)
    inside = ~part[data]
    edge = np.zeros(len(data) + 1, dtype=bool)  # a text's first byte begins a word anew
    edge[at] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    prefix = prefix_hashes(_BYTE[LOWER[data]])
    text = np.searchsorted(at, starts, side="right") - 1
    return text, starts, ends, span_hashes(prefix, starts, ends)


def shingles(text: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each run of ``n`` words within a text."""
    if len(hashes) < n:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = mix(out + hashes[k : len(hashes) - n + 1 + k] + np.uint64(k))
    same = text[: len(text) - n + 1] == text[n - 1 :]
    return text[: len(text) - n + 1][same], out[same]


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``n`` words.

    With fewer words the whole sequence is one shingle; without words the set is empty.
    """
    for first, end, data, at in chunks(column):
        text, _, _, hashes = words(data, at)
        owner, values = shingles(text, hashes, n)
        rows = np.arange(end - first + 1)
        cuts, word_cuts = np.searchsorted(owner, rows), np.searchsorted(text, rows)
        for i in range(end - first):
            if cuts[i] < cuts[i + 1]:
                yield np.unique(values[cuts[i] : cuts[i + 1]])
            elif word_cuts[i] < word_cuts[i + 1]:
                whole = np.zeros(1, dtype=np.uint64)
                for k, h in enumerate(hashes[word_cuts[i] : word_cuts[i + 1]]):
                    whole = mix(whole + h + np.uint64(k))
                yield mix(whole + np.uint64(word_cuts[i + 1] - word_cuts[i]))
            else:
                yield np.empty(0, dtype=np.uint64)
