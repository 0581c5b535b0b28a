"""Array helpers for words and word shingles, used inside Arrow tasks.

A word is a maximal run of bytes other than space and 0x09-0x0D, so words are
found on the UTF-8 bytes without decoding. Hashes are 64 bits wide; two
different words or shingles of one comparison collide with a probability of
about 2**-64, which the operators treat as equality.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_GOLDEN = 0x9E3779B97F4A7C15
_MULT = U64(0xD6E8FEB86659FD93)
#: Bytes of text handled at once, which bounds the arrays of a task.
PART_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_GOLDEN))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and the len+1 offsets of its rows; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def parts(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows of about PART_BYTES of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(text))
        cut = np.searchsorted(at // PART_BYTES, np.arange(at[-1] // PART_BYTES + 2))
        cut = np.unique(np.clip(cut, 0, batch.num_rows))
        cut = np.unique(np.concatenate([[0], cut, [batch.num_rows]]))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield batch.slice(a, b - a)


@dataclass
class Words:
    """Words of several texts: row r has words off[r] to off[r + 1]."""

    data: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    off: np.ndarray
    hash: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))


def find_words(column: pa.Array, lower: bool = True, members: np.ndarray = ~_SPACE) -> Words:
    """Maximal runs of member bytes (a flag for each byte value), with A-Z lowered first if asked."""
    data, at = text_bytes(column)
    if lower:
        data = _LOWER[data]
    inside = members[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, at, start, end, np.searchsorted(start, at), _hash_runs(data, start, end))


def _hash_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of every run; the runs are disjoint, in order and not empty."""
    if not len(start):
        return np.zeros(0, U64)
    size = end - start
    power = np.ones(int(size.max()), U64)
    power[1:] = _MULT
    power = np.multiply.accumulate(power)
    first = np.cumsum(size) - size
    inner = np.arange(int(size.sum())) - np.repeat(first, size)
    value = _BYTE[data[inner + np.repeat(start, size)]] * power[inner]
    return mix(np.add.reduceat(value, first) + size.astype(U64) * U64(_GOLDEN))


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from every position on, and whether they lie in one text."""
    h, total = words.hash, len(words.hash)
    if total < n:
        return np.zeros(total, U64), np.zeros(total, bool)
    out = np.zeros(total, U64)
    value = h[: total - n + 1].copy()
    for k in range(1, n):
        value = value * _MULT + h[k : total - n + 1 + k]
    out[: total - n + 1] = mix(value)
    left = np.repeat(words.off[1:], np.diff(words.off)) - np.arange(total)
    return out, left >= n


def shingle_sets(column: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of every text, sorted, and their len+1 offsets.

    A text of one to n-1 words has its whole sequence as its only shingle; a
    text without words has none.
    """
    words = find_words(column)
    value, whole = ngrams(words, n)
    row, count = words.row, np.diff(words.off)
    keep = [value[whole]]
    rows = [row[whole]]
    for k in range(1, n):
        short = np.flatnonzero(count == k)
        if len(short):
            few, _ = ngrams(words, k)
            keep.append(few[words.off[short]] + U64(k))
            rows.append(short)
    value, row = np.concatenate(keep), np.concatenate(rows)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(len(column) + 1))
