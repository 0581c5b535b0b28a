"""Benchmark decontamination: SimHash of item-sized windows, then exact similarity.

Every item and every window of an item's size (in words) gets a SimHash of BITS bits
over its words. The fingerprints of the items of one size are indexed by disjoint
blocks of bits, one block more than the size's radius: two fingerprints within the
radius agree on one block at least, so the index proposes every item within it. The
radius is three standard deviations above the distance that a window of the wanted
similarity has whose other words stand together (which is when most words differ).
What is proposed is verified by the weighted Jaccard similarity of the 5-word shingles
(shingles count as often as they occur).

A window can reach the similarity only if enough of its shingles occur in the
benchmark at all; fingerprints of other windows are not computed, which loses no
match. With exact=True windows are proposed by an inverted index of the items'
shingles instead, which loses none at all. Items of fewer than five words have their
whole sequence as their one shingle; items without words match nothing.

The benchmark is handed to the tasks in blocks of about BLOCK_BYTES of text and
BLOCK_ITEMS items at most, each against all documents, so a broadcast is bounded
whatever the benchmark's size.

Defined cases: null and empty texts match nothing; a document that repeats is
reported once a row; of equally similar windows the first is reported; texts of
any length are searched whole; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U64, find_words, mix, ngrams, parts

SHINGLE, BITS = 5, 128
#: Windows whose fingerprints are looked up together.
WINDOWS = 4096
#: Items and bytes of text of one broadcast.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20


def radius(size: int, percent: int) -> int:
    """Bits within which a window of so many words with the similarity has its item's fingerprint."""
    shingles = max(size - SHINGLE + 1, 1)
    # Of the shingles 1 - 2s / (1 + s) may be others, and if they stand together as many words.
    other = shingles * (1 - 2 * percent / (100 + percent)) / size
    apart = math.acos(1 - other) / math.pi
    return min(math.ceil(BITS * apart + 3 * math.sqrt(BITS * apart * (1 - apart))), BITS - 1)


def _planes(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the BITS bits of every word."""
    two = np.stack([mix(hashes ^ U64(0x5EED)), mix(hashes ^ U64(0xFACADE))], axis=1)
    return np.unpackbits(np.ascontiguousarray(two).view(np.uint8), axis=1).astype(np.int32) * 2 - 1


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1)


class _Blocks:
    """Fingerprints of the items of one size by the values of their blocks of bits."""

    def __init__(self, items: np.ndarray, prints: np.ndarray, within: int) -> None:
        self.items, self.prints, self.within = items, prints, within
        # More blocks than the radius asks for keep a block's list of values short.
        edges = np.linspace(0, BITS, max(within + 1, BITS // 16) + 1).astype(int)
        self.spans = list(zip(edges[:-1], edges[1:], strict=True))
        self.lists = []
        for value, (low, high) in zip(self._values(prints), self.spans, strict=True):
            first = np.searchsorted(np.sort(value), np.arange((1 << (high - low)) + 1))
            self.lists.append((np.argsort(value, kind="stable"), first))

    def _values(self, prints: np.ndarray) -> Iterator[np.ndarray]:
        bits = np.unpackbits(prints, axis=1)
        for low, high in self.spans:
            yield bits[:, low:high] @ (1 << np.arange(high - low))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all fingerprints within the radius of the windows' own."""
        met = np.zeros((len(prints), len(self.items)), bool)
        for value, (order, first) in zip(self._values(prints), self.lists, strict=True):
            many = first[value + 1] - first[value]
            window = np.repeat(np.arange(len(prints)), many)
            met[window, order[np.arange(len(window)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[value], many)]] = True
        window, item = np.nonzero(met)
        close = np.bitwise_count(prints[window] ^ self.prints[item]).sum(axis=1) <= self.within
        return window[close], self.items[item[close]]


class Benchmark:
    """Items by size, their fingerprints in blocks, their shingles and, for each size, the items of every shingle."""

    def __init__(self, ids: list[int], texts: list[str], percent: int) -> None:
        words = find_words(pa.array(texts, pa.string()))
        size = np.diff(words.off)
        order = [k for k in np.argsort(size, kind="stable") if size[k]]
        self.ids = np.array([ids[k] for k in order], np.int64)
        self.size = size[order]
        self.shingles: list[tuple[np.ndarray, np.ndarray]] = []
        grams = {n: ngrams(words, n)[0] for n in range(1, SHINGLE + 1)}
        for x, k in enumerate(order):
            n = min(SHINGLE, size[k])
            own = grams[n][words.off[k] : words.off[k] + size[k] - n + 1]
            self.shingles.append(np.unique(own, return_counts=True))
        #: For every shingle length, the shingles of all items of that length.
        self.known = {
            n: np.unique(np.concatenate([s for (s, _), z in zip(self.shingles, self.size, strict=True) if min(z, SHINGLE) == n]))
            for n in sorted({int(min(z, SHINGLE)) for z in self.size})
        }
        self.sizes = np.unique(self.size)
        spans = [words.hash[words.off[k] : words.off[k + 1]] for k in order]
        prints = np.concatenate([np.zeros((0, BITS // 8), np.uint8), *[_fingerprints(_planes(h).sum(axis=0)[None]) for h in spans]])
        self.blocks = {int(z): _Blocks(own := np.flatnonzero(self.size == z), prints[own], radius(int(z), percent)) for z in self.sizes}
        #: By size: shingles in order, and the item of each.
        self.index = {}
        for z in self.sizes:
            own = np.flatnonzero(self.size == z)
            grams_of = np.concatenate([self.shingles[x][0] for x in own])
            item = np.repeat(own, [len(self.shingles[x][0]) for x in own])
            sort = np.argsort(grams_of, kind="stable")
            self.index[int(z)] = grams_of[sort], item[sort]

    def windows(self, size: int, at: np.ndarray, grams: np.ndarray, grams_in: int, need: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (start, item): windows of grams_in shingles of which `need` or more, at the places `at`, are the item's."""
        value, item = self.index[size]
        first = np.searchsorted(value, grams)
        many = np.searchsorted(value, grams, "right") - first
        place = np.repeat(at, many)
        item = item[np.repeat(first, many) + np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many)]
        order = np.lexsort((place, item))
        place, item = place[order], item[order]
        if len(place) < need:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, high = place[: len(place) - need + 1], place[need - 1 :]
        close = (item[: len(low)] == item[need - 1 :]) & (high - low < grams_in)
        low, high, item = low[close], high[close], item[: len(close)][close]
        start = np.maximum(high - grams_in + 1, 0)
        many = low - start + 1
        start = np.repeat(start - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        pair = np.unique(np.repeat(item, many) + start * len(self.ids))
        return pair // len(self.ids), pair % len(self.ids)


def _near_windows(hashes: np.ndarray, start: np.ndarray, size: int, blocks: _Blocks) -> Iterator[tuple[int, int]]:
    """(start, item): windows of the words whose fingerprint is within the radius of the item's."""
    # Windows that overlap share the sums of their words' planes.
    prints, edge = [], [0, *(np.flatnonzero(np.diff(start) > size) + 1), len(start)]
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        for low in range(a, b, WINDOWS):
            own = start[low : min(low + WINDOWS, b)]
            own, first = own - own[0], own[0]
            sums = np.zeros((int(own[-1]) + size + 1, BITS), np.int32)
            np.cumsum(_planes(hashes[first : first + own[-1] + size]), axis=0, out=sums[1:])
            prints.append(_fingerprints(sums[own + size] - sums[own]))
    prints = np.concatenate(prints)
    for low in range(0, len(start), WINDOWS):
        window, item = blocks.near(prints[low : low + WINDOWS])
        yield from zip(start[low + window].tolist(), item.tolist(), strict=True)


def _matches(part: pa.RecordBatch, bench: Benchmark, percent: int, exact: bool) -> Iterator[tuple[int, int, int, int, float]]:
    """(row, item, first word, words, similarity) of verified windows."""
    words = find_words(part.column("text"))
    total = len(words.hash)
    for n, known in bench.known.items():
        grams, whole = ngrams(words, n)
        # A table of the known shingles' low bits leaves few for the exact lookup.
        maybe = np.zeros(1 << 20, bool)
        maybe[(known & U64((1 << 20) - 1)).astype(np.int64)] = True
        hit = np.flatnonzero(maybe[(grams & U64((1 << 20) - 1)).astype(np.int64)] & whole)
        hit = hit[np.isin(grams[hit], known)]
        if not len(hit):
            continue
        hits = np.concatenate([[0], np.cumsum(np.bincount(hit, minlength=total))])
        left = np.repeat(words.off[1:], np.diff(words.off)) - np.arange(total)
        for size in (z for z in bench.sizes if min(z, SHINGLE) == n):
            grams_in = size - n + 1
            # A similarity of s needs a common weight of 2s/(1+s) times the mean weight, here the window's.
            need = -(-2 * percent * grams_in // (100 + percent))
            if exact:
                proposed = zip(*bench.windows(int(size), hit, grams[hit], int(grams_in), int(need)), strict=True)
            else:
                start = np.flatnonzero(hits[grams_in:] - hits[:-grams_in] >= need)
                start = start[left[start] >= size]
                proposed = _near_windows(words.hash, start, int(size), bench.blocks[int(size)]) if len(start) else ()
            for at, x in proposed:
                if left[at] >= size:
                    value, count = bench.shingles[x]
                    mine, times = np.unique(grams[at : at + grams_in], return_counts=True)
                    _, i, j = np.intersect1d(value, mine, assume_unique=True, return_indices=True)
                    both = int(np.minimum(count[i], times[j]).sum())
                    union = 2 * int(grams_in) - both
                    if 100 * both >= percent * union:
                        yield int(np.searchsorted(words.off, at, "right")) - 1, int(x), at, int(size), both / union


def _shared_blocks(benchmark: DataFrame, percent: int):
    """Broadcasts of the benchmark, block after block: each of BLOCK_BYTES of text on average, BLOCK_ITEMS items or fewer."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null and item_id is not null")
    many, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(-(-many // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Benchmark([r[0] for r in rows], [r[1] for r in rows], percent))


def contaminated(documents: DataFrame, benchmark: DataFrame, percent: int = 75, exact: bool = False) -> DataFrame:
    """Best matching window of each (document, item): (doc_id, item_id, first_word, n_words, similarity)."""
    out = documents.sparkSession.createDataFrame([], "doc_id long, item_id long, first_word long, n_words long, similarity double")
    for shared in _shared_blocks(benchmark, percent):

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bench = shared.value
            for part in parts(batches):
                ids = part.column("doc_id")
                best: dict[tuple[int, int], tuple] = {}
                for row, x, at, size, sim in _matches(part, bench, percent, exact):
                    key = row, int(bench.ids[x])
                    if key not in best or (-sim, at) < best[key][:2]:
                        best[key] = (-sim, at, size)
                if not best:
                    continue
                offsets = find_words(part.column("text")).off
                rows = [(ids[r].as_py(), i, a - int(offsets[r]), n, -s) for (r, i), (s, a, n) in best.items()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)],
                    ["doc_id", "item_id", "first_word", "n_words", "similarity"],
                )

        out = out.unionAll(documents.select("doc_id", "text").mapInArrow(scan, out.schema))
    return out


def without_contaminated(documents: DataFrame, benchmark: DataFrame, percent: int = 75, exact: bool = False) -> DataFrame:
    """The rows of documents(text, ...) that hold no item of the benchmark, in place: rows without doc_id are judged alike."""
    out = documents
    for shared in _shared_blocks(benchmark, percent):

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in parts(batches):
                keep = np.ones(part.num_rows, bool)
                keep[[row for row, *_ in _matches(part, shared.value, percent, exact)]] = False
                yield part.filter(pa.array(keep))

        out = out.mapInArrow(clean, documents.schema)
    return out
