"""Exact token counts of a SentencePiece BPE vocabulary without encoding.

A text becomes one symbol per character (space as the escape character, one of
it prepended). A heap holds the adjacent pairs whose concatenation is a piece,
a linked list the symbols; the best pair is popped and merged until none is
left. The count is the initial symbols minus the merges, where a character
without a piece of its own counts its UTF-8 bytes. No identifier is made.

No piece of the vocabulary has the escape character after another character,
so no merge crosses the start of a run of spaces; each run with the word that
follows is counted on its own and remembered in a cache of bounded size.

Defined cases: null and empty texts have 0 tokens; rows without doc_id, repeated
rows and other columns change nothing; texts of any length are counted whole.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import parts

SPACE = "▁"
CACHE_ENTRIES = 400_000
#: Longer units are counted but not remembered.
CACHED_CHARS = 40


class MergeTable:
    """Pieces with their ranks (lower merges first), read from a .model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [
            k
            for k in range(size)
            if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))
        ]
        self.rank = {model.id_to_piece(k): -model.get_score(k) for k in plain}
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("a piece crosses the start of a run of spaces")
        self._units = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self._known: dict[str, int] = {}

    def count(self, text: str) -> int:
        if not text:
            return 0
        known, total = self._known, 0
        for unit in self._units.findall(SPACE + text.replace(" ", SPACE)):
            n = known.get(unit)
            if n is None:
                n = self.merge(unit)
                if len(unit) <= CACHED_CHARS:
                    if len(known) >= CACHE_ENTRIES:
                        known.clear()
                    known[unit] = n
            total += n
        return total

    def merge(self, unit: str) -> int:
        rank = self.rank
        symbol: list[str] = list(unit)
        n = len(symbol)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [
            (r, k, 2) for k in range(n - 1) if (r := rank.get(symbol[k] + symbol[k + 1])) is not None
        ]
        heapq.heapify(heap)
        count = sum(1 if c in rank else len(c.encode()) for c in symbol)
        while heap:
            _, k, size = heapq.heappop(heap)
            after = right[k]
            if not symbol[k] or after >= n or len(symbol[k]) + len(symbol[after]) != size:
                continue  # one of the two has been merged since
            symbol[k] += symbol[after]
            symbol[after] = ""
            right[k] = after = right[after]
            if after < n:
                left[after] = k
                if (r := rank.get(symbol[k] + symbol[after])) is not None:
                    heapq.heappush(heap, (r, k, len(symbol[k]) + len(symbol[after])))
            before = left[k]
            if before >= 0 and (r := rank.get(symbol[before] + symbol[k])) is not None:
                heapq.heappush(heap, (r, before, len(symbol[before]) + len(symbol[k])))
            count -= 1
        return count


def token_counts(documents: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of documents(doc_id, text)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = MergeTable(model_path)
        for batch in parts(batches):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array([len(x.encode()) for x in texts], pa.int64()),
                    pa.array([table.count(x) for x in texts], pa.int64()),
                ],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    return (
        documents.select("doc_id", "text")
        .mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
