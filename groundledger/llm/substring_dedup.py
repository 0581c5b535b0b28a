"""Substring dedup: content-defined chunks, deduplicated by digest.

A gear hash rolls over the bytes of a text: shifted left by one and increased by
a random number of the new byte, so that it depends on the last 32 bytes only. A
chunk ends where its upper bits are all zero, 32 bytes on average; an insertion
thus moves the boundaries next to it alone. Chunks without such a place end after
MAX_CHUNK bytes.

A chunk whose digest occurs before, in a document of smaller doc_id or earlier in
its own, is an anchor: it lies at some distance from the digest's first place.
Anchors of one document, first document and distance make a passage where the text
between them is the same in both places, which hashes of the texts' beginnings
tell without the texts. So every passage stands in one earlier place as a whole.

Cuts leave off what a passage has before its first and behind its last anchor. So
passages of SEED_WORDS words or more are extended at both ends, byte by byte against
the first place, to the last whole character that is the same; only the bytes about
the ends are fetched from the texts, more of them in each round for the few ends that
have not met a difference. Passages that then have LEAST_WORDS words or more and lie
within no other one are reported.

Defined cases: null and empty texts have no chunks; of equal places the smallest
doc_id and start is the first; rows that repeat a doc_id are one document, so their
texts should be one as well (ends are extended in the bytes that come first); rows
without doc_id are not compared; a text of any length is chunked whole, and one
document's anchors fit a task; other columns are not read. A word counts where it
begins. The result does not depend on how rows are dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import release, settle, unused
from .words import _BYTE, _SPACE, U64, parts, text_bytes

WINDOW, MEAN_BITS, MAX_CHUNK, LEAST_WORDS, SEED_WORDS = 32, 5, 4096, 12, 3
#: Bytes about an end that are fetched in the first round, and how many times more in each further one.
NEAR, FURTHER = 96, 8
_GEAR = (_BYTE >> np.uint64(32)).astype(np.uint32)
#: Base of the polynomial hash of chunks and of the texts before them, and its inverse modulo 2**64.
_BASE = U64(0xA24BAED4963EE407)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_LOW = U64((1 << 32) - 1)


def gear_cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places (exclusive ends) at which the gear hash of the text's bytes before has MEAN_BITS leading zeros.

    at are the texts' offsets. Every text has WINDOW - 1 empty steps before it, so that
    no hash reaches into the text before.
    """
    gap = WINDOW - 1
    row = np.repeat(np.arange(1, len(at)), np.diff(at))
    place = np.arange(len(data)) + gap * row
    step = np.zeros(len(data) + gap * (len(at) - 1), np.uint32)
    step[place] = _GEAR[data]
    value = np.zeros(len(step), np.uint32)
    for back in range(min(WINDOW, len(step))):
        value[back:] += step[: len(step) - back] << np.uint32(back)
    return np.flatnonzero(value[place] >> np.uint32(32 - MEAN_BITS) == 0) + 1


def chunk_ends(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ends of the chunks of all texts; every text's end is one of them."""
    ends = np.unique(np.concatenate([gear_cuts(data, at), at[1:]]))
    ends = ends[ends > 0]
    long = np.flatnonzero(np.diff(ends, prepend=0) > MAX_CHUNK)
    before = np.concatenate([[0], ends])
    more = [np.arange(before[k] + MAX_CHUNK, ends[k], MAX_CHUNK) for k in long]
    ends = np.concatenate([ends, *more])
    for _ in range(3):  # an end inside a character moves behind it
        ends += (data[np.minimum(ends, len(data) - 1)] & 0xC0 == 0x80) & (ends < len(data))
    return np.unique(ends)


def _powers(base: np.uint64, many: int) -> np.ndarray:
    out = np.ones(many, U64)
    out[1:] = base
    return np.multiply.accumulate(out)


def _raised(base: np.uint64, to: np.ndarray) -> np.ndarray:
    """base ** to, number by number."""
    out, square, left = np.ones(len(to), U64), np.array([base], U64), to.astype(U64)
    while left.any():
        out = np.where(left & U64(1) == 1, out * square, out)
        square, left = square * square, left >> U64(1)
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with the words before their start and their end, and half of the hash of the text before their start."""
    for part in parts(batches):
        data, at = text_bytes(part.column("text"))
        if not len(data):
            continue
        ends = chunk_ends(data, at)
        start = np.concatenate([[0], ends[:-1]])
        row = np.searchsorted(at, start, "right") - 1
        first = ~_SPACE[data]
        first[1:] &= _SPACE[data][:-1]
        begins = at[:-1][np.diff(at) > 0]
        first[begins] = ~_SPACE[data[begins]]
        words = np.concatenate([[0], np.cumsum(first)])
        # A polynomial hash of everything before a place; a chunk's own, as if it stood at the start, is its digest.
        sums = np.concatenate([[U64(0)], np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), dtype=U64)])
        digest = (sums[ends] - sums[start]) * _raised(_INVERSE, start)
        before = (sums[start] - sums[at[row]]) * _raised(_INVERSE, at[:-1])[row]
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id").cast(pa.int64()).take(pa.array(row)),
                pa.array(start - at[row], pa.int32()),
                pa.array(ends - at[row], pa.int32()),
                pa.array(words[start] - words[at[row]], pa.int32()),
                pa.array(words[ends] - words[at[row]], pa.int32()),
                pa.array(digest.view(np.int64)),
                pa.array((before & _LOW).astype(np.uint32).view(np.int32)),
            ],
            ["doc_id", "start", "end", "word", "end_word", "digest", "before"],
        )


def _passages(least_words: int):
    """Passages from anchors that come together by doc_id, in the order of first place, distance and start."""
    names = ("doc_id", "start", "end", "word", "end_word", "digest", "before", "first_doc", "first_start", "first_before")

    def found(table: pa.Table) -> pa.RecordBatch:
        doc, start, end, word, end_word, digest, before, first, first_start, first_before = (table.column(c).to_numpy() for c in names)
        start, end, first_start = (x.astype(np.int64) for x in (start, end, first_start))
        before, first_before, digest = (x.astype(np.int64).view(U64) for x in (before, first_before, digest))
        far = start - first_start
        same = (doc[1:] == doc[:-1]) & (first[1:] == first[:-1]) & (far[1:] == far[:-1])
        # The text between two anchors, here and at the first place.
        upto = before + digest * _raised(_BASE, start)
        first_upto = first_before + digest * _raised(_BASE, first_start)
        here = (before[1:] - upto[:-1]) * _raised(_INVERSE, end[:-1])
        there = (first_before[1:] - first_upto[:-1]) * _raised(_INVERSE, (end - far)[:-1])
        new = np.flatnonzero(np.concatenate([[True], ~same | ((here ^ there) & _LOW != 0)]))
        last = np.concatenate([new[1:], [len(doc)]]) - 1
        many = end_word[last] - word[new]
        keep = many >= least_words
        new, last, many = new[keep], last[keep], many[keep]
        # Of passages within another one, the longer, then the one of the earlier place, stays.
        order = np.lexsort((first[new], -end[last], start[new], doc[new]))
        new, last, many = new[order], last[order], many[order]
        owner = np.searchsorted(np.unique(doc), doc[new])
        reach = owner * (1 << 40) + end[last]
        top = np.maximum.accumulate(np.concatenate([[-1], reach]))[:-1]
        out = reach > top
        new, last, many = new[out], last[out], many[out]
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[new]), pa.array(start[new]), pa.array(end[last]), pa.array(many, pa.int64()), pa.array(first[new]), pa.array(first_start[new])],
            ["doc_id", "start_byte", "end_byte", "n_words", "first_doc_id", "first_byte"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            doc = batch.column("doc_id").to_numpy()
            edge = int(np.searchsorted(doc, doc[-1]))
            if edge or (rest and rest[-1].column("doc_id")[0].as_py() != doc[0]):
                yield found(pa.Table.from_batches([*rest, batch.slice(0, edge)]))
                rest = []
            rest.append(batch.slice(edge))
        if rest:
            yield found(pa.Table.from_batches(rest))

    return run


def _same_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How far own and first agree from the end that they meet at: backwards on the left side, forwards on the right.

    (bytes, words that begin there, whether they agree as far as they go): on the
    right, both begin a byte early, as on the left they hold a byte more: it tells
    whether a word begins.
    """
    for batch in batches:
        left = np.array(batch.column("left").to_pylist(), bool)
        width = batch.column("width").to_numpy()
        rows = zip(batch.column("own").to_pylist(), batch.column("other").to_pylist(), left.tolist(), width.tolist(), strict=True)
        same, words, more = [], [], []
        for own, other, back, most in rows:
            a, b = np.frombuffer(own, np.uint8), np.frombuffer(other, np.uint8)
            a, b = (a[::-1], b[::-1]) if back else (a[1:], b[1:])
            n = min(len(a), len(b), most)
            differ = np.flatnonzero(a[:n] != b[:n])
            k = int(differ[0]) if len(differ) else n
            open_end = k == most
            # Whole characters only: the first byte inside, or behind, must not continue one.
            if back:
                while k and a[k - 1] & 0xC0 == 0x80:
                    k -= 1
                space = _SPACE[np.append(a[: k + 1], 32) if k == len(a) else a[: k + 1]]
                begun = int((~space[:k] & space[1 : k + 1]).sum())
            else:
                while k and k < len(a) and a[k] & 0xC0 == 0x80:
                    k -= 1
                space = _SPACE[np.frombuffer(own, np.uint8)[: k + 1]]
                begun = int((~space[1:] & space[:-1]).sum())
            same.append(k)
            words.append(begun)
            more.append(open_end)
        keep = [c for c in batch.schema.names if c not in ("own", "other")]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in keep], pa.array(same, pa.int64()), pa.array(words, pa.int64()), pa.array(more, pa.bool_())], [*keep, "same", "begun", "more"]
        )


_KEY = ["doc_id", "start_byte", "end_byte", "first_doc_id"]
_END = "doc_id long, start_byte long, end_byte long, first_doc_id long, left boolean, pos long, first_pos long, width long"


def _about(documents: DataFrame, ends: DataFrame) -> DataFrame:
    """(of, at, side, bytes) of the texts about the places (doc_id, pos, left, width) of both documents of the ends."""
    asked = ends.select("doc_id", "pos", "left", "width").unionAll(ends.select("first_doc_id", "first_pos", "left", "width")).distinct()
    asked = asked.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "left", "width")).alias("asked"))

    def piece(raw: Column, a: Column) -> Column:
        start = F.when(a["left"], F.greatest(a["pos"] - a["width"] - 1, F.lit(0))).otherwise(a["pos"] - 1)
        end = F.when(a["left"], a["pos"]).otherwise(a["pos"] + a["width"] + 1)
        return F.struct(a["pos"].alias("at"), a["left"].alias("side"), F.substring(raw, (start + 1).cast("int"), (end - start).cast("int")).alias("bytes"))

    raw = F.array(F.encode("text", "UTF-8"))
    found = documents.select("doc_id", "text").join(asked, "doc_id")
    found = found.select(F.col("doc_id").alias("of"), F.inline(F.get(F.transform(raw, lambda r: F.transform("asked", lambda a: piece(r, a))), F.lit(0))))
    # One row a place, also where rows repeat a doc_id; settled, so that a place of many passages can be split.
    return settle(found.groupBy("of", "at", "side").agg(F.min("bytes").alias("bytes")))


def _extended(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """The passages up to their exact ends."""
    length, width = F.col("end_byte") - F.col("start_byte"), F.lit(NEAR).cast("long").alias("width")
    left = passages.select(*_KEY, F.lit(True).alias("left"), F.col("start_byte").alias("pos"), F.col("first_byte").alias("first_pos"), width)
    right = passages.select(*_KEY, F.lit(False).alias("left"), F.col("end_byte").alias("pos"), (F.col("first_byte") + length).alias("first_pos"), width)
    ends, done = left.unionAll(right), []
    while True:
        # An end at a text's beginning on either side is where it is.
        ends = ends.where("not left or (pos > 0 and first_pos > 0)")
        about = _about(documents, ends)
        places = [about.withColumnRenamed("bytes", name) for name in ("own", "other")]
        rows = ends.join(places[0], (F.col("doc_id") == F.col("of")) & (F.col("pos") == F.col("at")) & (F.col("left") == F.col("side"))).drop("of", "at", "side")
        rows = rows.join(places[1], (F.col("first_doc_id") == F.col("of")) & (F.col("first_pos") == F.col("at")) & (F.col("left") == F.col("side"))).drop("of", "at", "side")
        met = settle(rows.mapInArrow(_same_bytes, f"{_END}, same long, begun long, more boolean"))
        release(about)
        done.append(met)
        step = F.when(F.col("left"), -F.col("same")).otherwise(F.col("same"))
        ends = met.where("more").select(*_KEY, "left", (F.col("pos") + step).alias("pos"), (F.col("first_pos") + step).alias("first_pos"), (F.col("width") * FURTHER).alias("width"))
        if ends.isEmpty():
            break
    grown = done[0]
    for met in done[1:]:
        grown = grown.unionAll(met)
    by_side = [F.sum(F.when(F.col("left") == side, F.col("same")).otherwise(0)).alias(name) for side, name in ((True, "before"), (False, "behind"))]
    grown = grown.groupBy(*_KEY).agg(*by_side, F.sum("begun").alias("begun"))
    nothing = F.lit(0).cast("long")
    out = passages.join(grown, _KEY, "left").select(
        "doc_id",
        (F.col("start_byte") - F.coalesce("before", nothing)).alias("start_byte"),
        (F.col("end_byte") + F.coalesce("behind", nothing)).alias("end_byte"),
        (F.col("n_words") + F.coalesce("begun", nothing)).alias("n_words"),
        "first_doc_id",
    )
    out = settle(out)
    release(*done)
    return out


def repeated_passages(documents: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Passages of documents(doc_id, text) that stand in an earlier place.

    (doc_id, start_byte, end_byte, n_words, first_doc_id): the bytes
    [start_byte, end_byte) of the text are also in first_doc_id, the document of
    smaller doc_id or the same one, there further ahead.
    """
    known = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = settle(known.mapInArrow(_chunks, "doc_id long, start int, end int, word int, end_word int, digest long, before int"))
    # Only the chunks whose digest occurs again are looked at further, some third.
    again = chunks.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")
    again = settle(again.select("digest", "first_doc"))
    some = settle(chunks.join(again, "digest"))
    release(chunks, again)
    # The first place in the first document; its start is the upper half of a number whose lower half is the hash before it.
    place = F.shiftleft(F.col("start").cast("long"), 32) + (F.col("before").cast("long") + F.lit(1 << 31))
    first = some.where("doc_id = first_doc").groupBy("digest").agg(F.min(place).alias("place"))
    # Settled, so that the join has a shuffle on either side and a frequent digest can be split.
    first = settle(
        first.select(
            "digest",
            F.shiftright("place", 32).cast("int").alias("first_start"),
            (F.col("place").bitwiseAND(F.lit((1 << 32) - 1)) - F.lit(1 << 31)).cast("int").alias("first_before"),
        )
    )
    anchors = settle(some.join(first, "digest").where("doc_id != first_doc or start != first_start").distinct())
    release(some, first)
    ordered = anchors.repartition("doc_id").sortWithinPartitions("doc_id", "first_doc", F.col("start") - F.col("first_start"), "start", "end")
    seeds = settle(ordered.mapInArrow(_passages(SEED_WORDS), "doc_id long, start_byte long, end_byte long, n_words long, first_doc_id long, first_byte long"))
    release(anchors)
    found = _extended(known, seeds).where(F.col("n_words") >= least_words)
    release(seeds)
    # Of passages within another one, the longer, then the one of the earlier place, stays.
    before = Window.partitionBy("doc_id").orderBy("start_byte", F.desc("end_byte"), "first_doc_id").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("reach", F.max("end_byte").over(before))
    return found.where("reach is null or end_byte > reach").drop("reach")


def without_passages(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """The documents with their repeated passages cut out of the text."""
    upto = Window.partitionBy("doc_id").orderBy("start_byte", "end_byte").rowsBetween(Window.unboundedPreceding, -1)
    spans = passages.select("doc_id", "start_byte", "end_byte", F.coalesce(F.max("end_byte").over(upto), F.lit(0)).alias("from"))
    kept = F.when(F.col("start_byte") > F.col("from"), F.struct("from", "start_byte"))
    cuts, last = unused(documents, "cuts", "last")
    spans = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(kept)).alias(cuts), F.max("end_byte").alias(last))

    def rest(raw: Column) -> Column:
        piece = F.transform(cuts, lambda c: F.substring(raw, (c["from"] + 1).cast("int"), (c["start_byte"] - c["from"]).cast("int")).cast("string"))
        return F.concat(F.array_join(piece, ""), F.substring(raw, (F.col(last) + 1).cast("int"), F.octet_length(raw)).cast("string"))

    text = F.get(F.transform(F.array(F.encode("text", "UTF-8")), rest), F.lit(0))
    joined = documents.join(spans, "doc_id", "left")
    return joined.withColumn("text", F.when(F.col(last).isNotNull(), text).otherwise(F.col("text"))).select(*documents.columns)
