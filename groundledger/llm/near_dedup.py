"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

Every document's set of distinct 5-word shingles gets a SuperMinHash signature
(Ertl 2017): element after element, the slots of one random permutation receive
increasing ranks, and the work stops at the rank no slot can improve on.
Documents with equal sets collapse to their smallest doc_id, so a group of
copies costs one signature. Bands of four slots propose links; in each bucket a
few hubs are tried first, what they join counts as one from then on, and only
members of a bucket that are still apart are compared with each other, block
against block. Every link is confirmed on the full sets.

With 128 slots in 32 bands of 4, a pair at the similarity of 0.75 shares no
band with a probability of 6e-6, and less above it; lower similarities are refused.

Rows of a bucket of more than BLOCK are dealt to blocks by salted keys, so that a
crowded bucket is spread over many tasks from the start.

Defined cases: null or word-less texts have an empty set and stay alone; a
text of one to four words has one shingle; rows that repeat a doc_id are one
document; a row without doc_id is kept and has no component; texts of any length
count whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import release, settle
from .words import U64, mix, parts, shingle_sets

SLOTS, ROWS = 128, 4
BANDS = SLOTS // ROWS
#: Bands tried with one hub a bucket, in turn; then buckets are compared in blocks.
HUB_ROUNDS = ((0, 3), (3, BANDS))
BLOCK = 256
#: Tasks that the rows of a bucket with several blocks are spread over.
SALTS = 64


def least_agreeing(percent: int) -> int:
    """Slots in which the signatures of a pair at the similarity agree but for a probability of about 1e-9: six deviations below."""
    share = percent / 100
    return int(SLOTS * share - 6 * (SLOTS * share * (1 - share)) ** 0.5)


def super_minhash(items: np.ndarray, off: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (texts, slots) of sets of 64-bit items; empty sets stay infinite."""
    sets = len(off) - 1
    sign = np.full((sets, slots), np.inf)
    owner = np.repeat(np.arange(sets), np.diff(off))
    moved: list[np.ndarray] = []
    for rank in range(slots):
        live = sign.max(axis=1) > rank
        keep = live[owner]
        if not keep.any():
            break
        if not keep.all():
            items, owner, moved = items[keep], owner[keep], [x[keep] for x in moved]
        draw = mix(items + U64((rank + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        pick = rank + ((draw & U64(0xFFFFFFFF)) * U64(slots - rank) >> U64(32)).astype(np.int16)
        slot = pick.copy()
        for earlier in range(rank - 1, -1, -1):
            slot[slot == moved[earlier]] = earlier
        np.minimum.at(sign.reshape(-1), owner * slots + slot, rank + (draw >> U64(32)).astype(float) / 2**32)
        moved.append(pick)
    return sign


def _bands(sign: np.ndarray) -> np.ndarray:
    """Bucket keys (texts, BANDS) of mixed signatures."""
    bands = np.zeros((len(sign), BANDS), U64)
    for k in range(ROWS):
        bands = mix(bands + sign[:, k::ROWS])
    return mix(bands + np.arange(BANDS, dtype=U64))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts(batches):
        items, off = shingle_sets(part.column("text"))
        count = np.diff(off)
        sign = mix(super_minhash(items, off).view(U64))
        bands = _bands(sign)
        total = np.concatenate([[U64(0)], np.cumsum(mix(items + U64(77)), dtype=U64)])
        other = np.concatenate([[U64(0)], np.cumsum(mix(items + U64(991)), dtype=U64)])
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id").cast(pa.int64()),
                pa.array(count, pa.int64()),
                pa.array((total[off[1:]] - total[off[:-1]]).view(np.int64)),
                pa.array((other[off[1:]] - other[off[:-1]]).view(np.int64)),
                pa.FixedSizeListArray.from_arrays(bands.reshape(-1).view(np.int64), BANDS).cast(pa.list_(pa.int64())),
                pa.array([x.tobytes() for x in (sign & U64(255)).astype(np.uint8)], pa.binary()),
            ],
            ["doc_id", "n_shingles", "set_a", "set_b", "bands", "sign"],
        )


def _links(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose full sets reach the similarity."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text_a"):
            left, lo = shingle_sets(part.column("text_a"))
            right, ro = shingle_sets(part.column("text_b"))
            found = np.zeros(part.num_rows, bool)
            for k in range(part.num_rows):
                x, y = left[lo[k] : lo[k + 1]], right[ro[k] : ro[k + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                found[k] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(found)) for c in ("a", "b")], ["a", "b"])

    sides = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b"
    )
    return sides.mapInArrow(confirm, "a long, b long")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts(batches):
        items, off = shingle_sets(part.column("text"))
        full = mix(super_minhash(items, off).view(U64))
        sign, bands = (full & U64(255)).astype(np.uint8), _bands(full)
        value = [items[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id").cast(pa.int64()), *(pa.array([x.tobytes() for x in c], pa.binary()) for c in (sign, bands)), pa.array(value, pa.binary())],
            ["rep", "sign", "bands", "items"],
        )


def _block_links(percent: int):
    """Links within block pairs, whose rows (key, i, j, band, rep, comp, sign, bands, items) come together.

    A block pair has some 2 * BLOCK rows. Pairs that are joined already, that an
    earlier band holds too (by the keys that make the buckets), or whose
    signatures differ too much are passed over; the full sets decide on the others, and only links leave the task.
    """
    names, agreeing = ("key", "i", "j"), least_agreeing(percent)

    def compare(group: pa.Table) -> pa.RecordBatch | None:
        ids, comp = (group.column(c).to_numpy() for c in ("rep", "comp"))
        band = group.column("band")[0].as_py()
        sign = np.frombuffer(b"".join(group.column("sign").to_pylist()), np.uint8).reshape(-1, SLOTS)
        bands = np.frombuffer(b"".join(group.column("bands").to_pylist()), U64).reshape(-1, BANDS)
        items = [np.frombuffer(x, U64) for x in group.column("items").to_pylist()]
        size = np.array([len(x) for x in items])
        a, b = [], []
        for k in range(len(ids) - 1):
            near = (comp[k + 1 :] != comp[k]) & (100 * np.minimum(size[k + 1 :], size[k]) >= percent * np.maximum(size[k + 1 :], size[k]))
            rest = np.flatnonzero(near) + k + 1
            same = (sign[rest] == sign[k]).sum(axis=1)
            first = (bands[rest] == bands[k]).argmax(axis=1)
            for x in rest[(same >= agreeing) & (first == band)]:
                both = len(np.intersect1d(items[k], items[x], assume_unique=True))
                if 100 * both >= percent * (size[k] + size[x] - both):
                    a.append(ids[k])
                    b.append(ids[x])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]) if a else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rest = rows if rest is None else pa.concat_tables([rest, rows])
            cols = [rest.column(c).to_numpy() for c in names]
            new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
            edge = [0, *new.tolist()]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if b - a > 1 and (out := compare(rest.slice(a, b - a))):
                    yield out
            rest = rest.slice(edge[-1]).combine_chunks()
        if rest is not None and rest.num_rows > 1 and (out := compare(rest)):
            yield out

    return run


def near_duplicates(documents: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of documents(doc_id, text)."""
    if not 75 <= percent <= 100:
        raise ValueError("bands are made for similarities of 75 to 100 percent")
    signed = settle(
        documents.select("doc_id", "text").mapInArrow(
            _signatures,
            "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sign binary",
        )
    )
    same_set = ["n_shingles", "set_a", "set_b"]
    some = signed.where("n_shingles > 0 and doc_id is not null")
    # Settled, so that the join has a shuffle on either side and a large group of equal sets can be split.
    classes = settle(some.groupBy(*same_set).agg(F.min("doc_id").alias("rep")))
    member = settle(some.select("doc_id", *same_set).join(classes, same_set).select("doc_id", "rep"))
    reps = member.where("doc_id = rep").select("doc_id").distinct()

    rows = (
        some.select("doc_id", "n_shingles", "bands")
        .join(reps, "doc_id", "left_semi")
        .select(F.col("doc_id").alias("rep"), "n_shingles", F.posexplode("bands").alias("band", "key"))
    )
    shared = rows.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("key")
    crowd = settle(rows.join(shared, "key").distinct())
    near = crowd.select(F.col("rep").alias("doc_id")).distinct()
    texts = settle(documents.select("doc_id", "text").join(near, "doc_id", "left_semi"))

    none = documents.sparkSession.createDataFrame([], "node long, component long")
    comp = none

    def joined(comp: DataFrame, links: DataFrame) -> DataFrame:
        out = settle(components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(links)))
        release(comp)
        return out

    def placed(rows: DataFrame) -> DataFrame:
        at = comp.select(F.col("node").alias("rep"), F.col("component").alias("comp"))
        return rows.join(at, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))

    def apart(rows: DataFrame) -> DataFrame:
        """Rows of the buckets that still have more than one component."""
        keys = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        return rows.join(keys.where("lo < hi").select("key"), "key")

    for lo, hi in HUB_ROUNDS:
        rows = placed(crowd.where(F.col("band").between(lo, hi - 1)))
        hub = rows.groupBy("key").agg(
            F.min_by(F.struct("rep", "comp", "n_shingles"), F.struct(F.xxhash64("rep", "key"), "rep")).alias("hub")
        )
        pairs = (
            rows.join(hub, "key")
            .where(f"comp != hub.comp and 100 * least(n_shingles, hub.n_shingles) >= {percent} * greatest(n_shingles, hub.n_shingles)")
            .select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b"))
            .distinct()
        )
        comp = joined(comp, _links(pairs, texts, percent))

    rest = settle(apart(placed(crowd)))
    # Only buckets of several blocks are looked up; their keys meet the rows in SALTS places each.
    count = rest.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    count = count.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = (
        rest.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
        .join(count, ["key", "salt"], "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("own", F.pmod(F.hash("rep"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "comp")
    )
    sets = texts.join(rest.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(
        _sets, "rep long, sign binary, bands binary, items binary"
    )
    sets = settle(sets)
    found = settle(
        spread.join(sets, "rep")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
        .mapInArrow(_block_links(percent), "a long, b long")
    )
    release(crowd, texts, rest, sets)
    comp = joined(comp, found)
    comp = member.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    comp = comp.groupBy("doc_id").agg(F.min("component").alias("component"))
    return signed.select("doc_id", "n_shingles").join(comp, "doc_id", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
