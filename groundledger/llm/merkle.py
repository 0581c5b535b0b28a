"""Merkle manifest of a dataset by incremental witnesses.

Leaves stand in a binary tree for each group, in order; a last node without a
partner is hashed alone. The groups' roots, ordered by group, are the leaves of the
tree above. A leaf's witness is the list of its siblings from the bottom to the
top, by which its root is found again from the leaf alone.

Leaves are dealt out by ranges of group and order, which gives each its position
without a task that sees a whole group. A task then appends aligned blocks of
2 ** BLOCK_BITS leaves, one leaf after another: the open subtrees keep the partial
witnesses of their leaves, and a subtree that meets its finished sibling extends
the witnesses on both sides. The blocks' roots are further appends of the same
kind, block by block, until each group has one root, and so are the groups' roots.
So a task holds one block, and the tables above shrink by the block's size.

Digests are SHA-256 of the parts' lower-case hexadecimal text; tables hold them as
32 bytes.

Defined cases: a null group is a group of its own and the first; null orders come
first; equal orders stand by leaf, so equal rows get their places in any order and
the roots are the same; no rows give no rows; a group of one leaf has that leaf as
its root; texts are hashed whole; other columns are carried as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StructField, StructType

from .storage import release, settle

BLOCK_BITS = 10
_INDEX = (1 << 33) - 1


def encoded(*columns: str) -> Column:
    """The values after their lengths in UTF-8 bytes, one after another; a null is a dash."""
    texts = [F.col(c).cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _above(*digests: bytes) -> bytes:
    return sha256(b"".join(d.hex().encode() for d in digests)).digest()


class OpenSubtrees:
    """The subtrees of a stream of appended nodes that wait for their siblings, the largest first."""

    def __init__(self) -> None:
        self.open: list[tuple[int, bytes, list[list[bytes | None]]]] = []

    def append(self, digest: bytes) -> list[bytes | None]:
        """The witness of the new node, which later appends extend."""
        witness: list[bytes | None] = []
        height, members = 0, [witness]
        while self.open and self.open[-1][0] == height:
            height, digest, members = self._joined(digest, members)
        self.open.append((height, digest, members))
        return witness

    def _joined(self, digest: bytes, members: list[list[bytes | None]]) -> tuple[int, bytes, list[list[bytes | None]]]:
        height, left, first = self.open.pop()
        for witness in first:
            witness.append(digest)
        for witness in members:
            witness.append(left)
        return height + 1, _above(left, digest), first + members

    def close(self, height: int) -> bytes:
        """The root at the given height; nodes without a partner are hashed alone."""
        at, digest, members = self.open.pop()
        while at < height:
            if self.open and self.open[-1][0] == at:
                at, digest, members = self._joined(digest, members)
            else:
                for witness in members:
                    witness.append(None)
                at, digest = at + 1, _above(digest)
        return digest


def _append_blocks(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (grp, pos, total, leaf, row) come block by block in order; adds the witness and, to a block's first row, its root."""
    trees, many, grown, rest = OpenSubtrees(), 0, [], []

    def closed(height: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(rest).combine_chunks()
        roots = [trees.close(height), *[None] * (many - 1)]
        columns = {c: table.column(c) for c in table.column_names}
        columns["witness"] = pa.array(grown, pa.list_(pa.binary()))
        columns["block_root"] = pa.array(roots, pa.binary())
        return pa.Table.from_pydict(columns).combine_chunks().to_batches()[0]

    for batch in batches:
        done = 0
        leaves = batch.column("leaf").to_pylist()
        for k, (pos, total) in enumerate(zip(batch.column("pos").to_pylist(), batch.column("total").to_pylist(), strict=True)):
            grown.append(trees.append(leaves[k]))
            many += 1
            if (pos + 1) % (1 << bits) == 0 or pos + 1 == total:
                rest.append(batch.slice(done, k + 1 - done))
                yield closed(min(bits, (total - 1).bit_length()))
                trees, many, grown, rest, done = OpenSubtrees(), 0, [], [], k + 1
        if done < batch.num_rows:
            rest.append(batch.slice(done))


def _placed(leaves: DataFrame) -> DataFrame:
    """Adds pos, the place of a leaf in its group, and total, the group's leaves."""
    order = ["grp", "ord", "leaf", "salt"]
    salted = settle(leaves.withColumn("salt", F.monotonically_increasing_id()))
    # After the sort the id is the task's number above the row's number in it.
    dealt = settle(salted.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt").withColumn("id", F.monotonically_increasing_id()))
    release(salted)
    dealt = dealt.withColumns({"task": F.shiftright("id", 33), "nth": F.col("id").bitwiseAND(F.lit(_INDEX))})
    runs = dealt.groupBy("task", "grp").agg(F.min("nth").alias("first"), F.count("*").alias("many"))
    # One row for each task and group: as many as tasks, not as leaves.
    group = Window.partitionBy("grp")
    upto = F.sum("many").over(group.orderBy("task").rowsBetween(Window.unboundedPreceding, 0))
    runs = runs.select(
        F.col("task").alias("of"), F.col("grp").alias("of_grp"), (upto - F.col("many") - F.col("first")).alias("shift"), F.sum("many").over(group).alias("total")
    )
    joined = dealt.join(settle(runs), F.col("task").eqNullSafe(F.col("of")) & F.col("grp").eqNullSafe(F.col("of_grp")))
    return joined.select("grp", (F.col("nth") + F.col("shift")).alias("pos"), "total", "leaf", "row")


def _grown(nodes: DataFrame, bits: int) -> DataFrame:
    """(grp, pos, leaf, row, witness, top) of placed nodes: the witness up to the group's root, and that root."""
    added = [StructField("witness", ArrayType(BinaryType())), StructField("block_root", BinaryType())]
    schema = StructType([*nodes.schema.fields, *added])
    block = F.shiftright("pos", bits)
    blocks = nodes.repartition("grp", block).sortWithinPartitions("grp", "pos")
    grown = settle(blocks.mapInArrow(lambda batches: _append_blocks(batches, bits), schema))
    roots = grown.where("block_root is not null").select(
        "grp",
        block.alias("pos"),
        F.shiftright(F.col("total") + ((1 << bits) - 1), bits).alias("total"),
        F.col("block_root").alias("leaf"),
        F.struct(F.lit(0).alias("none")).alias("row"),
    )
    if roots.where("total > 1").isEmpty():
        above = roots.select("grp", "pos", F.array().cast("array<binary>").alias("witness"), F.col("leaf").alias("top"))
    else:
        above = _grown(roots, bits)
    above = settle(above.select(F.col("grp").alias("of_grp"), F.col("pos").alias("of"), F.col("witness").alias("further"), "top"))
    joined = grown.join(above, F.col("grp").eqNullSafe(F.col("of_grp")) & (block == F.col("of")))
    return joined.select("grp", "pos", "leaf", "row", F.concat("witness", "further").alias("witness"), "top")


def _sided(witness: Column, pos: Column) -> Column:
    """The siblings with their side; the bits of the position are the sides from the bottom up."""
    return F.transform(witness, lambda w, k: F.struct(w.alias("digest"), (F.call_function("getbit", pos, k) == 1).alias("left")))


def merkle_manifest(rows: DataFrame, group: Column, order: Column, leaf: Column, bits: int = BLOCK_BITS) -> DataFrame:
    """(row, pos, leaf, witness, subroot, root) of every row.

    row holds the columns of rows, pos the place in the group. The argument leaf is a
    digest in hexadecimal text; leaf, subroot and root of the result have 32 bytes.
    witness holds (digest, left) from the bottom to the root: the sibling and whether
    it stands to the left, or a null digest where there is none.
    """
    leaves = rows.select(group.alias("grp"), order.alias("ord"), F.unhex(leaf).alias("leaf"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    grown = settle(_grown(_placed(leaves), bits))
    subroots = grown.where("pos = 0").select(F.lit(0).alias("grp"), F.col("grp").alias("ord"), F.col("top").alias("leaf"), F.struct("grp").alias("row"))
    top = _grown(_placed(subroots), bits)
    top = settle(top.select(F.col("row.grp").alias("of_grp"), _sided(F.col("witness"), F.col("pos")).alias("further"), F.col("top").alias("root")))
    joined = grown.join(top, F.col("grp").eqNullSafe(F.col("of_grp")))
    witness = F.concat(_sided(F.col("witness"), F.col("pos")), F.col("further"))
    return joined.select("row", "pos", "leaf", witness.alias("witness"), F.col("top").alias("subroot"), "root")


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def folded(leaf: Column, witness: Column) -> Column:
    """The root (hexadecimal text) that a leaf (the same) has by its witness."""

    def up(below: Column, step: Column) -> Column:
        beside = hexed(step["digest"])
        pair = F.when(step["digest"].isNull(), below).when(step["left"], F.concat(beside, below)).otherwise(F.concat(below, beside))
        return F.sha2(pair, 256)

    return F.aggregate(witness, leaf, up)


def proof_digest(witness: Column) -> Column:
    """Digest of the siblings, where there are any, from the bottom up."""
    return F.sha2(F.array_join(F.transform(F.filter(witness, lambda w: w["digest"].isNotNull()), lambda w: hexed(w["digest"])), ""), 256)
