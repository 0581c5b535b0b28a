"""Nearest vectors by cosine: exactly, and by an inverted file of cells, within a scope.

A scope (columns that vector and search must agree on, such as a model version and a
jurisdiction) holds before the search: vectors outside it are no candidates, so a full
list comes back wherever the scope has one.

The index has the cells of centroids that are fitted on SAMPLE vectors, those of the
smallest hashes of their ids, and holds every vector. A search looks into the PROBES
nearest cells, and what it finds there is ranked by the exact similarity. Searches
whose cells hold less than a full list are made again over all vectors of their scope.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settle

#: Vectors that centroids are fitted on, most cells, cells that a search looks into, searches compared together, and vectors compared with them at a time.
SAMPLE, MOST_CELLS, PROBES, BLOCK, SLAB = 20_000, 4096, 8, 2048, 1024
#: Decimals of a similarity that count: products of equal vectors may differ in their last bits by where they stand in a matrix.
DECIMALS = 12


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of length one; a vector of zeros stays."""
    flat = pc.fill_null(column.flatten(), 0.0).to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1.0)


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The k most similar of each search, of equals the smallest id; ranked in each task before the shuffle."""
    order = Window.partitionBy("search").orderBy(F.desc("similarity"), "id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def nearest(vectors: DataFrame, searches: DataFrame, k: int, scope: list[str]) -> DataFrame:
    """(search, id, similarity, place): the k nearest of vectors(id, vector, scope) to each of searches(search, wanted, scope), itself left out.

    All vectors are compared, with the searches in blocks of BLOCK: a task holds one
    block, SLAB vectors and the k nearest so far, whatever the tables' sizes; vectors
    and searches of other scopes never meet.
    """
    spark = vectors.sparkSession
    asked = settle(searches.select("search", F.col("wanted").cast("array<double>").alias("wanted"), F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("\1")) for c in scope]).alias("scope")))
    many = asked.count()
    blocks = max(1, math.ceil(many / BLOCK))
    known = vectors.select("id", F.col("vector").cast("array<double>").alias("vector"), F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("\1")) for c in scope]).alias("scope")).where("size(vector) > 0")
    out = None
    for block in range(blocks):
        rows = asked.where((F.pmod(F.xxhash64("search"), F.lit(blocks)) == block) & (F.size("wanted") > 0)).collect()
        shared = spark.sparkContext.broadcast((np.array([r.search for r in rows], np.int64), _matrix(pa.array([r.wanted for r in rows], pa.list_(pa.float64()))), np.array([r.scope for r in rows], object)))

        def compare(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search, wanted, within = shared.value
            asked_in = {scope: np.flatnonzero(within == scope) for scope in set(within)}
            best: dict[str, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                for start in range(0, batch.num_rows, SLAB):
                    slab = batch.slice(start, SLAB)
                    ids, own, rows = slab.column("id").to_numpy(), np.array(slab.column("scope").to_pylist(), object), _matrix(slab.column("vector"))
                    for scope in asked_in.keys() & set(own):
                        mine, column = np.flatnonzero(own == scope), asked_in[scope]
                        like = np.round(rows[mine] @ wanted[column].T, DECIMALS)
                        like[ids[mine, None] == search[None, column]] = -np.inf
                        both = like, np.broadcast_to(ids[mine, None], like.shape)
                        if scope in best:
                            both = tuple(np.vstack(x) for x in zip(best[scope], both, strict=True))
                        # Of equally similar ones the smallest ids count, so ties are not cut off by chance.
                        order = np.lexsort((both[1], -both[0]), axis=0)[:k]
                        best[scope] = tuple(np.take_along_axis(x, order, 0) for x in both)
            for scope, (like, ids) in best.items():
                some = np.isfinite(like)
                found = np.broadcast_to(search[asked_in[scope]], like.shape)
                yield pa.RecordBatch.from_arrays([pa.array(found[some]), pa.array(ids[some]), pa.array(like[some])], ["search", "id", "similarity"])

        part = known.mapInArrow(compare, "search long, id long, similarity double")
        out = part if out is None else out.unionAll(part)
    return _best(out, k)


def fit_cells(vectors: DataFrame, cells: int, sample: int = SAMPLE) -> np.ndarray:
    """Centroids of length one of vectors(id, vector), fitted on a bounded sample."""
    some = vectors.where("size(vector) > 0").orderBy(F.xxhash64("id"), "id").limit(sample).select("id", F.col("vector").cast("array<double>").alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = some.select(array_to_vector(F.transform("v", lambda x: F.coalesce(F.try_divide(x, length), F.lit(0.0)))).alias("features"))
    model = KMeans(k=cells, seed=1, maxIter=12).fit(settle(unit.coalesce(1)))
    return _matrix(pa.array([c.tolist() for c in model.clusterCenters()], pa.list_(pa.float64())))


def _with_cells(column: str, centroids: np.ndarray, many: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the numbers of the nearest cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            like = _matrix(batch.column(column)) @ centroids.T if batch.num_rows else np.zeros((0, len(centroids)))
            near = np.argsort(-like, axis=1, kind="stable")[:, :many]
            cells = pa.array(near.tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], [*batch.schema.names, "cells"])

    return run


def cell_index(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vectors(id, vector, ...) with their cell, settled: every vector is in it."""
    rows = vectors.withColumn("vector", F.col("vector").cast("array<double>")).where("size(vector) > 0")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", cells array<int>"
    return settle(rows.mapInArrow(_with_cells("vector", centroids, 1), schema).withColumn("cell", F.get("cells", F.lit(0))).drop("cells"))


def indexed_nearest(index: DataFrame, centroids: np.ndarray, searches: DataFrame, k: int, scope: list[str], probes: int = PROBES) -> DataFrame:
    """What nearest() gives, from the cells nearest to each search; a list that stays short is made from all vectors."""
    asked = searches.select("search", F.col("wanted").cast("array<double>").alias("wanted"), *scope).where("size(wanted) > 0")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema) + ", cells array<int>"
    asked = settle(asked.mapInArrow(_with_cells("wanted", centroids, probes), schema))
    probed = asked.withColumn("cell", F.explode("cells")).select("search", "wanted", "cell", *[F.col(c).alias(f"asked_{c}") for c in scope])
    within = F.lit(True)
    for c in scope:
        within = within & F.col(c).eqNullSafe(F.col(f"asked_{c}"))
    pairs = index.join(probed, "cell").where(within & (F.col("id") != F.col("search")))
    dot = F.aggregate(F.zip_with("vector", "wanted", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    size = [F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)) for v in ("vector", "wanted")]
    like = F.coalesce(F.try_divide(dot, size[0] * size[1]), F.lit(0.0))
    found = settle(_best(pairs.select("search", "id", like.alias("similarity")), k))
    full = found.groupBy("search").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = settle(asked.join(full, "search", "left_anti").select("search", "wanted", *scope))
    again = nearest(index, short, k, scope)
    return found.join(full.select("search"), "search", "left_semi").unionByName(again)


def cells_for(many: int) -> int:
    """As many cells as a cell has vectors, MOST_CELLS at most."""
    return max(1, min(MOST_CELLS, math.isqrt(many)))
