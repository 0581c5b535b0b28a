"""Isolation forest: outlier scores from the depth at which random splits isolate a row.

The trees are grown on the driver from a sample of at most TREES * DRAWN rows,
taken in the order of a hash of the key, so reruns agree; they are a few
thousand numbers. All rows are scored in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Number of trees, rows drawn for each, least corpus, share of outliers, least reported score, seed.
TREES, DRAWN, LEAST, OUTLIERS, REPORTED, SEED = 100, 256, 30, 0.05, 0.55, 42


def usual_depth(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A tree as rows (feature or -1, cut, left, right, depth at a leaf)."""
    most = int(np.ceil(np.log2(max(len(rows), 2))))
    nodes: list[list[float]] = [[]]
    todo = [(0, rows, 0)]
    while todo:
        at, own, depth = todo.pop()
        low, high = own.min(axis=0), own.max(axis=0)
        open_ = np.flatnonzero(high > low)
        if depth >= most or len(own) < 2 or not len(open_):
            nodes[at] = [-1, 0.0, at, at, depth + float(usual_depth(len(own)))]
            continue
        feature = int(rng.choice(open_))
        cut = rng.uniform(low[feature], high[feature])
        left = own[:, feature] <= cut
        nodes[at] = [feature, cut, len(nodes), len(nodes) + 1, 0.0]
        todo += [(len(nodes), own[left], depth + 1), (len(nodes) + 1, own[~left], depth + 1)]
        nodes += [[], []]
    return np.array(nodes)


def depth(tree: np.ndarray, rows: np.ndarray) -> np.ndarray:
    at = np.zeros(len(rows), int)
    while (inner := np.flatnonzero(tree[at, 0] >= 0)).size:
        node = tree[at[inner]]
        left = rows[inner, node[:, 0].astype(int)] <= node[:, 1]
        at[inner] = np.where(left, node[:, 2], node[:, 3]).astype(int)
    return tree[at, 4]


def isolation_scores(rows: DataFrame, key: str, features: list[str], reported: float = REPORTED) -> DataFrame:
    """(key, score) of the rows at least that unusual; none if there are fewer than LEAST. Null features count as 0."""
    spark = rows.sparkSession
    rows = rows.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    sample = rows.orderBy(F.xxhash64(key), key).limit(TREES * DRAWN).select(*features).toPandas().to_numpy(float)
    if len(sample) < LEAST:
        return rows.select(key, F.lit(0.0).alias("score")).where("false")
    rng = np.random.default_rng(SEED)
    size = min(DRAWN, len(sample))
    trees = spark.sparkContext.broadcast([grow(sample[rng.choice(len(sample), size, replace=False)], rng) for _ in range(TREES)])
    usual = float(usual_depth(size))

    def unusual(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            matrix = frame[features].to_numpy(float)
            mean = sum(depth(t, matrix) for t in trees.value) / TREES
            yield pd.DataFrame({key: frame[key], "_unusual": 2.0 ** (-mean / usual)})

    kind = rows.schema[key].dataType.simpleString()
    scored = rows.mapInPandas(unusual, f"{key} {kind}, _unusual double")
    # The cut leaves a twentieth of all rows above it; its error in rank is a ten-thousandth.
    cut = scored.agg(F.percentile_approx("_unusual", 1 - OUTLIERS, 10_000)).first()[0]
    score = F.least(F.greatest(0.5 + F.col("_unusual") - F.lit(cut), F.lit(0.0)), F.lit(1.0))
    return scored.select(key, score.alias("score")).where(F.col("score") >= reported)
