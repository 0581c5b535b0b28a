"""Closure of a self-referencing table, scopes over it, and roll-ups along it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import release, settle


def closure(nodes: DataFrame) -> DataFrame:
    """(id, ancestor, depth) of nodes(id, parent_id), each node its own ancestor at depth 0.

    Every round joins what is known with itself and so doubles the depth, until
    nothing is new; a tree of any depth takes its logarithm. On a cycle each
    ancestor counts once, at its least depth.
    """
    reach = settle(nodes.where("parent_id is not null and parent_id != id").select("id", F.col("parent_id").alias("ancestor"), F.lit(1).alias("depth")))
    step, known = 1, reach.count()
    while True:
        far = reach.where(F.col("depth") == step).select("id", F.col("ancestor").alias("middle"))
        more = far.join(reach.select(F.col("id").alias("middle"), "ancestor", (F.col("depth") + step).alias("depth")), "middle").where("id != ancestor")
        new = settle(reach.unionByName(more.select("id", "ancestor", "depth")).groupBy("id", "ancestor").agg(F.min("depth").alias("depth")))
        step, before, known = 2 * step, known, new.count()
        release(reach)
        reach = new
        if known == before:
            break
    return nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth")).unionByName(reach)


def descendants(closed: DataFrame, root: str) -> DataFrame:
    """Ids at or below the root."""
    return closed.where(F.col("ancestor") == root).select("id")


def in_scope(rows: DataFrame, scope: DataFrame | None, columns: list[str]) -> DataFrame:
    """Rows whose location columns are all null or in scope, and one of which is not null.

    scope(id) is the allowed set; an empty one allows nothing, None everything.
    """
    if scope is None:
        return rows
    any_ = reduce(Column.__or__, [F.col(c).isNotNull() for c in columns])
    out = rows.where(any_)
    for c in columns:
        ok = out.where(F.col(c).isNotNull()).join(scope.select(F.col("id").alias(c)), c, "left_semi").select(*rows.columns)
        out = out.where(F.col(c).isNull()).unionByName(ok)
    return out


def rolled_up(facts: DataFrame, closed: DataFrame, key: str, measures: list[Column]) -> DataFrame:
    """Measures of facts(key) credited to the key's node and all of its ancestors."""
    return facts.join(closed, F.col(key) == F.col("id")).groupBy("ancestor").agg(*measures)
