"""Registry of the land-record queries: Spark plan and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function (spark, folder) under its name, with its SQL if it has one."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def FLAGSHIP(spark: SparkSession, folder: str) -> DataFrame:  # noqa: N802
    return QUERIES["a13_progress_by_location"](spark, folder)


from . import aggregates, composites, extraction, land_boards, land_extra, land_ground, land_more, land_pages, land_rules, land_security, land_text, pages, relational, texts  # noqa: E402, F401
