"""The library's functions by name in SQL: columns, task functions, grouped aggregates and table functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .labels import likeness_of
from .transliteration import romanised
from .values import folded, nfc, ngram_vector

KINDS = ("scalar", "aggregate", "table")


def _fused(value: pd.Series, weight: pd.Series) -> float:
    """The weighted mean of the values that are there; 0 without any."""
    some = value.notna() & weight.notna()
    total = weight[some].sum()
    return float((value[some] * weight[some]).sum() / total) if total else 0.0


class _ShareParts:
    """Rows (nth, numerator, denominator) of a list of shares such as "1/2, 1/4"."""

    def eval(self, shares: str):
        for nth, share in enumerate(x for x in (shares or "").split(",") if x.strip()):
            num, _, den = (x.strip() for x in share.partition("/"))
            if num.isdigit() and (den.isdigit() or not den) and int(den or 1):
                yield nth, int(num), int(den or 1)


def register(spark: SparkSession, name: str, function: Callable, kind: str = "scalar") -> None:
    """Makes a function of a kind callable in SQL under the name; an unknown kind is refused."""
    if kind not in KINDS:
        raise ValueError(f"{kind} is none of {', '.join(KINDS)}")
    if kind == "table":
        spark.udtf.register(name, function)
    else:
        spark.udf.register(name, function)


def register_all(spark: SparkSession) -> list[str]:
    """Registers what the library brings; returns the names."""
    latin = F.udf(lambda x: romanised(x) if x is not None else None, useArrow=True)
    fused = F.pandas_udf(_fused, DoubleType())
    parts = F.udtf(_ShareParts, returnType="nth int, numerator int, denominator int")
    own = {
        "gl_nfc": (nfc, "scalar"), "gl_folded": (folded, "scalar"), "gl_ngram_vector": (ngram_vector, "scalar"), "gl_likeness": (likeness_of, "scalar"),
        "gl_romanised": (latin, "scalar"), "gl_fused": (fused, "aggregate"), "gl_share_parts": (parts, "table"),
    }
    for name, (function, kind) in own.items():
        register(spark, name, function, kind)
    return list(own)
