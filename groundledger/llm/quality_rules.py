"""Quality rules: robust multivariate outliers of text statistics.

Per language and source a minimum-covariance-determinant estimate of location
and scatter is found by concentration steps from three starts: medians and
absolute deviations, all rows, and a random half of them. A step takes the mean
and covariance of the three quarters of rows nearest by Mahalanobis distance;
steps end when no determinant changes any more, and the start with the least one
wins. A last step reweights by the rows within the 97.5 % quantile. Distances
are cut by a histogram, whose last bin counts in part, so a step is one grouped
aggregate with partial sums, whatever the size of a group.

Estimates exist for all rows, every language and every language and source; each
is drawn to the one above it as by PRIOR_ROWS further rows, at every size: a
group of a few rows has nearly its language's estimate, a large one its own.
Standard deviations below FLOORS count as FLOORS, as most documents have no
repeated line. Rows beyond CUTOFF, or failing a base rule, are not kept.

Defined cases: null and empty texts have zero words, fail the base rules and
don't enter estimates; null languages or sources are groups of their own;
repeated rows count as often as they occur; texts of any length count whole;
other columns are not read.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import release, settle
from .words import find_words, ngrams, parts

FEATURES = ("f0", "f1", "f2", "f3", "f4")
P = len(FEATURES)
STARTS = 3
#: Concentration steps at most; a group's end when its log-determinant changes by less than TOLERANCE. What still moves then counts as it is, with a warning.
STEPS, TOLERANCE = 30, 1e-3
SHARE = 0.75
#: Rows that the estimate of the language (of all rows, for a language) counts for.
PRIOR_ROWS = 50
#: 97.5 % quantile of chi-square with five degrees of freedom.
CHI2_975 = 12.8325
#: Squared distance of a rejected row: the quantile of 1 - 1e-6.
CUTOFF = 35.888
#: Least standard deviations.
FLOORS = (0.25, 0.05, 0.03, 0.08, 0.08)
#: Corrections that make the scatter of the nearest 75 % and 97.5 % consistent at the normal.
CONSISTENT, CONSISTENT_975 = 0.75 / 0.5310, 0.975 / 0.9239
#: Bins of a unit of a statistic, for medians.
GRID = 200
#: Estimates (of some 500 bytes) that are handed to every task; more are joined by a shuffle.
MOST_SHARED = 20_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts(batches):
        words = find_words(part.column("text"), lower=False)
        n = part.num_rows
        count = np.diff(words.off)
        letters = (words.data & 0xC0) != 0x80
        inside = np.concatenate([[0], np.cumsum(letters)])
        chars = np.concatenate([[0], np.cumsum(inside[words.end] - inside[words.start])])
        symbols = np.concatenate([[0], np.cumsum(_SYMBOL[words.data])])

        window, whole = ngrams(words, 3)
        at = np.flatnonzero(whole)
        row = words.row
        order = np.lexsort((window[at], row[at]))
        at = at[order]
        same = np.zeros(len(at) + 1, bool)
        same[1:-1] = (window[at[1:]] == window[at[:-1]]) & (row[at[1:]] == row[at[:-1]])
        again = at[same[1:] | same[:-1]]
        covered = np.zeros(len(row) + 3, bool)
        for k in range(3):
            covered[again + k] = True
        repeated = np.bincount(row[covered[: len(row)]], minlength=n)

        dup_lines = np.zeros(n, np.int64)
        for k, text in enumerate(part.column("text").to_pylist()):
            lines = [x for x in (text or "").encode().split(b"\n") if x.strip()]
            dup_lines[k] = len(lines) - len(set(lines))
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id").cast(pa.int64()),
                part.column("lang").cast(pa.string()),
                part.column("source").cast(pa.string()),
                pa.array(count, pa.int64()),
                pa.array(chars[words.off[1:]] - chars[words.off[:-1]], pa.int64()),
                pa.array(symbols[words.at[1:]] - symbols[words.at[:-1]], pa.int64()),
                pa.array(dup_lines),
                pa.array(repeated, pa.int64()),
                pa.array([(x or "").count("\n") + 1 for x in part.column("text").to_pylist()], pa.int64()),
            ],
            ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"],
        )


def _transformed() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p("n_words").alias("f0"),
        F.log1p(F.col("word_chars") / words).alias("f1"),
        F.sqrt(F.col("n_symbols") / (F.col("word_chars") + 1)).alias("f2"),
        F.sqrt(F.col("n_dup_lines") / F.col("n_lines")).alias("f3"),
        F.sqrt(F.col("n_repeat_words") / words).alias("f4"),
    ]


def _distance() -> Column:
    """Squared Mahalanobis distance from the columns mean and inv (row by row)."""
    gap = [F.col(f) - F.col("mean")[k] for k, f in enumerate(FEATURES)]
    return sum((gap[i] * gap[j] * F.col("inv")[P * i + j] for i in range(P) for j in range(P)), F.lit(0.0))


def floored(cov: np.ndarray) -> np.ndarray:
    """The scatter with all variances raised to those of FLOORS, in every direction."""
    unit = np.outer(FLOORS, FLOORS)
    value, vector = np.linalg.eigh(cov / unit)
    return (vector * np.maximum(value, 1.0)) @ vector.T * unit


def _beside(rows: DataFrame, few: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """The rows with the estimate of their group; a hot group's rows stay where they are while there are few estimates."""
    return rows.join(F.broadcast(few) if few.count() <= MOST_SHARED else few, on, how)


def _estimates(sums: DataFrame, scale: float) -> DataFrame:
    """(grp, start, n, mean, cov, inv, det) from one row of sums for each group and start; det is a logarithm."""

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for grp, start, n, first, second in frame[["grp", "start", "n", "first", "second"]].itertuples(index=False):
                mean = np.asarray(first) / n
                cov = (np.asarray(second).reshape(P, P) / n - np.outer(mean, mean)) * scale
                fit = floored(cov)
                out.append((grp, start, n, mean.tolist(), cov.reshape(-1).tolist(), np.linalg.inv(fit).reshape(-1).tolist(), np.linalg.slogdet(fit)[1]))
            yield pd.DataFrame(out, columns=["grp", "start", "n", "mean", "cov", "inv", "det"])

    return sums.mapInPandas(solve, "grp string, start int, n double, mean array<double>, cov array<double>, inv array<double>, det double")


def _sums() -> list[Column]:
    first = [F.sum(f).alias(f"a{k}") for k, f in enumerate(FEATURES)]
    second = [F.sum(F.col(f) * F.col(g)).alias(f"b{P * i + j}") for i, f in enumerate(FEATURES) for j, g in enumerate(FEATURES)]
    return [F.count("*").alias("n"), *first, *second]


def _arrays(count: Column, part: Column) -> list[Column]:
    """Sums of the partial sums, each times `part`."""
    return [
        F.sum(count * part).alias("n"),
        F.array(*[F.sum(F.col(f"a{k}") * part) for k in range(P)]).alias("first"),
        F.array(*[F.sum(F.col(f"b{k}") * part) for k in range(P * P)]).alias("second"),
    ]


def _medians(rows: DataFrame, value: list[Column]) -> DataFrame:
    """(grp, m0..m4): medians from histograms, right to a bin."""
    cells = rows.select("grp", F.posexplode(F.array(*[F.floor(v * GRID).cast("int") for v in value])).alias("k", "bin"))
    cells = cells.groupBy("grp", "k", "bin").agg(F.count("*").alias("n"))
    own = Window.partitionBy("grp", "k")
    upto = F.sum("n").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    half = cells.withColumn("upto", upto).withColumn("all", F.sum("n").over(own)).where("2 * upto >= all")
    middle = [F.min(F.when(F.col("k") == k, (F.col("bin") + 0.5) / GRID)).alias(f"m{k}") for k in range(P)]
    return half.groupBy("grp").agg(*middle)


def _starts(rows: DataFrame) -> DataFrame:
    """(grp, start, mean, inv, det) before the first step."""
    mid = settle(_medians(rows, [F.col(f) for f in FEATURES]))
    away = _beside(rows, mid, "grp").select("grp", *[F.abs(F.col(f) - F.col(f"m{k}")).alias(f) for k, f in enumerate(FEATURES)])
    dev = _medians(away, [F.col(f) for f in FEATURES]).select("grp", *[F.col(f"m{k}").alias(f"s{k}") for k in range(P)])
    spread = [F.greatest(F.lit(FLOORS[k]), 1.4826 * F.col(f"s{k}")) for k in range(P)]
    inv = [1 / (spread[i] * spread[i]) if i == j else F.lit(0.0) for i in range(P) for j in range(P)]
    first = mid.join(dev, "grp").select(
        "grp", F.lit(0).alias("start"), F.array(*[F.col(f"m{k}") for k in range(P)]).alias("mean"), F.array(*inv).alias("inv"), F.lit(1e9).alias("det")
    )
    draw = F.pmod(F.xxhash64(*FEATURES), F.lit(2))
    some = rows.select("*", F.explode(F.when(draw == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("start"))
    some = some.groupBy("grp", "start").agg(*_sums()).groupBy("grp", "start").agg(*_arrays(F.col("n"), F.lit(1.0)))
    return first.unionByName(_estimates(some, 1.0).select(*first.columns))


def _nearest(bins: DataFrame) -> DataFrame:
    """Sums over the nearest SHARE of each group's rows; of the bin that the share ends in, a part.

    A group has at most some hundred bins, however many rows it has.
    """
    own = Window.partitionBy("grp", "start")
    upto = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    inner = bins.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn("all", F.sum("n").over(own))
    inner = inner.where(F.col("before") < SHARE * F.col("all"))
    part = F.least(F.lit(1.0), (SHARE * F.col("all") - F.col("before")) / F.col("n"))
    return inner.groupBy("grp", "start").agg(*_arrays(F.col("n"), part))


def robust_estimates(rows: DataFrame) -> DataFrame:
    """(grp, n, mean, cov) of rows(grp, f0..f4): reweighted minimum covariance determinant."""
    fit = settle(_starts(rows))
    near = F.floor(16 * F.log2(_distance() + F.lit(1e-12))).cast("int")
    ended: list[DataFrame] = []
    for _ in range(STEPS):
        # Only the rows of groups that still move are looked at.
        placed = _beside(rows, fit, "grp").withColumn("bin", near)
        new = _estimates(_nearest(placed.groupBy("grp", "start", "bin").agg(*_sums())), CONSISTENT)
        old = fit.select("grp", "start", F.col("det").alias("old"))
        new = settle(new.join(old, ["grp", "start"]).withColumn("moves", F.abs(F.col("det") - F.col("old")) >= TOLERANCE).drop("old"))
        release(fit)
        ended.append(new.where("not moves").drop("moves"))
        fit = new.where("moves").drop("moves")
        if fit.isEmpty():
            break
    else:
        warnings.warn(f"{fit.count()} starts of groups still moved after {STEPS} steps", stacklevel=2)
        ended.append(fit)
    fit = ended[0]
    for more in ended[1:]:
        fit = fit.unionByName(more)
    best = fit.groupBy("grp").agg(F.min_by(F.struct("mean", "inv"), F.struct("det", "start")).alias("x")).select("grp", "x.*")
    inner = _beside(rows, settle(best), "grp").where(_distance() <= CHI2_975).withColumn("start", F.lit(0))
    sums = inner.groupBy("grp", "start").agg(*_sums()).groupBy("grp", "start").agg(*_arrays(F.col("n"), F.lit(1.0)))
    return settle(_estimates(sums, CONSISTENT_975).select("grp", "n", "mean", "cov"))


def _drawn(own: DataFrame, above: DataFrame) -> DataFrame:
    """Estimates own(grp, above, n, mean, cov) drawn to those above(above, mean, cov) as by PRIOR_ROWS rows."""

    def both(name: str) -> Column:
        return F.transform(F.arrays_zip(name, f"{name}_above"), lambda x: (F.col("n") * x[name] + PRIOR_ROWS * x[f"{name}_above"]) / (F.col("n") + PRIOR_ROWS)).alias(name)

    up = above.select(F.col("grp").alias("above"), F.col("mean").alias("mean_above"), F.col("cov").alias("cov_above"))
    return own.join(up, "above").select("grp", "n", both("mean"), both("cov"))


def _inverted(fits: DataFrame) -> DataFrame:
    """(grp, mean, inv) of the floored scatters."""

    def invert(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            inv = [np.linalg.inv(floored(np.asarray(c).reshape(P, P))).reshape(-1).tolist() for c in frame["cov"]]
            yield pd.DataFrame({"grp": frame["grp"], "mean": frame["mean"], "inv": inv})

    return fits.mapInPandas(invert, "grp string, mean array<double>, inv array<double>")


def quality_rules(documents: DataFrame) -> DataFrame:
    """Statistics and verdict of every row of documents(doc_id, text, lang, source)."""
    stats = settle(
        documents.select("doc_id", "lang", "source", "text").mapInArrow(
            _statistics,
            "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, "
            "n_dup_lines long, n_repeat_words long, n_lines long",
        )
    )
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for c in ("lang", "source"))
    # Names of the three levels begin with their number, so they never meet.
    level = [F.lit("0"), F.concat(F.lit("1"), lang), F.concat(F.lit("2"), lang, F.lit("\x01"), source)]
    rows = stats.select("*", *_transformed(), *[n.alias(f"grp{k}") for k, n in enumerate(level)])
    sound = rows.where("n_words > 0")
    fit = robust_estimates(settle(sound.select(F.explode(F.array("grp0", "grp1", "grp2")).alias("grp"), *FEATURES)))
    top = fit.where("grp = '0'")
    langs = settle(_drawn(fit.where("grp like '1%'").withColumn("above", F.lit("0")), top))
    names = sound.select(F.col("grp2").alias("grp"), F.col("grp1").alias("above")).distinct()
    groups = settle(_inverted(_drawn(fit.where("grp like '2%'").join(names, "grp"), langs)))
    placed = _beside(rows, groups.withColumnRenamed("grp", "grp2"), "grp2", "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    distance = F.coalesce(_distance(), F.lit(0.0))
    return placed.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (distance <= CUTOFF)).alias("kept"),
        F.round(distance, 6).alias("distance"),
    )
