"""Toxicity scores: gradient-boosted trees over dense features, calibrated isotonically.

Features of a text are densities per word: words of a lexicon learned from the
labelled sample (and its strongest window), the lexicon's words near a second
person, capitals, punctuation and obfuscated words. The lexicon holds the words
with the largest likelihood ratio between toxic and other labelled texts. The trees are
Spark ML's; each row that they learn from has features by a lexicon learned from the other
parts of the sample, so that its own words don't flatter it. A share of the sample that
neither sees calibrates the trees; the calibrated value is the score, and decides.

The classifier is fitted on at most SAMPLE labelled rows, taken in the order of a
hash of their ids; every document is scored, from its whole text.

Defined cases: null and empty texts have features of zero and are scored like
other texts; labels other than 0 and 1 are not used, and of contradicting labels
of an id the larger counts; if the sample lacks a class, every score is the
smoothed share of toxic labels; repeated rows are scored alike; texts of any
length are scored whole; other columns are carried, never read or replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import release, settle, shared_dir, unused

SAMPLE, LEXICON = 20_000, 1_000
TREES, DEPTH = 20, 3
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
#: Parts of the sample that take turns in being left out of the lexicon.
PARTS = 4
#: What ties of the calibrated score are broken by, at most.
TIE = 1e-6
FEATURES = 11
#: Lengths of the prefixes that may enter the lexicon, and words a task remembers.
STEM = (5, 6, 7, 8)
KNOWN_WORDS = 300_000
#: Words around a second person, and the span of the strongest window.
NEAR, SPAN = 6, 40
#: Pronouns of the second person in English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself youre u du dich dir dein deine ihr euch tu toi te ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: Characters commonly put for letters.
_PLAIN = str.maketrans("013457@$!", "oleastasi")
_EDGE = "".join(map(chr, (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)))) + "«»“”„’…¿¡"
_OBFUSCATED = re.compile(r"[^\W\d_]+[0-9@$!*]+[^\W\d_]|([^\W\d_])\1\1")


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def bare(word: str) -> str:
    """The lower-cased word without punctuation at its edges and with common substitutions undone."""
    word = word.lower().strip(_EDGE)
    return word.translate(_PLAIN) if not word.isalpha() and any(map(str.isalpha, word)) else word


def stems(word: str) -> list[str]:
    """The word, and its prefixes marked as such: other forms and compounds share them."""
    return [word, *(word[:k] + "*" for k in STEM if len(word) >= k)]


class Lexicon:
    """Weighted stems, with a bounded memory of the words met."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights
        self.known: dict[str, tuple[float, bool, bool]] = {}

    def look(self, word: str) -> tuple[float, bool, bool]:
        """Weight (0 if absent), whether it's a second person, whether it's obfuscated."""
        got = self.known.get(word)
        if got is None:
            plain = bare(word)
            weight = max((self.weights.get(x, 0.0) for x in stems(plain)), default=0.0)
            got = weight, plain in SECOND_PERSON, not word.isalpha() and bool(_OBFUSCATED.search(word))
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            self.known[word] = got
        return got


def features(text: str, lexicon: Lexicon) -> list[float]:
    raw = text.split()
    n = len(raw)
    if not n:
        return [0.0] * FEATURES
    look = lexicon.look
    found = [look(w) for w in raw]
    at = [k for k, x in enumerate(found) if x[0]]
    best = lo = 0
    for hi, k in enumerate(at):
        while k - at[lo] >= SPAN:
            lo += 1
        best = max(best, hi - lo + 1)
    close = 0
    if at and (second := [k for k, x in enumerate(found) if x[1]]):
        for k, p in zip(at, np.searchsorted(second, at).tolist(), strict=True):
            close += any(0 <= q < len(second) and abs(second[q] - k) <= NEAR for q in (p - 1, p))
    data = np.frombuffer(text.encode(), np.uint8)
    capitals = np.count_nonzero((data >= 65) & (data <= 90))
    letters = capitals + np.count_nonzero(((data >= 97) & (data <= 122)) | (data >= 192))
    weights = [found[k][0] for k in at]
    return [
        len(at) / n,
        sum(weights) / n,
        max(weights, default=0.0),
        float(best),
        math.log1p(len(at)),
        math.log1p(len({raw[k] for k in at})),
        close / n,
        capitals / max(letters, 1),
        (text.count("!") + text.count("?")) / n,
        sum(x[2] for x in found) / n,
        math.log1p(n),
    ]


def labelled_sample(labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(doc_id, toxic) of at most `most` labelled ids outside the held-out fold."""
    rows = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return rows.where(fold(F.col("doc_id")) != HELD_OUT).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def learn_lexicons(sample: DataFrame, size: int = LEXICON) -> list[dict[str, float]]:
    """The words of sample(text, toxic, part) with the largest likelihood ratio, and their smoothed log-odds.

    Lexicon p is learned from all parts but p, the last one from all.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[Counter(), Counter()] for _ in range(PARTS)]
            for text, toxic, part in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "part")), strict=True):
                found[part][toxic].update({x for w in set((text or "").split()) for x in stems(bare(w))})
            for part, (good, bad) in enumerate(found):
                rows = [(w, part, bad[w], good[w]) for w in {**bad, **good}]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
                        ["word", "part", "bad", "good"],
                    )

    total = sample.groupBy("part").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).collect()
    words = sample.select("text", "toxic", "part").mapInArrow(counts, "word string, part int, bad long, good long")
    words = words.where("length(word) > 1").groupBy("word", "part").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    words = settle(words.where(F.col("word").isNotNull()))
    out = []
    for left_out in range(PARTS + 1):
        n_bad, n_good = (sum(r[c] for r in total if r.part != left_out) for c in ("bad", "good"))
        own = words.where(F.col("part") != left_out).groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where("bad >= 3")
        odds = F.log((F.col("bad") + 0.1) / (n_bad + 0.2)) - F.log((F.col("good") + 0.1) / (n_good + 0.2))
        # Likelihood ratio against equal shares of both classes: frequent and pure words come first.
        all_, share = F.col("bad") + F.col("good"), n_bad / max(n_bad + n_good, 1)
        gain = F.col("bad") * F.log((F.col("bad") + 0.1) / (all_ * share)) + F.col("good") * F.log((F.col("good") + 0.1) / (all_ * (1 - share)))
        rows = own.select("word", odds.alias("odds"), gain.alias("gain")).where("odds > 1.5")
        out.append({r.word: r.odds for r in rows.orderBy(F.desc("gain"), "word").limit(size).collect()})
    release(words)
    return out


def with_features(rows: DataFrame, lexicon: dict[str, float], name: str = "features") -> DataFrame:
    """The rows of (..., text, ...) with an array of features as their last column."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value)
        for batch in batches:
            value = [features(x or "", lexicon) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value, pa.list_(pa.float64()))], [*batch.schema.names, name])

    return rows.mapInArrow(added, T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))


class ToxicityModel:
    """Lexicon, trees and calibration learned from documents(doc_id, text) and labels(doc_id, toxic)."""

    def __init__(self, documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> None:
        shared_dir(documents.sparkSession)
        sample = settle(labelled_sample(labels, most))
        # At most `most` ids, so the broadcast is bounded.
        texts = settle(documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))
        n, bad = texts.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        self.prior = (bad + 1) / (n + 2)
        self.lexicon: dict[str, float] = {}
        self.trees = None
        part = fold(F.col("doc_id")) == CALIBRATION
        fit_bad = texts.where(~part).agg(F.min("toxic"), F.max("toxic")).first()
        if tuple(fit_bad) != (0, 1):
            return
        texts = texts.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(PARTS)).cast("int"))
        *others, self.lexicon = learn_lexicons(texts.where(~part))
        rows = with_features(texts.where(part), self.lexicon)
        for left_out, lexicon in enumerate(others):
            rows = rows.unionAll(with_features(texts.where(~part & (F.col("part") == left_out)), lexicon))
        rows = settle(rows.select("doc_id", "toxic", "features"))
        rows = rows.withColumn("features", array_to_vector("features"))
        trees = GBTClassifier(labelCol="toxic", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, minInstancesPerNode=3)
        # The sample is bounded: one task in the order of ids adds up alike in every run.
        self.trees = trees.fit(rows.where(~part).repartition(1).sortWithinPartitions("doc_id"))
        seen = self._margin(rows.where(part)).select("margin", F.col("toxic").cast("double").alias("label"))
        both = seen.agg(F.min("label"), F.max("label")).first()
        self.calibration = None
        if tuple(both) == (0.0, 1.0):
            self.calibration = IsotonicRegression(featuresCol="margin", labelCol="label").fit(seen)

    def _margin(self, rows: DataFrame) -> DataFrame:
        scored = self.trees.transform(rows)
        return scored.withColumn("margin", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")

    def score(self, rows: DataFrame, name: str = "score") -> DataFrame:
        """The rows with a score column."""
        if self.trees is None:
            return rows.withColumn(name, F.lit(float(self.prior)))
        dense, vector, guess, chance, raw, margin, fitted = unused(rows, "dense", "vector", "guess", "chance", "raw", "margin", "fitted")
        model = self.trees.copy().setFeaturesCol(vector).setPredictionCol(guess).setProbabilityCol(chance).setRawPredictionCol(raw)
        out = with_features(rows, self.lexicon, dense).withColumn(vector, array_to_vector(dense))
        out = model.transform(out).withColumn(margin, vector_to_array(chance)[1])
        score = F.col(margin)
        if self.calibration is not None:
            out = self.calibration.copy().setFeaturesCol(margin).setPredictionCol(fitted).transform(out)
            # Ties keep the order of the trees' margin, without moving a score over one half.
            low = F.least(F.col(fitted) + TIE * F.col(margin), F.lit(0.5 - TIE / 2))
            score = F.when(F.col(fitted) < 0.5, low).otherwise(F.greatest(F.col(fitted) - TIE * (1 - F.col(margin)), F.lit(0.5)))
        return out.withColumn(name, F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))).select(*[F.col(f"`{c}`") for c in rows.columns], name)


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of documents(doc_id, text)."""
    model = ToxicityModel(documents, labels)
    out = model.score(documents.select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
