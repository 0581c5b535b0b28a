"""Corpus preparation in five stages, each a Spark job over all that the stage before kept.

Every stage takes (spark, docs, sf_dir), is written as Parquet to the shared
folder, and is read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundledger.llm.decontamination import without_contaminated
from groundledger.llm.mixing import mixed
from groundledger.llm.near_dedup import near_duplicates
from groundledger.llm.secret_scan import without_live_secrets
from groundledger.llm.storage import release, settle, table, unused
from groundledger.llm.toxicity import ToxicityModel


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated score is below one half; all of them where the labels teach nothing."""
    model = ToxicityModel(docs, table(spark, sf_dir, "labels"))
    if model.trees is None:
        return docs
    (score,) = unused(docs, "score")
    return model.score(docs, score).where(F.col(score) < 0.5).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest id; of its equal rows one."""
    gone, times = unused(docs, "gone", "times")
    ids = near_duplicates(docs).where("doc_id is not null").groupBy("doc_id")
    ids = ids.agg(F.bool_or(~F.col("kept")).alias(gone), F.count("*").alias(times)).where(f"`{gone}` or `{times}` > 1")
    marked = settle(docs.join(settle(ids), "doc_id", "left").where(f"`{gone}` is null or not `{gone}`"))
    once, again = marked.where(f"`{times}` is null"), marked.where(f"`{times}` > 1").dropDuplicates(["doc_id", "text"])
    return once.unionAll(again).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking credentials masked; widely copied examples stay."""
    repository = F.concat_ws("/", "source", "lang")
    return without_live_secrets(docs, F.col("source"), repository)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words taken and the copies these make.

    Columns named taken and copies are replaced.
    """
    keep = [c for c in docs.columns if c not in ("taken", "copies")]
    return mixed(docs, keep).where("taken > 0").select("doc.*", "taken", "copies")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secret_stage),
    ("mixing", mixing_stage),
]

#: Trees, signatures and the dual have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, settle(stage(spark, docs, sf_dir))
        release(before)
    return docs
