"""One query for each operator over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import END, START, format_chats, read_back
from .decontamination import contaminated
from .license_scan import license_scan
from .lm_scoring import lm_scores
from .merkle import encoded, folded, hexed, merkle_manifest, proof_digest
from .mixing import mix
from .near_dedup import near_duplicates
from .quality_rules import quality_rules
from .secret_scan import secret_report, secret_scan
from .spelling_variants import spelling_variants
from .storage import table
from .substring_dedup import repeated_passages
from .token_counts import token_counts
from .toxicity import toxicity


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A source is an owner; its documents of one language are a repository.
    repository = F.concat_ws("/", "source", "lang")
    return secret_report(secret_scan(table(spark, sf_dir, "documents"), F.col("source"), repository, ["doc_id"]))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    role, text = F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(f"{END}{START}assistant ok")
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), text.alias("text"))
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_chats(given.unionByName(added)))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = ("doc_id", "source", "lang", "n_chars", "text")
    leaf = F.sha2(encoded(*hashed), 256)
    # Tampered rows: one more character than there is.
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    rows = table(spark, sf_dir, "documents").select(*hashed, changed.alias("more"))
    tampered = F.when(F.col("more") != F.col("n_chars"), F.sha2(encoded("doc_id", "source", "lang", "more", "text"), 256))
    rows = rows.select("doc_id", "lang", leaf.alias("leaf"), F.unhex(tampered).alias("tampered"))
    made = merkle_manifest(rows, F.col("lang"), F.col("doc_id"), F.col("leaf"))
    start = hexed(F.coalesce("row.tampered", "leaf"))
    made = made.select(
        "row.doc_id",
        hexed(F.col("leaf")).alias("leaf"),
        hexed(F.col("subroot")).alias("subroot"),
        hexed(F.col("root")).alias("root"),
        proof_digest(F.col("witness")).alias("proof_sha256"),
        folded(start, F.col("witness")).alias("folded_root"),
    )
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_quality_rules, op3_license_scan, op4_secret_scan, op5_decontamination,
        op6_token_counts, op7_near_dedup, op8_mixing, op9_lm_scoring, op10_toxicity,
        op11_chat_format, op12_merkle_manifest, op13_spelling_variants,
    )
}
