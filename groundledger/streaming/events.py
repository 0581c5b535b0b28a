"""Structured Streaming forms: deduplication, replays, sweeps, deliveries, record events; what keeps other state is in stateful.py."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.sinks import replace_partitions


def once(stream: DataFrame, key: str, delay: str) -> DataFrame:
    """The first event of each key; keys are forgotten after the delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def replays(stream: DataFrame, token: str, expires: str, delay: str) -> DataFrame:
    """(token, ts, replayed): whether a token was used before and hadn't expired; it is forgotten once the watermark passes its expiry."""

    def use(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until = state.get[0] if state.exists else None
        for frame in frames:
            out = []
            for row in frame.sort_values("ts").itertuples():
                again = until is not None and row.ts.timestamp() < until
                until = until if again else row.expires.timestamp()
                out.append((k[0], row.ts, again))
            yield pd.DataFrame(out, columns=[token, "ts", "replayed"])
        if until is not None:
            state.update((until,))
            state.setTimeoutTimestamp(max(int(until * 1000), state.getCurrentWatermarkMs() + 1))

    rows = stream.withWatermark("ts", delay).select(F.col(token).cast("string").alias(token), "ts", F.col(expires).alias("expires"))
    return rows.groupBy(token).applyInPandasWithState(use, f"{token} string, ts timestamp, replayed boolean", "until double", "append", GroupStateTimeout.EventTimeTimeout)


def replace_by_document(path: str, document: str):
    """A foreachBatch sink that replaces the partitions of a batch's documents, so that a batch delivered again changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        replace_partitions(batch, path, document)

    return write


def stalled(stream: DataFrame, key: str, final: list[str], minutes: int) -> DataFrame:
    """(key, ts): jobs that made no progress for `minutes` of event time and weren't in a final state; each is reported once.

    A job's timer starts anew with every event; it fires when the watermark passes it.
    """

    def watch(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame([(k[0], pd.Timestamp(last, unit="s"))], columns=[key, "ts"])
            return
        last, done = state.get if state.exists else (0.0, False)
        for frame in frames:
            for row in frame.sort_values("ts").itertuples():
                if row.ts.timestamp() >= last:
                    last, done = row.ts.timestamp(), row.state in final
        if done:
            if state.exists:
                state.remove()
        else:
            state.update((last, done))
            state.setTimeoutTimestamp(max(int((last + 60 * minutes) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([], columns=[key, "ts"])

    rows = stream.withWatermark("ts", "0 seconds").select(F.col(key).cast("string").alias(key), "ts", "state")
    return rows.groupBy(key).applyInPandasWithState(watch, f"{key} string, ts timestamp", "last double, done boolean", "append", GroupStateTimeout.EventTimeTimeout)


def deliver_once(path: str, digest: str):
    """A foreachBatch sink of an outbox: rows whose digest was delivered before are passed over, so a batch sent again adds nothing.

    Delivered rows lie in a folder a batch; a batch's folder is replaced as a whole.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([digest])
        system = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if system.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(system):
            sent = spark.read.parquet(path).where(F.col("batch") != number).select(digest)
            new = new.join(sent, digest, "left_anti")
        new.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return write


def record_events(stream: DataFrame) -> DataFrame:
    """(channel, payload): what is told of approved and of flagged records, of a stream (record_id, parcel_id, role, ts, state, reason, audit_hash)."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    approved = F.to_json(F.struct("record_id", "parcel_id", F.col("role").alias("approved_by"), stamp.alias("timestamp"), F.col("audit_hash").alias("approval_audit_hash")))
    flagged = F.to_json(F.struct("record_id", "parcel_id", "reason", stamp.alias("timestamp")))
    rows = stream.where(F.col("state").isin("APPROVED", "FLAGGED"))
    is_approved = F.col("state") == "APPROVED"
    return rows.select(F.when(is_approved, "record.approved").otherwise("record.flagged").alias("channel"), F.when(is_approved, approved).otherwise(flagged).alias("payload"))


def caught_up(stream: DataFrame, sink, checkpoint: str) -> None:
    """Runs once over all that has come in since the last run and ends, as a nightly job does; the checkpoint is its only memory."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
