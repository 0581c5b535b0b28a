"""Job upkeep: jobs that stopped making progress, and deliveries still due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Minutes without progress, and attempts after which a delivery is given up.
STALE_MINUTES, ATTEMPTS = 10, 5
#: Minutes an analysis may be pending, and how many may be at once.
PENDING_MINUTES, PENDING = 10, 32


def stale_jobs(jobs: DataFrame, document: str, order: Column, running: Column, progressed: str, now: Column) -> DataFrame:
    """(document, progressed) where the newest job is running but made no progress for STALE_MINUTES.

    The newest job is a maximum, which tasks combine before the shuffle.
    """
    newest = F.max(F.struct(order.alias("o"), running.alias("running"), F.col(progressed).alias("at")))
    last = jobs.groupBy(document).agg(newest.alias("j")).where("j.running")
    return last.where(F.col("j.at") < now - F.expr(f"interval {STALE_MINUTES} minutes")).select(document, F.col("j.at").alias(progressed))


def due_deliveries(outbox: DataFrame, delivered: DataFrame, digest: str, attempts: str) -> DataFrame:
    """Rows of the outbox to be sent: attempts are left and no row of the same digest was delivered."""
    return outbox.where(F.col(attempts) < ATTEMPTS).join(delivered.select(digest), digest, "left_anti")


def expired_jobs(jobs: DataFrame, active: Column, created: str, now: Column) -> DataFrame:
    """Jobs with a column failed: still active PENDING_MINUTES after they were created."""
    late = F.col(created) < now - F.expr(f"interval {PENDING_MINUTES} minutes")
    return jobs.withColumn("failed", F.coalesce(active & late, F.lit(False)))


def admitted_jobs(active: DataFrame, requests: DataFrame, document: str, ts: str, most: int = PENDING) -> DataFrame:
    """(document, ts) of the requests that start a job: the first of each document that has no active one, while places are free.

    The limit is the queue's size; the rows are ordered by a top-k in each task.
    """
    free = max(0, most - active.select(document).distinct().count())
    first = requests.groupBy(document).agg(F.min(ts).alias(ts)).join(active.select(document), document, "left_anti")
    return first.orderBy(ts, document).limit(free)
