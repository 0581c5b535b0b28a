"""Streams whose state expires: quotas, changes, job admission and deliveries.

Every key's state ends by a timer of event time, so a stream holds the keys that are
active now and not all it has ever seen. Timers fire when the watermark, `delay`
behind the latest event, passes them; what an event decides never waits for a timer.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ..operators.jobs import ATTEMPTS, PENDING, PENDING_MINUTES

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _millis(ts: datetime) -> int:
    return round(ts.timestamp() * 1000)


def _moment(millis: int) -> datetime:
    return datetime.fromtimestamp(millis / 1000, UTC).astimezone().replace(tzinfo=None)


def _run(rows: DataFrame, keys: list[str], processor: StatefulProcessor, result: str, delay: str) -> DataFrame:
    rows.sparkSession.conf.set(_PROVIDER, _ROCKSDB)
    return rows.withWatermark("ts", delay).groupBy(*keys).transformWithState(processor, result, "append", "EventTime")


class _Expiring(StatefulProcessor):
    """One value a key, forgotten at a time that its events move on."""

    fields: tuple[tuple[str, Any], ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kind = StructType([*[StructField(name, of) for name, of in self.fields], StructField("until", LongType())])
        self.value = handle.getValueState("value", kind)

    def read(self) -> tuple | None:
        return tuple(self.value.get()) if self.value.exists() else None

    def write(self, before: tuple | None, *now: Any) -> None:
        """The last of the values is when they are forgotten."""
        if before is None or before[-1] != now[-1]:
            if before is not None:
                self.handle.deleteTimer(before[-1])
            self.handle.registerTimer(now[-1])
        self.value.update(now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.value.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Quota(_Expiring):
    fields = (("start", LongType()), ("n", LongType()))

    def __init__(self, rules: dict[str, tuple[int, int]]) -> None:
        self.rules = rules

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        limit, seconds = self.rules[key[0]]
        before = self.read()
        start, n, _ = before or (None, 0, 0)
        for ts in sorted(r.ts for r in rows):
            if start is None or _millis(ts) >= start + 1000 * seconds:
                start, n = _millis(ts), 0
            n += 1
            yield Row(quota=key[0], key=key[1], ts=ts, accepted=n <= limit)
        self.write(before, start, n, start + 1000 * seconds)


def quotas(stream: DataFrame, limits: list[tuple[str, str, int, int]], delay: str = "1 minute") -> DataFrame:
    """(quota, key, ts, accepted) for several quotas (name, key column, limit, seconds) of every event at once.

    An event becomes a row for each quota, and each (quota, key) has a state and a
    window of its own that its first event begins and whose end forgets it. Every
    quota counts every event; an event passes if all of its rows are accepted.
    """
    rules = {name: (limit, seconds) for name, _, limit, seconds in limits}
    each = F.array(*[F.struct(F.lit(name).alias("quota"), F.col(key).cast("string").alias("key")) for name, key, _, _ in limits])
    rows = stream.select("ts", F.inline(each)).where("key is not null")
    return _run(rows, ["quota", "key"], _Quota(rules), "quota string, key string, ts timestamp, accepted boolean", delay)


def anchored_quota(stream: DataFrame, key: str, limit: int, seconds: int, delay: str = "1 minute") -> DataFrame:
    """(key, ts, accepted): at most `limit` events in a window that the key's first event begins."""
    return quotas(stream, [(key, key, limit, seconds)], delay).select(F.col("key").alias(key), "ts", "accepted")


class _Changes(_Expiring):
    fields = (("last", StringType()), ("done", BooleanType()))

    def __init__(self, terminal: tuple[str, ...], idle: int) -> None:
        self.terminal, self.idle = terminal, idle

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        before = self.read()
        last, done, until = before or (None, False, 0)
        for r in sorted(rows, key=lambda r: r.ts):
            until = max(until, _millis(r.ts) + 1000 * self.idle)
            if not done and r.payload != last:
                last, done = r.payload, r.payload in self.terminal
                yield Row(key=key[0], ts=r.ts, payload=last)
        self.write(before, last, done, until)


def changes_only(stream: DataFrame, key: str, payload: str, terminal: tuple[str, ...] = (), idle: int = 300, delay: str = "1 minute") -> DataFrame:
    """Rows whose payload differs from the one emitted before for the key; nothing after a terminal one.

    A key is forgotten after so many idle seconds.
    """
    rows = stream.select(F.col(key).cast("string").alias("key"), "ts", F.col(payload).cast("string").alias("payload"))
    found = _run(rows, ["key"], _Changes(terminal, idle), "key string, ts timestamp, payload string", delay)
    return found.select(F.col("key").alias(key), "ts", F.col("payload").alias(payload))


class _Admission(StatefulProcessor):
    """Pending documents of a queue, so many at most, with the time at which each was admitted."""

    def __init__(self, most: int, minutes: int) -> None:
        self.most, self.stay = most, minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", StructType([StructField("document", StringType())]), StructType([StructField("since", LongType())]))

    def _expired(self, queue: str, now: int) -> Iterator[Row]:
        held = sorted((v[0], k[0]) for k, v in self.pending.iterator()) if self.pending.exists() else []
        for since, document in held:
            if since + self.stay <= now:
                self.pending.removeKey((document,))
                yield Row(queue=queue, document=document, ts=_moment(since + self.stay), outcome="expired")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        for r in sorted(rows, key=lambda r: (r.ts, r.kind, r.document)):
            now = _millis(r.ts)
            yield from self._expired(key[0], now)
            held = self.pending.containsKey((r.document,))
            if r.kind == "finished":
                if held:
                    self.pending.removeKey((r.document,))
                outcome = "finished" if held else "unknown"
            elif held:
                outcome = "running"
            elif sum(1 for _ in self.pending.keys()) >= self.most:
                outcome = "full"
            else:
                self.pending.updateValue((r.document,), (now,))
                self.handle.registerTimer(now + self.stay)
                outcome = "admitted"
            yield Row(queue=key[0], document=r.document, ts=r.ts, outcome=outcome)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        yield from self._expired(key[0], expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def admissions(stream: DataFrame, queue: str, document: str, kind: str, most: int = PENDING, minutes: int = PENDING_MINUTES, delay: str = "1 minute") -> DataFrame:
    """(queue, document, ts, outcome) of a queue's events, whose kind is "request" or "finished".

    A request is admitted while fewer than `most` documents are pending; it is
    "running" if its own document is, else "full". A document pending for so many
    minutes is reported as expired and makes room.
    """
    rows = stream.select(*[F.col(c).cast("string").alias(n) for c, n in ((queue, "queue"), (document, "document"), (kind, "kind"))], "ts")
    rows = rows.where("document is not null and kind in ('request', 'finished')")
    return _run(rows, ["queue"], _Admission(most, minutes), "queue string, document string, ts timestamp, outcome string", delay)


class _Delivery(_Expiring):
    fields = (("attempts", LongType()), ("state", StringType()))

    def __init__(self, attempts: int, keep: int) -> None:
        self.most, self.keep = attempts, keep

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        before = self.read()
        attempts, state, until = before or (0, "new", 0)
        for r in sorted(rows, key=lambda r: (r.ts, r.kind != "queued", r.kind)):
            until = max(until, _millis(r.ts) + 1000 * self.keep)
            outcome = None
            if state == "new":
                # A receipt for what was forgotten, or never queued, starts nothing.
                if r.kind == "queued":
                    attempts, state, outcome = 1, "sent", "send"
            elif r.kind == "queued":
                outcome = "already delivered" if state == "delivered" else None
            elif state == "sent" and r.kind == "delivered":
                state = outcome = "delivered"
            elif state == "sent" and attempts < self.most:
                attempts, outcome = attempts + 1, "send"
            elif state == "sent":
                state = outcome = "given up"
            if outcome:
                yield Row(digest=key[0], ts=r.ts, attempt=attempts, outcome=outcome)
        self.write(before, attempts, state, until)


def deliveries(stream: DataFrame, digest: str, kind: str, attempts: int = ATTEMPTS, keep: int = 7 * 86_400, delay: str = "1 minute") -> DataFrame:
    """(digest, ts, attempt, outcome) of an outbox's events, whose kind is "queued", "failed" or "delivered".

    A digest is sent when it is first queued and after each failure while attempts
    are left, then given up; queued again, it is delivered already or still under way.
    It is forgotten so many seconds after its last event.
    """
    rows = stream.select(F.col(digest).cast("string").alias("digest"), F.col(kind).cast("string").alias("kind"), "ts").where("digest is not null and kind in ('queued', 'failed', 'delivered')")
    return _run(rows, ["digest"], _Delivery(attempts, keep), "digest string, ts timestamp, attempt long, outcome string", delay)
