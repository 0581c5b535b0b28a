"""Streams with expiring state: what they tell, and that their state gets smaller again."""

import random
from datetime import datetime, timedelta

import pytest

from groundledger.streaming.stateful import admissions, anchored_quota, changes_only, deliveries, quotas

START = datetime(2020, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def run(spark, tmp_path, batches, schema, build, name):
    """The rows of a stream that reads a batch of (seconds, ...) after another, and the number of keys held after each."""
    source = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame([(at(s), *r) for s, *r in rows], f"ts timestamp, {schema}").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(f"ts timestamp, {schema}").option("maxFilesPerTrigger", 1).parquet(source)
    query = build(stream).writeStream.format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    assert query.exception() is None
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return spark.table(name).collect(), held


def seconds(ts):
    return round((ts - START).total_seconds())


def test_windows_begin_at_the_first_event_and_end(spark, tmp_path):
    batches = [[(5, "u"), (20, "u"), (30, "u"), (30, "v")], [(64, "u"), (66, "u")], [(900, "w")], [(901, "w"), (5000, "w")]]
    rows, held = run(spark, tmp_path, batches, "user string", lambda s: anchored_quota(s, "user", 2, 60, "0 seconds"), "expiring_quota")
    assert sorted((r.user, seconds(r.ts), r.accepted) for r in rows) == [
        ("u", 5, True), ("u", 20, True), ("u", 30, False), ("u", 64, False), ("u", 66, True), ("v", 30, True), ("w", 900, True), ("w", 901, True), ("w", 5000, True),
    ]
    assert max(held) > held[-1]


def test_quotas_against_plain_counting(spark, tmp_path):
    rng = random.Random(2)
    limits = [("minute", "user", 3, 60), ("day", "user", 9, 300), ("ip", "ip", 4, 60)]
    # Times differ, so that the order of a batch's events is the order of their windows.
    times = sorted(rng.sample(range(2000), 240))
    events = [(s, rng.choice("abc"), rng.choice(["x", "y", None])) for s in times]
    batches = [events[k : k + 60] for k in range(0, 240, 60)]
    rows, held = run(spark, tmp_path, batches, "user string, ip string", lambda s: quotas(s, limits, "0 seconds"), "expiring_quotas")
    want = []
    for name, column, limit, size in limits:
        state = {}
        for s, user, ip in events:
            key = user if column == "user" else ip
            if key is None:
                continue
            start, n = state.get(key, (None, 0))
            start, n = (s, 1) if start is None or s >= start + size else (start, n + 1)
            state[key] = start, n
            want.append((name, key, s, n <= limit))
    assert sorted((r.quota, r.key, seconds(r.ts), r.accepted) for r in rows) == sorted(want)
    assert max(held) <= 8


def test_changes_stop_at_the_end_and_are_forgotten(spark, tmp_path):
    batches = [
        [(0, "a", "1"), (1, "a", "1"), (2, "a", "2"), (3, "b", "DONE"), (4, "b", "more")],
        [(50, "b", "DONE"), (51, "a", "2")],
        [(1000, "c", "x")], [(1001, "c", "x")], [(1002, "a", "2"), (1003, "b", "DONE")],
    ]
    rows, held = run(spark, tmp_path, batches, "job string, payload string", lambda s: changes_only(s, "job", "payload", ("DONE",), 300, "0 seconds"), "expiring_changes")
    assert sorted((r.job, seconds(r.ts), r.payload) for r in rows) == [("a", 0, "1"), ("a", 2, "2"), ("a", 1002, "2"), ("b", 3, "DONE"), ("b", 1003, "DONE"), ("c", 1000, "x")]
    assert min(held[2:]) < max(held)


def test_admission_of_so_many_at_most(spark, tmp_path):
    ask, end = (lambda s, d: (s, "q", d, "request")), (lambda s, d: (s, "q", d, "finished"))
    batches = [
        [ask(0, "a"), ask(1, "a"), ask(2, "b"), ask(3, "c"), ask(4, "d"), (4, "other", "d", "request"), (4, "q", None, "request"), (4, "q", "d", "?")],
        [end(10, "b"), ask(11, "d"), end(12, "never")],
        [ask(605, "e"), ask(606, "f")], [ask(2000, "g")], [ask(2001, "h")],
    ]
    rows, held = run(spark, tmp_path, batches, "queue string, doc string, kind string", lambda s: admissions(s, "queue", "doc", "kind", most=3, minutes=10, delay="0 seconds"), "expiring_jobs")
    told = sorted((seconds(r.ts), r.document, r.outcome) for r in rows if r.queue == "q")
    assert told == [
        (0, "a", "admitted"), (1, "a", "running"), (2, "b", "admitted"), (3, "c", "admitted"), (4, "d", "full"), (10, "b", "finished"), (11, "d", "admitted"), (12, "never", "unknown"),
        (600, "a", "expired"), (603, "c", "expired"), (605, "e", "admitted"), (606, "f", "admitted"), (611, "d", "expired"), (1205, "e", "expired"), (1206, "f", "expired"), (2000, "g", "admitted"), (2001, "h", "admitted"),
    ]
    assert [(seconds(r.ts), r.outcome) for r in rows if r.queue == "other"] == [(4, "admitted"), (604, "expired")]


def test_thirty_two_pending(spark, tmp_path):
    batches = [[(k, "q", f"d{k}", "request") for k in range(40)]]
    rows, _ = run(spark, tmp_path, batches, "queue string, doc string, kind string", lambda s: admissions(s, "queue", "doc", "kind"), "expiring_thirty_two")
    assert [r.outcome for r in sorted(rows, key=lambda r: r.ts)] == ["admitted"] * 32 + ["full"] * 8


def test_deliveries_end_after_five_attempts(spark, tmp_path):
    batches = [
        [(0, "p", "queued"), (1, "q", "queued"), (2, "p", "failed"), (3, "p", "failed"), (3, "q", "delivered"), (3, "stray", "failed"), (3, None, "queued")],
        [(4, "q", "queued"), (5, "p", "queued"), (6, "p", "failed"), (7, "p", "failed"), (8, "p", "failed"), (9, "p", "failed"), (10, "p", "queued")],
        [(5000, "r", "queued")], [(5001, "r", "delivered")], [(5002, "q", "queued")],
    ]
    rows, held = run(spark, tmp_path, batches, "digest string, kind string", lambda s: deliveries(s, "digest", "kind", keep=600, delay="0 seconds"), "expiring_outbox")
    told = {d: [(r.attempt, r.outcome) for r in sorted(rows, key=lambda r: r.ts) if r.digest == d] for d in ("p", "q", "r", "stray")}
    assert told["p"] == [*[(k, "send") for k in range(1, 6)], (5, "given up")]
    assert told["q"] == [(1, "send"), (1, "delivered"), (1, "already delivered"), (1, "send")]
    assert told["r"] == [(1, "send"), (1, "delivered")] and told["stray"] == []
    assert min(held[2:]) < max(held)


@pytest.mark.parametrize("build", [lambda s: quotas(s, [("m", "k", 1, 60)]), lambda s: changes_only(s, "k", "kind"), lambda s: admissions(s, "k", "k", "kind"), lambda s: deliveries(s, "k", "kind")])
def test_no_events(spark, tmp_path, build):
    rows, _ = run(spark, tmp_path, [[]], "k string, kind string", build, f"none_{abs(hash(build))}")
    assert rows == []
