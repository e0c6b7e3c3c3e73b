"""Streams: session alerts, the ledger of ids, state logs and segments."""

import datetime as dt
import os
import random

import numpy as np
from pyspark.sql import functions as F

from tallyspark.sources.scratch import scratch_path
from tallyspark.sources.segments import SegmentLog
from tallyspark.streaming import jobs as J
from tallyspark.streaming import latest, ledger, sessions

BASE = dt.datetime(2024, 1, 1)


def alerts_of(spark, batches, delay="10 minutes"):
    """Alerts of a stream whose micro-batches are the given lists of (user, seconds)."""
    folder, target, cp = (scratch_path(spark, n) for n in ("alert-events", "alerts", "cp"))
    n = 0
    for batch in batches:
        rows = [(n + i, BASE + dt.timedelta(seconds=s), u, "view", 0.0, "") for i, (u, s) in enumerate(batch)]
        n += len(rows)
        spark.createDataFrame(rows, J.EVENTS).coalesce(1).write.mode("append").parquet(folder)
        sessions.write_session_alerts(J.event_stream(spark, folder), target, cp, delay=delay).awaitTermination()
    got = spark.read.schema("user_id long, start timestamp, state string, at timestamp, events long").parquet(target).collect()
    return sorted((r.user_id, r.state, (r.start - BASE).total_seconds(), (r.at - BASE).total_seconds(), r.events) for r in got)


def plain_alerts(events, until):
    out = []
    for user in sorted({u for u, _ in events}):
        times = sorted(s for u, s in events if u == user and s <= until)
        start, n = None, 0
        for i, t in enumerate(times):
            start, n = (t, 1) if start is None else (start, n + 1)
            silence = (times[i + 1] if i + 1 < len(times) else until) - t
            out += [(user, name, start, t + s, n) for name, s in (("warned", 340), ("ended", 600)) if silence >= s]
            start = None if silence >= 600 else start
    return sorted(out)


def test_session_alerts_at_340_and_600_seconds(spark):
    events = [(1, 0), (1, 340), (1, 679), (1, 1279), (2, 10), (2, 350.5), (3, 5000)]
    got = alerts_of(spark, [events])
    assert got == plain_alerts(events, 5000 - 600)
    assert [x[:2] + x[3:] for x in got] == [(1, "ended", 1279.0, 3), (1, "ended", 1879.0, 1), (1, "warned", 340.0, 1), (1, "warned", 1019.0, 3), (1, "warned", 1619.0, 1), (2, "ended", 950.5, 2), (2, "warned", 350.0, 1), (2, "warned", 690.5, 2)]


def test_session_alerts_come_as_time_passes_and_mind_events_out_of_order(spark):
    # A warning is out before the end; an event within the delay, though behind later ones, still prevents both.
    first = alerts_of(spark, [[(1, 0)], [(9, 1000)]])
    assert first == [(1, "warned", 0.0, 340.0, 1)]
    batches = [[(1, 0), (2, 0)], [(9, 500), (2, 900)], [(1, 310), (9, 1100)], [(9, 3000)], [(1, 100), (9, 4000)]]
    late = {(1, 100)}
    assert alerts_of(spark, batches) == plain_alerts([e for b in batches for e in b if e not in late], 4000 - 600)


def test_session_alerts_on_a_table(spark):
    rng = random.Random(4)
    events = [(rng.randrange(6), rng.randrange(20_000)) for _ in range(300)]
    rows = [(i, BASE + dt.timedelta(seconds=s), u, "view", 0.0, "") for i, (u, s) in enumerate(events)]
    until = F.lit((BASE + dt.timedelta(seconds=15_000)).isoformat()).cast("timestamp")
    got = sessions.session_alerts_exact(spark.createDataFrame(rows, J.EVENTS), until).collect()
    assert sorted((r.user_id, r.state, (r.start - BASE).total_seconds(), (r.at - BASE).total_seconds(), r.events) for r in got) == plain_alerts(events, 15_000)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "entry_id string")


def test_ledger_opens_only_buckets_that_may_hold_an_id(spark):
    book = ledger.Ledger(spark, scratch_path(spark, "ledger"), buckets=8)
    book.append(ids(spark, *[f"m{i}" for i in range(400)], "m1", None), 0)
    asked = book.keyed(ids(spark, *[f"n{i}" for i in range(40)]))
    assert len(book.buckets_to_open(asked, 1)) <= 2  # about one id in a thousand is mistaken for a known one
    one = book.keyed(ids(spark, "m7", "n1", "n2"))
    home = one.filter("entry_id = 'm7'").first().bucket
    assert [f for f in book.buckets_to_open(one, 1) if f.endswith(f"bucket={home}")] and len(book.buckets_to_open(one, 1)) <= 2
    book.append(ids(spark, "m7", "x", "x"), 1)
    assert sorted(r.entry_id for r in book.read().collect()) == sorted([f"m{i}" for i in range(400)] + ["x"])
    assert book.buckets_to_open(book.keyed(ids(spark)), 2) == []


def test_ledger_replays_and_merges(spark):
    path = scratch_path(spark, "ledger")
    book = ledger.Ledger(spark, path, buckets=2, fan=2)
    for number, names in enumerate((("a", "b"), ("b", "c"), ("c", "d"), ("a", "e"), ("e", "f"))):
        for _ in range(2):  # each batch once more, as after a failure before its commit
            book.append(ids(spark, *names), number)
        assert sorted(r.entry_id for r in book.read().collect()) == sorted(set("abcdef"[: number + 2]))
    assert book.filters.live() == [(0, 3), (4, 4)]
    book.append(ids(spark), 5)
    assert book.filters.committed() == [(0, 3), (4, 4), (5, 5)] == book.ids.committed()


def test_filters_never_miss_and_rarely_mistake():
    rng = np.random.default_rng(0)
    known, other = rng.integers(-(2**63), 2**63 - 1, 20_000), rng.integers(-(2**63), 2**63 - 1, 20_000)
    bits = ledger.filter_bits(known)
    assert ledger.may_hold(bits, known).all() and ledger.may_hold(bits, other).mean() < 0.003
    assert not ledger.may_hold(ledger.filter_bits(known[:0]), other).any()


def test_new_mail_is_handled_once(spark):
    folder, path, cp = (scratch_path(spark, n) for n in ("mails", "ledger", "cp"))
    schema = "entry_id string, received timestamp"
    for names in (("a", "b", "a"), ("b", "c")):
        spark.createDataFrame([(i, BASE) for i in names], schema).write.mode("append").parquet(folder)
        ledger.write_new_mail(spark.readStream.schema(schema).parquet(folder), path, cp).awaitTermination()
    assert sorted(r.entry_id for r in ledger.Ledger(spark, path).read().collect()) == ["a", "b", "c"]


TYPES = {"status": "string", "roi": "double"}


def test_late_and_repeated_patches(spark):
    folder, state, cp = (scratch_path(spark, n) for n in ("patches", "state", "cp"))
    schema = "id string, seq int, status string, roi double"
    for rows in ([("a", 5, "UAT", None)], [("a", 3, "WIP", 2.0), ("b", 1, None, 1.0)], [("a", 4, None, 9.0), ("b", 1, None, 1.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        latest.stream_latest_state(spark.readStream.schema(schema).parquet(folder), state, cp, ("status", "roi")).awaitTermination()
    log = latest.StateLog(spark, state, TYPES)
    assert {r.id: (r.status, r.roi) for r in log.read().collect()} == {"a": ("UAT", 9.0), "b": (None, 1.0)}
    assert [tuple(r) for r in log.read(["b", "z"]).collect()] == [("b", None, 1.0)]


def _bytes(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder.removeprefix("file:")) for f in names if f.endswith(".parquet"))


def test_a_batch_of_patches_writes_what_it_brings(spark):
    log = latest.StateLog(spark, scratch_path(spark, "state"), TYPES, buckets=4)
    schema = "id string, seq int, status string, roi double"
    log.append(spark.range(20_000).select(F.col("id").cast("string").alias("id"), F.lit(1).alias("seq"), F.md5(F.col("id").cast("string")).alias("status"), F.rand(1).alias("roi")), 0)
    log.append(spark.createDataFrame([("7", 2, "late", None)], schema), 1)
    big, small = (_bytes(log.log.folder((n, n))) for n in (0, 1))
    assert small * 50 < big and log.read(["7"]).first().status == "late" and log.read().count() == 20_000


def test_segments_merge_by_powers_of_fan(spark):
    log = SegmentLog(spark, scratch_path(spark, "segments"), fan=2)
    merge = lambda parts, wide: log.write(log.read("x long, bucket int", [log.folder(s) for s in parts]), wide)
    for number in range(9):
        log.advance(number, merge)
        log.write(spark.createDataFrame([(number, number % 2)], "x long, bucket int"), (number, number))
        assert sorted(r.x for r in log.read("x long, bucket int", [log.folder(s) for s in log.live()]).collect()) == list(range(number + 1))
    assert log.live() == [(0, 7), (8, 8)] and log.due(12) == (8, 11) and log.due(0) is None
