"""Session alerts as time passes: a warning after a silence, the end after a longer one, from one state row a user.

Events may come in any order within the watermark's delay.  They wait in the user's state until the watermark has passed
them, so that every silence is judged on all events that can still count; a timer in event time wakes the user up where the next decision falls.
The state holds one user's events of the delay at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tallyspark.streaming.settings import END_S, WARN_S, state_store

_ALERTS = "user_id long, start timestamp, state string, at timestamp, events long"
_SECOND = 1_000_000


class SessionAlerts(StatefulProcessor):
    """Rows (user_id, start, state, at, events): ``warned`` and ``ended``, each once a silence, at the moment it came to that length."""

    def __init__(self, warn_s: int = WARN_S, end_s: int = END_S):
        self.warn, self.end = warn_s * _SECOND, end_s * _SECOND

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "start long, last long, events long, warned boolean, timer long, waiting array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [int(t) for part in rows for t in part["micros"]]
        yield from self._advance(key[0], new, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key[0], [], timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass

    def _advance(self, user, new: list[int], known: int) -> Iterator[pd.DataFrame]:
        """Events up to ``known``, the watermark, are all there: they settle, and so does the silence after the last of them."""
        start, last, events, warned, timer, waiting = self.state.get() if self.state.exists() else (None, None, 0, False, None, [])
        out: list[tuple] = []

        def silence(until: int) -> None:
            nonlocal start, warned
            if start is not None and not warned and until - last >= self.warn:
                warned = True
                out.append((user, start, "warned", last + self.warn, events))
            if start is not None and until - last >= self.end:
                out.append((user, start, "ended", last + self.end, events))
                start = None

        every = sorted([*waiting, *new])
        for t in every:
            if t > known:
                break
            silence(t)
            if start is None:
                start, events = t, 0
            last, events, warned = t, events + 1, False
        silence(known)
        waiting = [t for t in every if t > known]
        self._keep(start, last, events, warned, timer, waiting)
        if out:
            rows = pd.DataFrame(out, columns=["user_id", "start", "state", "at", "events"])
            yield rows.assign(start=pd.to_datetime(rows["start"], unit="us", utc=True), at=pd.to_datetime(rows["at"], unit="us", utc=True))

    def _keep(self, start, last, events, warned, timer, waiting) -> None:
        nexts = waiting[:1] + ([last + (self.end if warned else self.warn)] if start is not None else [])
        wake = -(-min(nexts) // 1000) - 1 if nexts else None  # a timer fires once the watermark is beyond it
        if timer is not None and timer != wake:
            self.handle.deleteTimer(timer)
        if wake is None:
            self.state.clear()
            return
        if timer != wake:
            self.handle.registerTimer(wake)
        self.state.update((start, last, events, warned, wake, waiting))


def session_alerts(events: DataFrame, delay: str = "10 minutes", warn_s: int = WARN_S, end_s: int = END_S) -> DataFrame:
    """The alerts of a stream of events (user_id, ts); needs the RocksDB state store, which ``write_session_alerts`` sets."""
    rows = events.withWatermark("ts", delay).select("user_id", "ts", F.unix_micros("ts").alias("micros"))
    return rows.groupBy("user_id").transformWithStateInPandas(SessionAlerts(warn_s, end_s), _ALERTS, "append", "EventTime")


def write_session_alerts(events: DataFrame, target: str, checkpoint: str, **options) -> StreamingQuery:
    """Append alerts to a Parquet folder."""
    with state_store(events.sparkSession):
        return session_alerts(events, **options).writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_alerts_exact(events: DataFrame, until: Column, warn_s: int = WARN_S, end_s: int = END_S) -> DataFrame:
    """The same on a table, with silences judged up to the time ``until``. One user's events are one window partition."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = lambda c: F.unix_micros(c)
    rows = events.filter(F.col("ts") <= until).withColumn("gap", micros("ts") - micros(F.lag("ts").over(w)))
    rows = rows.withColumn("n", F.sum(F.when(F.col("gap").isNull() | (F.col("gap") >= end_s * _SECOND), 1).otherwise(0)).over(w))
    of_session = Window.partitionBy("user_id", "n").orderBy("ts", "event_id")
    rows = rows.withColumns({"start": F.min("ts").over(of_session), "events": F.row_number().over(of_session).cast("long"), "next": F.coalesce(F.lead("ts").over(w), until)})
    states = F.array(*[F.struct(F.lit(name).alias("state"), F.lit(s).alias("s")) for name, s in (("warned", warn_s), ("ended", end_s))])
    alerts = rows.withColumn("x", F.explode(states)).filter(micros("next") - micros("ts") >= F.col("x.s") * _SECOND)
    return alerts.select("user_id", "start", "x.state", F.timestamp_micros(micros("ts") + F.col("x.s") * _SECOND).alias("at"), "events")
