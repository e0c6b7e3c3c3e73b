"""Structured Streaming jobs: mail within a watermark, presence, sessions and new results.

The exact ledger of mail is in ``ledger``, session alerts are in ``sessions``, state under patches is in ``latest``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyspark.streaming.settings import END_S, WARN_S

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, schema: str = EVENTS, files_per_batch: int | None = None) -> DataFrame:
    """Files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def mail_dedup(mails: DataFrame, delay: str = "7 days") -> DataFrame:
    """Each mail id once, while its first sight is within the watermark."""
    return mails.withWatermark("received", delay).dropDuplicatesWithinWatermark(["entry_id"])


def user_panes(events: DataFrame, step: str = "1 minute", delay: str = "10 minutes", lg_k: int = 12) -> DataFrame:
    """(window, sketch): a mergeable sketch of the users in each pane; the relative standard error is about 0.8 / sqrt(2**lg_k)."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    return rows.groupBy(F.window("ts", step).alias("window")).agg(F.hll_sketch_agg("user_id", F.lit(lg_k)).alias("sketch"))


def active_users(events: DataFrame, width: str = "5 minutes", step: str = "1 minute", delay: str = "10 minutes", lg_k: int = 12) -> DataFrame:
    """About how many users each sliding window saw: an event goes into one pane's sketch, and only sketches into the windows.

    ``active_users_exact`` counts; this one moves a sketch of at most 2**lg_k bytes a pane and window, however many events there are.
    """
    panes = user_panes(events, step, delay, lg_k)
    return panes.groupBy(F.window(F.window_time("window"), width, step).alias("window")).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("users"))


def active_users_exact(events: DataFrame, width: str = "5 minutes", step: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """The same, exact in a stream too: users by window first, then their number; a window comes out once its time is over."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    users = rows.groupBy(F.window("ts", width, step).alias("window"), "user_id").agg(F.count("*").alias("events"))
    return users.groupBy("window").agg(F.count("*").alias("users"))


def present_at(events: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    """Users whose last event lies within the minutes before a time."""
    last = events.filter(F.col("ts") <= now).groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    return last.filter(F.col("last_seen") >= now - F.expr(f"INTERVAL {minutes} MINUTES"))


def user_sessions(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Sessions by user that end after END_S seconds of silence; a gap of just that long ends one, hence the microsecond less."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    s = F.session_window("ts", f"{END_S - 1} seconds 999999 microseconds")
    return rows.groupBy("user_id", s.alias("s")).agg(F.count("*").alias("events"), F.max("ts").alias("last")).select("user_id", F.col("s.start").alias("start"), "last", "events")


def sessions_exact(events: DataFrame) -> DataFrame:
    """The same on a table, by gaps. One user's events are one window partition."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))
    rows = events.withColumn("n", F.sum(F.when(gap.isNull() | (gap >= END_S * 1_000_000), 1).otherwise(0)).over(w))
    return rows.groupBy("user_id", "n").agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("events")).drop("n")


def session_states(events: DataFrame, now: Column) -> DataFrame:
    """(user_id, state) of each user at a time, by the silence since their last event."""
    last = events.filter(F.col("ts") <= now).groupBy("user_id").agg(F.max("ts").alias("last"))
    return last.select("user_id", idle_state((F.unix_micros(now) - F.unix_micros("last")) / 1_000_000).alias("state"))


def idle_state(idle_seconds: Column) -> Column:
    """Whether a session goes on, is warned or has ended."""
    return F.when(idle_seconds >= END_S, "ended").when(idle_seconds >= WARN_S, "warned").otherwise("active")


def incremental_results(source: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append what is new since the last run; offsets live in the checkpoint."""
    return source.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drive a stream over what is there now into an in-memory table: for tests and small results only."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
