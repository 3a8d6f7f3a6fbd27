"""Structured Streaming over the events table: bounded runs with availableNow.

The state of each query is bounded by its watermark. Results go to a Parquet sink in the
shared folder, exactly once by its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder, table

LATE = "10 minutes"
TIMEOUT_S = 600
#: Milliseconds without an event after which a user's state ends.
IDLE_MS = 2 * 3600 * 1000


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream; ts becomes a timestamp, which watermarks need."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def run_now(stream: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """All rows that are there now, through the stream, as a batch; with the path of an earlier run, goes on from it."""
    spark, path = stream.sparkSession, path or shared_folder(stream.sparkSession, label)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).outputMode("append").start(f"{path}/rows")
    if not query.awaitTermination(TIMEOUT_S):
        query.stop()
        raise TimeoutError(label)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def c36_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = event_stream(spark, sf_dir).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    out = run_now(w.select(F.col("window.start").alias("start"), "event_type", "n"), "tumbling")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


def c37_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = event_stream(spark, sf_dir).groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n"))
    out = run_now(w.select("user_id", F.col("session_window.start").alias("start"), "n"), "session")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


def c38_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    doubled = event_stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return run_now(doubled.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id"), "dedup")


def c39_stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with the purchases of their user in the hour after; both states end with the watermark."""
    clicks = event_stream(spark, sf_dir).where("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("user_id").alias("click_user"), F.col("ts").alias("click_ts"))
    buys = event_stream(spark, sf_dir).where("event_type = 'purchase'").select(F.col("event_id").alias("buy_id"), "user_id", "ts")
    on = F.expr("user_id = click_user AND ts >= click_ts AND ts <= click_ts + INTERVAL 1 HOUR")
    return run_now(clicks.join(buys, on).select("click_id", "buy_id"), "join")


def c40_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and largest value by user, in a state of a few numbers that a timer ends.

    A user's state goes when the watermark is IDLE_MS past the last event; a later event
    begins a new one. Each row tells the state's own beginning, and the last row of each
    state counts.
    """

    def count(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, top, began, last = state.get if state.exists else (0, 0.0, 0, 0)
        for frame in frames:
            ms = (frame["ts"].astype("int64") // (10**6 if frame["ts"].dtype == "datetime64[ns]" else 10**3)).tolist()
            n, top, began, last = n + len(frame), max(top, float(frame["value"].max())), began or min(ms), max(last, *ms)
        state.update((n, top, began, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + IDLE_MS)
        yield pd.DataFrame({"user_id": [key[0]], "began": [began], "n": [n], "top": [top]})

    stream = event_stream(spark, sf_dir).select("user_id", "ts", "value").groupBy("user_id")
    stream = stream.applyInPandasWithState(count, "user_id long, began long, n long, top double", "n long, top double, began long, last long", "append", "EventTimeTimeout")
    every = run_now(stream, "state").groupBy("user_id", "began").agg(F.max("n").alias("n"), F.max("top").alias("top"))
    return every.groupBy("user_id").agg(F.sum("n").alias("n"), F.round(F.max("top"), 4).alias("top"))


def late_rows(spark: SparkSession, first: DataFrame, second: DataFrame) -> DataFrame:
    """Windows of a stream whose second part comes after a run over the first: its rows behind the watermark are dropped.

    Spark drops by the watermark that the batch before had, so the first run must end, with
    the empty batch that moves the watermark on, before the second part is there.
    """
    path = shared_folder(spark, "late")
    for part in (first, second):
        part.write.mode("append").parquet(f"{path}/in")  # all files of a run are one batch
        stream = spark.readStream.schema(first.schema).parquet(f"{path}/in").withWatermark("ts", LATE)
        windows = stream.groupBy(F.window("ts", "10 minutes")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")
        found = run_now(windows, "late-windows", f"{path}/windows")
    return found


def c41_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events come a second time after a run over them: behind the watermark, they change no window."""
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    return late_rows(spark, events, events).withColumn("start", F.col("start").cast("timestamp_ntz"))
