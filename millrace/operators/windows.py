"""Window functions, as-of join and event-time windows over batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table


def c09_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with its user's latest view before it or at the same time.

    The two sides are tagged and united; one shuffle and sort by user and time, and the
    last view so far is carried along. No pair of rows is ever built.
    """
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    view = F.when(F.col("event_type") == "view", F.struct("ts", "event_id"))
    order = Window.partitionBy("user_id").orderBy("ts", F.desc("event_type"), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    met = events.withColumn("v", F.last(view, ignorenulls=True).over(order)).where("event_type = 'click' AND v IS NOT NULL")
    return met.select("event_id", "user_id", F.col("v.event_id").alias("view_id"), F.col("v.ts").alias("view_ts"))


def c20_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row number and quarter of each customer's orders; rank and dense rank by priority within a status.

    A status holds a third of all orders, so its ranks come from counts by status and
    priority, summed in order and joined back.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    by = Window.partitionBy("o_orderstatus").orderBy("o_orderpriority")
    counts = orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    ranks = counts.select("o_orderstatus", "o_orderpriority", (F.sum("n").over(by) - F.col("n") + 1).cast("int").alias("rnk"), F.row_number().over(by).alias("dense"))
    whole = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    placed = orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", F.row_number().over(whole).alias("rn"), F.ntile(4).over(whole).alias("quarter"))
    return placed.join(ranks, ["o_orderstatus", "o_orderpriority"]).select("o_orderkey", "rn", "quarter", "rnk", "dense")


def c21_analytic(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    whole = user.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.lag("event_id").over(user).alias("prev_id"),
        F.lead("event_type", 2, "none").over(user).alias("later_type"),
        F.first("event_id").over(whole).alias("first_id"),
        F.last("event_id").over(whole).alias("last_id"),
    )


def c22_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = Window.partitionBy("user_id").orderBy("sec").rangeBetween(-3600, 0)
    events = table(spark, sf_dir, "events").withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp")))
    cents = F.round(F.col("value") * 100).cast("long")
    return events.select("event_id", F.sum(cents).over(user.rowsBetween(-2, 0)).alias("last3"), F.count("*").over(seconds).alias("last_hour"))


def c23_top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three dearest orders of each priority; Spark keeps only candidates before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("o_orderpriority", "o_orderkey", "rn")


def c33_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def c34_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "events").groupBy(F.window("ts", "2 hours", "1 hour")).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


def c35_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "events").groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")
