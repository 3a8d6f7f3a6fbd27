"""Interval-overlap join by hierarchical buckets.

An interval has a level, the smallest power of two that is no shorter than it, and so lies in
one or two buckets of that width. Two intervals that overlap share a bucket at the level
of the longer one. So each interval is listed in its own level's buckets, as the longer
side, and in the buckets of each higher level, as the shorter side; an equi-join of the two lists
meets every pair that overlaps, and few others, as a bucket is less than twice as wide as the
interval listed in it. A pair that shares two buckets counts in the first of them alone. An
interval so has two rows a level at most, however long it is: its rows are logarithmic in
the range of lengths, where buckets of one width would give a long interval a row a
bucket, or a short one a crowd.

Levels that one side doesn't have are left out; the driver sees them, 64 numbers at most.
The joins are equi-joins right above their shuffles, which Spark may split where a bucket is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table


def level(first: Column, last: Column) -> Column:
    """Exponent of the smallest power of two that is no less than the number of points from first to last; 63 at most."""
    steps = F.try_subtract(last, first)  # null: longer than a long says
    return F.when(steps == 0, 0).otherwise(F.coalesce(F.length(F.bin(steps)), F.lit(63))).cast("int")


def bucket(point: Column, at: Column) -> Column:
    """Number of the bucket of width 2^at that holds a point."""
    return F.call_function("shiftright", point, at)


def _listed(side: DataFrame, name: str, levels: list[int], longer: bool, strict: bool) -> DataFrame:
    """A row for each bucket: at the interval's own level, or at each of the levels from it on (strict: above it)."""
    if longer:
        at = F.array(F.col("level"))
    else:
        at = F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x > F.col("level") if strict else x >= F.col("level"))
    rows = side.select("*", F.explode(at).alias("_at"))
    first, last = bucket(F.col("first"), F.col("_at")), bucket(F.col("last"), F.col("_at"))
    return rows.select(*side.columns, "_at", first.alias("from"), F.explode(F.sequence(first, last)).alias("_bucket")).withColumnsRenamed({c: f"{name}_{c}" for c in (*side.columns, "from")})


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Columns of left and right of each pair with equal keys whose closed spans share a point.

    Spans are pairs of columns, whole numbers (or what casts to long, as timestamps in
    microseconds do by unix_micros). A span with a null or with its end before its start overlaps
    nothing; nor do null keys. Rows count as often as they are there. Names that both sides have come out
    twice, as in a join.
    """

    def side(df: DataFrame, span: tuple[str, str]) -> DataFrame:
        first, last = (F.col(f"`{c}`").cast("long") for c in span)
        some = df.dropna(subset=on).select(F.struct(*[F.col(f"`{c}`") for c in on]).alias("key"), first.alias("first"), last.alias("last"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
        return some.where(F.col("first") <= F.col("last")).withColumn("level", level(F.col("first"), F.col("last")))

    a, b = side(left, left_span), side(right, right_span)
    levels = [sorted(r["level"] for r in x.select("level").distinct().collect()) for x in (a, b)]
    meet = (F.col("a_key") == F.col("b_key")) & (F.col("a__at") == F.col("b__at")) & (F.col("a__bucket") == F.col("b__bucket"))
    once = F.col("a__bucket") == F.greatest("a_from", "b_from")
    overlap = (F.col("a_first") <= F.col("b_last")) & (F.col("b_first") <= F.col("a_last"))
    rename = lambda df, name: df.withColumnsRenamed({c: f"{name}_{c}" for c in ("_at", "_bucket")})
    pairs = []
    for a_longer in (False, True):  # of equal levels the left one counts as the shorter
        one = rename(_listed(a, "a", levels[1], a_longer, False), "a")
        two = rename(_listed(b, "b", levels[0], not a_longer, True), "b")
        pairs.append(one.join(two, meet & once & overlap).select("a_row", "b_row"))
    return pairs[0].union(pairs[1]).select("a_row.*", "b_row.*")


def sessions(events: DataFrame, keys: list[str], gap_s: int) -> DataFrame:
    """keys, first, last (microseconds) and n of runs of events that are less than gap_s apart."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    order = Window.partitionBy(*keys).orderBy("us")
    rows = events.select(*keys, us.alias("us"))
    rows = rows.withColumn("new", F.coalesce(F.col("us") - F.lag("us").over(order) >= gap_s * 1_000_000, F.lit(True)).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "run").agg(F.min("us").alias("first"), F.max("us").alias("last"), F.count("*").alias("n")).drop("run")


def c51_session_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's sessions of views and of clicks (a day without one ends a session) that overlap."""
    found = sessions(table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click")), ["user_id", "event_type"], 86_400)
    kind = lambda name: found.where(F.col("event_type") == name).select("user_id", *[F.col(c).alias(f"{name}_{c}") for c in ("first", "last", "n")])
    views, clicks = kind("view"), kind("click").withColumnRenamed("user_id", "click_user")
    met = overlap_join(views, clicks.withColumn("user_id", F.col("click_user")), ["user_id"], ("view_first", "view_last"), ("click_first", "click_last"))
    return met.select(F.col("click_user").alias("user_id"), "view_first", "view_last", "view_n", "click_first", "click_last", "click_n")
