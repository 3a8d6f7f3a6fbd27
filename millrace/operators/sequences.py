"""Ordered events: pattern matching by an automaton over runs, and regular grids with filled gaps.

Both work on sorted partitions that Spark streams through windows; no group is gathered into an
array. A key that holds a large part of all rows is dealt over blocks of time for the filling; for the matching it is one
sorted partition that spills, as order is what is asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table


@dataclass(frozen=True)
class Step:
    """An event of this kind; more: one or several in a row."""

    kind: str
    more: bool = False


def match_sequences(events: DataFrame, key: str, order: list[str], kind: str, at: str, pattern: list[Step], within_us: int) -> DataFrame:
    """(key, first, last, n, of each match): runs of events of a key that are the pattern's steps one after another, nothing between.

    Events are cut into runs of one kind; a step without more takes one event of its run: the last if the match begins in it, the
    first if it ends in it, and a run of one event if it lies within. A step with more takes the whole run. first and last are values of at
    (microseconds), n the number of events; last - first is within_us at most: a first step with more leaves out
    events that are too early for it, as the pattern holds without them. Steps next to each other are of different kinds. Matches may share events. Null keys, kinds and times take no part.
    """
    if not pattern or any(a.kind == b.kind for a, b in zip(pattern, pattern[1:])):
        raise ValueError("a pattern has steps, and no two of one kind next to each other")
    rows = events.where(F.col(key).isNotNull() & F.col(kind).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("key"), *[F.col(c) for c in order], F.col(kind).alias("kind"), F.col(at).alias("at"))
    line = Window.partitionBy("key").orderBy(*order)
    rows = rows.withColumn("new", F.coalesce(F.lag("kind").over(line) != F.col("kind"), F.lit(True)).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("key", "run").agg(F.first("kind").alias("kind"), F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"))
    # The automaton's state before a run is what the runs before it were: with one run a step, it reads them back by lag.
    by_run, m = Window.partitionBy("key").orderBy("run"), len(pattern)
    back = lambda c, k: F.lag(c, k).over(by_run) if k else F.col(c)
    state = runs.select("key", "run", *[back(c, m - 1 - k).alias(f"{c}{k}") for k in range(m) for c in ("kind", "first", "last", "n")])
    holds: Column = F.lit(True)
    for k, step in enumerate(pattern):
        holds = holds & (F.col(f"kind{k}") == step.kind)
        if not step.more and 0 < k < m - 1:
            holds = holds & (F.col(f"n{k}") == 1)
    final = F.col(f"last{m - 1}") if pattern[-1].more and m > 1 else F.col(f"first{m - 1}") if m > 1 else F.col("last0")
    found = state.where(F.coalesce(holds, F.lit(False))).select("key", "run", F.col("first0").alias("head"), F.col("last0").alias("tail"), final.alias("end"), *[F.col(f"n{k}") for k in range(m)])
    found = found.where(F.col("end") - F.col("tail") <= within_us) if m > 1 else found
    middle = sum((F.col(f"n{k}") for k in range(1, m - 1)), F.lit(0))
    end_n = (F.col(f"n{m - 1}") if pattern[-1].more else F.lit(1)) if m > 1 else F.lit(0)
    if not pattern[0].more:
        return found.select("key", F.col("tail").alias("first"), F.col("end").alias("last"), (F.lit(1) + middle + end_n).cast("long").alias("n"))
    # The first run's events that are in time.
    own = rows.where(F.col("kind") == pattern[0].kind).select(F.col("key").alias("k"), F.col("run").alias("r"), "at")
    timely = found.join(own, (F.col("key") == F.col("k")) & (F.col("run") - (m - 1) == F.col("r")) & (F.col("end") - F.col("at") <= within_us))
    return timely.groupBy("key", "run", "end").agg(F.min("at").alias("first"), (F.count("*") + F.first(middle + end_n)).cast("long").alias("n")).select("key", "first", F.col("end").alias("last"), "n")


def fill_grid(values: DataFrame, key: list[str], at: str, value: str, step: int, block: int = 1024) -> DataFrame:
    """(key, at, value, filled, linear): a row for each multiple of step from a key's first to its last.

    values has at most one row a key and grid point (at: a whole number, divisible by step). filled is the last known value up to the
    point, linear the line between the known values around it; both are the value itself where it is known. A null value is a gap too. A key's grid is dealt to blocks
    of so many steps, and what is known at the end of the blocks before and at the start of those after is found over one row a block, so that no
    task walks through the whole of a long key.
    """
    span = step * block
    some = values.where(F.col(at).isNotNull()).select(*key, F.col(at).cast("long").alias("at"), F.col(value).cast("double").alias("value"))
    ends = some.groupBy(*key).agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    # First a row a block, then its points: no row makes more than block of them.
    number = lambda c: F.floor(F.col(c) / F.lit(span)).cast("long")
    blocks = ends.select("*", F.explode(F.sequence(number("lo"), number("hi"))).alias("block"))
    grid = blocks.select(*key, "block", F.explode(F.sequence(F.greatest("lo", F.col("block") * span), F.least("hi", (F.col("block") + 1) * span - step), F.lit(step).cast("long"))).alias("at"))
    same = lambda a, b, names: [a[c].eqNullSafe(b[c]) for c in names]
    there = some.where("value is not null").withColumn("block", number("at"))
    known = F.when(F.col("value").isNotNull(), F.struct("at", "value"))
    ends_of = there.groupBy(*key, "block").agg(F.max(F.struct("at", "value")).alias("end"), F.min(F.struct("at", "value")).alias("start"))
    line = Window.partitionBy(*key).orderBy("block")
    every = blocks.select(*key, "block").join(ends_of.withColumnsRenamed({c: f"_{c}" for c in [*key, "block"]}), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*key, "block"]], "left").select(*key, "block", "start", "end")
    carried = every.select(*key, "block", F.last("end", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("start", ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    points = grid.join(there.withColumnsRenamed({c: f"_{c}" for c in [*key, "block", "at"]}), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*key, "block", "at"]], "left").select(*key, "block", "at", "value")
    own = Window.partitionBy(*key, "block").orderBy("at")
    points = points.withColumns({"back": F.last(known, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)), "ahead": F.first(known, ignorenulls=True).over(own.rowsBetween(0, Window.unboundedFollowing))})
    carried = carried.withColumnsRenamed({c: f"_{c}" for c in [*key, "block"]})
    points = points.join(carried, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*key, "block"]])
    a, b = F.coalesce("back", "before"), F.coalesce("ahead", "after")
    share = (F.col("at") - a["at"]) / F.nullif(b["at"] - a["at"], F.lit(0))
    linear = F.when(F.col("value").isNotNull(), F.col("value")).otherwise(a["value"] + (b["value"] - a["value"]) * share)
    return points.select(*key, "at", "value", a["value"].alias("filled"), linear.alias("linear"))


def c58_event_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """view+ click purchase of a user with nothing between, within two days."""
    events = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", "event_type")
    found = match_sequences(events, "user_id", ["us", "event_id"], "event_type", "us", [Step("view", more=True), Step("click"), Step("purchase")], 2 * 86_400_000_000)
    return found.select(F.col("key").alias("user_id"), "first", "last", "n")


def c59_gap_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value of events by type and hour (in hundredths, whole), on an hourly grid without gaps."""
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) * 3600
    means = table(spark, sf_dir, "events").groupBy("event_type", hour.alias("at")).agg(F.floor(F.sum(F.round(F.col("value") * 100).cast("long")) / F.count("*")).alias("mean"))
    found = fill_grid(means, ["event_type"], "at", "mean", 3600, block=24)
    return found.select("event_type", F.col("at").alias("t_s"), F.col("value").alias("mean"), "filled", F.round("linear", 6).alias("linear"))
