"""An equi-join that hot keys don't hold up.

A frequent-items sketch over the larger side finds its heavy keys, HOT at most: every key
with more than a share of the rows is among them, whatever the data, as the sketch tracks TRACKED
keys and misses none that has more than a TRACKED-th. Rows of the other keys are joined as ever. The
smaller side's rows of hot keys are broadcast if they are few (counted first); otherwise
each hot key is dealt to so many salts that a task of it has about the rows of an ordinary one, and
only the smaller side's rows of that key are repeated, once a salt.

The sketch costs one pass over one column of the larger side, with partial sketches in the
tasks. The driver sees the hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

#: Hot keys at most, and keys that the sketch tracks.
HOT, TRACKED = 64, 4096
#: Rows of the smaller side that may be broadcast.
BROADCAST_ROWS = 1_000_000


def heavy_keys(rows: DataFrame, key: Column, share: float) -> tuple[list[tuple], int]:
    """[(key, rows of it, at least)] of the keys that may have more than a share of the rows, most first, and the number of rows; null is no key."""
    counted = rows.select(key.alias("k")).agg(F.expr(f"approx_top_k(k, {HOT}, {TRACKED})").alias("top"), F.count("k").alias("n")).first()
    return [(r["item"], r["count"]) for r in counted["top"] or [] if r["item"] is not None and r["count"] > share * counted["n"]], counted["n"]


def skew_join(large: DataFrame, small: DataFrame, on: str, how: str = "inner", broadcast_rows: int = BROADCAST_ROWS, tasks: int | None = None) -> DataFrame:
    """large joined with small on a column that both have (how: inner or left); the columns of large, then small's others.

    Null keys join nothing. tasks: among how many a side is to be dealt evenly, by default Spark's number of
    shuffle partitions. Rows are told apart by all their columns for the salts, so equal rows of large share one.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left: small's rows are repeated, so they can't be kept unmatched")
    spark, tasks = large.sparkSession, tasks or int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot, n = heavy_keys(large, F.col(on), 1 / (4 * tasks))
    out = [*large.columns, *(c for c in small.columns if c != on)]
    if not hot:
        return large.join(small, on, how).select(out)
    kind = large.schema[on].dataType
    is_hot = F.coalesce(F.col(on).isin([F.lit(k).cast(kind) for k, _ in hot]), F.lit(False))
    cold = large.where(~is_hot).join(small.where(~is_hot), on, how).select(out)
    some = small.where(is_hot)
    if some.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return cold.unionAll(large.where(is_hot).join(F.broadcast(some), on, how).select(out))
    # A salt has about a 16th of an even task, so that tasks with some salts more or less are still alike. The rows
    # that this repeats are few beside the result, which has a row for each row of large and of small of the key.
    salts = {k: max(1, -(-16 * tasks * m // max(1, n))) for k, m in hot}
    salted = F.coalesce(*[F.when(F.col(on) == F.lit(k).cast(kind), F.lit(s)) for k, s in salts.items()])
    left = large.where(is_hot).withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in large.columns]), salted).cast("int"))
    right = some.withColumn("_salt", F.explode(F.sequence(F.lit(0), salted.cast("int") - 1)))
    return cold.unionAll(left.join(right, [on, "_salt"], how).select(out))


def c56_skew_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of which half name one supplier, joined with suppliers: lines and quantity by nation."""
    lines = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_orderkey") % 2 == 0, 1).otherwise(F.col("l_suppkey")).alias("suppkey"), "l_quantity", "l_orderkey", "l_linenumber")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("suppkey"), "s_nationkey")
    found = skew_join(lines, suppliers, "suppkey")
    return found.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"))
