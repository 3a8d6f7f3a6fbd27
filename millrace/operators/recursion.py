"""Recursion over a table: semi-naive iteration.

Each round joins only what the round before found with the links, and keeps what no round found
yet; so cycles end, and a node has the number of the round that first came to it. Rounds are
written to the shared folder, which cuts the lineage; the driver sees a count a round. A
round is a shuffle of its own size, not of all that is known, save for the anti join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder, table


def reachable(links: DataFrame, start: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(node, hops) of all that start (node) reaches by links (src, dst), itself with 0; hops is the least number of links.

    Null nodes are no nodes. most_rounds ends it early, with what is known by then.
    """
    spark = links.sparkSession
    links = links.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct()
    kind = links.schema["src"].dataType
    path = shared_folder(spark, "reach")
    links.write.parquet(f"{path}/links")
    links = spark.read.schema(links.schema).parquet(f"{path}/links")
    schema = spark.range(0).select(F.lit(None).cast(kind).alias("node"), F.lit(0).alias("hops")).schema
    round_, new = 0, start.where("node is not null").select(F.col("node").cast(kind).alias("node")).distinct()
    while True:
        new.select("node", F.lit(round_).alias("hops")).write.parquet(f"{path}/rounds/{round_}")
        last = spark.read.schema(schema).parquet(f"{path}/rounds/{round_}")
        known = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/rounds")
        if last.isEmpty() or round_ == most_rounds:
            return known
        new = links.join(last, F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("node")).distinct().join(known, "node", "left_anti")
        round_ += 1


def c32_recursion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers that large, discounted line items link, directly or over others, to the suppliers of nations 0 to 4."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity >= 48 AND l_discount >= 0.08").select("l_orderkey", "l_suppkey")
    pairs = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = pairs.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    start = table(spark, sf_dir, "supplier").where("s_nationkey < 5").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))
    return reachable(pairs.union(pairs.select("dst", "src")), start)
