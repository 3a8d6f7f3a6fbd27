"""Storage that later reads and joins profit from: buckets, partitions that are replaced alone, pruning at run time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import shared_folder, table


def write_bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """df as a table in buckets of a key, sorted by it; tables with as many buckets of their keys join without an exchange.

    The rows are dealt to the buckets before the write, so that a bucket is one file. The table is external, in the shared folder.
    """
    spark, name = df.sparkSession, f"millrace_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", shared_folder(spark, name)).saveAsTable(name)
    return spark.table(name)


def replace_partitions(df: DataFrame, path: str, column: str) -> None:
    """Write df over the partitions of the column that it has rows of; the others stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def c61_bucketed_join(spark: SparkSession, sf_dir: str, buckets: int = 16) -> DataFrame:
    """Orders with their line items, both in buckets of the order's key: lines and quantity by priority."""
    orders = write_bucketed(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", buckets)
    lines = write_bucketed(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity"), "l_orderkey", buckets)
    joined = orders.hint("merge").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"))


def c62_replaced_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by ship year, of which 1997 is replaced with half its rows; then the lines of years with few orders, pruned at run time."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", F.year("l_shipdate").alias("ship_year"))
    path = shared_folder(spark, "years")
    lines.write.partitionBy("ship_year").parquet(path)
    replace_partitions(lines.where("ship_year = 1997 AND l_orderkey % 2 = 0"), path, "ship_year")
    years = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("orders_of_year")).where("y BETWEEN 1996 AND 1998")
    schema = "l_orderkey long, l_quantity double, ship_year int"
    met = spark.read.schema(schema).parquet(path).join(years, F.col("ship_year") == F.col("y"))
    return met.groupBy("ship_year").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"), F.first("orders_of_year").alias("orders_of_year"))
