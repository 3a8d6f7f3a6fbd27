"""Sinks: a table written in a format and read again with its schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import shared_folder, table


def round_trip(df: DataFrame, fmt: str, **options: str) -> DataFrame:
    path = shared_folder(df.sparkSession, fmt)
    df.write.format(fmt).options(**options).save(path)
    return df.sparkSession.read.format(fmt).schema(df.schema).options(**options).load(path)


def c50_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parquet, partitioned by a column: a filter on it reads only its folders."""
    nation = table(spark, sf_dir, "nation")
    path = shared_folder(spark, "parquet")
    nation.write.partitionBy("n_regionkey").parquet(path)
    return spark.read.schema(nation.schema).parquet(path).where("n_regionkey in (1, 2)").select("n_nationkey", "n_name", "n_regionkey")


def c50_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "nation"), "csv", header="true")


def c50_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "nation"), "json")


def c50_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "nation"), "orc")


def c50_csv_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with quotes, commas and line breaks through CSV, and nulls beside empty strings."""
    pages = table(spark, sf_dir, "pages")
    odd = pages.select("page_id", "url", "html", F.when(F.col("page_id") % 2 == 0, "").when(F.col("page_id") % 3 == 0, '\\ "a", \r\n b').alias("note"))
    return round_trip(odd, "csv", header="true", quoteAll="true", escape='"', multiLine="true", lineSep="\n", nullValue="\\N", emptyValue="", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")


def c50_json_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps, doubles and JSON within JSON, each in its own type again."""
    return round_trip(table(spark, sf_dir, "events"), "json", timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def dealt(df: DataFrame, column: str, by: str, rows_a_file: int = 1_000_000) -> DataFrame:
    """df dealt for a write that is partitioned by column: about rows_a_file rows a task, also where a value holds half of all rows.

    The counts by value, one row each, decide how many tasks a value is dealt to, so tasks grow with the rows.
    """
    counts = df.groupBy(column).agg(F.count("*").alias("_rows"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("_rows") / rows_a_file))
    tasks = counts.agg(F.sum(parts).cast("long")).first()[0] or 1
    # A value's tasks are numbered from _first on, so that no two parts meet in one task.
    held = counts.select(F.col(column).alias("_value"), parts.alias("_parts"))
    held = held.withColumn("_first", F.sum("_parts").over(Window.orderBy("_value")) - F.col("_parts"))
    # Broadcast, a row a folder: a shuffled join would bring all rows of a value to one task.
    some = df.join(F.broadcast(held), F.col(column).eqNullSafe(F.col("_value")))
    task = F.col("_first") + F.pmod(F.xxhash64(by), F.col("_parts"))
    return some.repartitionById(max(1, tasks), task.cast("int")).drop("_value", "_parts", "_first")


def c50_parquet_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large table dealt by its partition column before it is written, so that a folder gets few files."""
    lines = table(spark, sf_dir, "lineitem")
    path = shared_folder(spark, "lineitem")
    dealt(lines, "l_returnflag", "l_orderkey").write.partitionBy("l_returnflag").parquet(path)
    back = spark.read.schema(lines.schema).parquet(path).where("l_returnflag = 'R'")
    return back.groupBy("l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"))
