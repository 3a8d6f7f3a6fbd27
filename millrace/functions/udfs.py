"""User-defined functions over Arrow batches; none is called once a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table


def c42_pandas_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def charge(price: pd.Series, discount: pd.Series, tax: pd.Series) -> pd.Series:
        cents, d, t = ((x * 100).round().astype("int64") for x in (price, discount, tax))
        return cents * (100 - d) * (100 + t) / 1e6

    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", charge("l_extendedprice", "l_discount", "l_tax").alias("charge"))


def c42_arrow_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrow arrays in and out, without pandas between."""

    @F.arrow_udf("long")
    def check_digits(price: pa.Array) -> pa.Array:
        cents = pc.cast(pc.round(pc.multiply(price, 100)), pa.int64())
        return pc.subtract(cents, pc.multiply(pc.divide(cents, 97), 97))

    @F.arrow_udf("string")
    def upper(x: pa.Array) -> pa.Array:
        return pc.utf8_upper(x)

    return table(spark, sf_dir, "orders").select("o_orderkey", check_digits("o_totalprice").alias("check_digits"), upper("o_orderpriority").alias("priority"))


def c43_grouped_map(spark: SparkSession, sf_dir: str, rows_a_group: int = 20_000) -> DataFrame:
    """Share of each order in its customer's total; a customer's orders are a small group.

    A call of the function costs about a millisecond, as much as hundreds of rows, so it gets the customers of a bucket
    together: buckets grow with the rows, a bucket doesn't. Orders without a customer have a bucket of their own, as pandas holds keys beside nulls as doubles.
    """

    def share(orders: pd.DataFrame) -> pd.DataFrame:
        cents = (orders["o_totalprice"] * 100).round()
        total = cents.groupby(orders["o_custkey"], dropna=False).transform("sum")
        return pd.DataFrame({"o_orderkey": orders["o_orderkey"], "share": (cents / total).round(6)})

    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    buckets = -(-orders.count() // rows_a_group) or 1
    bucket = F.when(F.col("o_custkey").isNull(), -1).otherwise(F.pmod(F.xxhash64("o_custkey"), F.lit(buckets)))
    return orders.groupBy(bucket.alias("bucket")).applyInPandas(share, "o_orderkey long, share double")


def c43_partition_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user-defined aggregate in two steps: sums by batch in the tasks, then Spark's sum."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch]).group_by("o_orderpriority").aggregate([("o_orderkey", "count"), ("o_custkey", "max")])
            yield from t.select(["o_orderpriority", "o_orderkey_count", "o_custkey_max"]).rename_columns(["o_orderpriority", "n", "top"]).to_batches()

    some = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_custkey").mapInArrow(partial, "o_orderpriority string, n long, top long")
    return some.groupBy("o_orderpriority").agg(F.sum("n").alias("n"), F.max("top").alias("top"))


def c44_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function that parts names, a batch of the table's rows a call; a null name has no parts."""

    class Parts:
        def eval(self, part: pa.RecordBatch) -> Iterator[pa.Table]:
            words = pc.split_pattern(part.column("p_name"), " ")
            counts = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
            pos = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            keys = part.column("p_partkey").take(pc.list_parent_indices(words))
            yield pa.table({"p_partkey": keys, "pos": pa.array(pos, pa.int32()), "word": pc.list_flatten(words)})

    spark.udtf.register("name_parts", F.arrow_udtf(Parts, returnType="p_partkey long, pos int, word string"))
    return spark.sql("SELECT p_partkey, pos, word FROM name_parts(TABLE({part}))", part=table(spark, sf_dir, "part").select("p_partkey", "p_name"))
