"""Scalar functions: strings, dates, numbers, arrays, JSON and URLs, all JVM-side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table


def c26_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.upper("p_name").alias("up"),
        F.regexp_extract("p_brand", "([0-9]+)", 1).alias("brand_no"),
        F.element_at(F.split("p_type", " "), 1).alias("first_word"),
        F.length("p_name").cast("long").alias("len"),
        F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"),
        F.translate("p_brand", "#", "-").alias("dashed"),
        F.concat_ws("/", F.substring("p_name", 1, 3), F.reverse("p_brand")).alias("mixed"),
    )


def c27_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.year(d).alias("y"),
        F.quarter(d).alias("q"),
        (F.weekday(d) + 1).alias("iso_day"),
        F.trunc(d, "month").alias("month"),
        F.date_add(d.cast("date"), 45).alias("due"),
        F.datediff(F.lit("2002-01-01").cast("date"), d.cast("date")).alias("age"),
        F.date_format(d, "yyyy-MM-dd").alias("text"),
    )


def c28_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.floor(p).alias("whole"),
        F.round(F.sqrt(q), 6).alias("root"),
        F.round(F.pow(q, F.lit(1.5)), 4).alias("power"),
        F.round(F.log10(p + 1), 6).alias("log10"),
        F.abs(q - 25).alias("off"),
        F.pmod(F.col("l_orderkey"), F.lit(7)).alias("mod7"),
        F.try_divide(p, F.when(q > 10, q)).isNull().alias("small"),
    )


def c29_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector with its label's smallest vector: one broadcastable row a label."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    head = vectors.groupBy("label").agg(F.min_by("v", "vec_id").alias("h"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cos = dot("v", "h") / F.sqrt(dot("v", "v") * dot("h", "h"))
    return vectors.join(head, "label").select("vec_id", F.round(cos, 4).alias("cosine"), F.size("v").cast("long").alias("dims"))


def c30_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.get_json_object("props", "$.k").alias("k_text"), F.to_json(F.struct("event_id", k.alias("k"))).alias("json"))


def c31_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.parse_url(url, F.lit("PROTOCOL")).alias("protocol"), F.parse_url(url, F.lit("HOST")).alias("host"), F.parse_url(url, F.lit("PATH")).alias("path"), F.parse_url(url, F.lit("QUERY")).alias("query"))
