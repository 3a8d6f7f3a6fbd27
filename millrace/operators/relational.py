"""Relational queries: scans, projections, filters, joins, aggregates, set operations.

Sums of doubles go through decimals, so that results don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table


def exact_sum(col: Column | str, places: int = 2) -> Column:
    """A sum of doubles that have this many places."""
    return F.sum((F.col(col) if isinstance(col, str) else col).cast(f"decimal(18,{places})")).cast("double")


def c01_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer")


def c02_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, discount = (F.col(c).cast("decimal(18,2)") for c in ("l_extendedprice", "l_discount"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (price * (1 - discount)).cast("double").alias("net"), (F.col("l_quantity") > 25).alias("large"))


def c03_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IN, LIKE and BETWEEN; all three reach the Parquet scan."""
    part = table(spark, sf_dir, "part")
    return part.where(F.col("p_size").isin(1, 5, 9, 14, 30) & F.col("p_brand").startswith("Brand#") & F.col("p_retailprice").between(900, 1800)).select("p_partkey", "p_name", "p_size")


def c04_region_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and revenue by region: a chain of equi-joins under a group-by.

    Orders are summed by customer first, so that the joins above carry a row a customer.
    """
    orders, customer, nation, region = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    per = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("s"))
    joined = per.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.sum("n").alias("n_orders"), F.sum("s").cast("double").alias("revenue"))


def _documents_and_labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return docs, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id"), "quality")


def c05_outer_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the left, right and full outer join, by whether each side is there."""
    docs, labels = _documents_and_labels(spark, sf_dir)
    labels = labels.where("quality = 1")
    docs = docs.where("lang <> 'fr'")
    on = docs["doc_id"] == labels["label_id"]
    parts = [docs.join(labels, on, how).select(F.lit(how).alias("kind"), F.col("doc_id").isNotNull().alias("has_doc"), F.col("label_id").isNotNull().alias("has_label")) for how in ("left", "right", "full")]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("kind", "has_doc", "has_label").agg(F.count("*").alias("n"))


def c06_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents_and_labels(spark, sf_dir)
    return docs.join(labels, docs["doc_id"] == labels["label_id"], "left_semi")


def c07_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents_and_labels(spark, sf_dir)
    return docs.join(labels, docs["doc_id"] == labels["label_id"], "left_anti")


def c08_range_join(spark: SparkSession, sf_dir: str, band: int = 500) -> DataFrame:
    """Parts and customers whose price and balance differ by at most 5: how many customers, and the first.

    Amounts are whole cents. Customers are summed by cent and parts brought to distinct prices
    before anything meets. Cents are cut into blocks as wide as a band, so a price's band is the end
    of one block and the start of the next: two running sums, each over the distinct cents and prices
    of a block, however many rows have them. No pair is built. Where pairs are wanted, overlap_join() gives them.
    """
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    width = 2 * band + 1
    block = lambda c: F.floor(F.col(c) / width)
    by_cent = table(spark, sf_dir, "customer").where("c_acctbal is not null").groupBy(cents("c_acctbal").alias("at")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))
    part = table(spark, sf_dir, "part").where("p_retailprice is not null").select("p_partkey", cents("p_retailprice").alias("price"))
    bands = part.select("price").distinct().select("price", (F.col("price") - band).alias("low"), (F.col("price") + band).alias("high"))
    # side -1 runs from a block's last cent down to a low, side 1 from its first up to a high; a band that is one whole block has no side 1.
    known = by_cent.select(F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"), block("at").alias("block"), "at", "n", "first", F.lit(None).cast("long").alias("price"))
    asked = lambda side, c: bands.where(F.lit(side < 0) | (block("low") < block("high"))).select(F.lit(side), block(c), c, F.lit(0).cast("long"), F.lit(None).cast("long"), "price")
    run = Window.partitionBy("side", "block").orderBy(F.col("side") * F.col("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = known.union(asked(-1, "low")).union(asked(1, "high")).select("price", F.sum("n").over(run).alias("n"), F.min("first").over(run).alias("first")).where("price is not null")
    by_price = sums.groupBy("price").agg(F.sum("n").alias("n"), F.min("first").alias("first")).where("n > 0")
    return part.join(by_price, "price").groupBy("p_partkey").agg(F.sum("n").alias("n_customers"), F.min("first").alias("first_customer"))


def c10_cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation and region have fixed sizes (25 and 5 rows)."""
    return table(spark, sf_dir, "nation").select("n_name").crossJoin(table(spark, sf_dir, "region").select("r_name"))


def c11_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dearest order of each customer: a correlated lateral subquery as a group-by and a join."""
    best = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("o_orderkey"), F.max("o_totalprice").alias("o_totalprice"))
    return table(spark, sf_dir, "customer").join(best, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")


def c12_subqueries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar subquery, EXISTS and IN in one statement."""
    return spark.sql(
        """
        SELECT o_orderkey, o_totalprice FROM {orders} o
        WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM {orders})
          AND EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45)
          AND o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'BUILDING')
        """,
        orders=table(spark, sf_dir, "orders"),
        lineitem=table(spark, sf_dir, "lineitem"),
        customer=table(spark, sf_dir, "customer"),
    )


def c13_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .where("l_shipdate <= timestamp_ntz'1998-09-02'")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            exact_sum("l_quantity").alias("sum_qty"),
            exact_sum("l_extendedprice").alias("sum_price"),
            F.round(exact_sum("l_discount") / F.count("*"), 6).alias("avg_discount"),
            F.min("l_shipdate").alias("first_ship"),
            F.max("l_extendedprice").alias("top_price"),
            F.count("*").alias("n"),
        )
    )


def c14_distinct_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey", "l_linenumber").alias("pairs"))


def c15_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("gid"))


def c16_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate")).rollup("year", "o_orderstatus").agg(exact_sum("o_totalprice").alias("total"), F.grouping_id().cast("long").alias("gid"))


def c16_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


def exact_percentiles(rows: DataFrame, group: str, value: str, asked: dict[str, float], steps: tuple[float, ...] = (1000.0, 1.0)) -> DataFrame:
    """(group, and a column for each asked share): exact percentiles, interpolated, from counts alone.

    Counts by the first step tell in which bins the wanted ranks lie; only the rows of these
    are counted by the next step, and at last by value, so that ties are one count. A window
    orders the counts of one bin, never rows. Nulls take no part.
    """
    rows = rows.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    bins = lambda k: F.floor(F.col("v") / steps[k]) if k < len(steps) else F.col("v")
    total = rows.groupBy("g").agg(F.count("*").alias("total"))
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(q).alias("q")) for name, q in asked.items()])
    ranks = total.select("g", "total", F.inline(ranks)).withColumn("rank", F.col("q") * (F.col("total") - 1))
    # The two ranks around each wanted one, as rows; "before" is how many rows lie below the bin at hand.
    at = ranks.select("g", "name", "rank", F.explode(F.array_distinct(F.array(F.floor("rank"), F.ceil("rank")))).alias("place"), F.lit(0).cast("long").alias("before"), F.lit(None).cast("long").alias("bin"))
    for k in range(len(steps) + 1):
        some = rows.withColumn("bin", bins(k - 1) if k else F.lit(None).cast("long")).withColumn("next", bins(k))
        if k:
            some = some.join(F.broadcast(at.select(F.col("g").alias("h"), F.col("bin").alias("wanted")).distinct()), F.col("g").eqNullSafe(F.col("h")) & (F.col("bin") == F.col("wanted")), "left_semi")
        counts = some.groupBy("g", "bin", "next").agg(F.count("*").alias("n"))
        counts = counts.withColumn("below", F.sum("n").over(Window.partitionBy("g", "bin").orderBy("next")) - F.col("n"))
        counts = counts.withColumnsRenamed({"g": "h", "bin": "of"})
        inside = F.col("g").eqNullSafe(F.col("h")) & F.col("bin").eqNullSafe(F.col("of")) & (F.col("place") >= F.col("before") + F.col("below")) & (F.col("place") < F.col("before") + F.col("below") + F.col("n"))
        at = at.join(counts, inside).select("g", "name", "rank", "place", (F.col("before") + F.col("below")).alias("before"), F.col("next").alias("bin"))
    found = at.groupBy("g", "name").agg(F.min("bin").alias("low"), F.max("bin").alias("high"), F.first("rank").alias("rank"))
    result = F.round(F.col("low") + (F.col("high") - F.col("low")) * (F.col("rank") - F.floor("rank")), 4)
    return found.groupBy(F.col("g").alias(group)).agg(*[F.max(F.when(F.col("name") == name, result)).alias(name) for name in asked])


def c17_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and 90th percentile of the orders' prices by priority."""
    return exact_percentiles(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", {"median": 0.5, "p90": 0.9})


def c18_approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sketch: it differs from the exact count by 5 % on average, so it has no SQL twin."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("approx_parts"))


def c19_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status values are named, so that no extra job has to look for them."""
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey"))


def c19_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price")).unpivot("p_partkey", ["size", "price"], "what", "amount")


def c23_sort_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k with an offset: partial heaps in the tasks, no full sort."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(20).select("o_orderkey", "o_totalprice")


def c24_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation"))
    return c.unionByName(s).groupBy("kind", "nation").agg(F.count("*").alias("n"))


def c25_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).intersect(table(spark, sf_dir, "orders").select("o_orderkey"))


def c25_intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    both = lines.select("l_linenumber").intersectAll(lines.where("l_returnflag = 'A'").select("l_linenumber"))
    return both.groupBy("l_linenumber").agg(F.count("*").alias("n"))


def c25_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).subtract(table(spark, sf_dir, "lineitem").select("l_orderkey"))


def c25_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    rest = lines.select("l_linenumber").exceptAll(lines.where("l_returnflag = 'A'").select("l_linenumber"))
    return rest.groupBy("l_linenumber").agg(F.count("*").alias("n"))
