"""Sketches that are rolled up, buckets, replaced partitions and pruning at run time."""

import pytest
from compare import duck
from pyspark.sql import functions as F

from millrace.operators.sketches import DISTINCT_BOUND, daily_sketches, rolled_up
from millrace.sources import layout
from millrace.sources.tables import shared_folder


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rolled_up_sketches_are_within_their_bounds(spark):
    rows = spark.range(60_000).selectExpr("id % 30 AS day", "concat('g', int(id % 7 < 3)) AS g", "pmod(xxhash64(id), 7000) AS u", "pmod(xxhash64(id, 1), 100000) AS x", "IF(id % 5 = 0, 'hot', concat('i', pmod(xxhash64(id, 2), 900))) AS item")
    path = shared_folder(spark, "test-sketches")
    daily_sketches(rows, "day", ["g"], "u", "x", "item").write.partitionBy("day").parquet(path)
    days = spark.read.parquet(path)
    assert days.count() == 60
    quantiles = F.array(*[F.kll_sketch_get_quantile_bigint("kll", F.lit(q)) for q in (0.1, 0.5, 0.9)]).alias("q")
    found = {r["g"]: r for r in rolled_up(days, ["g"]).select("*", quantiles).collect()}
    for g, n, u, xs in rows.groupBy("g").agg(F.count("*"), F.count_distinct("u"), F.sort_array(F.collect_list("x"))).collect():
        assert found[g]["n"] == n and abs(found[g]["n_distinct"] - u) <= DISTINCT_BOUND * u
        for q, x in zip((0.1, 0.5, 0.9), found[g]["q"]):
            assert abs(sum(v <= x for v in xs) / len(xs) - q) <= 0.02
        heavy = {h["item"]: h["count"] for h in found[g]["heavy"]}
        exact = rows.where((F.col("g") == g) & (F.col("item") == "hot")).count()
        assert max(heavy, key=heavy.get) == "hot" and abs(heavy["hot"] - exact) <= 0.01 * n
    # Some days alone: partitions are read, not rows.
    some = rolled_up(days.where("day < 3"), ["g"]).collect()
    assert {r["g"]: r["n"] for r in some} == {g: n for g, n in rows.where("day < 3").groupBy("g").count().collect()}
    assert rolled_up(days.limit(0), ["g"]).collect() == []


def test_buckets_join_without_an_exchange(spark, sf_dir):
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(held, ("-1", "false")):
            spark.conf.set(k, v)
        orders = layout.write_bucketed(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey", 8)
        lines = layout.write_bucketed(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_orderkey", 8)
        joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        text = plan(joined)
        assert "SortMergeJoin" in text and "Exchange" not in text
        assert joined.count() == duck(sf_dir).execute("SELECT count(*) FROM orders JOIN lineitem ON o_orderkey = l_orderkey").fetchone()[0]
        grouped = plan(lines.groupBy("l_orderkey").count())  # a group by the key needs none either
        assert "Exchange" not in grouped
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_only_the_partitions_of_the_new_rows_are_replaced(spark):
    path = shared_folder(spark, "test-replace")
    spark.range(100).selectExpr("id", "id % 4 AS p").write.partitionBy("p").parquet(path)
    files = lambda df: {p: {r["f"] for r in df.where(F.col("p") == p).select(F.input_file_name().alias("f")).collect()} for p in range(4)}
    before = files(spark.read.parquet(path))
    layout.replace_partitions(spark.createDataFrame([(1000, 2), (1001, 9)], "id long, p long"), path, "p")
    back = spark.read.schema("id long, p long").parquet(path)
    assert {r["p"]: r["count"] for r in back.groupBy("p").count().collect()} == {0: 25, 1: 25, 2: 1, 3: 25, 9: 1}
    after = files(back)
    assert all(before[p] == after[p] for p in (0, 1, 3)) and not before[2] & after[2]
    layout.replace_partitions(back.where("id < 0"), path, "p")  # no rows: nothing is replaced
    assert spark.read.parquet(path).count() == 77


def test_partitions_are_pruned_by_what_the_other_side_holds(spark):
    path = shared_folder(spark, "test-prune")
    spark.range(1000).selectExpr("id", "id % 20 AS p").write.partitionBy("p").parquet(path)
    other = spark.range(20).selectExpr("id AS k", "concat('n', id) AS name").where("name IN ('n3', 'n5')")
    small = shared_folder(spark, "test-small")
    other.write.parquet(small)
    joined = spark.read.parquet(path).join(spark.read.parquet(small).where("name <> 'n5'"), F.col("p") == F.col("k"))
    assert "dynamicpruning" in plan(joined)
    assert joined.count() == 50


@pytest.mark.parametrize("query", ["c61_bucketed_join"])
def test_the_query_joins_its_buckets_as_they_are(spark, sf_dir, query):
    text = plan(getattr(layout, query)(spark, sf_dir))
    join = text[text.index("SortMergeJoin") :]
    assert "Exchange" not in join.split("== Initial Plan ==")[0]
