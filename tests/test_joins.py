"""The joins that Spark has no operator for: brute force, odd rows, plans and skew."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.intervals import bucket, c51_session_overlap, level, overlap_join
from millrace.operators.recursion import reachable
from millrace.operators.skew import heavy_keys, skew_join
from millrace.operators.vectors import nearest_vectors


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def spans(rng, n):
    out = []
    for k in range(n):
        a = rng.randint(-2000, 2000)
        out.append((k, rng.choice(["x", "y", None]), a, a + rng.choice([-1, 0, 0, 1, 2, 3, 5, 7, 8, 100, 1500, 10**6])))
    return [*out, (-1, "x", None, 5), (-2, "x", 5, None), (-3, "x", -(2**63), 2**63 - 1), (-4, "y", 2**63 - 1, 2**63 - 1), (-5, "x", 7, 7), (-5, "x", 7, 7)]


@pytest.mark.parametrize("seed", range(4))
def test_overlaps_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    a, b = spans(rng, 150), spans(rng, 100)
    left, right = (spark.createDataFrame(x, f"{n} long, k string, s long, e long") for x, n in ((a, "i"), (b, "j")))
    got = sorted((r[0], r[4]) for r in overlap_join(left, right, ["k"], ("s", "e"), ("s", "e")).collect())
    there = lambda x: x[1] and x[2] is not None and x[3] is not None and x[2] <= x[3]
    assert got == sorted((x[0], y[0]) for x in a for y in b if there(x) and there(y) and x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    assert overlap_join(left, right.limit(0), ["k"], ("s", "e"), ("s", "e")).collect() == []


def test_overlaps_without_a_nested_loop(spark, sf_dir):
    text = plan(c51_session_overlap(spark, sf_dir))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_a_long_interval_has_two_rows_a_level_at_most(spark):
    """Of 2,000 short intervals and one that spans them all, the long one is listed in two buckets, and each pair is met once."""
    short = spark.range(2000).selectExpr("'k' AS k", "id * 1000 AS s", "id * 1000 + 3 AS e")
    long = spark.sql("SELECT 'k' AS k, -5L AS s, 5000000L AS e")
    assert overlap_join(short, long, ["k"], ("s", "e"), ("s", "e")).count() == 2000
    rows = spark.range(61).selectExpr("1234567L AS first", "1234567L + (1L << int(id)) AS last").withColumn("at", level(F.col("first"), F.col("last")))
    rows = rows.withColumn("buckets", bucket(F.col("last"), F.col("at")) - bucket(F.col("first"), F.col("at")) + 1)
    assert {r["buckets"] for r in rows.collect()} <= {1, 2}


# The skew-proof join


def skewed(spark, n=40_000):
    """Half of all rows have the key 7, a few the key null, the others 1,000 keys."""
    return spark.range(n).selectExpr("CASE WHEN id % 2 = 0 THEN 7 WHEN id % 101 = 0 THEN NULL ELSE id % 1000 END AS k", "id AS v")


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_skew_join_equals_a_plain_join(spark, how, broadcast_rows):
    large = skewed(spark, 5000).union(spark.createDataFrame([(7, 1), (7, 1), (None, 1)], "k long, v long"))  # equal rows count each
    small = spark.createDataFrame([(7, "a"), (7, "b"), (3, "c"), (None, "d"), (5000, "e")], "k long, w string")
    got = skew_join(large, small, "k", how, broadcast_rows=broadcast_rows, tasks=4)
    assert got.columns == ["k", "v", "w"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, large.join(small, "k", how).collect()), key=repr)
    for a, b in ((large.limit(0), small), (large, small.limit(0)), (large.where("k = 7"), small)):
        assert sorted(map(tuple, skew_join(a, b, "k", how, broadcast_rows=broadcast_rows).collect()), key=repr) == sorted(map(tuple, a.join(b, "k", how).collect()), key=repr)
    with pytest.raises(ValueError):
        skew_join(large, small, "k", "right")


def test_heavy_keys_are_found_and_counted(spark):
    found, n = heavy_keys(skewed(spark), F.col("k"), 0.05)
    assert [k for k, _ in found] == [7] and n == skewed(spark).where("k is not null").count() and found[0][1] <= 20_040
    strings = skewed(spark).select(F.concat(F.lit("k"), "k").alias("k"))
    assert [k for k, _ in heavy_keys(strings, F.col("k"), 0.05)[0]] == ["k7"]


def test_largest_task_of_a_salted_join_is_within_twice_the_median(spark):
    large, small = skewed(spark), spark.range(1000).selectExpr("id AS k", "id * 2 AS w")
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(held, ("false", "-1", "8")):
            spark.conf.set(k, v)
        per = lambda df: [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).orderBy("n").collect()]
        plain_tasks, salted = per(large.join(small, "k")), skew_join(large, small, "k", broadcast_rows=0)
        assert plain_tasks[-1] > 5 * plain_tasks[len(plain_tasks) // 2]
        n = per(salted)
        # The union has the tasks of both parts; those of the hot key alone are alike, and no task is far above the others.
        hot = per(salted.where("k = 7"))
        assert hot[-1] <= 2 * hot[len(hot) // 2] and n[-1] <= 2.5 * sum(n) / len(n)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


# Nearest vectors


@pytest.mark.parametrize("block", [3, 1000])
def test_nearest_vectors_equal_brute_force(spark, block):
    import numpy as np

    draw = np.random.default_rng(block)
    rows = [(k, [round(float(x), 1) for x in draw.normal(size=4)]) for k in range(300)]
    rows += [(1000 + k, [0.5, 0.5, 0.0, 0.0]) for k in range(30)]  # ties
    odd = [(5000, None), (5001, [1.0, None, 0.0, 0.0]), (5002, [float("nan")] * 4), (None, [0.0] * 4), (5003, [1.0]), (5004, [])]
    base = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(5)
    queries = base.where("vec_id % 10 = 0")
    got = sorted((r["query"], r["rank"], r["id"], r["distance"]) for r in nearest_vectors(queries, base, 7, block=block).collect())
    want = []
    for q, x in rows:
        if q % 10 == 0:
            d = sorted((round(sum((a - b) ** 2 for a, b in zip(x, y)) ** 0.5, 6), i) for i, y in rows)[:7]
            want += [(q, k, i, far) for k, (far, i) in enumerate(d, 1)]
    assert [r[:3] for r in got] == [r[:3] for r in sorted(want)] and all(a[3] == pytest.approx(b[3], abs=1e-6) for a, b in zip(got, sorted(want)))
    assert len(nearest_vectors(queries.limit(1), base.limit(0), 3).collect()) == len(nearest_vectors(queries.limit(0), base, 3).collect()) == 0
    few = nearest_vectors(base.where("vec_id = 1"), base.where("vec_id < 2"), 5).collect()
    assert sorted(r["id"] for r in few) == [0, 1]


# Recursion


def test_reachability_with_cycles_equals_brute_force(spark):
    rng = random.Random(4)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(70)] + [(5, 5), (None, 3), (3, None), (100, 101), (101, 100), (101, 102), (102, 103), (103, 104)]
    start = [0, 7, 100, None]
    far, edge = {x: 0 for x in start if x is not None}, [x for x in start if x is not None]
    while edge:
        edge = sorted({b for a, b in links if a in edge and b is not None} - set(far))
        far |= {b: max(far.values()) + 1 for b in edge}
    frame = spark.createDataFrame(links, "src long, dst long")
    seeds = spark.createDataFrame([(x,) for x in start], "node long")
    found = {r["node"]: r["hops"] for r in reachable(frame, seeds).collect()}
    assert set(found) == set(far) and found[104] == 4 and found[101] == 1
    assert {r["node"] for r in reachable(frame, seeds, most_rounds=1).collect()} == {k for k, h in found.items() if h <= 1}
    assert reachable(frame, seeds.limit(0)).collect() == [] and reachable(frame.limit(0), seeds).count() == 3
