"""Every query outside llm against DuckDB, and what has no SQL twin against a bound."""

import datetime

import pytest
from compare import assert_same, duck

from millrace.plans.catalog import ORACLES, QUERIES
from millrace.streaming.events import late_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_duckdb(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir)


def test_all_but_sketches_have_sql():
    assert set(QUERIES) - set(ORACLES) == {"c18_approx_distinct"}


def test_approx_distinct_is_near(spark, sf_dir):
    exact = dict(duck(sf_dir).execute("SELECT l_returnflag, count(DISTINCT l_partkey) FROM lineitem GROUP BY 1").fetchall())
    for row in QUERIES["c18_approx_distinct"](spark, sf_dir).collect():
        assert abs(row["approx_parts"] - exact[row["l_returnflag"]]) <= 0.15 * exact[row["l_returnflag"]]


def test_late_rows_are_dropped(spark):
    at = lambda minute: datetime.datetime(2024, 1, 1, 12) + datetime.timedelta(minutes=minute)
    first = spark.createDataFrame([(at(1),), (at(2),), (at(60),)], "ts timestamp")
    second = spark.createDataFrame([(at(3),), (at(61),), (at(200),)], "ts timestamp")  # minute 3 is 47 minutes behind the watermark
    found = {row["start"].strftime("%H:%M"): row["n"] for row in late_rows(spark, first, second).collect()}
    assert found == {"12:00": 2, "13:00": 2}


def test_region_revenue_reads_few_columns(spark, sf_dir):
    plan = QUERIES["c04_region_revenue"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" in plan and "o_orderdate" not in plan and "o_orderpriority" not in plan


def test_entry_imports_without_llm(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parent.parent
    shutil.copytree(repo / "millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); assert not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_entry_keeps_the_other_queries_without_a_package():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; assert 'c01_scan' in e.queries() and not any(q.startswith('op') for q in e.queries()) and 'c01_scan' in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, check=True, timeout=120)


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from millrace.sources.tables import folder_name

    there = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master))
    assert folder_name(there("yarn", "hdfs://x/"), "a").startswith("hdfs://x/millrace-a-")
    assert folder_name(there("local[4]", None), "a")
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(ValueError, match="checkpoint"):
            folder_name(there(master, None), "a")


def test_tasks_of_a_partitioned_write_grow_with_its_rows(spark, sf_dir):
    from millrace.sources.sinks import dealt

    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    for rows_a_file in (10_000, 1000, 200):
        tasks = dealt(lines, "l_returnflag", "l_orderkey", rows_a_file)
        n = sum(-(-r["count"] // rows_a_file) for r in lines.groupBy("l_returnflag").count().collect())
        assert tasks.rdd.getNumPartitions() == n and tasks.count() == lines.count() and tasks.columns == lines.columns


def test_no_task_of_a_partitioned_write_has_two_parts(spark):
    """Each task has one value and about rows_a_file rows, a null and a hot value too, and no shuffle before brings a value to one task."""
    from collections import Counter

    from millrace.sources.sinks import dealt

    rows = spark.range(40_000).selectExpr("id", "CASE WHEN id % 4 = 0 THEN concat('v', id % 12) WHEN id % 101 > 0 THEN 'hot' END AS g")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = dealt(rows, "g", "id", 1000)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        found = Counter((r["t"], r["g"]) for r in out.selectExpr("spark_partition_id() AS t", "g").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len({t for t, _ in found}) == len(found) and max(found.values()) < 1250 and sum(found.values()) == 40_000


def test_grouped_map_takes_many_customers_a_call(spark, tmp_path):
    """Calls grow with rows, not with customers; large keys, customers whose total is null and orders without a customer."""
    from millrace.functions.udfs import c43_grouped_map

    rows = spark.range(6000).selectExpr("id AS o_orderkey", "IF(id % 7 = 0, NULL, 9007199254740992 + id % 1500) AS o_custkey", "IF(id % 1500 = 3 OR id % 11 = 0, NULL, round(pmod(xxhash64(id), 90000) / 100D + 1, 2)) AS o_totalprice")
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    for more in ({}, {"rows_a_group": 500}):
        df = c43_grouped_map(spark, str(tmp_path), **more)
        assert "FlatMapGroupsInPandas [bucket" in df._jdf.queryExecution().optimizedPlan().toString()
        assert_same(df, ORACLES["c43_grouped_map"], str(tmp_path))


def test_table_function_takes_batches(spark, tmp_path):
    """Empty and null names, spaces at the ends and in a row, and more rows than a batch has; no row is joined with its own call."""
    rows = spark.range(25_000).selectExpr("IF(id = 9, NULL, id) AS p_partkey", "CASE id % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' ' WHEN 3 THEN ' a  b ' WHEN 4 THEN 'größe rot' ELSE concat('w', id) END AS p_name")
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    df = QUERIES["c44_udtf"](spark, str(tmp_path))
    assert "ArrowEvalPythonUDTF" in df._jdf.queryExecution().executedPlan().toString()
    assert_same(df, ORACLES["c44_udtf"], str(tmp_path))


def test_percentiles_with_ties_nulls_and_other_steps(spark):
    import random
    import statistics

    from millrace.operators.relational import exact_percentiles

    rng = random.Random(1)
    rows = [(g, rng.choice([7.25, 7.25, -3.5, round(rng.uniform(-5000, 5000), 2)])) for g in ("a", "b", None) for _ in range(200)] + [("a", None), ("one", 4.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    for steps in ((1000.0, 1.0), (100.0,), ()):
        found = {r["g"]: (r["low"], r["mid"]) for r in exact_percentiles(df, "g", "v", {"low": 0.1, "mid": 0.5}, steps).collect()}
        for g in ("a", "b", None, "one"):
            x = sorted(v for h, v in rows if h == g and v is not None)
            at = 0.1 * (len(x) - 1)
            low = x[int(at)] + (x[min(int(at) + 1, len(x) - 1)] - x[int(at)]) * (at - int(at))
            assert found[g] == (pytest.approx(low, abs=1e-3), pytest.approx(statistics.median(x), abs=1e-3))


def test_range_sums_meet_few_rows(spark, sf_dir):
    """However many customers have one balance, a part meets a sum for it."""
    text = QUERIES["c08_range_join"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and text.index("partial_count") > text.index("Join")  # summed below the join


def test_range_sums_are_by_price_not_by_part(spark, tmp_path):
    """Parts of one price share its sums, so nothing is generated for each part; bands at the borders of blocks, below zero and without customers."""
    balances = [None, 0.0, -999.85, -5.0, 5.0, 5.01, 10.01, 10.02, 100.1, 100.1, 904.99, 910.01, 955.55]
    prices = [None, 0.0, 5.0, 5.01, 15.02, -1000.0, 500.0, 900.0, 910.01, *[950.55] * 50]
    spark.createDataFrame(list(enumerate(balances)), "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k // 2, x) for k, x in enumerate(prices)], "p_partkey long, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    df = QUERIES["c08_range_join"](spark, str(tmp_path))
    assert_same(df, ORACLES["c08_range_join"], str(tmp_path))
    logical = df._jdf.queryExecution().optimizedPlan().toString()
    assert "inline(" not in logical and "sequence(" not in logical


def test_scratch_folders_go_with_the_driver(tmp_path):
    """A driver of its own writes a table and ends; its folder is gone."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "{tmp_path}/shared").getOrCreate()
from millrace.sources.tables import shared_folder
path = shared_folder(spark, "x")
spark.range(3).write.parquet(path)
assert spark.read.parquet(path).count() == 3
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, check=True, timeout=180)
    assert not [x for x in os.listdir(tmp_path / "shared") if x.startswith("millrace-")]
