"""Table functions and the Python data source: odd rows, batches, failures, pruning."""

import datetime
import json
import os
import random

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringStartsWith

from millrace.functions import table_functions as tf
from millrace.sources import range_files as rf

START = datetime.datetime(2024, 1, 1)


# Table functions


def brute_sessions(rows, gap):
    """(key, start, last, n, sum, max) of (key, ts, x)."""
    out = []
    for key in {r[0] for r in rows}:
        run = []
        for _, at, x in sorted((r for r in rows if r[0] == key and r[1] is not None), key=lambda r: r[1]):
            if run and (at - run[-1][0]).total_seconds() >= gap:
                out.append((key, run))
                run = []
            run.append((at, x))
        if run:
            out.append((key, run))
    fold = lambda f, run: f([x for _, x in run if x is not None]) if any(x is not None for _, x in run) else None
    return sorted(((k, run[0][0], run[-1][0], len(run), fold(sum, run), fold(max, run)) for k, run in out), key=repr)


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_session_functions_equal_brute_force(spark, batch):
    rng = random.Random(batch)
    rows = [(rng.choice([1, 2, 3, None]), START + datetime.timedelta(seconds=rng.randint(0, 4000)), rng.choice([None, 1, 5, -7])) for _ in range(300)]
    rows += [(1, None, 9), (4, None, None)]
    df = spark.createDataFrame(rows, "k long, ts timestamp_ntz, x int")
    tf.register(spark)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = spark.sql("SELECT k, start, last, n, sum_x, max_x FROM session_summary(TABLE({t}), 'k', 'ts', 60)", t=df).collect()
        assert sorted(map(tuple, got), key=repr) == brute_sessions(rows, 60)
        us = [(k, at, x) for k, at, x in rows if k is not None and at is not None]
        flat = spark.createDataFrame([(k, round((at - START).total_seconds() * 1e6)) for k, at, _ in us], "user_id long, us long")
        got = spark.sql("SELECT * FROM session_batches(TABLE({t}) PARTITION BY user_id ORDER BY (us), 60000000L)", t=flat).collect()
        micros = lambda at: round((at - START).total_seconds() * 1e6)
        assert sorted(map(tuple, got)) == sorted((k, micros(a), micros(b), n) for k, a, b, n, *_ in brute_sessions(us, 60))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_summary_columns_follow_the_table(spark):
    tf.register(spark)
    df = spark.createDataFrame([("a", START, 1.5, 2, "x", True)], "who string, at timestamp_ntz, d double, i byte, s string, b boolean")
    found = spark.sql("SELECT * FROM session_summary(TABLE({t}), 'who', 'at', 10)", t=df)
    assert found.dtypes == [("who", "string"), ("start", "timestamp_ntz"), ("last", "timestamp_ntz"), ("n", "bigint"), ("sum_d", "double"), ("max_d", "double"), ("sum_i", "bigint"), ("max_i", "bigint")]
    assert found.collect()[0][3:] == (1, 1.5, 1.5, 2, 2)
    assert spark.sql("SELECT * FROM session_summary(TABLE({t}), 'who', 'at', 10)", t=df.limit(0)).collect() == []
    for wrong in ("'nobody', 'at', 10", "'who', 'd', 10", "'who', 'at', 0", "'who', 'at', NULL"):
        with pytest.raises(PySparkException):
            spark.sql(f"SELECT * FROM session_summary(TABLE({{t}}), {wrong})", t=df)


def test_batches_hold_one_open_session():
    """Whatever the batches of a partition, what is kept between them is four numbers."""
    f, out = tf.SessionBatches(), []
    for at in range(0, 1000, 10):
        batch = pa.record_batch({"user_id": pa.array([7] * 10), "us": pa.array(range(at, at + 10))})
        out += list(f.eval(batch, pa.array([5])))
        assert f.open == (7, 0, at + 9, at + 10)
    assert out == [] and [t.to_pylist() for t in f.terminate()] == [[{"user_id": 7, "first": 0, "last": 999, "n": 1000}]]


# The data source


def rows_of(df):
    return sorted(map(repr, df.collect()))


def stored(path):
    return sorted(f for _, _, files in os.walk(f"{path}/data") for f in files if f.endswith(".arrow"))


def test_round_trip_of_odd_values(spark, tmp_path):
    rf.register(spark)
    rows = [
        (1, "a", 1.5, datetime.date(2024, 2, 29), START, True, [1, None], b"x", "é\n"),
        (2, None, float("nan"), None, None, None, None, None, None),
        (None, "", float("-inf"), datetime.date(1, 1, 1), datetime.datetime(9999, 12, 31, 23, 59, 59, 999999), False, [], b"", "z" * 100_000),
    ]
    df = spark.createDataFrame(rows, "i long, s string, d double, day date, at timestamp_ntz, b boolean, xs array<int>, raw binary, long string")
    path = str(tmp_path / "t")
    df.repartition(2).write.format("range_files").mode("append").save(path)
    back = spark.read.format("range_files").load(path)
    assert back.dtypes == df.dtypes and rows_of(back) == rows_of(df)
    df.write.format("range_files").mode("append").save(path)
    assert spark.read.format("range_files").load(f"file://{path}").count() == 6
    df.limit(1).write.format("range_files").mode("overwrite").save(path)
    assert spark.read.format("range_files").load(path).count() == 1 and len(stored(path)) == 1
    df.limit(0).write.format("range_files").mode("overwrite").save(path)
    empty = spark.read.format("range_files").load(path)
    assert empty.collect() == [] and empty.dtypes == df.dtypes and stored(path) == []
    with pytest.raises(PySparkException):
        df.select("i").write.format("range_files").mode("append").save(path)
    with pytest.raises(PySparkException):
        spark.read.format("range_files").load(str(tmp_path / "nothing")).collect()


def test_filters_read_fewer_partitions_and_lose_no_row(spark, tmp_path):
    rf.register(spark)
    path = str(tmp_path / "t")
    df = spark.range(1000).selectExpr("IF(id % 50 = 0, NULL, id) AS id", "concat('k', lpad(id, 4, '0')) AS s", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, int(id)) AS at", "id * 0.5D AS d")
    df.repartitionByRange(8, "s").write.format("range_files").mode("append").save(path)
    back = lambda: spark.read.format("range_files").load(path)
    parts = lambda x: x.rdd.getNumPartitions()
    assert parts(back()) == len(stored(path)) == 8
    for where, most in {
        "id = 500": 1,
        "id >= 990": 1,
        "id > 5 AND id < 20": 1,
        "id IN (3, 999)": 2,
        "s LIKE 'k05%'": 2,
        "s = 'k0999'": 1,
        "at < timestamp_ntz'2024-01-01 00:01:00'": 1,
        "d <= 10": 1,
        "id IS NULL": 8,
        "id <=> 7": 1,
        "id = 5000": 1,
        "id % 2 = 0": 8,
    }.items():
        found = back().where(where)
        assert parts(found) <= most, where
        assert rows_of(found) == rows_of(df.where(where)), where


def test_may_pass():
    column = lambda low, high, nulls: {"rows": 10, "columns": {"c": {"low": low, "high": high, "nulls": nulls}}}
    file, at = column(5, 9, 1), ("c",)
    assert [rf.may_pass(EqualTo(at, x), file) for x in (4, 5, 9, 10, "x", None)] == [False, True, True, False, True, True]
    assert [rf.may_pass(GreaterThan(at, 9), file), rf.may_pass(GreaterThanOrEqual(at, 9), file), rf.may_pass(LessThan(at, 5), file), rf.may_pass(LessThanOrEqual(at, 5), file)] == [False, True, False, True]
    assert rf.may_pass(In(at, (1, 2)), file) is False and rf.may_pass(In(at, (1, 6)), file) and rf.may_pass(IsNull(at), file) and rf.may_pass(EqualNullSafe(at, None), file)
    none, full = column(None, None, 10), column(None, None, 0)
    assert not rf.may_pass(EqualTo(at, 1), none) and not rf.may_pass(IsNotNull(at), none) and rf.may_pass(EqualTo(at, 1), full) and not rf.may_pass(IsNull(at), full)
    assert rf.may_pass(StringStartsWith(at, "ab"), column("aa", "ac", 0)) and not rf.may_pass(StringStartsWith(at, "ad"), column("aa", "ac", 0))
    for unknown in (Not(EqualTo(at, 6)), StringContains(at, "x"), EqualTo(("d",), 1), EqualTo(("c", "inner"), 1)):
        assert rf.may_pass(unknown, file)


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    rf.register(spark)
    path = str(tmp_path / "t")
    spark.range(10).write.format("range_files").mode("append").save(path)
    before = stored(path)
    bad = spark.range(0, 5000, 1, 4).select(F.when(F.col("id") == 4900, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(PySparkException):
        bad.write.format("range_files").mode("append").save(path)
    assert stored(path) == before and spark.read.format("range_files").load(path).count() == 10


def test_two_jobs_can_not_commit_the_same_number(tmp_path):
    folder = rf.Folder(str(tmp_path))
    folder.commit(1, {"schema": "{}", "files": []})
    with pytest.raises(RuntimeError):
        folder.commit(1, {"schema": "{}", "files": [1]})
    assert folder.newest() == (1, {"schema": "{}", "files": []})
    assert os.listdir(tmp_path / "manifest") == ["00000001.json"] and json.loads((tmp_path / "manifest/00000001.json").read_text())["files"] == []
