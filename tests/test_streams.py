"""Streaming operators beyond the bounded runs: timers, replays, late and repeated rows."""

import datetime

import pytest
from compare import duck
from pyspark.sql import functions as F

from millrace.streaming.events import LATE, run_now
from millrace.streaming.funnel import ROW, Funnel, funnels, rocksdb_state
from millrace.streaming.upsert import Snapshot, upsert_now

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def at(minute):
    return START + datetime.timedelta(minutes=minute)


def event_files(spark, folder, *files):
    """A stream of a file a batch: rows (user, kind, minute)."""
    rows = [[(u, k, at(m)) for u, k, m in f] for f in files]
    for k, f in enumerate(rows):
        spark.createDataFrame(f, "user_id long, event_type string, ts timestamp").coalesce(1).write.parquet(f"{folder}/{k:03}")
    return spark.readStream.schema("user_id long, event_type string, ts timestamp").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder)).withWatermark("ts", LATE)


def minutes(rows):
    us = int(START.timestamp() * 1e6)
    return sorted((r["user_id"], *((r[c] - us) // 60_000_000 for c in ("view_us", "click_us", "buy_us")), r["n_views"]) for r in rows)


def test_funnel_takes_events_in_order_across_batches(spark, tmp_path):
    stream = event_files(
        spark,
        tmp_path / "in",
        [(1, "click", 5), (1, "view", 1), (2, "view", 0), (3, "view", 2)],
        [(1, "purchase", 9), (2, "click", 8), (1, "view", 3), (3, "purchase", 9)],  # user 1 views again at 3, before the click at 5
        [(2, "purchase", 12), (9, "view", 500)],
        [(9, "view", 501)],
    )
    with rocksdb_state(spark):
        found = run_now(funnels(stream, within_s=3600), "test", str(tmp_path / "out")).collect()
    assert minutes(found) == [(1, 3, 5, 9, 2), (2, 0, 8, 12, 1)]


def test_a_timer_ends_the_funnel_and_its_state(spark, tmp_path):
    """The purchase of user 1 is a minute late for its view; user 2's is just in time; a view after the end begins anew."""
    stream = event_files(
        spark,
        tmp_path / "in",
        [(1, "view", 0), (2, "view", 0), (1, "click", 1), (2, "click", 2)],
        [(1, "purchase", 61), (2, "purchase", 60), (1, "click", 62), (1, "purchase", 63)],
        [(1, "view", 100), (1, "click", 101), (1, "purchase", 102)],
        [(9, "view", 900)],
        [(9, "view", 901)],
    )
    with rocksdb_state(spark):
        found = run_now(funnels(stream, within_s=3600), "test", str(tmp_path / "out")).collect()
    assert minutes(found) == [(1, 100, 101, 102, 2), (2, 0, 2, 60, 1)]
    # No list of waiting events and no begun funnel is left of users 1 and 2; the counts stay.
    state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "out/state"))
    assert {r["key"]["user_id"] for r in state("begun").collect()} <= {9}
    assert {r["key"]["user_id"] for r in state("counts").collect()} >= {1, 2}


def test_funnel_timer_clears_without_further_events():
    """The processor alone, by a handle that keeps its states: a timer past the span clears what has begun."""

    class Held:
        def __init__(self):
            self.x = None

        exists = lambda self: self.x is not None
        get = lambda self: self.x

        def update(self, x):
            self.x = x

        def clear(self):
            self.x = None

    class Listed:
        def __init__(self):
            self.x = []

        get = lambda self: iter(self.x)

        def appendList(self, more):
            self.x += more

        def put(self, x):
            self.x = x

        def clear(self):
            self.x = []

    class Mapped(dict):
        containsKey, getValue, updateValue = dict.__contains__, dict.__getitem__, dict.__setitem__

    class Handle:
        timers = []
        getValueState = lambda self, *a: Held()
        getListState = lambda self, *a: Listed()
        getMapState = lambda self, *a: Mapped()
        registerTimer = lambda self, ms: self.timers.append(ms)

    class Fired:
        def __init__(self, ms):
            self.getExpiryTimeInMs = lambda: ms

    class Passed:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    import pandas as pd

    f = Funnel(1_000_000, ROW)
    f.init(Handle())
    assert list(f.handleInputRows((7,), iter([pd.DataFrame({"us": [2_000_001, 1_500], "kind": [1, 0]})]), None)) == []
    assert Handle.timers == [2]
    assert list(f.handleExpiredTimer((7,), Passed(500), Fired(2))) == []
    # The click waits for its own timer; the view has one at the end of its span.
    assert f.begun.get() == (1500, None) and f.pending.x == [(2_000_001, 1)] and Handle.timers == [2, 2001, 1002]
    assert list(f.handleExpiredTimer((7,), Passed(1500), Fired(1002))) == []
    assert not f.begun.exists() and f.pending.x == [(2_000_001, 1)]
    list(f.handleExpiredTimer((7,), Passed(3000), Fired(2001)))
    assert f.pending.x == [] and f.counts == {(0,): (1,), (1,): (1,)}


SCHEMA = "k string, at long, v double, gone boolean"


def upserted(spark, folder, **more):
    return Snapshot(spark, f"{folder}/table", spark.createDataFrame([], SCHEMA).schema, ["k"], ["at"], **{"buckets": 4} | more)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_upsert_merges_and_a_replayed_batch_changes_nothing(spark, tmp_path):
    s = upserted(spark, tmp_path, deleted="gone")
    assert s.read().collect() == [] and s.versions() == []
    batch = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    first = batch(("a", 1, 1.0, None), ("b", 5, 2.0, False), ("a", 3, 9.0, False), (None, 1, 4.0, None))
    s.merge(first, 0)
    assert rows_of(s.read()) == [("a", 3, 9.0, False), ("b", 5, 2.0, False), (None, 1, 4.0, None)]
    folders = s._folders("data")
    s.merge(first, 0)
    s.merge(batch(("a", 99, 0.0, False)), 0)  # a number that is committed already
    assert s._folders("data") == folders and rows_of(s.read()) == [("a", 3, 9.0, False), ("b", 5, 2.0, False), (None, 1, 4.0, None)]
    s.merge(batch(("a", 2, 7.0, False), ("b", 6, None, True), ("c", 0, 1.0, False), ("c", 0, 3.0, False)), 1)  # a's row is late, b goes, c ties
    assert rows_of(s.read()) == [("a", 3, 9.0, False), ("c", 0, 3.0, False), (None, 1, 4.0, None)]
    assert rows_of(s.read(0)) == [("a", 3, 9.0, False), ("b", 5, 2.0, False), (None, 1, 4.0, None)]
    s.merge(batch(("b", 7, 8.0, False)), 2)
    s.merge(batch(), 3)  # an empty batch
    assert ("b", 7, 8.0, False) in rows_of(s.read()) and s.versions() == [0, 1, 2, 3]
    before = rows_of(s.read())
    assert s.vacuum(1) > 0 and rows_of(s.read()) == before and s.versions() == [3]


def test_upsert_writes_only_what_a_batch_touches(spark, tmp_path):
    s = upserted(spark, tmp_path, buckets=32)
    s.merge(spark.range(500).selectExpr("concat('k', id) AS k", "0L AS at", "0D AS v", "false AS gone"), 0)
    s.merge(spark.createDataFrame([("k7", 1, 5.0, False)], SCHEMA), 1)
    old, new = s._parts(0), s._parts(1)
    assert len(new) == 32 and sum(old[b] != new[b] for b in new) == 1
    assert s.read().count() == 500 and s.read().where("v = 5").count() == 1


def test_upsert_after_a_failure_between_data_and_commit(spark, tmp_path, monkeypatch):
    s = upserted(spark, tmp_path)
    rows = spark.createDataFrame([("a", 1, 1.0, False)], SCHEMA)
    s.merge(rows, 0)
    with monkeypatch.context() as m:
        m.setattr(s, "_parts", lambda v, f=s._parts: (f(v), 1 / 0)[0])
        with pytest.raises(ZeroDivisionError):
            s.merge(spark.createDataFrame([("a", 2, 2.0, False)], SCHEMA), 1)
    # Data of an attempt, and a manifest without _SUCCESS, are no version.
    spark.createDataFrame([(0, "nowhere")], "bucket int, folder string").write.parquet(f"{s.root}/manifest/1")
    import os

    os.remove(f"{s.root}/manifest/1/_SUCCESS")
    assert s.versions() == [0] and rows_of(s.read()) == [("a", 1, 1.0, False)]
    s.merge(spark.createDataFrame([("a", 2, 2.0, False)], SCHEMA), 1)
    assert rows_of(s.read()) == [("a", 2, 2.0, False)]


def test_upsert_stream_of_several_batches_equals_sql(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.select("user_id", "event_id", "value").repartition(5, F.col("event_id") % 5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, event_id long, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    s = Snapshot(spark, str(tmp_path / "table"), stream.schema, ["user_id"], ["event_id"], buckets=8)
    upsert_now(stream, s, str(tmp_path / "state"))
    assert len(s.versions()) > 1
    want = duck(sf_dir).execute("SELECT user_id, max(event_id), arg_max(value, event_id) FROM events GROUP BY 1").fetchall()
    assert rows_of(s.read()) == sorted(want, key=repr)
    upsert_now(stream, s, str(tmp_path / "other"))  # all batches again, by a checkpoint that has forgotten them
    assert rows_of(s.read()) == sorted(want, key=repr)
