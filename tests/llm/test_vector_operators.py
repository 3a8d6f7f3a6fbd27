"""op12 and op13 against brute-force versions, and odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import hard_negatives as mining
from millrace.llm import whitening
from millrace.llm.queries import QUERIES

NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


# op12


def brute_whitening(rows, scale=64, shift=1_000_000, components=16):
    """{(id, component): (n, deviation, |whitened|, explained)} and the fit list's whitened covariance."""
    kept = [(i, [math.floor(scale * float(c)) + shift for c in v]) for i, v in rows]
    fit = np.array(sorted({tuple(x) for _, x in kept}), object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = np.array([[float(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    v = centred.T @ centred / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    out = {}
    for i, x in kept:
        w = np.array([float(n * a - s) / n for a, s in zip(x, sums)]) @ axes / np.sqrt(values)
        for k, (a, e) in enumerate(zip(w, values), 1):
            out[i, k] = (n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), abs(a), e / np.trace(v))
    return out


def test_whitening_equals_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    want = brute_whitening([tuple(r) for r in rows.collect()])
    found = QUERIES["op12_embedding_whitening"](spark, sf_dir).collect()
    assert len(found) == len(want) == 16 * rows.count()
    for r in found:
        n, deviation, white, explained = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["whitened"]) == pytest.approx(white, rel=1e-7, abs=1e-9) and r["explained"] == pytest.approx(explained, rel=1e-9)
        assert r["identity_error"] < 1e-9
    by = {}
    for r in found:
        by.setdefault(r["vec_id"], {})[r["component"]] = r["whitened"]
    white = np.array([[v[k] for k in range(1, 17)] for v in by.values()])
    assert np.abs(np.cov(white.T, bias=True) - np.eye(16)).max() < 1e-9


def test_whitening_of_odd_rows(spark):
    rows = [(1, [1.0, 2.0, 0.5], 0), (1, [1.0, 2.0, 0.5], 0), (2, [1.0, 2.0, 0.5], 0), (3, [0.0, 1.0, -0.25], 0), (4, [0.3, -1.0, 4.0], 0), (None, [5.0, 0.2, 1.0], 0)]
    odd = [(5, None, 0), (6, [1.0, None, 2.0], 0), (7, [1.0, NAN, 2.0], 0), (8, [1.0, INF, 2.0], 0), (9, [1.0, -INF, 2.0], 0), (10, [1.0], 0), (11, [], 0)]
    df = vectors(spark, rows + odd).withColumns({c: F.lit("x") for c in ("n", "x", "id", "component", "whitened", "deviation")})
    found = whitening.whiten(df).collect()
    want = brute_whitening([(i, [np.float32(c) for c in v]) for i, v, _ in rows])
    assert sorted((r["vec_id"] or -1, r["component"]) for r in found) == sorted((i or -1, k) for i, _, _ in rows for k in (1, 2, 3))
    for r in found:
        n, deviation, white, explained = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (4, deviation) and abs(r["whitened"]) == pytest.approx(white, abs=1e-9) and r["explained"] == pytest.approx(explained)
    schema = whitening.whiten(df).dtypes
    for none in (df.limit(0), df.where("vec_id = 5"), df.where("vec_id = 11"), df.where("vec_id in (1, 2)")):  # nothing to fit, or one point
        empty = whitening.whiten(none)
        assert empty.collect() == [] and empty.dtypes == schema


def test_whitening_of_fewer_dimensions_than_rank(spark):
    df = vectors(spark, [(k, [float(k), 2.0 * k, 1.0], 0) for k in range(10)])  # rank 1
    found = whitening.whiten(df).collect()
    assert {r["component"] for r in found} == {1} and found[0]["explained"] == pytest.approx(1)
    assert np.var([r["whitened"] for r in found]) == pytest.approx(1)


def test_pair_sums_in_several_aggregations(spark, monkeypatch):
    x = np.random.default_rng(1).normal(size=(40, 7))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>")
    monkeypatch.setattr(whitening, "MOST_PAIRS", 5)
    assert np.allclose(whitening.pair_sums(df, [f"x[{i}]" for i in range(7)]), x.T @ x)


def test_whitening_deviation_beyond_a_long(spark):
    df = vectors(spark, [(k, [(-1) ** k * 1e12, float(k)], 0) for k in range(4)])
    assert {r["deviation"] for r in whitening.whiten(df).collect()} == {None}


def test_whitening_sums_in_one_aggregation_of_tasks(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("embedding").alias("x"))
    plan = rows.selectExpr("x[0] AS c0", "x[1] AS c1").selectExpr("sum(c0 * c1) AS s")._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan


# op13


def brute_negatives(rows, m=mining.Mining(), anchor=lambda i: i % 50 == 0):
    x = {i: [math.floor(m.scale * float(c)) for c in v] for i, v, _ in rows}
    y = {i: label for i, _, label in rows}
    out = []
    for a in filter(anchor, x):
        score = {i: sum(p * q for p, q in zip(x[a], v)) for i, v in x.items()}
        near = sorted((i for i in x if i != a and y[i] == y[a]), key=lambda i: (-score[i], i))[: m.positives]
        for p in near:
            far = sorted((i for i in x if y[i] != y[a] and m.low * score[p] <= m.whole * score[i] <= m.high * score[p]), key=lambda i: (-score[i], i))
            out += [(a, p, k, i, score[p], score[i]) for k, i in enumerate(far[: m.negatives], 1)]
    return sorted(out)


def test_hard_negatives_equal_brute_force(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found = QUERIES["op13_hard_negatives"](spark, sf_dir)
    assert dict(found.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    got = sorted(map(tuple, found.collect()))
    assert got == brute_negatives(rows) and len(got) > 100


@pytest.mark.parametrize("block", [3, 1000])
def test_hard_negatives_with_ties_copies_and_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(mining, "TILE", 16)
    monkeypatch.setattr(mining, "GATHERED", 20)
    monkeypatch.setattr(mining, "DIGIT", 3)
    draw = np.random.default_rng(block)
    rows = [(k, [round(float(c), 1) for c in draw.normal(size=3)], int(draw.integers(3))) for k in range(0, 400, 5)]
    rows += [(k, [0.5, 0.5, 0.0], 1) for k in range(1001, 1041)]  # a group of copies, many ties
    rows += [(k, [0.4, 0.4, 0.0], 2) for k in range(1101, 1141)]
    rows += [(50_000, [0.0, 0.0, 0.0], 1), (50_050, [-1.0, -1.0, -1.0], 9), (50_100, [1e5, 1e5, 1e5], 1)]
    got = sorted(map(tuple, mining.hard_negatives(vectors(spark, rows).repartition(5), block=block).collect()))
    assert got == brute_negatives(rows)
    assert any(a == 50_100 for a, *_ in got) and not any(a == 50_050 for a, *_ in got)  # the only row of its label has no positive


def test_hard_negatives_with_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.8, 0.0], 2), (3, [0.7, 0.7], 2)]
    odd = [(4, None, 1), (5, [1.0, None], 1), (6, [1.0, NAN], 1), (7, [INF, 0.0], 1), (8, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (9, [1.0], 1), (10, [], 1), (11, [3e30, 1.0], 2)]
    copies = [(2, [0.8, 0.0], 2), (3, [0.9, 0.0], 7), (1, [0.0, 0.0], 3)]  # of one id the first by label and vector counts
    df = vectors(spark, rows + odd + copies).withColumns({c: F.lit("x") for c in ("id", "x", "v", "score", "rank", "norm2")})
    assert sorted(map(tuple, mining.hard_negatives(df).collect())) == brute_negatives(rows)
    empty = mining.hard_negatives(df.limit(0))
    assert empty.collect() == [] and empty.dtypes == mining.hard_negatives(df).dtypes
    assert mining.hard_negatives(df.where("vec_id = 0")).collect() == []


def test_tasks_send_few_counts_of_each_window(spark):
    """Whatever the data, at most k buckets of a window leave a task."""
    ids = np.arange(4, dtype=np.int64)
    x = np.ones((4, 2), np.int64)
    w = mining.Windows(ids * 50, ids * 0, x, True, np.full((4, 1), -(10**6)), np.full((4, 1), 10**6))
    rows = spark.range(20_000).selectExpr("id + 1000 AS id", "0L AS label", "array(id % 997, id % 13) AS x").repartition(3)
    counts = mining.digit_counts(rows, w, np.zeros((4, 1), np.int64), np.full((4, 1), 5), 12, 9)
    assert counts.count() <= 3 * 4 * 5
    assert (mining.kth_scores(rows, w, 5) == sorted((k % 997 + k % 13 for k in range(20_000)), reverse=True)[4]).all()
