"""Event sequences and gap filling against brute force, odd rows, and keys longer than a block."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.sequences import Step, fill_grid, match_sequences


def brute_matches(rows, pattern, within):
    """Every way to read the pattern off a key's events, one event or a run a step, as the docstring says."""
    out = []
    for key in {r[0] for r in rows if r[0] is not None}:
        own = sorted((at, kind) for k, at, kind in rows if k == key and at is not None and kind is not None)
        runs = [(kind, [at for at, _ in g]) for kind, g in itertools.groupby(own, key=lambda r: r[1])]
        m = len(pattern)
        for i in range(len(runs) - m + 1):
            some = runs[i : i + m]
            if any(kind != s.kind for (kind, _), s in zip(some, pattern)) or any(not s.more and len(at) != 1 for (_, at), s in list(zip(some, pattern))[1:-1]):
                continue
            head = some[0][1] if pattern[0].more else some[0][1][-1:]
            end = (some[-1][1] if pattern[-1].more else some[-1][1][:1]) if m > 1 else some[0][1][-1:]
            timely = [at for at in head if end[-1] - at <= within]
            if timely:
                out.append((key, timely[0], end[-1], len(timely) + sum(len(at) for _, at in some[1:-1]) + (len(end) if m > 1 else 0)))
    return sorted(out)


@pytest.mark.parametrize("text", ["v+ c p", "v c p", "v c+ p+", "v+", "c", "v+ p", "p c v c+ p"])
def test_sequences_equal_brute_force(spark, text):
    pattern, rng = [Step(x[0], x.endswith("+")) for x in text.split()], random.Random(text)
    rows = []
    for key in (1, 2, 3):
        rows += [(key, at, rng.choice("vvccp")) for at in rng.sample(range(1000), 150)]
    rows += [(None, 5, "v"), (None, 6, "c"), (9, None, "v"), (9, 3, None), (9, 4, "v")]
    df = spark.createDataFrame(rows, "k long, us long, e string")
    for within in (3, 60, 10_000):
        got = sorted(map(tuple, match_sequences(df, "k", ["us"], "e", "us", pattern, within).collect()))
        assert got == brute_matches(rows, pattern, within), within
    assert match_sequences(df.limit(0), "k", ["us"], "e", "us", pattern, 5).collect() == []


def test_patterns_that_say_nothing_are_refused(spark):
    df = spark.createDataFrame([(1, 1, "v")], "k long, us long, e string")
    for pattern in ([], [Step("v"), Step("v", True)]):
        with pytest.raises(ValueError):
            match_sequences(df, "k", ["us"], "e", "us", pattern, 5)


def brute_fill(rows, step):
    out = []
    for key in {r[0] for r in rows}:
        own = {at: v for k, at, v in rows if k == key and at is not None}
        if not own:
            continue
        known = sorted(at for at, v in own.items() if v is not None)
        for at in range(min(own), max(own) + step, step):
            before, after = [x for x in known if x <= at], [x for x in known if x >= at]
            a, b = before[-1] if before else None, after[0] if after else None
            linear = own[a] if a == at else own[a] + (own[b] - own[a]) * (at - a) / (b - a) if a is not None and b is not None else None
            out.append((key, at, own.get(at), own[a] if a is not None else None, None if linear is None else round(linear, 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_filled_grids_equal_brute_force(spark, block):
    rng = random.Random(block)
    rows = [(key, at * 10, rng.choice([None, float(rng.randint(-9, 9))])) for key in ("a", "b", None) for at in rng.sample(range(-60, 60), 25)]
    rows += [("none", 0, None), ("none", 500, None), ("one", 70, 1.5), ("c", None, 2.0), ("far", -1000, 1.0), ("far", 3000, 5.0)]
    df = spark.createDataFrame(rows, "k string, at long, v double")
    got = fill_grid(df, ["k"], "at", "v", 10, block).withColumn("linear", F.round("linear", 6))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_fill(rows, 10)
    assert fill_grid(df.limit(0), ["k"], "at", "v", 10, block).collect() == []
