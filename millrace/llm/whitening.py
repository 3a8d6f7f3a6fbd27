"""Embedding whitening from column aggregates over the upper triangle.

Vectors become whole numbers, x = floor(scale * c) + shift. The fit list holds each distinct
x vector once. Two aggregations over it, each of generated SQL expressions, are all that
the corpus is read for: the sums of every dimension, exact, and then, with the means known,
the sum of the centred products of every pair of dimensions i <= j (for 64 dimensions 2,080
sums in one aggregation). The driver puts these d (d + 1) / 2 numbers into the covariance and
has LAPACK decompose it. Rows are centred and projected on the leading components.

Centring is exact before it is rounded: x less the whole part of the mean is a whole number,
and only the fraction of the mean, below 1, is a double. So the shift costs no digits.

Plan: one map over the rows; one shuffle, of the distinct vectors, for the fit list, with
copies gone in the tasks; sums are taken in the tasks and one row meets in the driver; one
map over the rows for the result. Nothing is broadcast but a d x components matrix. Memory
is bounded by an Arrow batch and by the sums. More than MOST_PAIRS pairs (over 90 dimensions)
are dealt to several aggregations of that many, as a plan of 10^5 expressions takes
Spark minutes to compile.

Defined results: a null vector, or one with a null, NaN or infinite entry, is dropped. So is
one whose length isn't the most common one (of equally common ones the largest); an empty
vector has no components and gives no row. Repeated rows each get their rows, and are one
vector of the fit list. Entries beyond +-1e15 / scale count as that. A covariance of rank r
has min(r, components) components: of a single distinct vector none, and no row comes out.
deviation is null where it doesn't fit a long. An empty table gives an empty result. Only the id and
the results are returned, so extra columns don't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ready_for_python, slices

#: Sums that one aggregation may have.
MOST_PAIRS = 4096
#: Largest absolute value of scale * c.
MOST = 1e15
#: Eigenvalues below this part of their sum are rounding errors of zero.
LEAST_EIGENVALUE = 1e-12


@dataclass(frozen=True)
class Fit:
    """What was learned: n distinct vectors, their sums, eigenvalues (falling) and unit eigenvectors as columns."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as its whole part and the rest, from 0 to below 1."""
        parts = [divmod(s, self.n) for s in self.sums]
        return np.array([q for q, _ in parts], np.int64), np.array([r / self.n for _, r in parts])

    def projection(self) -> np.ndarray:
        """Columns that take a centred vector to its whitened components."""
        return self.vectors / np.sqrt(self.values)


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))


def whole_numbers(vector: Column, scale: float, shift: int) -> Column:
    """floor(scale * c) + shift of each entry c, as a double, in longs."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), c.cast("double") * float(scale)))) + F.lit(shift).cast("long"))


def pair_sums(rows: DataFrame, terms: list[str]) -> np.ndarray:
    """The symmetric matrix of sum(a * b) over every two of the terms, SQL expressions, from generated sums of the upper triangle."""
    d = len(terms)
    # No term is null; said to Spark, its sums do without a test each, which halves their time.
    rows = rows.selectExpr(*[f"coalesce({t}, 0D) AS c{i}" for i, t in enumerate(terms)])
    pairs, out = [(i, j) for i in range(d) for j in range(i, d)], np.zeros((d, d))
    for at in range(0, len(pairs), MOST_PAIRS):
        some = pairs[at : at + MOST_PAIRS]
        for (i, j), s in zip(some, rows.selectExpr(*[f"sum(c{i} * c{j}) AS s{i}_{j}" for i, j in some]).first()):
            out[i, j] = out[j, i] = s
    return out


def fit_list(rows: DataFrame, x: str = "x") -> DataFrame:
    """Each distinct vector once; equal ones meet in the tasks first."""
    return rows.groupBy(x).agg(F.lit(1).alias("one")).select(x)


def fit(distinct: DataFrame, d: int, components: int) -> Fit | None:
    """The leading components of the covariance (divisor n) of distinct's column x; None of no rows."""
    sums = distinct.agg(F.count("*"), *[F.expr(f"sum(CAST(x[{i}] AS DECIMAL(19, 0)))") for i in range(d)]).first()
    n, sums = sums[0], [int(s or 0) for s in sums[1:]]
    if not n:
        return None
    whole = [divmod(s, n) for s in sums]
    # Sums of products of whole numbers and fractions below 1: as exact as doubles are.
    v = pair_sums(distinct, [f"(CAST(x[{i}] - {q}L AS DOUBLE) - {r / n!r}D)" for i, (q, r) in enumerate(whole)]) / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(np.trace(v))
    k = min(components, int((values > LEAST_EIGENVALUE * trace).sum())) if trace > 0 else 0
    vectors = vectors[:, :k] * np.where(vectors[np.abs(vectors[:, :k]).argmax(axis=0), range(k)] < 0, -1.0, 1.0)  # the largest entry is positive
    return Fit(n, sums, trace, values[:k].copy(), vectors)


def project(rows: DataFrame, keep: list[str], model: Fit) -> DataFrame:
    """keep, deviation and whitened (an array) of rows with a column x."""
    q, rest = model.centre()
    p = model.projection()
    n, sums = model.n, np.array(model.sums, object)
    offset = rest @ p
    kinds = dict(rows.dtypes)

    def deviation(x: np.ndarray) -> list[int | None]:
        near = n * ((x - q).astype(float) - rest)
        most = (near * near).sum(axis=1)
        if most.max(initial=0) < 2.0**62 and np.abs(near).max(initial=0) < 2.0**31 and n * np.abs(x).max(initial=0).astype(float) < 2.0**62:
            exact = n * x - sums.astype(np.int64)
            return (exact * exact).sum(axis=1).tolist()
        exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
        return [e if e < 1 << 63 else None for e in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1024):
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                w = (x - q).astype(float) @ p - offset
                arrays = [*(batch.column(c) for c in keep), pa.array(deviation(x), pa.int64()), pa.array(list(w), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "deviation", "whitened"])

    return rows.select(*keep, "x").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "deviation long", "whitened array<double>"]))


def identity_error(distinct: DataFrame, model: Fit) -> float:
    """Largest absolute entry of the covariance of the whitened fit list less the identity, measured on its rows."""
    k = len(model.values)
    white = project(distinct, [], model)
    means = np.array([s or 0.0 for s in white.agg(*[F.expr(f"sum(whitened[{i}])") for i in range(k)]).first()]) / model.n
    v = pair_sums(white, [f"(whitened[{i}] - {float(m)!r}D)" for i, m in enumerate(means)]) / model.n
    return float(np.abs(v - np.eye(k)).max())


def whiten(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", scale: float = 64, shift: int = 1_000_000, components: int = 16) -> DataFrame:
    """A row for each row and component: id, component (from 1), n, deviation, whitened, explained, identity_error."""
    spark = rows.sparkSession
    ready_for_python(spark)
    scratch = Scratch(spark, "whiten")
    kind = dict(rows.dtypes)[id]
    x = whole_numbers(F.col(f"`{vector}`"), scale, shift)
    clean = scratch.write(rows.where(finite(F.col(f"`{vector}`"))).select(F.col(f"`{id}`").alias("id"), x.alias("x")), "rows")
    lengths = clean.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("m")).orderBy(F.desc("m"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    model, error = None, 0.0
    if d:
        clean = clean.where(F.size("x") == d)
        distinct = scratch.write(fit_list(clean), "distinct")
        model = fit(distinct, d, components)
        if len(model.values):
            error = identity_error(distinct, model)
        scratch.drop(distinct)
    if model is None or not len(model.values):
        return spark.createDataFrame([], f"`{id}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    explained = F.array(*[F.lit(float(e) / model.trace) for e in model.values])
    out = project(clean, ["id"], model).select(F.col("id").alias(id), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(id, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
