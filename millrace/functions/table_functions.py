"""Table functions that take a table: partitions in order, one pass, memory of a batch.

session_summary tells its output columns from the table that it is given (analyze), and asks
Spark for the partitioning, the order and the columns that it needs, so a caller names none of them
twice. session_batches does the fixed part of it over Arrow batches. Both keep one open session
of a partition, whatever its rows, and give it out when a gap or the partition's end closes it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn

from ..sources.tables import ship_by_value, table


class SessionSummary:
    """session_summary(TABLE(t), key, at, gap_s): key, start, last and n of each session, and sum_<c> and max_<c> of every other numeric column c of t.

    A session ends where at, a timestamp, is gap_s seconds or more after the row before. Rows with a null at are in no
    session; a null number is left out of its sum and maximum, which are null without any. Null keys are one partition.
    """

    @staticmethod
    def analyze(t: AnalyzeArgument, key: AnalyzeArgument, at: AnalyzeArgument, gap_s: AnalyzeArgument) -> AnalyzeResult:
        if not t.isTable:
            raise ValueError("the first argument must be a table")
        if not all(x.isConstantExpression and x.value is not None for x in (key, at, gap_s)):
            raise ValueError("key, at and gap_s must be constants")
        fields = {f.name: f.dataType for f in t.dataType.fields}
        for name in (key.value, at.value):
            if name not in fields:
                raise ValueError(f"the table has no column {name}, only {', '.join(fields)}")
        if not isinstance(fields[at.value], (T.TimestampType, T.TimestampNTZType)):
            raise ValueError(f"{at.value} must be a timestamp")
        if gap_s.value <= 0:
            raise ValueError("gap_s must be positive")
        measures = [(c, T.LongType() if isinstance(kind, T.IntegralType) else T.DoubleType()) for c, kind in fields.items() if isinstance(kind, (T.IntegralType, T.FractionalType)) and not isinstance(kind, T.DecimalType) and c != key.value]
        schema = T.StructType([T.StructField(key.value, fields[key.value]), T.StructField("start", fields[at.value]), T.StructField("last", fields[at.value]), T.StructField("n", T.LongType())])
        for c, kind in measures:
            schema = schema.add(f"sum_{c}", kind).add(f"max_{c}", kind)
        return AnalyzeResult(
            schema=schema,
            partitionBy=[PartitioningColumn(key.value)],
            orderBy=[OrderingColumn(at.value)],
            select=[SelectedColumn(c) for c in (key.value, at.value, *(c for c, _ in measures))],
        )

    def __init__(self):
        self.open: list | None = None

    def eval(self, row: Row, key: str, at: str, gap_s: int) -> Iterator[tuple]:
        when = row[at]
        if when is None:
            return
        numbers = [row[c] for c in row.__fields__ if c not in (key, at)]
        if self.open is not None and (when - self.open[2]).total_seconds() >= gap_s:
            yield self._closed()
        if self.open is None:
            self.open = [row[key], when, when, 0, [[None, None] for _ in numbers]]
        self.open[2] = when
        self.open[3] += 1
        for held, x in zip(self.open[4], numbers):
            if x is not None:
                held[0], held[1] = (x, x) if held[0] is None else (held[0] + x, max(held[1], x))

    def _closed(self) -> tuple:
        key, start, last, n, held = self.open
        self.open = None
        return (key, start, last, n, *(x for pair in held for x in pair))

    def terminate(self) -> Iterator[tuple]:
        if self.open is not None:
            yield self._closed()


class SessionBatches:
    """session_batches(TABLE(t) PARTITION BY user_id ORDER BY us, gap_us): user_id, first, last and n of each session, from Arrow batches of (user_id, us)."""

    SCHEMA = "user_id long, first long, last long, n long"

    def __init__(self):
        self.open: tuple[int | None, int, int, int] | None = None

    def eval(self, batch: pa.RecordBatch, gap_us: pa.Array) -> Iterator[pa.Table]:
        us = batch.column("us").to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(us):
            return
        user, gap = batch.column("user_id")[0].as_py(), gap_us[0].as_py()
        starts = np.flatnonzero(np.r_[self.open is None or us[0] - self.open[2] >= gap, np.diff(us) >= gap])
        if self.open is not None:  # the session that came in goes to where the first new one starts
            until = starts[0] if len(starts) else len(us)
            if until:
                self.open = (user, self.open[1], int(us[until - 1]), self.open[3] + int(until))
        if len(starts):
            ends = np.r_[starts[1:], len(us)]
            rows = [*([self.open] if self.open is not None else []), *((user, int(us[a]), int(us[b - 1]), int(b - a)) for a, b in zip(starts, ends))]
            self.open = rows.pop()
            if rows:
                yield self._table(rows)

    def terminate(self) -> Iterator[pa.Table]:
        if self.open is not None:
            yield self._table([self.open])

    @staticmethod
    def _table(rows: list[tuple]) -> pa.Table:
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("user_id", "first", "last", "n"), zip(*rows))})


def register(spark: SparkSession) -> None:
    """Both functions, for SQL."""
    ship_by_value(__name__)
    spark.udtf.register("session_summary", F.udtf(SessionSummary))
    spark.udtf.register("session_batches", F.arrow_udtf(SessionBatches, returnType=SessionBatches.SCHEMA))


def c54_session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users with sums of what the events have; the columns follow the table's."""
    register(spark)
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.round(F.col("value") * 100).cast("long").alias("cents"), "event_type")
    return spark.sql("SELECT * FROM session_summary(TABLE({events}), 'user_id', 'ts', 86400)", events=events)


def c54_session_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users from ordered Arrow batches."""
    register(spark)
    events = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return spark.sql("SELECT * FROM session_batches(TABLE({events}) PARTITION BY user_id ORDER BY (us), 86400000000L)", events=events)
