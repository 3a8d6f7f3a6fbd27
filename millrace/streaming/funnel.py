"""A keyed funnel with timers: transformWithState over value, list and map state in RocksDB.

A user's events wait in a list until the watermark has passed them, so that they are
taken in event-time order whatever batches they come in. Then a small automaton goes on: a
view begins (and begins anew), a click after it goes on, a purchase after that ends the funnel with a
row, all within a span from the view. A timer at the end of the span clears what has begun, so
a user without events holds two counters and no more. State is a user's pending events (bounded by the
lateness that the watermark allows), one funnel, and a count for each kind of event.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..sources.tables import ship_by_value
from .events import event_stream, run_now

#: Kinds of events, in the order of the funnel.
STEPS = ("view", "click", "purchase")
#: Span from the view to the purchase.
WITHIN_S = 7 * 86_400
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROW = "user_id long, view_us long, click_us long, buy_us long, n_views long"


def _ms(us: int) -> int:
    """The first millisecond that is not before a microsecond."""
    return -(-us // 1000)


class Funnel(StatefulProcessor):
    """Rows (user_id, kind, us) in; a row for each finished funnel out."""

    def __init__(self, within_us: int, row: str = ROW):
        self.within_us = within_us
        self.names = [c.split()[0] for c in row.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "us long, kind int")
        self.begun = handle.getValueState("begun", "view_us long, click_us long")
        self.counts = handle.getMapState("counts", "kind int", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = [(int(us), int(kind)) for frame in rows for us, kind in zip(frame["us"], frame["kind"])]
        if new:
            self.pending.appendList(new)
            self.handle.registerTimer(_ms(min(new)[0]))  # one a batch: the next ones follow when it fires
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All that the watermark has passed, with each state read and written once."""
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        waiting = sorted((us, kind) for us, kind in self.pending.get())
        due, later = [e for e in waiting if _ms(e[0]) <= now], [e for e in waiting if _ms(e[0]) > now]
        before = begun = self.begun.get() if self.begun.exists() else None
        done = []
        if due:
            kinds = {kind for _, kind in due} | {0}
            counts = {kind: self.counts.getValue((kind,))[0] if self.counts.containsKey((kind,)) else 0 for kind in kinds}
            for us, kind in due:
                counts[kind] += 1
                view, click = begun or (None, None)
                if kind == 0:
                    begun = (us, None)
                elif view is not None and us - view > self.within_us:
                    begun = None
                elif kind == 1 and view is not None and click is None:
                    begun = (view, us)
                elif kind == 2 and click is not None:
                    done.append((key[0], view, click, us, counts[0]))
                    begun = None
            for kind, n in counts.items():
                if n:
                    self.counts.updateValue((kind,), (n,))
            if later:
                self.pending.put(later)
                self.handle.registerTimer(_ms(later[0][0]))
            else:
                self.pending.clear()
        if begun is not None and self._end(begun) <= now:
            begun = None  # too late for this view
        if begun is None and before is not None:
            self.begun.clear()
        elif begun != before:
            self.begun.update(begun)
            self.handle.registerTimer(self._end(begun))
        if done:
            yield pd.DataFrame(done, columns=self.names)

    def _end(self, begun: tuple) -> int:
        """The millisecond from which on nothing can end what has begun."""
        return _ms(begun[0] + self.within_us + 1)

    def close(self) -> None:
        pass


@contextmanager
def rocksdb_state(spark: SparkSession):
    """State of the streams that start within is kept by RocksDB, off the heap."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def funnels(events: DataFrame, within_s: int = WITHIN_S) -> DataFrame:
    """The stream of finished funnels of a stream of events with a watermark on ts; start it within rocksdb_state()."""
    ship_by_value(__name__)
    kind = F.array_position(F.array(*map(F.lit, STEPS)), F.col("event_type")) - 1
    rows = events.where(F.col("event_type").isin(*STEPS)).select("user_id", kind.cast("int").alias("kind"), F.unix_micros("ts").alias("us"), "ts")
    return rows.groupBy("user_id").transformWithStateInPandas(Funnel(within_s * 1_000_000), ROW, "append", "eventtime")


def c52_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View, click, purchase within a week by user, of events that the watermark has passed."""
    with rocksdb_state(spark):
        return run_now(funnels(event_stream(spark, sf_dir)), "funnel")
