"""Hard-negative mining by distributed radix selection.

Each anchor has positives, the k best rows of its label; each anchor and positive has a window
of scores, from a part of the positive's score to a larger part of it, and wants the best
rows of other labels in it. Both are the same problem: the k best rows of a window. It is
solved without sorting scores and without listing them: tasks count, for each window, the scores
by their leading digit (up to DIGIT bits); the sums over all tasks tell in which bucket the kth score
lies; the next pass counts that bucket's scores by the next digit, until the kth score is
known. Then one more pass gathers the rows that reach it. Ties at the kth score go by id, of
which a task need keep k.

A task sends only the buckets from the top down to the one where its own count reaches k: no
bucket below can hold the kth score of all. So it sends at most k counts a window, whatever
the data, and a label or a score that a third of all rows have costs no more than another.

Plan: rows are cleaned and written once. Anchors go out in blocks of about ANCHORS by hash
(ANCHORS x dimensions x 8 bytes, the bound of what is broadcast), and each block makes 2 to 3
passes over the rows for each of the two selections and one to gather: matrix products of row slices
and anchor slices, so memory is some tiles of TILE x TILE scores and a histogram of a block.
Only counts, and the gathered rows, are shuffled. The driver holds one block of anchors with its windows. The
work is anchors x rows, as every score must be known.

Scores are whole numbers and exact: products of doubles where no sum can pass 2^53, else of
64-bit integers.

Defined results: rows with a null id, a null label, a null or empty vector, or a null, NaN or infinite entry
take no part; neither do rows of another length than the most common (of equals the largest), nor entries so large that
a score may not fit a long. Rows of one id are one row: of several, the first by label and
vector. Fewer positives or negatives than asked: all there are; an anchor without positive, or a window
without negative, gives no row. A negative or zero positive score has the window that the inequalities give (none,
or the score 0). An empty table gives an empty result. Extra columns aren't carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ready_for_python, slices

#: Anchors in a block on average, and rows or anchors in a tile of scores.
ANCHORS, TILE = 2048, 1024
#: Bits of a digit at most: buckets of a window's histogram.
DIGIT = 9
#: Gathered rows of a task at which those beyond the k best of each window go.
GATHERED = 1 << 16


@dataclass(frozen=True)
class Mining:
    #: Positives of an anchor, and negatives of a positive.
    positives: int = 5
    negatives: int = 3
    #: low * positive <= whole * negative <= high * positive
    low: int = 50
    high: int = 95
    whole: int = 100
    scale: float = 256


@dataclass(frozen=True)
class Windows:
    """Windows of the anchors of a block: an array with a row an anchor, and a column each of its windows."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    #: Whether rows of the anchor's label are sought, or those of others.
    same: bool
    low: np.ndarray
    high: np.ndarray

    def tiles(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(row ids, first anchor, window, rows, anchors, scores) of the scores in each window, tile by tile; the last three are arrays side by side."""
        wide = int(np.abs(self.x).max(initial=0))
        for whole in batches:
            for batch in slices(whole, TILE):
                ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                exact = np.float64 if wide * int(np.abs(x).max(initial=0)) * x.shape[1] < 1 << 53 else np.int64
                for at in range(0, len(self.ids), TILE):
                    part = slice(at, at + TILE)
                    s = x.astype(exact) @ self.x[part].T.astype(exact)
                    fits = labels[:, None] == self.labels[None, part]
                    fits = fits & (ids[:, None] != self.ids[None, part]) if self.same else ~fits
                    for w in range(self.low.shape[1]):
                        r, c = np.nonzero(fits & (s >= self.low[None, part, w]) & (s <= self.high[None, part, w]))
                        if len(r):
                            yield ids, at, w, r, c, s[r, c].astype(np.int64)


def digit_counts(rows: DataFrame, windows: Windows, prefix: np.ndarray, need: np.ndarray, shift: int, bits: int) -> DataFrame:
    """(w, bucket, n, need): how many scores of each window, from its low end and with the prefix before this digit, have this digit."""
    sent, n, size = rows.sparkSession.sparkContext.broadcast((windows, prefix, need)), prefix.size, 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, prefix, need = sent.value
        per = prefix.shape[1]
        total = np.zeros(n * size, np.int64)
        for _, at, w, _, c, score in windows.tiles(batches):
            offset = score - windows.low[at + c, w]
            own = (need[at + c, w] > 0) & (offset >> (shift + bits) == prefix[at + c, w])
            c, offset = c[own], offset[own]
            cell = ((at + c) * per + w) * size + ((offset >> shift) & (size - 1))
            first = at * per * size
            found = np.bincount(cell - first)
            total[first : first + len(found)] += found
        counts = total.reshape(n, size)
        # What lies above each bucket in this task: where it is enough, the kth score isn't in the bucket.
        above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
        w, bucket = np.nonzero((counts > 0) & (above < need.reshape(-1, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(bucket), pa.array(counts[w, bucket]), pa.array(need.reshape(-1)[w])], names=["w", "bucket", "n", "need"])

    return rows.mapInArrow(count, "w long, bucket long, n long, need long")


def kth_scores(rows: DataFrame, windows: Windows, k: int) -> np.ndarray:
    """The kth best score of each window; of windows with fewer, the low end."""
    width = int((windows.high - windows.low).max(initial=0))
    total = max(1, width.bit_length())
    n_digits = -(-total // DIGIT)
    bits = -(-total // n_digits)
    prefix, need = np.zeros(windows.low.shape, np.int64), np.where(windows.high >= windows.low, k, 0)
    down = Window.partitionBy("w").orderBy(F.desc("bucket"))
    for digit in reversed(range(n_digits)):
        counts = digit_counts(rows, windows, prefix, need, digit * bits, bits).groupBy("w", "bucket").agg(F.sum("n").alias("n"), F.first("need").alias("need"))
        reached = counts.withColumn("above", F.sum("n").over(down) - F.col("n")).where("above < need and need <= above + n")
        found = reached.select("w", "bucket", "above").collect()  # one row a window of the block at most
        left, at = np.zeros(need.size, np.int64), [r["w"] for r in found]
        left[at] = need.reshape(-1)[at] - [r["above"] for r in found]
        bucket = np.zeros(need.size, np.int64)
        bucket[at] = [r["bucket"] for r in found]
        # Windows with fewer than k rows are not found at the first digit, and are done.
        need, prefix = left.reshape(need.shape), np.where(left.reshape(need.shape) > 0, (prefix << bits) | bucket.reshape(need.shape), 0)
    return windows.low + prefix


def best_rows(rows: DataFrame, windows: Windows, kth: np.ndarray, k: int) -> DataFrame:
    """(w, anchor, id, score, rank): the k best rows of each window; only rows that reach its kth score are gathered."""
    sent = rows.sparkSession.sparkContext.broadcast((windows, kth))

    def best(found: np.ndarray) -> np.ndarray:
        """Of rows (window, score, id) the k best of each window."""
        found = found[np.lexsort((found[:, 2], -found[:, 1], found[:, 0]))]
        start = np.r_[True, found[1:, 0] != found[:-1, 0]]
        place = np.arange(len(found)) - np.maximum.accumulate(np.where(start, np.arange(len(found)), 0))
        return found[place < k]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, kth = sent.value
        per = kth.shape[1]
        parts, held = [np.zeros((0, 3), np.int64)], 0
        for ids, at, w, r, c, score in windows.tiles(batches):
            own = score >= kth[at + c, w]
            parts.append(np.stack([(at + c[own]) * per + w, score[own], ids[r[own]]], axis=1))
            held += len(parts[-1])
            if held > GATHERED:
                parts = [best(np.concatenate(parts))]
                held = 0
        found = best(np.concatenate(parts))
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(windows.ids[found[:, 0] // per]), pa.array(found[:, 2]), pa.array(found[:, 1])], names=["w", "anchor", "id", "score"])

    order = Window.partitionBy("w").orderBy(F.desc("score"), "id")
    return rows.mapInArrow(gather, "w long, anchor long, id long, score long").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def clean_rows(rows: DataFrame, id: str, label: str, vector: str, scale: float) -> DataFrame:
    """(id, label, x, norm2) of the rows that take part; x are whole numbers, norm2 their squares' sum."""
    inf = F.lit(float("inf"))
    there = F.forall("v", lambda c: F.coalesce(F.abs(c) < inf, F.lit(False)))
    # So that d * x^2 fits a long.
    small = F.forall("v", lambda c: F.abs(c.cast("double") * float(scale)) < F.sqrt(F.lit(2.0**62) / F.size("v")) - 1)
    some = rows.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").alias("v"))
    some = some.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False)) & F.coalesce(there, F.lit(False)) & F.coalesce(small, F.lit(False)))
    x = F.transform("v", lambda c: F.floor(c.cast("double") * float(scale)))
    one = some.select("id", "label", x.alias("x")).groupBy("id").agg(F.min(F.struct("label", "x")).alias("r"))
    return one.select("id", "r.label", "r.x", F.aggregate("r.x", F.lit(0).cast("long"), lambda s, c: s + c * c).alias("norm2"))


def hard_negatives(rows: DataFrame, id: str = "vec_id", label: str = "label", vector: str = "embedding", anchor: Column | None = None, m: Mining = Mining(), block: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchor: a condition on the column id, by default id divisible by 50."""
    spark = rows.sparkSession
    ready_for_python(spark)
    scratch = Scratch(spark, "mine")
    written = scratch.write(clean_rows(rows, id, label, vector, m.scale), "rows")
    lengths = written.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.max("norm2").alias("norm2")).orderBy(F.desc("n"), F.desc("d")).first()
    held = written.where(F.size("x") == (lengths["d"] if lengths else 0))
    chosen = F.pmod(F.col("id"), F.lit(50)) == 0 if anchor is None else anchor
    anchors = scratch.write(held.where(chosen), "anchors")
    n_blocks = -(-anchors.count() // block)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = scratch.write(spark.createDataFrame([], schema), "negatives")
    for b in range(n_blocks):
        some = anchors.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b).orderBy("id").collect()  # about a block
        if not some:
            continue
        ids, labels, x = (np.array([r[c] for r in some], np.int64) for c in ("id", "label", "x"))
        bound = math.isqrt(lengths["norm2"] * max(r["norm2"] for r in some)) + 1  # no score is larger
        around = np.full((len(ids), 1), bound, np.int64)
        near = Windows(ids, labels, x, True, -around, around)
        first = best_rows(held, near, kth_scores(held, near, m.positives), m.positives).collect()  # m.positives rows an anchor
        positive, score = np.zeros((len(ids), m.positives), np.int64), np.zeros((len(ids), m.positives), np.int64)
        low, high = np.ones_like(score), np.zeros_like(score)  # no window
        for r in first:
            at = r["w"], r["rank"] - 1
            positive[at], score[at] = r["id"], r["score"]
            low[at], high[at] = -(-m.low * r["score"] // m.whole), m.high * r["score"] // m.whole
        far = Windows(ids, labels, x, False, low, high)
        last = best_rows(held, far, kth_scores(held, far, m.negatives), m.negatives)
        pairs = spark.createDataFrame([(r["w"] * m.positives + r["rank"] - 1, r["id"], r["score"]) for r in first] or [], "w long, positive_id long, positive_score long")
        named = last.join(F.broadcast(pairs), "w")  # m.positives rows an anchor of the block
        named.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(out._scratch_path)
    scratch.drop(written, anchors)
    return spark.read.schema(schema).parquet(out._scratch_path)
