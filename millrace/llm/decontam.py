"""Benchmark decontamination with suffix arrays over the training documents.

Every Arrow batch of documents is a shard (its bytes are bounded). The shard's words
become ids of the test vocabulary, its suffixes are sorted by prefix doubling, and all
test suffixes are binary-searched in it at once: their interval is narrowed word by
word to its window, and every location is followed to its longest verbatim match. Only suffixes that
start a run of test words as long as the shortest window are sorted, since no other one
can match a window; the sort is as deep as the longest window, and matches go on from there.

Plan: one map over the documents without a shuffle. The test set passes the driver and is
sent out in blocks of bounded size, of which at most blocks_at_once are held anywhere: a
larger test set takes a pass over the documents for each so many blocks, which carries on
what the passes before have found, in the shared folder.

Defined results: a null or empty document has no words and isn't contaminated. A null or
wordless test item never occurs; a null item id counts as an empty string. An item of
fewer words than the window is one window. Repeated items and rows are handled each by
itself; item ids are listed once. Extra columns are carried, those with the name of a
measure, or of what passes hand on (__hits and so on), are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, byte_texts, ready_for_python

#: Lower-cases A-Z and makes a space of every byte of [\x00-\x2F\x3A-\x60\x7B-\x7F].
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

MEASURES = (
    ("n_words", "long", pa.int64()),
    ("n_hit", "long", pa.int64()),
    ("items", "array<string>", pa.list_(pa.string())),
    ("longest_match", "long", pa.int64()),
    ("longest_item", "string", pa.string()),
    ("longest_at", "long", pa.int64()),
    ("contaminated", "boolean", pa.bool_()),
)


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class TestSet:
    """A block of test items as word ids: every item's words, then a 0."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        found = [(name, w) for name, text in items if (w := words(text))]
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        self.names = [name for name, _ in found]
        sizes = np.array([len(w) for _, w in found], np.int64)
        self.ids = np.zeros(int(sizes.sum()) + len(found) + 1, np.int32)
        starts, self.item, self.window, at = [], [], [], 0
        for k, (_, w) in enumerate(found):
            self.ids[at : at + len(w)] = [number(x, len(self.vocabulary) + 1) for x in w]
            n = min(window, len(w))
            # Suffixes that are shorter than their window can't match one.
            starts.append(np.arange(at, at + len(w) - n + 1))
            self.item += [k] * len(starts[-1])
            self.window += [n] * len(starts[-1])
            at += len(w) + 1
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.item, self.window = np.array(self.item, np.int64), np.array(self.window, np.int64)
        self.least = int(self.window.min()) if len(self.window) else 0


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ids, sorted by what follows them, to this depth at least."""
    rank = ids.astype(np.int64)
    order, known = np.argsort(rank, kind="stable"), 1
    while known < depth:
        after = np.zeros_like(rank)
        after[:-known] = rank[known:] if known < len(rank) else 0
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        steps = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty_like(rank)
        rank[order] = steps + 1
        known *= 2
        if len(steps) and steps[-1] == len(steps) - 1:
            break
    return order


def _bound(ids: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, target: np.ndarray, right: bool) -> np.ndarray:
    """For each interval of the suffix array, where the word at depth reaches (passes) the target."""
    lo, hi = lo.copy(), hi.copy()
    while (active := lo < hi).any():
        mid = (lo + hi) >> 1
        at = ids[np.minimum(order[np.minimum(mid, len(order) - 1)] + depth, len(ids) - 1)]
        on = active & ((at <= target) if right else (at < target))
        lo = np.where(on, mid + 1, lo)
        hi = np.where(active & ~on, mid, hi)
    return lo


def _lengths(ids: np.ndarray, at: np.ndarray, tests: np.ndarray, test: int, known: int) -> np.ndarray:
    """How many words match from each position on; known words do."""
    size, more, step = np.full(len(at), known), np.arange(len(at)), 0
    while len(more) and step < 64:
        word = tests[test + size[more]]
        more = more[(word > 0) & (ids[np.minimum(at[more] + size[more], len(ids) - 1)] == word)]
        size[more] += 1
        step += 1
    for k in more:  # very long matches, each in one comparison
        a, b = ids[at[k] :], tests[test:]
        n = min(len(a), len(b))
        size[k] = int(np.argmax(np.append((a[:n] != b[:n]) | (b[:n] == 0), True)))
    return size


class Shard:
    """The words of some documents as ids of the test vocabulary, 0 for other words and between documents."""

    def __init__(self, texts: list[bytes], tests: TestSet):
        get, parts, self.n_words = tests.vocabulary.get, [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            w = words(text)
            self.n_words[k] = len(w)
            parts.append(np.fromiter((get(x, 0) for x in w), np.int32, len(w)))
            parts.append(np.zeros(1, np.int32))
        self.ids = np.concatenate(parts) if parts else np.zeros(1, np.int32)
        self.first = np.concatenate([[0], np.cumsum(self.n_words + 1)])[:-1]

    def search(self, tests: TestSet) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(item, window, interval, its positions in the shard, where a longest match starts, match lengths).

        One for each test suffix whose window occurs; equal windows have equal intervals.
        """
        if not tests.least:
            return
        # Runs of test words that are long enough, packed one after another with a 0 after each.
        known = np.concatenate([[0], (self.ids > 0).view(np.int8), [0]])
        begin, end = np.flatnonzero(np.diff(known) == 1), np.flatnonzero(np.diff(known) == -1)
        long = end - begin >= tests.least
        begin, end = begin[long], end[long]
        if not len(begin):
            return
        keep = np.zeros(len(self.ids) + 1, np.int8)
        np.add.at(keep, begin, 1)
        np.add.at(keep, np.minimum(end + 1, len(self.ids)), -1)  # the 0 that ends the run too
        place = np.flatnonzero(np.cumsum(keep[:-1]))
        packed = np.concatenate([self.ids[place], [0]])
        order = suffix_array(packed, int(tests.window.max()))
        lo = np.searchsorted(packed[order], tests.ids[tests.starts], "left")
        hi = np.searchsorted(packed[order], tests.ids[tests.starts], "right")
        live, depth = np.flatnonzero(lo < hi), 1
        lo, hi = lo[live], hi[live]
        while len(live):
            for q in np.flatnonzero(tests.window[live] == depth):
                test, at = int(tests.starts[live[q]]), order[lo[q] : hi[q]]
                # A match that goes on to the left is counted at its start.
                starts = at[(at == 0) | (packed[at - 1] != tests.ids[test - 1])] if test and tests.ids[test - 1] else at
                yield int(tests.item[live[q]]), depth, int(lo[q]), place[at], place[starts], _lengths(packed, starts, tests.ids, test, depth)
            target = tests.ids[tests.starts[live] + depth]
            left = _bound(packed, order, lo, hi, depth, target, False)
            right = _bound(packed, order, left, hi, depth, target, True)
            on = (left < right) & (target > 0) & (tests.window[live] > depth)
            live, lo, hi, depth = live[on], left[on], right[on], depth + 1


#: What one pass leaves to the next: hit ranges of words, items, and the longest match so far.
_FOUND = (("__hits", "binary", pa.binary()), ("__items", "array<string>", pa.list_(pa.string())), ("__best", "long", pa.int64()), ("__best_item", "string", pa.string()), ("__best_at", "long", pa.int64()))


def one_pass(docs: DataFrame, text: str, carried: list[str], sets: list[TestSet], first: bool, last: bool) -> tuple[DataFrame, list]:
    """docs held against some blocks, with the MEASURES if it is the last pass, else with _FOUND; and the broadcasts."""
    blocks = [docs.sparkSession.sparkContext.broadcast(x) for x in sets]
    added = MEASURES if last else _FOUND
    names = [m[0] for m in added]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch.column(text))
            if first:
                hits, items, best = [b""] * len(texts), [set() for _ in texts], [(0, None, None)] * len(texts)
            else:
                hits, items, *best = (batch.column(name).to_pylist() for name, _, _ in _FOUND)
                items, best = [set(x) for x in items], list(zip(*best))
            marks = None
            for sent in blocks:
                shard = Shard(texts, tests := sent.value)
                if marks is None:
                    marks = np.zeros(len(shard.ids) + 1, np.int64)
                    for at, ranges in zip(shard.first, hits):
                        ranges = np.frombuffer(ranges, np.int64).reshape(-1, 2) + at
                        np.add.at(marks, ranges[:, 0], 1)
                        np.add.at(marks, ranges[:, 1], -1)
                marked, listed = set(), set()
                for k, n, interval, at, starts, size in shard.search(tests):
                    if (n, interval) not in marked:
                        marked.add((n, interval))
                        np.add.at(marks, at, 1)
                        np.add.at(marks, at + n, -1)
                    if (n, interval, k) not in listed:
                        listed.add((n, interval, k))
                        for d in np.unique(np.searchsorted(shard.first, at, "right") - 1):
                            items[d].add(tests.names[k])
                    for d, start, length in zip((np.searchsorted(shard.first, starts, "right") - 1).tolist(), starts.tolist(), size.tolist()):
                        if length > best[d][0]:
                            best[d] = (length, tests.names[k], start - int(shard.first[d]))
            on = np.cumsum(marks) > 0
            lists = [sorted(x) for x in items]
            if last:
                hit = np.concatenate([[0], np.cumsum(on)])
                n_hit = hit[shard.first + shard.n_words] - hit[shard.first] if len(texts) else []
                columns = [shard.n_words, n_hit, lists, *([b[i] for b in best] for i in range(3)), [bool(x) for x in n_hit]]
            else:
                edge = np.flatnonzero(np.diff(np.concatenate([[0], on.view(np.int8), [0]])))
                ranges = edge.reshape(-1, 2)
                part = np.searchsorted(ranges[:, 0], np.append(shard.first, len(marks)))
                columns = [[(ranges[part[d] : part[d + 1]] - shard.first[d]).astype(np.int64).tobytes() for d in range(len(texts))], lists, *([b[i] for b in best] for i in range(3))]
            found = [pa.array(x, kind) for x, (_, _, kind) in zip(columns, added)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carried] + found, names=carried + names)

    schema = T.StructType(docs.select(*[F.col(f"`{c}`") for c in carried]).schema.fields + T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind, _ in added)).fields)
    return docs.mapInArrow(scan, schema), blocks


def find_matches(docs: DataFrame, tests: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 4 << 20, blocks_at_once: int = 16) -> DataFrame:
    """docs with the MEASURES: hit words, the items found, the longest verbatim match and its word position."""
    spark = docs.sparkSession
    ready_for_python(spark)
    names = [m[0] for m in (*MEASURES, *_FOUND)]
    carried = [c for c in docs.columns if c not in names]
    docs = docs.select(*[F.col(f"`{c}`") for c in carried])
    scratch, before, first = Scratch(spark, "tests"), None, True

    sets, block, size = [], [], 0
    rows = tests.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.encode(F.coalesce(F.col(item_text), F.lit("")), "UTF-8").alias("t"))
    for row in rows.toLocalIterator():
        if block and size + len(row["t"]) > block_bytes:
            sets.append(TestSet(block, window))
            block, size = [], 0
            if len(sets) == blocks_at_once:
                docs, sent = one_pass(docs, text, carried, sets, first, False)
                docs, sets, first = scratch.write(docs, "pass"), [], False
                for x in sent:
                    x.destroy()
                scratch.drop(before)
                before = docs
        block.append((row["i"], bytes(row["t"])))
        size += len(row["t"])
    return one_pass(docs, text, carried, [*sets, TestSet(block, window)], first, True)[0]


def decontaminate(docs: DataFrame, tests: DataFrame, **options) -> DataFrame:
    """The documents that hold no window of any test item, with their own columns."""
    return find_matches(docs, tests, **options).where(~F.col("contaminated")).select(*[F.col(f"`{c}`") for c in docs.columns])
