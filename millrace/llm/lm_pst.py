"""LM scoring with a probabilistic suffix tree over words.

Root: every word's count over all training documents, add-one smoothed. Contexts of one
to depth words are counted over all training documents, level by level: a context of
frequent words is a candidate from a number of occurrences on that is growth times the
square root of the training tokens, a next symbol is listed from a next_part of that on.
So the tree gains contexts as the corpus grows, without an end, and yet has no more than
sqrt(tokens) / growth of them a level, which is what keeps it fit for a broadcast: at
10^13 tokens a word counts as frequent from 1.3 million occurrences on. A candidate is
retained if its next-symbol distribution diverges from that of its longest retained suffix
(likelihood ratio G beyond chance, and a least divergence). A retained context's
distribution is smoothed with its suffix's; symbols that it doesn't list share its
remaining mass as its suffix shares it. Scoring takes the longest retained suffix at each
word.

Plan: the words' exact counts grow with the corpus and are never gathered in one place.
Documents are dealt to blocks by hash, blocks of bounded text; each block writes a row for
each distinct word; the rows of a word are summed, with partial sums; and each block gets
the counts of its own words back, those of frequent words by a broadcast, the others by a
join that Spark may split. So what is shuffled is the text, twice, and a row for each word
and block, twice. The training texts are written once as arrays of symbols; counting a level is
a map over these, whole batches at a time, with sums per task.

Defined results: a null text is empty and has one token, the end. Without training
documents every count is 0. Rows are scored each by itself, also where ids repeat (rows of
equal id and text share a block); a null id is hashed as an empty text. Extra columns
aren't carried, so they can't clash.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from math import log, log10, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ready_for_python, byte_texts, slices

#: The end of a text; no word is empty.
END = b""


@dataclass(frozen=True)
class Tree:
    depth: int = 3
    #: Occurrences of a context, by the square root of the training tokens, and at least.
    growth: float = 0.4
    least_context: int = 20
    #: Occurrences of a listed next symbol, by those of a context, and at least.
    next_part: float = 1 / 40
    least_next: int = 3
    #: Standard deviations of G above its mean under chance.
    deviations: float = 3.0
    least_divergence: float = 1e-3
    #: Weight of the suffix's distribution, in tokens.
    prior: float = 20.0
    folds: int = 7
    held_fold: int = 2
    #: Characters of text in a block, about.
    block_chars: int = 6_000_000

    def context_count(self, n_all: int) -> float:
        return max(self.least_context, self.growth * sqrt(n_all))

    def next_count(self, n_all: int) -> float:
        return max(self.least_next, self.next_part * self.context_count(n_all))


@dataclass
class Model:
    """Nodes are numbered from 1; 0 is the root. Symbols: 0 other, 1..k frequent words, k + 1 the end."""

    symbols: dict[bytes, int]
    base: int  # codes are node * base + symbol
    #: By level: sorted codes of (candidate of the level before, symbol), one for each candidate.
    paths: list[np.ndarray] = field(default_factory=list)
    #: By level: each candidate's node, or 0 if it isn't retained.
    nodes: list[np.ndarray] = field(default_factory=list)
    parent: list[int] = field(default_factory=lambda: [0])
    log_rest: list[float] = field(default_factory=lambda: [0.0])
    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    log_p: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def contexts(self, x: np.ndarray) -> list[np.ndarray]:
        """By level: the candidate that ends at each position of x, or -1. The candidates of the first level are the symbols 1, 2, ..."""
        out: list[np.ndarray] = []
        for level, path in enumerate(self.paths):
            if level == 0:
                before = np.where((x >= 1) & (x <= len(path)), x - 1, -1)
            else:  # only where the level before has a candidate
                at = np.flatnonzero(out[-1][:-1] >= 0) + 1
                code = out[-1][at - 1] * self.base + x[at]
                place = np.searchsorted(path, code)
                hit = path[np.minimum(place, len(path) - 1)] == code
                before = np.full(len(x), -1, np.int64)
                before[at[hit]] = place[hit]
            out.append(before)
        return out

    def states(self, x: np.ndarray) -> np.ndarray:
        """The node of the longest retained context before each position of x."""
        state = np.zeros(len(x), np.int64)
        for at, nodes in zip(self.contexts(x), self.nodes):
            known = np.flatnonzero(at[:-1] >= 0)
            node = nodes[at[known]]
            state[known[node > 0] + 1] = node[node > 0]
        return state

    def scores(self, x: np.ndarray, root: np.ndarray) -> np.ndarray:
        """Log10 probability of each of the symbols x, whose root log10 probabilities are given. Texts may follow one another, each with its end."""
        parent, rest = np.array(self.parent), np.array(self.log_rest)
        state, out = self.states(x), np.zeros(len(x))
        out[state == 0] = root[state == 0]
        left = np.flatnonzero(state)
        while len(left):
            code = state[left] * self.base + x[left]
            hit = np.zeros(len(left), bool)
            if len(self.codes):
                at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                hit = self.codes[at] == code
                out[left[hit]] += self.log_p[at[hit]]
            left = left[~hit]
            out[left] += rest[state[left]]
            state[left] = parent[state[left]]
            done = left[state[left] == 0]
            out[done] += root[done]
            left = left[state[left] > 0]
        return out


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]  # bytes: A-Z alone, and exactly [\x20\x09-\x0D]


def held_out(doc: Column, t: Tree) -> Column:
    return F.crc32(F.coalesce(doc.cast("string"), F.lit("")).cast("binary")) % t.folds == t.held_fold


def word_rows(blocked: DataFrame) -> DataFrame:
    """(block, w, n): each distinct word of a block and its count in the block's training texts."""

    def count(group: pa.Table) -> pa.Table:
        sums: Counter = Counter()
        for batch in group.to_batches():
            for part in slices(batch):
                for text, held in zip(byte_texts(part.column("text")), part.column("held").to_pylist()):
                    if held:
                        sums.update(dict.fromkeys(tokens(text), 0))
                    else:
                        sums.update(tokens(text))
        block = group.column("block")[0].as_py()
        return pa.table([pa.array([block] * len(sums), pa.int64()), pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.int64())], names=["block", "w", "n"])

    return blocked.groupBy("block").applyInArrow(count, "block long, w binary, n long")


def coded(docs: DataFrame, symbols: dict[bytes, int]) -> DataFrame:
    """(x): the symbols of each text, so that words are read as text once for all levels."""
    sent = docs.sparkSession.sparkContext.broadcast(symbols)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent.value.get
        for batch in batches:
            for part in slices(batch):
                x = [np.fromiter((get(k, 0) for k in w), np.int32, len(w)) for w in map(tokens, byte_texts(part.column(0)))]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int32()))], names=["x"])

    return docs.select("text").mapInArrow(code, "x array<int>")


def level_counts(texts: DataFrame, model: Model) -> DataFrame:
    """(code, n): what follows the candidates of the last level in coded texts; symbol base - 1 has the total."""
    sent, base = texts.sparkSession.sparkContext.broadcast(model), model.base

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, codes, sums = sent.value, [], []

        def compact() -> None:
            u, inverse = np.unique(np.concatenate(codes), return_inverse=True)
            codes[:], sums[:] = [u], [np.bincount(inverse, weights=np.concatenate(sums)).astype(np.int64)]

        for batch in batches:
            for part in slices(batch):
                # Texts one after another: each ends with the end, which no context has, so none goes over to the next.
                x = part.column(0).flatten().to_numpy().astype(np.int64)
                at = model.contexts(x)[-1][:-1]
                hit = np.flatnonzero(at >= 0)
                codes += [at[hit] * base + x[1:][hit], at[hit] * base + base - 1]
                sums += [np.ones(len(hit), np.int64)] * 2
                if sum(map(len, codes)) > 2_000_000:
                    compact()
        if codes:
            compact()
            yield pa.RecordBatch.from_arrays([pa.array(codes[0], pa.int64()), pa.array(sums[0], pa.int64())], names=["code", "n"])

    return texts.select("x").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def grow(docs: DataFrame, frequent: dict[bytes, int], n_all: int, n_types: int, t: Tree, scratch: Scratch) -> Model:
    """The tree. frequent: the words of context_count or more, and the end, and their counts."""
    names = sorted(w for w in frequent if w != END)
    symbols = {w: k for k, w in enumerate(names, 1)} | {END: len(names) + 1}
    model = Model(symbols, len(names) + 3)
    by_symbol = np.zeros(model.base)
    for w, k in symbols.items():
        by_symbol[k] = (frequent.get(w, 0) + 1) / (n_all + n_types + 1)
    tables: dict[int, dict[int, float]] = {0: {}}  # of each node, the listed symbols' probabilities
    rest = {0: 1.0}

    def p(node: int, symbol: int) -> float:
        weight = 1.0
        while node:
            if symbol in tables[node]:
                return weight * tables[node][symbol]
            weight, node = weight * rest[node], model.parent[node]
        return weight * by_symbol[symbol]

    texts = scratch.write(coded(docs, symbols), "coded")
    path = np.arange(1, len(names) + 1, dtype=np.int64)
    words = [(k,) for k in path.tolist()]
    retained: dict[tuple[int, ...], int] = {}
    for _ in range(t.depth):
        if not len(path):
            break
        model.paths.append(path)
        counts: dict[int, dict[int, int]] = {}
        rows = level_counts(texts, model).where((F.col("n") >= t.next_count(n_all)) | (F.pmod("code", F.lit(model.base)) == model.base - 1))
        for row in rows.collect():  # at most n_all / next_count rows, and a total for each of n_all / context_count contexts: both as the root of n_all
            counts.setdefault(row["code"] // model.base, {})[row["code"] % model.base] = row["n"]
        nodes, longer = np.zeros(len(path), np.int64), []
        for k, word in enumerate(words):
            found = counts.get(k, {})
            total = found.pop(model.base - 1, 0)
            found.pop(0, None)  # other words are in the remaining mass
            longer += [(k * model.base + s, (*word, s)) for s, n in found.items() if n >= t.context_count(n_all) and s <= len(names)]
            suffix = next((retained[word[i:]] for i in range(1, len(word)) if word[i:] in retained), 0)
            listed = {s: p(suffix, s) for s in found}
            open_, left = 1 - sum(listed.values()), total - sum(found.values())
            if not found or not total or open_ <= 0:
                continue
            g = 2 * sum(n * log(n / total / listed[s]) for s, n in found.items()) + (2 * left * log(left / total / open_) if left else 0.0)
            if g / (2 * total) < t.least_divergence or g <= len(found) + t.deviations * sqrt(2 * len(found)):
                continue
            node = retained[word] = nodes[k] = len(model.parent)
            mix = t.prior / (total + t.prior)
            model.parent.append(suffix)
            tables[node] = {s: (1 - mix) * n / total + mix * listed[s] for s, n in found.items()}
            rest[node] = (1 - mix) * left / total / open_ + mix
            model.log_rest.append(log10(rest[node]))
        model.nodes.append(nodes)
        longer.sort()
        path, words = np.array([c for c, _ in longer], np.int64), [w for _, w in longer]
    scratch.drop(texts)
    pairs = sorted((node * model.base + s, log10(x)) for node, table in tables.items() for s, x in table.items())
    model.codes, model.log_p = np.array([c for c, _ in pairs], np.int64), np.array([x for _, x in pairs])
    return model


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(docs: DataFrame, doc: str = "doc_id", text: str = "text", t: Tree = Tree()) -> DataFrame:
    """One row for each document, with the columns of RESULT."""
    spark = docs.sparkSession
    ready_for_python(spark)
    scratch = Scratch(spark, "lm")
    rows = docs.select(F.col(doc).cast("long").alias("id"), F.col(text).alias("text"), held_out(F.col(doc), t).alias("held"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // t.block_chars))
    blocked = rows.withColumn("block", F.pmod(F.xxhash64("id", F.xxhash64("text")), F.lit(blocks)))

    words = scratch.write(word_rows(blocked), "words")
    sums = scratch.write(words.where("n > 0").groupBy("w").agg(F.sum("n").alias("c")), "sums")
    n_all, n_types = sums.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # At most n_all / context_count words, as the root of n_all.
    often = sums.where((F.col("c") >= t.context_count(n_all)) | (F.col("w") == F.lit(END)))
    model = grow(rows.where("not held"), {bytes(r["w"]): r["c"] for r in often.collect()}, n_all, n_types, t, scratch)
    hot, columns = F.broadcast(often), ["block", "w", "c"]
    rare = words.join(hot, "w", "left_anti").select("block", "w").join(sums, "w", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    counted = words.join(hot, "w").select(columns).union(rare.select(columns))
    sent = spark.sparkContext.broadcast(model)

    def score(group: pa.Table, words: pa.Table) -> pa.Table:
        model = sent.value
        known = words.column("w").to_pylist()
        number = {w: k for k, w in enumerate(known)}.__getitem__
        counts = words.column("c").to_numpy()
        symbols = np.fromiter((model.symbols.get(w, 0) for w in known), np.int64, len(known))
        roots = np.log10((counts + 1) / (n_all + n_types + 1))
        out = []
        for batch in group.to_batches():
            for part in slices(batch):
                # The texts of a slice one after another, so that numpy is called once for all.
                w = [tokens(x) for x in byte_texts(part.column("text"))]
                sizes = np.fromiter(map(len, w), np.int64, len(w))
                at = np.fromiter(map(number, chain.from_iterable(w)), np.int64, int(sizes.sum()))
                root, first = roots[at], np.cumsum(sizes) - sizes  # no text is without a token
                sums = [np.add.reduceat(x, first).tolist() for x in ((counts[at] > 0).astype(np.int64), root, model.scores(symbols[at], root))]
                out += zip(part.column("id").to_pylist(), part.column("held").to_pylist(), sizes.tolist(), sums[0], [n_all] * len(w), sums[1], sums[2])
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 7, kinds)], names=[x.split()[0] for x in RESULT.split(", ")])

    return blocked.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(score, RESULT)


def fold_of(doc_id: int | None, t: Tree = Tree()) -> int:
    """The fold of an id, for tests."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % t.folds
