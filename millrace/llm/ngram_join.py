"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is its set of word shingles. Sets are sorted by one global order (rare
shingles first). For a pair with Jaccard >= t and any l >= 1, the first n - ceil(t n) + l
shingles of both sets share at least l shingles, so a pair that shares fewer is out
without a look at its sets. A longer prefix (larger l) costs more postings but leaves
fewer candidates. The 1-prefixes are posted first; the exact lengths of the lists that a
document is in give the candidates that it would meet, and l is what costs least. Only
documents with l > 1 post the rest of their prefix. A pair is held to the smaller l.

Order: frequencies come from a table of BUCKETS counters over all shingles of all
documents. Its size is fixed; where counters collide the order is less sharp, never
wrong, as any order that all documents share is correct.

Bitmaps: before the sets of a pair are read, the parities of their shingles by bucket are
compared. Sets differ in at least as many shingles as their bitmaps differ in bits, so this
drops no link; it takes a 32nd of the bytes of the sets. A bitmap of 256 bits goes with the
postings where pairs are listed, so that most pairs end in the join.

Components without all pairs. n near copies have n^2 links, so pairs inside a group are
not listed. First each posting list links its members to its smallest member (a star);
verified stars give components. Then, per posting list, only pairs of different
components are listed, counted against l, bounded by size and verified; a list whose
members are in one component gives none. While such pairs would be many, more stars are
drawn first, between the components of a list, as long as they leave far fewer. No candidate is
dropped. A pair is met only at positions that can still give what its two sizes need.

Plan: exact copies collapse to one node before postings. Postings of a shingle that
occurs once go in a partial count before anything is joined. Texts move only for nodes
that are in pairs whose bitmaps fit, once a node. All joins are plain equi-joins right
above their shuffles, which Spark may split where a key is hot.

Defined results: null, empty and wordless texts have no shingles, and their rows are linked
with nothing. Texts with fewer words than a shingle are one shingle. Repeated rows and ties
are linked like other copies; rows with words and the same id are linked, whatever their
texts. The component of a null id is the smallest id that it reaches, or null. Extra
columns are not carried, so they can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, byte_texts, hash128, ready_for_python, slices

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
#: Rows of text hashes that may be broadcast (24 bytes each); beyond it the join is shuffled.
BROADCAST_IDS = 1_000_000
#: Stars go on while they leave no more than this part of the pairs between components.
PAYS = 0.7
#: Words of 64 bits in the largest bitmap.
BITMAP = 1 << 10
#: Words of the bitmap that goes with a posting where pairs are listed.
SIGN = 4


@dataclass(frozen=True)
class Jaccard:
    """Similarity of num / den or more over shingles of this many words."""

    words: int = 5
    num: int = 80
    den: int = 100
    #: Counters for the order of shingles.
    buckets: int = 1 << 22
    #: Largest l, as a part of a document's shingles.
    most_extra: float = 0.1
    #: Cost of a candidate, in postings.
    verify_cost: float = 8.0

    def least(self, n: int) -> int:
        """Shingles that a set of n shares at least with any set it links to."""
        return -(-self.num * n // self.den)

    def most(self, n: int) -> int:
        """The largest l of a set of n."""
        return max(1, min(int(self.most_extra * n), self.least(n)))


def shingles(text: bytes, words: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    w = text.lower().split()  # bytes: A-Z alone, and exactly [\x20\x09-\x0D]
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    m = min(words, len(w))
    s = np.full(len(w) - m + 1, m, np.uint64)
    for j in range(m):
        s = (s ^ (s >> np.uint64(31))) * _MIX[0] + h[j : len(h) - m + 1 + j]
    s = (s ^ (s >> np.uint64(29))) * _MIX[1]
    return np.unique((s ^ (s >> np.uint64(32))) * _MIX[2])


def frequency_table(docs: DataFrame, text: str, j: Jaccard) -> np.ndarray:
    """Documents per counter, over all documents: j.buckets numbers, whatever the data."""
    part = 1 << 16
    n_parts = -(-j.buckets // part)

    def pack(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zstandard.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], names=["k", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_parts * part, np.int64)
        for batch in batches:
            for some in slices(batch):
                found = [shingles(x, j.words) % np.uint64(j.buckets) for x in byte_texts(some.column(0))]
                total += np.bincount(np.concatenate(found).astype(np.int64), minlength=len(total)) if found else 0
        yield pack({k: total[k * part : (k + 1) * part] for k in range(n_parts)})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(zstandard.decompress(blob), np.int64)
        yield pack(sums)

    schema = "k int, counts binary"
    rows = docs.select(text).mapInArrow(count, schema)
    # Sums of sums, so that no task reads the blobs of all tasks.
    rows = rows.repartition(8 * n_parts, F.col("k"), F.pmod(F.xxhash64("counts"), F.lit(8))).mapInArrow(add, schema)
    table = np.zeros(n_parts * part, np.int64)
    for row in rows.repartition(n_parts, "k").mapInArrow(add, schema).collect():  # n_parts rows
        table[row["k"] * part : (row["k"] + 1) * part] += np.frombuffer(zstandard.decompress(bytes(row["counts"])), np.int64)
    return table


def bitmap(s: np.ndarray, words: int = 0) -> np.ndarray:
    """Parities of the shingles by bucket, in 64-bit words: a power of two of them; if not given, 2 to 4 bits a shingle."""
    words = words or min(BITMAP, 1 << max(0, (len(s) - 1) // 32).bit_length())
    odd = np.bincount((s & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def prefixes(docs: DataFrame, doc: str, text: str, j: Jaccard, table: np.ndarray) -> DataFrame:
    """(doc, t1, t2, k1, k2, n, sign, bits, prefix): hashes of the text and of the shingle set, its size, bitmaps and longest prefix."""
    # Counts above what chance puts in a counter, in steps, so that noise doesn't reorder rare shingles.
    mean = float(table.mean())
    excess = np.maximum(0.0, table - mean - 4 * mean**0.5)
    sent = docs.sparkSession.sparkContext.broadcast(excess.astype(np.float32))
    top = np.uint64(j.buckets)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        excess = sent.value
        for batch in batches:
            for some in slices(batch):
                key1, key2, size, sign, bits, prefix = [], [], [], [], [], []
                for x in byte_texts(some.column(3)):
                    s = shingles(x, j.words)
                    raw, n = s.tobytes(), len(s)
                    key1.append(xxhash.xxh64_intdigest(raw, 1) - (1 << 63))
                    key2.append(xxhash.xxh64_intdigest(raw, 2) - (1 << 63))
                    size.append(n)
                    sign.append(bitmap(s, SIGN))
                    bits.append(bitmap(s))
                    order = np.lexsort((s, excess[(s % top).astype(np.int64)]))
                    prefix.append(s[order[: n - j.least(n) + j.most(n)]].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(k) for k in range(3)), pa.array(key1, pa.int64()), pa.array(key2, pa.int64()), pa.array(size, pa.int32()), pa.array(sign, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())), pa.array(prefix, pa.list_(pa.int64()))],
                    names=["doc", "t1", "t2", "k1", "k2", "n", "sign", "bits", "prefix"],
                )

    return docs.select(F.col(doc).cast("long").alias("doc"), *hash128(F.col(text), "t"), F.col(text).alias("text")).mapInArrow(emit, "doc long, t1 long, t2 long, k1 long, k2 long, n int, sign array<long>, bits array<long>, prefix array<long>")


def overlaps(a: Column, b: Column, both: Column, j: Jaccard) -> Column:
    """Whether sets of sizes a and b that share this many are similar enough."""
    return both.cast("long") * (j.num + j.den) >= (a.cast("long") + b) * j.num


def in_prefix(n: Column, pos: Column, least: Column, l: Column) -> Column:
    """Whether a position of a set of n is in its l-prefix for a partner with which it must share least."""
    return pos < n - least + l


def needed(a: Column, b: Column, j: Jaccard) -> Column:
    """Shingles that sets of sizes a and b share at least if they are linked."""
    return F.ceil((a.cast("long") + b) * j.num / (j.num + j.den))


def alike(pairs: DataFrame, nodes: DataFrame, j: Jaccard) -> DataFrame:
    """The pairs (a, b) of nodes whose bitmaps don't rule them out."""
    left, right = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b")
    # Linked sizes are near each other, so that one of the two bitmaps is folded once at most.
    size = F.least(F.size("bitsa"), F.size("bitsb"))

    def fold(x: Column) -> Column:
        return F.when(F.size(x) > size, F.zip_with(F.slice(x, 1, size), F.slice(x, size + 1, size), lambda p, q: p.bitwiseXOR(q))).otherwise(x)

    apart = F.aggregate(F.zip_with(fold(F.col("bitsa")), fold(F.col("bitsb")), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, x: s + x)
    near = (F.least("na", "nb").cast("long") * j.den >= F.greatest("na", "nb").cast("long") * j.num) & (F.col("na").cast("long") + F.col("nb") - apart >= 2 * needed(F.col("na"), F.col("nb"), j))
    return both.where(near).select("a", "b")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text: str, j: Jaccard, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of nodes whose whole shingle sets are similar enough."""
    pairs = scratch.write(alike(pairs, nodes, j), "alike")
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    ids = scratch.write(nodes.select("node", "t1", "t2").join(ids, "node", "left_semi"), "ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids  # checked; else a shuffled join
    # One text of each node; copies of it go in the partial step.
    some = docs.select(F.col(text).alias("text"), *hash128(F.col(text), "t")).join(wanted, ["t1", "t2"]).groupBy("node").agg(F.first("text").alias("text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(x, j.words).view(np.int64) for x in byte_texts(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "s"])

    sets = scratch.write(some.mapInArrow(build, "node long, s array<long>"), "sets")
    left, right = (sets.withColumnsRenamed({"node": c, "s": f"s{c}"}) for c in "ab")
    both = pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    found = scratch.write(both.where(overlaps(F.size("sa"), F.size("sb"), F.col("both"), j)).select("a", "b"), "links")
    scratch.drop(pairs, ids, sets)
    return found


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp): the smallest node of each node's component, by alternating stars.

    Large stars link a node's larger neighbours to its smallest one, small stars its
    smaller ones; the rounds are logarithmic in the size of a component. Every step is a
    distributed group-by with a partial minimum. It ends when no node has two parents or
    is parent and child.
    """
    now = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        sides = now.select(F.col("u").alias("k"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(now.select("v", F.lit(0), F.lit(1)))
        state = sides.groupBy("k").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
        if state.where("child > 1 OR (child = 1 AND parent = 1)").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        # Large star: each neighbour larger than u goes to the smallest of u and its neighbours.
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours go to the smallest.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = scratch.write(small, "edges")
        scratch.drop(now)
        now = new


def postings(nodes: DataFrame, j: Jaccard, scratch: Scratch) -> DataFrame:
    """(token, node, n, l, pos): each node's l-prefix, without tokens that one node alone has."""

    def shared(rows: DataFrame) -> DataFrame:
        counts = rows.groupBy("token").agg(F.count("*").alias("f")).where("f > 1")
        return rows.join(counts, "token")

    base = F.col("n") - F.ceil(F.col("n").cast("long") * j.num / j.den) + 1
    first = nodes.select("node", "n", F.posexplode(F.slice("prefix", 1, base.cast("int"))).alias("pos", "token"))
    first = scratch.write(shared(first), "first")
    # l: candidates, of which about an l-th is left, against the whole l-prefix that is posted again.
    met = F.sum(F.when(in_prefix(F.col("n"), F.col("pos"), needed(F.col("n"), F.col("n"), j), F.lit(1)), F.col("f") - 1).otherwise(0)) * j.verify_cost
    n = F.first("n")
    least = F.ceil(n.cast("long") * j.num / j.den)
    best = F.greatest(F.lit(1), F.least(least, F.floor(n * j.most_extra), F.floor(F.sqrt(met)))).cast("int")
    level = first.groupBy("node").agg(F.when(met - met / best > n - least + best, best).otherwise(1).alias("l"))
    level = scratch.write(level, "levels")
    long = nodes.join(level.where("l > 1"), "node").select("node", "n", "l", F.posexplode(F.slice("prefix", 1, (base + F.col("l") - 1).cast("int"))).alias("pos", "token"))
    columns = ["token", "node", "n", "l", "pos"]
    first_l = first.join(level, "node").select(columns)
    more = first_l.where("l > 1").union(shared(long).select(columns)).dropDuplicates(["token", "node"])
    out = scratch.write(first_l.where("l = 1").union(more), "postings")
    scratch.drop(first, level)
    return out


def links(nodes: DataFrame, docs: DataFrame, text: str, j: Jaccard, scratch: Scratch) -> DataFrame:
    """Links (a, b) of nodes: enough of them that all that links reach are in one component."""
    posts = postings(nodes, j, scratch)
    edges, tried, before = None, None, None
    at, turn = posts.withColumn("comp", F.col("node")), 0
    while True:
        if turn:
            # Lists with more than one component, and the pairs between components in them.
            # near: rows that a partner of the same size would meet, for an estimate of the pairs.
            near = in_prefix(F.col("n"), F.col("pos"), needed(F.col("n"), F.col("n"), j), F.col("l"))
            per = at.groupBy("token", "comp").agg(F.count("*").alias("m"), F.count_if(near).alias("k"))
            mixed = per.groupBy("token").agg(F.count("*").alias("c"), F.sum("m").alias("f"), F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("kk")).where("c > 1")
            mixed = scratch.write(mixed, "lists")
            rest = scratch.write(at.join(mixed.select("token"), "token", "left_semi"), "mixed")
            cross = mixed.agg(F.sum((F.col("k") * F.col("k") - F.col("kk")) / 2).alias("x"), F.sum("f").alias("f")).first()
            scratch.drop(mixed, posts)
            at = posts = rest
            if not cross["f"]:
                return edges
            if cross["x"] <= 8 * cross["f"] or before and cross["x"] > PAYS * before:
                break
            before = cross["x"]
        # A star for each list: its members and one pivot of another component. At first the pivot is
        # the member with the fewest rarer shingles (an original rather than a changed copy), then any.
        key = F.xxhash64(F.lit(turn), "node") if turn else F.col("pos") / F.col("n")
        pivot = at.groupBy("token").agg(F.min(F.struct(key.alias("key"), "node", "n", "l", "pos", "comp")).alias("p"))
        least, l = needed(F.col("n"), F.col("p.n"), j), F.least("l", "p.l")
        star = at.join(pivot, "token").where((F.col("comp") != F.col("p.comp")) & in_prefix(F.col("n"), F.col("pos"), least, l) & in_prefix(F.col("p.n"), F.col("p.pos"), least, l))
        star = star.groupBy("node", F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).agg(F.count("*").alias("hits"))
        best = star.groupBy("node").agg(F.max(F.struct("hits", "a", "b")).alias("x")).select("x.a", "x.b").distinct()
        pairs = scratch.write(best if tried is None else best.join(tried, ["a", "b"], "left_anti"), "stars")
        found = verified(pairs, nodes, docs, text, j, scratch)
        tried = pairs if tried is None else tried.union(pairs)
        edges = found if edges is None else edges.union(found)
        comp = components(edges, scratch).withColumnRenamed("node", "m")
        at = at.drop("comp").join(comp, F.col("node") == F.col("m"), "left").withColumn("comp", F.coalesce("comp", "node")).drop("m")
        turn += 1

    # The rest, whole: pairs of different components that share enough of their prefixes.
    # Of each list, the pairs of components that can hold a pair of nodes: by the best slack and the least size.
    # The one with fewer members in the list comes first, so that a large component isn't copied for each other one.
    lists = at.groupBy("token", "comp").agg(F.max(F.col("n") - F.col("pos") + F.col("l")).alias("slack"), F.min("n").alias("n"), F.count("*").alias("m"))
    left, right = (lists.select("token", *[F.col(c).alias(f"{c}{k}") for c in ("comp", "slack", "n", "m")]) for k in (1, 2))
    fewer = (F.col("m1") < F.col("m2")) | ((F.col("m1") == F.col("m2")) & (F.col("comp1") < F.col("comp2")))
    # Pairs of components with one member each in the list are met at once, below.
    sides = left.join(right, "token").where(fewer & (F.col("m2") > 1) & (F.least("slack1", "slack2") > needed(F.col("n1"), F.col("n2"), j))).select("token", "comp1", "comp2")
    signed = at.join(nodes.select(F.col("node").alias("i"), "sign"), F.col("node") == F.col("i")).join(lists.select("token", "comp", "m"), ["token", "comp"])
    one, two = (signed.select("token", *[F.col(c).alias(f"{c}{k}") for c in ("comp", "node", "n", "l", "pos", "m")], *[F.col("sign")[i].alias(f"s{k}{i}") for i in range(SIGN)]) for k in (1, 2))
    least, l = needed(F.col("n1"), F.col("n2"), j), F.least("l1", "l2")
    # What lies before and behind a shared token bounds what two sets share, as their bitmaps do.
    room = F.least("pos1", "pos2") + 1 + F.least(F.col("n1") - F.col("pos1") - 1, F.col("n2") - F.col("pos2") - 1) >= least
    apart = sum((F.bit_count(F.col(f"s1{i}").bitwiseXOR(F.col(f"s2{i}"))) for i in range(SIGN)), F.lit(0))
    fits = in_prefix(F.col("n1"), F.col("pos1"), least, l) & in_prefix(F.col("n2"), F.col("pos2"), least, l) & room & (F.col("n1") + F.col("n2") - apart >= 2 * least)
    met = sides.join(one.drop("m1"), ["token", "comp1"]).join(two.drop("m2"), ["token", "comp2"]).where(fits).select("node1", "node2", "l1", "l2")
    alone = one.where("m1 = 1").join(two.where("m2 = 1"), "token").where((F.col("comp1") < F.col("comp2")) & fits).select("node1", "node2", "l1", "l2")
    # A pair may be met either way round.
    met = met.union(alone).select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b"), F.least("l1", "l2").alias("l"))
    met = met.groupBy("a", "b", "l").agg(F.count("*").alias("hits")).where("hits >= l").select("a", "b")
    pairs = scratch.write(met.join(tried, ["a", "b"], "left_anti"), "pairs")
    return edges.union(verified(pairs, nodes, docs, text, j, scratch))


def jaccard_components(docs: DataFrame, doc: str = "doc_id", text: str = "text", j: Jaccard = Jaccard()) -> DataFrame:
    """One row for each document: its id, n_shingles, and component_id."""
    spark = docs.sparkSession
    ready_for_python(spark)
    scratch = Scratch(spark, "join")
    each = scratch.write(prefixes(docs, doc, text, j, frequency_table(docs, text, j)), "prefixes")
    rows = scratch.write(each.select("doc", "k1", "k2", "n"), "rows")
    # A node for each distinct set; id is the smallest of its documents'.
    nodes = each.where("n > 0").groupBy("k1", "k2").agg(F.min("doc").alias("id"), F.min(F.struct("t1", "t2")).alias("t"), *[F.first(c).alias(c) for c in ("n", "sign", "bits", "prefix")])
    nodes = scratch.write(nodes.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "id", "t.t1", "t.t2", "n", "sign", "bits", "prefix"), "nodes")
    scratch.drop(each)

    edges = links(nodes, docs, text, j, scratch)
    # Rows of one id are linked, whatever their texts.
    held = rows.where("doc is not null and n > 0").join(nodes.select("k1", "k2", "node"), ["k1", "k2"]).select("doc", "node")
    twice = held.groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").drop("z")
    edges = edges.union(held.join(twice, "doc").where("node <> a").select("a", F.col("node").alias("b")).distinct())

    comp = components(edges, scratch)
    named = nodes.select("node", "k1", "k2", "id").join(comp.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("id").alias("component"))
    labels = named.join(least, "comp").select("k1", "k2", "component")
    out = rows.join(labels, ["k1", "k2"], "left")
    return out.select(F.col("doc").alias(doc), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc")).alias("component_id"))
