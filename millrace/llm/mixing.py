"""Mixing sources to target weights by pivotal dependent rounding.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share a
part of all words; a target stops at most_copies times its source's words and the
excess is shared again by weight. That is water filling: target = min(cap, level *
weight), and the level follows from running sums over the sources.

Rounding: a document of a source is wanted target / source words times. The whole part
is taken for certain. The fractions are rounded dependently: two documents a, b meet,
and mass moves between their probabilities at the rate of their sizes (the expected
words of the pair stay as they are) until one of the two is 0 or 1; which way is random,
with odds that keep every document's expectation. One fractional document is left of
each fold, and the folds form a reduction tree: GROUP fractions are folded in one group,
the residuals again, until GROUP are left of each source; every source goes through one level at
least. A long document is mostly what a fold leaves, so some wait for the last group, in
which the longest comes first and shorter and shorter ones after it take up what it
lacks, so that the one that is left, and drawn, is mostly short: documents of a LONG-th of their source's
words or more (LONG at most), and, drawn by hash, a quarter of the others, about RESERVE at most. A source's
words miss its target by less than the document that is left.

Plan: only (id, size, source) is shuffled, never the text. A hot source is dealt over
many groups, so no group holds more than GROUP rows, or GROUP, LONG and about RESERVE in a
source's last one, and the number of levels is the logarithm of the source's documents. All
randomness is a hash of ids and the level: reruns agree.

Defined results: a null text has size 0; a document of size 0 is taken 0 times. A null
source is a source of its own, the last one. Equal rows are told apart by a row number
in their bucket. An empty table gives an empty result. Only ids, sizes and sources are
returned, so extra columns don't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, word_count

#: Fractions in a group of the tree; long documents, and others at most, that a source keeps for its last group.
GROUP, LONG, RESERVE = 16, 64, 256


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most_copies: int = 2) -> DataFrame:
    """source, source_size, target of (source, size): one row for each source."""
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    # One small row for each source is all that these windows order.
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), (rank % len(weights) + 1).cast("int")))
    per = per.withColumns({"cap": F.col("source_size") * float(most_copies), "all": F.sum("source_size").over(everything) * float(share)})
    before = Window.partitionBy().orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    spent, used = (F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in ("cap", "w"))
    per = per.withColumn("level", (F.col("all") - spent) / (F.sum("w").over(everything) - used))
    # The first source, in this order, that its share doesn't fill has the level of all.
    per = per.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "level"))).over(everything)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap")))
    return per.select("source", "source_size", target.alias("target"))


def _draw(*of: Column | str, seed: int) -> Column:
    """A number from 0 to 1 that only the arguments decide."""
    return (F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 53)) + 0.5) / float(1 << 53)


def _fold(units: Column, seed: Column) -> Column:
    """Pivotal rounding of an array of (doc, rn, size, p): one is left, the others are 0 or 1.

    State: the fractional unit at hand, and what is decided so far.
    """

    def meet(state: Column, new: Column) -> Column:
        old, p, q, a, b = state["at"], state["at"]["p"], new["p"], state["at"]["size"], new["size"]
        # Up: old gains what new can give; down: old gives what new can take. Mass in words is p * size.
        up = F.least((1 - p) * a, q * b)
        down = F.least(p * a, (1 - q) * b)
        u = (F.pmod(F.xxhash64(seed, old["doc"], old["rn"], new["doc"], new["rn"]), F.lit(1 << 53)) + 0.5) / float(1 << 53)
        rise = u * (up + down) < down
        moved = F.when(rise, up).otherwise(-down)
        # The one whose room was the smaller becomes integral, exactly.
        old_done = F.when(rise, (1 - p) * a <= q * b).otherwise(p * a <= (1 - q) * b)
        pp = F.when(old_done, F.when(rise, 1.0).otherwise(0.0)).otherwise(p + moved / a)
        qq = F.when(old_done, q - moved / b).otherwise(F.when(rise, 0.0).otherwise(1.0))
        one = lambda x, prob: F.struct(x["doc"].alias("doc"), x["rn"].alias("rn"), x["size"].alias("size"), prob.alias("p"))
        first, second = one(old, pp), one(new, qq)
        return F.struct(F.when(old_done, second).otherwise(first).alias("at"), F.concat(state["done"], F.array(F.when(old_done, first).otherwise(second))).alias("done"))

    return F.aggregate(F.slice(units, 2, F.size(units)), F.struct(F.get(units, F.lit(0)).alias("at"), F.slice(units, 1, 0).alias("done")), meet)


def pivotal_round(units: DataFrame, scratch: Scratch, seed: int = 0) -> DataFrame:
    """units (source, doc, rn, size > 0, 0 < p < 1) rounded: (source, doc, rn, p) with p 0 or 1.

    The driver sees one number a level: the largest count of fractions in a source.
    """
    keys = ["source", "doc", "rn", "size", "p"]
    same = lambda df, n: df.join(F.broadcast(n) if n.count() < 100_000 else n, df["source"].eqNullSafe(n["source"])).drop(n["source"])
    units = same(units.select(*keys), units.groupBy("source").agg(F.count("*").alias("all"), F.sum("size").alias("words")))
    kept = (F.col("size") * LONG >= F.col("words")) | (_draw("doc", "rn", seed=seed + 3000) < F.least(F.lit(0.25), RESERVE / F.col("all")))
    reserve, todo = units.where(kept).select(*keys), units.where(~kept).select(*keys)
    decided, level = None, 0

    def fold(dealt: DataFrame, by: list[str], name: str) -> DataFrame:
        """Long documents come first: of the shorter ones after them some make them integral, so that a short one is left."""
        folded = dealt.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("shorter"), "doc", "rn", "size", "p"))).alias("x"))
        units_ = F.transform("x", lambda u: F.struct(u["doc"].alias("doc"), u["rn"].alias("rn"), u["size"].alias("size"), u["p"].alias("p")))
        folded = folded.select("source", _fold(units_, F.lit(seed + 1000 + level)).alias("f"))
        return scratch.write(folded.select("source", F.inline(F.concat("f.done", F.array("f.at")))), name)

    whole = F.col("p").isin(0.0, 1.0)
    while True:
        counted = scratch.write(todo.groupBy("source").agg(F.count("*").alias("n")), f"counts{level}")
        if (counted.agg(F.max("n")).first()[0] or 0) <= (GROUP if level else 0):
            break
        # Buckets of GROUP on average, then parts of GROUP at most. The seed differs at each level.
        dealt = same(todo, counted).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + level), "doc", "rn"), F.ceil(F.col("n") / GROUP)))
        order = Window.partitionBy("source", "bucket").orderBy(F.desc("size"), "doc", "rn")
        dealt = dealt.withColumn("part", F.floor((F.row_number().over(order) - 1) / GROUP))
        folded = fold(dealt, ["source", "bucket", "part"], f"level{level}")
        done = folded.where(whole)
        decided = done if decided is None else decided.unionByName(done)
        todo, level = folded.where(~whole), level + 1
    folded = fold(todo.unionByName(reserve), ["source"], "last")
    done, todo = folded.where(whole), folded.where(~whole)
    decided = done if decided is None else decided.unionByName(done)
    last = todo.withColumn("p", F.when(_draw("doc", "rn", seed=seed + 2000) < F.col("p"), 1.0).otherwise(0.0))
    return decided.unionByName(last).select("source", "doc", "rn", "p")


def mix(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most_copies: int = 2, seed: int = 0) -> DataFrame:
    """One row for each document: its id, size, source, source_size, target, copies, taken."""
    scratch = Scratch(docs.sparkSession, "mix")
    rows = docs.select(F.col(doc).alias("doc"), word_count(F.col(text)).alias("size"), F.col(source).alias("source"))
    # Equal rows (same id and size) get numbers, so that each is a unit of its own.
    rows = scratch.write(rows.withColumn("rn", F.row_number().over(Window.partitionBy("doc", "size", "source").orderBy("doc"))), "sizes")
    targets = scratch.write(source_targets(rows, weights, share, most_copies), "targets")
    t = targets.withColumnRenamed("source", "s")
    small = targets.count() < 100_000  # checked: one row for each source
    wanted = rows.join(F.broadcast(t) if small else t, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = wanted.withColumns({"whole": F.floor(rate).cast("long"), "p": rate - F.floor(rate)})
    open_ = (F.col("size") > 0) & (F.col("p") > 0)
    rounded = pivotal_round(wanted.where(open_), scratch, seed)
    rounded = rounded.select(F.col("doc").alias("d"), F.col("rn").alias("r"), F.col("source").alias("s"), F.col("p").cast("long").alias("extra"))
    out = wanted.join(rounded, F.col("doc").eqNullSafe(F.col("d")) & (F.col("rn") == F.col("r")) & F.col("source").eqNullSafe(F.col("s")), "left")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce(F.col("extra"), F.lit(0))).otherwise(0)
    return out.select(F.col("doc").alias(doc), "size", F.col("source").alias(source), "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
