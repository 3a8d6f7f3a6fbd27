"""Line dedup: drop the lines that many documents share.

Lines are exploded, normalised (outer white space stripped, A-Z lower-cased) and
hashed to 128 bits; (hash, id) pairs are made distinct and then counted by hash, both
with map-side partial steps; lines over the threshold go, the rest is put together by position.

Plan: only hashes, ids and positions are shuffled on the way to the decision. Each
document sends a key once (array_distinct); pairs are dealt by hash and id, so one line
in a third of the documents is spread over all tasks and then a partial count, not a group.
The common lines are written and counted: the most common of them, BROADCAST at most, are
sent out, so that their rows are never shuffled; where there are more, the others are joined back by their hash,
and none of these has more documents than a task can read: fewer than SPREAD, or than a power of two times that
where over BROADCAST lines have as many. Nothing is repeated. The text itself moves once, in the join by document.

Defined results: a null text counts as one empty line and gives an empty text. Empty
keys never drop. Rows of one id count as one document and those with a null id as none, as in the SQL.
Extra columns are carried; n_lines and n_dropped are replaced where they exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Scratch, hash128, lower_ascii

#: Common lines that may be broadcast (16 bytes each).
BROADCAST = 500_000
#: Documents of a line whose rows may meet in one task; a power of two.
SPREAD = 1 << 17


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def common_lines(docs: DataFrame, doc: str, text: str, min_docs: int, min_chars: int) -> DataFrame:
    """(h1, h2, n_docs) of the line keys that at least min_docs documents have."""
    keys = F.array_distinct(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), line_key))
    each = docs.select(F.col(doc).alias("d"), F.explode(keys).alias("key")).where(F.length("key") >= min_chars)
    once = each.select("d", *hash128(F.col("key"))).distinct()
    return once.groupBy("h1", "h2").agg(F.count("d").alias("n_docs")).where(F.col("n_docs") >= min_docs)


def sent_from(common: DataFrame) -> int:
    """The documents from which on a common line is broadcast: 0 where all are few enough, else a power of two that BROADCAST lines at most reach."""
    classes = {r["c"]: r["n"] for r in common.groupBy(F.floor(F.log2("n_docs")).cast("int").alias("c")).agg(F.count("*").alias("n")).collect()}  # 63 rows at most
    above = lambda c: sum(n for k, n in classes.items() if k >= c)
    if above(0) <= BROADCAST:
        return 0
    return 1 << next(c for c in range(SPREAD.bit_length() - 1, 65) if above(c) <= BROADCAST)


def drop_common_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with the text rewritten, and n_lines (before) and n_dropped."""
    common = Scratch(docs.sparkSession, "lines").write(common_lines(docs, doc, text, min_docs, min_chars), "common")
    least = sent_from(common)
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    rows = docs.select(F.col(doc).alias("d"), F.xxhash64(text).alias("t"), F.posexplode(lines).alias("pos", "line")).select("d", "t", "pos", line_key(F.col("line")).alias("key"))
    rows = rows.where(F.length("key") >= min_chars).select("d", "t", "pos", *hash128(F.col("key")))
    sent = F.broadcast(common.where(F.col("n_docs") >= least).select("h1", "h2"))  # checked
    gone = rows.join(sent, ["h1", "h2"], "left_semi")
    if least:
        gone = gone.unionByName(rows.join(sent, ["h1", "h2"], "left_anti").join(common.where(F.col("n_docs") < least), ["h1", "h2"], "left_semi"))
    # A document's dropped positions are bounded by its own lines.
    dropped = gone.groupBy("d", "t").agg(F.collect_set("pos").alias("__gone"))
    dropped = dropped.withColumnsRenamed({"d": "__d", "t": "__t"})
    whole = docs.join(dropped, F.col(doc).eqNullSafe(F.col("__d")) & (F.xxhash64(text) == F.col("__t")), "left").withColumn("__lines", lines)
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    put = F.when(F.col("__gone").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("__lines"), i)), "\n"))
    measures = {"n_lines": F.size("__lines").cast("long"), "n_dropped": F.coalesce(F.size("__gone"), F.lit(0)).cast("long")}
    return whole.withColumns({text: put, **measures}).drop("__d", "__t", "__gone", "__lines")
