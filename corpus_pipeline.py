"""The corpus pipeline: quality rules, line dedup, near duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All
but the last return the columns of documents. Nulls, empty texts, ties, repeated rows
and extra columns are handled as each operator's module says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, table
from millrace.llm.decontam import decontaminate
from millrace.llm.line_dedup import drop_common_lines
from millrace.llm.mixing import mix
from millrace.llm.ngram_join import BROADCAST_IDS, jaccard_components
from millrace.llm.quality import compression_bands

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rule or the compression bands reject."""
    return compression_bands(docs.select(COLUMNS)).where("kept").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines that 10 documents or more have; n_chars follows the text."""
    return drop_common_lines(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component, once; those without words or id stay.

    Rows of one id are one document: of several, the one that is first by text, language,
    source and n_chars stays.
    """
    found = Scratch(spark, "near").write(jaccard_components(docs.select("doc_id", "text")), "components")
    keep = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n"))
    once, more = (keep.where(n).select("id") for n in ("n = 1", "n > 1"))
    if keep.count() <= BROADCAST_IDS:  # checked; else both joins are shuffled
        once, more = F.broadcast(once), F.broadcast(more)
    own = lambda ids: docs.join(ids, F.col("doc_id") == F.col("id"), "left_semi").select(COLUMNS)
    first = own(more).groupBy("doc_id").agg(F.min(F.struct(COLUMNS[1:])).alias("x")).select("doc_id", "x.*")
    return own(once).union(first).union(docs.where("doc_id is null").select(COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark."""
    return decontaminate(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: zstandard and the random rounding can't be written in SQL; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again."""
    docs, scratch, before = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(docs, name)
            scratch.drop(before)
            before = docs
    return docs
