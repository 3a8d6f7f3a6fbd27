"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import shutil
import string
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only characters that part words: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\f\r"
#: The same set as a regular expression for one word, for Spark and DuckDB.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one Arrow batch may hold, so that very long documents don't
#: pile up in a Python worker.
BATCH_BYTES = 8 << 20
#: Spark's setting that deletes the shuffle files of a query when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def word_count(col: Column) -> Column:
    """Number of words, as a long; null counts as 0."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def hash128(col: Column, prefix: str = "h") -> list[Column]:
    """Two 64-bit hashes with different seeds, as columns <prefix>1 and <prefix>2.

    One 64-bit hash would collide among the 10^12 lines of a 100 TB corpus.
    """
    return [F.xxhash64(col).alias(f"{prefix}1"), F.xxhash64(F.lit(7), col).alias(f"{prefix}2")]


def ready_for_python(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, not by rows alone, and ship this package to the executors, once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if not any(f.endswith("/millrace.zip") for f in context.listFiles):
        root = Path(__file__).resolve().parents[2]
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/millrace", "zip", root, "millrace"))


def byte_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, so that only some texts are Python objects at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


class Scratch:
    """Tables written in the folder that driver and executors share.

    Uses spark.checkpoint.dir; where that is unset and Spark runs in one process (tests) a
    temporary folder. On a cluster it must be set: other machines don't see local folders.
    A written table cuts the lineage and survives the loss of an executor. Tables that aren't
    dropped before, as a result reads them, go when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            base = getattr(Scratch, "_local", None) or tempfile.mkdtemp(prefix="millrace-")
            Scratch._local = base
        self.root = f"{base.rstrip('/')}/millrace-{label}-{uuid.uuid4().hex}"
        self.n = 0
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        there.mkdirs(path)
        there.deleteOnExit(path)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """df, written and read again."""
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        # The shuffles of a write are of no use once the table is there; else they stay until the driver happens to collect garbage.
        held = self.spark.conf.get(SHUFFLE_CLEANUP, None)
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            if held is None:
                self.spark.conf.unset(SHUFFLE_CLEANUP)
            else:
                self.spark.conf.set(SHUFFLE_CLEANUP, held)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            if t is not None:
                path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
                path.getFileSystem(conf).delete(path, True)
