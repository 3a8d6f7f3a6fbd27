"""A streaming upsert sink: each batch is merged into a snapshot of the latest row a key, exactly once.

The snapshot is dealt to buckets by a hash of the key. A batch is reduced to its latest row a
key; only the buckets that it touches are read, merged and written anew, each to a new
folder, and a manifest with the folder of every bucket is written last. Spark's
_SUCCESS file of the manifest is the commit: readers follow the newest manifest that has one, and a
batch whose number a manifest already has is left alone, so a batch that is replayed after a
failure changes nothing. A merge takes the greatest of two rows by the order columns, so that rows
that come late or twice, or in other batches, give the same snapshot.

Plan: one partial and final aggregate over the batch, one over the touched buckets, one
shuffle to a task a bucket for the write. The driver sees a row a bucket. One stream writes a
snapshot at a time, as one checkpoint has one query.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import shared_folder
from .events import TIMEOUT_S, event_stream


@dataclass
class Snapshot:
    """The latest row of each key under a folder that all machines share.

    order: columns that put the rows of a key in order; of rows equal in them the one that is greatest by its other columns
    counts. deleted: a column that, where true in the latest row, takes the key away. buckets: parts of
    the snapshot; it stays as it is for the life of a snapshot, and a bucket is what one task writes.
    """

    spark: SparkSession
    root: str
    schema: T.StructType
    keys: list[str]
    order: list[str]
    deleted: str | None = None
    buckets: int = 16
    _columns: list[str] = field(init=False)

    def __post_init__(self):
        self._columns = [f.name for f in self.schema.fields]

    def _folders(self, under: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{under}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def versions(self) -> list[int]:
        """Batches that are committed, in order."""
        return sorted(int(x) for x in self._folders("manifest") if x.isdigit() and self._exists(f"manifest/{x}/_SUCCESS"))

    def _parts(self, version: int | None) -> dict[int, str]:
        """The folder of each bucket."""
        if version is None:
            return {}
        return {r["bucket"]: r["folder"] for r in self.spark.read.schema("bucket int, folder string").parquet(f"{self.root}/manifest/{version}").collect()}

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/data/{f}" for f in folders])

    def _latest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self._columns if c not in self.keys and c not in self.order]
        last = rows.groupBy(*self.keys).agg(F.max(F.struct(*self.order, *rest)).alias("_last"))
        return last.select(*[F.col(c) if c in self.keys else F.col(f"_last.{c}").alias(c) for c in self._columns])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """What foreachBatch calls; a batch that is committed is passed over."""
        done = self.versions()
        if done and done[-1] >= batch_id:
            return
        before = self._parts(done[-1] if done else None)
        news = self._latest(batch.select(*self._columns)).persist()
        try:
            touched = [r["b"] for r in news.select(self._bucket().alias("b")).distinct().collect()]
            merged = self._latest(self._read([before[b] for b in touched if b in before]).unionByName(news)) if any(b in before for b in touched) else news
            folder = f"{batch_id}-{uuid.uuid4().hex}"  # a new one for each attempt
            if touched:
                merged.withColumn("_bucket", self._bucket()).repartition(max(1, len(touched)), "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/data/{folder}")
        finally:
            news.unpersist()
        now = before | {b: f"{folder}/_bucket={b}" for b in touched}
        self.spark.createDataFrame(sorted(now.items()), "bucket int, folder string").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/{batch_id}")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a committed version, the newest if not given."""
        done = self.versions()
        if version is not None and version not in done:
            raise ValueError(f"version {version} is not among {done}")
        rows = self._read(list(self._parts(version if version is not None else done[-1] if done else None).values()))
        return rows if self.deleted is None else rows.where(~F.coalesce(F.col(self.deleted), F.lit(False)))

    def vacuum(self, keep: int = 2) -> int:
        """Delete what the newest keep versions don't need; how many folders of data went."""
        done = self.versions()
        held = {f.split("/")[0] for v in done[-keep:] for f in self._parts(v).values()}
        gone = [f"data/{x}" for x in self._folders("data") if x not in held]
        for name in [*gone, *(f"manifest/{v}" for v in done[:-keep])]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return len(gone)


def upsert_now(stream: DataFrame, snapshot: Snapshot, checkpoint: str) -> Snapshot:
    """All rows that are there now, merged batch by batch."""
    query = stream.writeStream.foreachBatch(snapshot.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if not query.awaitTermination(TIMEOUT_S):
        query.stop()
        raise TimeoutError(snapshot.root)
    return snapshot


def c53_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's latest event, kept up by a stream; an error as the latest takes the user away."""
    events = event_stream(spark, sf_dir).select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "event_type", "value", (F.col("event_type") == "error").alias("gone"))
    folder = shared_folder(spark, "upsert")
    snapshot = Snapshot(spark, f"{folder}/table", events.schema, ["user_id"], ["ts", "event_id"], deleted="gone")
    return upsert_now(events, snapshot, f"{folder}/state").read().drop("gone")
