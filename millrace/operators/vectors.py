"""Exact nearest vectors: blocked distance products, a bounded heap a task, and a merge.

Queries go out in blocks of about BLOCK by hash (BLOCK x dimensions x 8 bytes are broadcast,
whatever the data), and each block is one pass over the base vectors: a task takes a slice of rows and a
slice of queries, finds their distances by one matrix product, and keeps the k nearest of each query so
far. What leaves a task is k rows a query at most; a second top-k by query merges them.
No pair of rows is ever a row, and no index stands between: every distance is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import shared_folder, table

#: Queries in a block on average, and rows or queries in a tile of distances.
BLOCK, TILE = 4096, 1024


def _nearest(queries: np.ndarray, names: np.ndarray, k: int, places: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, far = np.zeros((len(queries), k), np.int64), np.full((len(queries), k), np.inf)
        own = (queries * queries).sum(axis=1)
        for whole in batches:
            for at in range(0, whole.num_rows, TILE):
                batch = whole.slice(at, TILE)
                new, x = batch.column("id").to_numpy(zero_copy_only=False), batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                square = (x * x).sum(axis=1)
                for q in range(0, len(queries), TILE):
                    part = slice(q, q + TILE)
                    d = np.round(np.sqrt(np.maximum(own[part, None] + square[None, :] - 2 * queries[part] @ x.T, 0.0)), places)
                    if d.shape[1] > k:  # ties at the kth distance stay, as ids decide between them
                        kth = np.partition(d, k - 1, axis=1)[:, k - 1]
                        keep = np.flatnonzero((d <= np.minimum(kth, far[part, -1])[:, None]).any(axis=0))
                        d, some = d[:, keep], new[keep]
                    else:
                        some = new
                    if not len(some):
                        continue
                    both = np.concatenate([far[part], d], axis=1)
                    name = np.concatenate([ids[part], np.broadcast_to(some, d.shape)], axis=1)
                    order = np.lexsort((name, both), axis=1)[:, :k]
                    far[part], ids[part] = np.take_along_axis(both, order, axis=1), np.take_along_axis(name, order, axis=1)
        q, place = np.nonzero(np.isfinite(far))
        yield pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(ids[q, place]), pa.array(far[q, place])], names=["query", "id", "distance"])

    return run


def nearest_vectors(queries: DataFrame, base: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding", places: int = 6, block: int = BLOCK) -> DataFrame:
    """(query, rank, id, distance): the k nearest base vectors of each query by Euclidean distance, rounded to places; of equally far ones the smallest ids.

    Rows with a null id, or a vector that is null, empty or has an entry that is no finite number, take no part; nor do those of another
    length than the first block of queries says (the most common length of the base, of equals the largest). Ids name the rows: rows of one id
    are told apart in the base, and among queries they count once.
    """
    spark = base.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(f"`{vector}`").cast("array<double>")
        there = F.coalesce(F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & (F.size(v) > 0), F.lit(False))
        return df.where(F.col(f"`{id}`").isNotNull() & there).select(F.col(f"`{id}`").cast("long").alias("id"), v.alias("v"))

    rows, asked = clean(base), clean(queries)
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    schema = "query long, rank int, id long, distance double"
    if size is None:
        return spark.createDataFrame([], schema)
    rows, asked = rows.where(F.size("v") == size["d"]), asked.where(F.size("v") == size["d"])
    n_blocks = -(-asked.count() // block)
    order = Window.partitionBy("query").orderBy("distance", "id")
    path = shared_folder(spark, "nearest")
    spark.createDataFrame([], schema).write.parquet(path)
    for b in range(n_blocks):
        some = {r["id"]: r["v"] for r in asked.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b).collect()}  # about a block
        if some:
            found = rows.mapInArrow(_nearest(np.array(list(some.values())), np.array(list(some), np.int64), k, places), "query long, id long, distance double")
            ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            ranked.select("query", F.col("rank").cast("int").alias("rank"), "id", "distance").write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def c57_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every vector whose id is divisible by 50, itself included."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_vectors(vectors.where("vec_id % 50 = 0"), vectors, 10)
