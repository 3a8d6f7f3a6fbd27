"""A Python data source: Arrow files with the range of every column, read by partition and pruned by filters.

spark.read.format("range_files").load(path) and df.write.format("range_files").mode(...).save(path).

Writing has two phases. A task streams its batches to a file of its own under data/<job>/ and returns its name with
the least and greatest value of each column; a task that fails takes its file away. Only when all
tasks are done does the driver write a manifest that names the files, under a temporary name, and move it to
its number: that move is the commit, and what no manifest names is never read. An aborted job takes its
folder away. Overwriting is a manifest with the new files alone; the old ones go after the commit.

Reading takes the newest manifest: a partition is a file, and the files that no row of which can pass
the pushed filters are left out. Filters are handed back to Spark as well, as a file's range says
what it may hold and not what it does. A reader holds one Arrow batch at a time. The driver sees a manifest, a line a file.

path is a folder that all machines share, as a URI that pyarrow.fs opens (a local folder in tests).
"""

from __future__ import annotations

import datetime
import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage

from .tables import shared_folder, ship_by_value, table

_EPOCH = datetime.datetime(1970, 1, 1)


def plain(x: Any) -> Any:
    """A value as JSON keeps it, in the same order: times as microseconds, dates as days; others that JSON lacks are None."""
    if isinstance(x, datetime.datetime):
        x = x.astimezone(datetime.timezone.utc).replace(tzinfo=None) if x.tzinfo else x
        return (x - _EPOCH) // datetime.timedelta(microseconds=1)
    if isinstance(x, datetime.date):
        return x.toordinal()
    if isinstance(x, (bool, int, str)) or isinstance(x, float) and math.isfinite(x):
        return x
    return None


@dataclass
class Column:
    """What a file holds of a column; low and high are None where that isn't known."""

    low: Any = None
    high: Any = None
    nulls: int = 0
    known: bool = True

    def add(self, x: pa.Array) -> None:
        self.nulls += x.null_count
        if not self.known or x.null_count == len(x):
            return
        simple = pa.types.is_integer(x.type) or pa.types.is_floating(x.type) or pa.types.is_temporal(x.type) or pa.types.is_string(x.type)
        if not simple or pa.types.is_floating(x.type) and pc.any(pc.is_nan(x)).as_py():  # NaN is Spark's greatest number
            self.known, self.low, self.high = False, None, None
            return
        found = pc.min_max(x)
        low, high = plain(found["min"].as_py()), plain(found["max"].as_py())
        if low is None or high is None:
            self.known, self.low, self.high = False, None, None
            return
        self.low, self.high = low if self.low is None else min(self.low, low), high if self.high is None else max(self.high, high)


def may_pass(f: Filter, file: dict) -> bool:
    """Whether a row of the file can pass the filter; True where that isn't known."""
    where = getattr(f, "attribute", ())
    c = file["columns"].get(where[0]) if len(where) == 1 else None
    if c is None:
        return True
    if isinstance(f, IsNull):
        return c["nulls"] > 0
    if isinstance(f, IsNotNull):
        return c["nulls"] < file["rows"]
    if isinstance(f, EqualNullSafe) and f.value is None:
        return c["nulls"] > 0
    if isinstance(f, In):
        return any(may_pass(EqualTo(where, x), file) for x in f.value)
    x = getattr(f, "value", None)
    if isinstance(f, (EqualTo, EqualNullSafe, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith)):
        if c["nulls"] == file["rows"]:
            return False  # no comparison holds for null
        x = plain(x)
        if x is None or c["low"] is None or isinstance(x, str) != isinstance(c["low"], str):
            return True
        low, high = c["low"], c["high"]
        if isinstance(f, (EqualTo, EqualNullSafe)):
            return low <= x <= high
        if isinstance(f, StringStartsWith):
            return low[: len(x)] <= x <= high[: len(x)]
        if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            return high > x or isinstance(f, GreaterThanOrEqual) and high == x
        return low < x or isinstance(f, LessThanOrEqual) and low == x
    return True


class Folder:
    """The files and manifests under a path."""

    def __init__(self, path: str):
        self.path = path

    def _open(self) -> tuple[fs.FileSystem, str]:
        if "://" in self.path or self.path.startswith("file:"):
            return fs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + self.path.removeprefix("file:"))
        return fs.LocalFileSystem(), self.path

    def newest(self) -> tuple[int, dict | None]:
        """The number of the newest manifest and what it says; 0 and None before the first."""
        there, root = self._open()
        found = [i.base_name for i in there.get_file_info(fs.FileSelector(f"{root}/manifest", allow_not_found=True))]
        numbers = sorted(int(x.removesuffix(".json")) for x in found if x.endswith(".json") and x[:-5].isdigit())
        if not numbers:
            return 0, None
        with there.open_input_stream(f"{root}/manifest/{numbers[-1]:08}.json") as f:
            return numbers[-1], json.loads(f.read())

    def commit(self, number: int, manifest: dict) -> None:
        there, root = self._open()
        there.create_dir(f"{root}/manifest")
        target, temporary = f"{root}/manifest/{number:08}.json", f"{root}/manifest/.{uuid.uuid4().hex}"
        with there.open_output_stream(temporary) as f:
            f.write(json.dumps(manifest).encode())
        if there.get_file_info(target).type != fs.FileType.NotFound:
            there.delete_file(temporary)
            raise RuntimeError(f"another job has written manifest {number} meanwhile")
        there.move(temporary, target)

    def create(self, name: str):
        there, root = self._open()
        there.create_dir(f"{root}/{name.rpartition('/')[0]}")
        return there.open_output_stream(f"{root}/{name}")

    def read(self, name: str):
        there, root = self._open()
        return there.open_input_file(f"{root}/{name}")

    def delete(self, name: str) -> None:
        there, root = self._open()
        kind = there.get_file_info(f"{root}/{name}").type
        if kind == fs.FileType.Directory:
            there.delete_dir(f"{root}/{name}")
        elif kind == fs.FileType.File:
            there.delete_file(f"{root}/{name}")


@dataclass
class Written(WriterCommitMessage):
    #: name, rows and columns of the task's file; None where the task had no rows.
    file: dict | None


class RangeWriter(DataSourceArrowWriter):
    def __init__(self, folder: Folder, schema: T.StructType, overwrite: bool):
        self.folder, self.schema, self.overwrite = folder, schema.json(), overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name, sink, out, rows, columns = f"data/{self.job}/{uuid.uuid4().hex}.arrow", None, None, 0, {}
        try:
            for batch in iterator:
                if out is None:
                    sink = self.folder.create(name)
                    out = pa.ipc.new_file(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                    columns = {c: Column() for c in batch.schema.names}
                out.write_batch(batch)
                rows += batch.num_rows
                for c, x in zip(batch.schema.names, batch.columns):
                    columns[c].add(x)
            if out is not None:
                out.close()
                sink.close()
        except BaseException:
            if sink is not None:
                sink.close()
                self.folder.delete(name)
            raise
        kept = {c: {"low": x.low, "high": x.high, "nulls": x.nulls} for c, x in columns.items()}
        return Written({"name": name, "rows": rows, "columns": kept} if rows else None)

    def commit(self, messages: list[Written | None]) -> None:
        number, before = self.folder.newest()
        files = [m.file for m in messages if m is not None and m.file]
        old = before["files"] if before else []
        if before and not self.overwrite and before["schema"] != self.schema:
            self.folder.delete(f"data/{self.job}")
            raise ValueError("appended rows must have the columns of those that are there")
        self.folder.commit(number + 1, {"schema": self.schema, "files": files if self.overwrite else [*old, *files]})
        for f in old if self.overwrite else []:
            self.folder.delete(f["name"])

    def abort(self, messages: list[Written | None]) -> None:
        self.folder.delete(f"data/{self.job}")


@dataclass
class FilePartition(InputPartition):
    name: str


class RangeReader(DataSourceReader):
    def __init__(self, folder: Folder):
        self.folder = folder
        self.files = (folder.newest()[1] or {"files": []})["files"]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        self.files = [x for x in self.files if all(may_pass(f, x) for f in filters)]
        yield from filters

    def partitions(self) -> list[FilePartition]:
        return [FilePartition(x["name"]) for x in self.files] or [FilePartition("")]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        if partition.name:
            with self.folder.read(partition.name) as f:
                there = pa.ipc.open_file(f)
                for k in range(there.num_record_batches):
                    yield there.get_batch(k)


class RangeFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "range_files"

    def _folder(self) -> Folder:
        if not self.options.get("path"):
            raise ValueError("range_files needs a path")
        return Folder(self.options["path"].rstrip("/"))

    def schema(self) -> T.StructType:
        manifest = self._folder().newest()[1]
        if manifest is None:
            raise ValueError(f"nothing is written at {self.options['path']}")
        return T.StructType.fromJson(json.loads(manifest["schema"]))

    def reader(self, schema: T.StructType) -> RangeReader:
        return RangeReader(self._folder())

    def writer(self, schema: T.StructType, overwrite: bool) -> RangeWriter:
        return RangeWriter(self._folder(), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known, and have Spark hand it filters."""
    ship_by_value(__name__)
    spark.dataSource.register(RangeFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def c55_range_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written in ranges of their date and read again; a year and a half reads the files of its dates."""
    register(spark)
    path = shared_folder(spark, "ranges")
    orders = table(spark, sf_dir, "orders")
    # A number that is asked for isn't coalesced, so the ranges are as many as the shuffle's partitions.
    orders.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderdate").write.format("range_files").mode("append").save(path)
    back = spark.read.format("range_files").load(path)
    return back.where((F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1997-07-01").cast("timestamp_ntz")))
