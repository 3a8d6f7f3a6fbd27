"""Parquet tables by name, and the shared folder for written results."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder_name(spark: SparkSession, label: str) -> str:
    """A new folder name under spark.checkpoint.dir; a temporary folder where that is unset and Spark runs in one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/millrace-{label}-{uuid.uuid4().hex}"


def shared_folder(spark: SparkSession, label: str) -> str:
    """A path in a new shared folder, for a table that lasts as long as the driver: the folder goes when the driver's JVM ends."""
    name = folder_name(spark, label)
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration())
    there.mkdirs(path)
    there.deleteOnExit(path)
    return f"{name}/data"


def ship_by_value(module: str) -> None:
    """Send classes of a module to Python workers as they are here, not by name: some workers don't get what spark.sparkContext.addPyFile ships."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
