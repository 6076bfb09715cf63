"""What the operators of this package share: work folders, row keys, Arrow batches, source ranks."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# ASCII white space of the contracts, as a Java and RE2 class and as bytes
BLANK = r"[\x20\x09-\x0D]+"
BLANK_BYTES = b" \t\n\x0b\x0c\r"
ROOT = str(Path(__file__).resolve().parents[2])
# One Arrow batch holds at most so many rows and bytes: bounds a Python worker's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def settings(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    # Python workers import this package by name, wherever the driver was started
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that ``spark.checkpoint.dir`` names.

    Where the setting is absent (tests in one JVM) a folder of this machine is set;
    on a cluster that is an error, as executors would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: survives lost executors, cuts lineage."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key() -> list[Column]:
    """``_id``, ``_h``: equal only for rows of equal doc_id and text, null ids included.

    Rows equal in both are interchangeable, so joins on this key need no unique doc_id.
    """
    return [F.coalesce("doc_id", F.lit(-(2**63))).cast("long").alias("_id"), F.xxhash64("text").alias("_h")]


def give_back() -> None:
    """What this worker has free goes back to the system: it waits for later tasks and stages, beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def per_batch(df: DataFrame, schema: str | StructType, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """``mapInArrow`` with a function made once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            if batch.num_rows:
                yield one(batch)
        del one
        give_back()

    return df.mapInArrow(run, schema)


# A memo keeps no longer keys than this: what has no spaces is worked out each time it comes.
LONGEST_KEY = 64


class TwoGenerations(dict):
    """A memo of a bounded number of entries of bounded keys; a miss calls ``make``.

    When the young generation is full it becomes the old one and the old one is
    dropped; what is still in use moves back. The bound changes only the speed.
    """

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        if len(key) > LONGEST_KEY:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
