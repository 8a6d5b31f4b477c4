"""Scratch space and table helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Characters that separate words in most contracts: space and x09 to x0D, which bytes.split() uses too.
WORD_SPACES = b" \t\n\x0b\x0c\r"
#: Rows that a worker turns into Python objects at once.
SLICE_ROWS = 500
#: Rows and bytes of an Arrow batch: executors hold some for each task, in and out, and long texts or packed rows make
#: batches large. A single row may be longer.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Rows that a Parquet reader decodes at once, into arrays that it doubles when texts or lists outgrow them.
READ_ROWS = 512
#: Row groups of stored tables: a writer holds one, and texts make them large.
ROW_GROUP_BYTES = 32 << 20
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the store that the whole cluster shares (spark.checkpoint.dir).

    Only where that setting is absent and all executors are this process, a local temporary folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "ridgewatch-scratch")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it actions read at most READ_ROWS rows at once, and pass at most BATCH_ROWS and, beyond a single row,
    BATCH_BYTES at once to workers."""
    most = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS,
        "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES,
        "spark.sql.parquet.columnarReaderBatchSize": READ_ROWS,
    }
    before = {name: spark.conf.get(name) for name in most}
    for name, value in before.items():
        number = 0 if value.startswith("-") else spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(value)
        spark.conf.set(name, str(min(number, most[name]) if number > 0 else most[name]))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes df into the shared store and reads it back: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    with small_batches(spark):
        df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by store() that nothing reads any more."""
    for df in tables:
        jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow over slices of record batches; a slice bounds what a worker holds as Python objects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                yield fn(batch.slice(start, SLICE_ROWS))
        give_back_memory()

    return df.mapInArrow(run, schema)


def give_back_memory() -> None:
    """Returns what a worker has freed to the system: workers wait for their next task, often of another stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8 bytes; null is empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]
