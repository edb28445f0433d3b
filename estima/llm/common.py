"""What the operators of this subpackage share: reading tables, cutting lineage, batches of Arrow columns."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space, tab, newline, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset and all run in one process, a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:  # the setting itself can't be changed in a running session
            _LOCAL.append(f"file://{tempfile.mkdtemp(prefix='estima-')}")
        return _LOCAL[0]
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back, so a lost executor can't lose it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/estima-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*frames: DataFrame) -> None:
    """Delete the files behind frames made by stored() that nothing will read again."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark._jvm
        for f in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(f).getParent()
            if folder.getName().startswith("estima-"):
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames that nothing refers to any more, rather than when the driver next happens to collect
    garbage: a step that comes after a large shuffle then doesn't add to its disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_LEAN: list[bool] = []


def lean_worker() -> None:
    """Let this Python worker give memory back when an array of some MB is freed, rather than keep it for its life: the worker outlives its tasks."""
    if not _LEAN:
        _LEAN.append(True)
        pa.set_memory_pool(pa.system_memory_pool())
        with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
            ctypes.CDLL(None).mallopt(-3, 2 << 20)  # M_MMAP_THRESHOLD


def text_or_empty(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit("")))


def row_chunks(batches, rows: int = 256, text: str = "text", most_bytes: int = 8 << 20):
    """Arrow batches cut into pieces of few rows and, but for single long texts, few bytes of text."""
    lean_worker()
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > most_bytes or i - start >= rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)
