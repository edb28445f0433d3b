"""Paths for streams: what they read, and a folder that driver and executors share for what they keep."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, or, where that is unset and all run in one process, in a local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='estima-')}"
    return f"{base.rstrip('/')}/estima-{name}-{uuid.uuid4().hex}"


def stream_of(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet table as a stream. A file source watches folders, so a table of one file is picked out of its folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    source = spark.readStream.schema(schema)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return source.parquet(path)
    return source.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
