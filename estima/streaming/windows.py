"""Sketches over event-time windows, alike in batch and Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estima.plans.rollup import upsert


def windowed(df: DataFrame, time: str, aggregates: dict[str, Column], duration: str, slide: str | None = None, gap: bool = False, keys: Sequence[str] = (), late: str = "1 hour") -> DataFrame:
    """Sketches by window and keys: tumbling, sliding with slide, or, with gap, sessions that end after duration without rows.

    time may be a timestamp without a zone, which watermarks refuse; it is read as UTC. Rows later than `late` may be dropped by a stream.
    """
    own = df.withColumn(time, F.col(time).cast("timestamp"))
    if df.isStreaming:
        own = own.withWatermark(time, late)
    w = F.session_window(time, duration) if gap else F.window(time, duration, slide) if slide else F.window(time, duration)
    out = own.groupBy(w.alias("w"), *keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *aggregates)


def keep_merged(path: str, keys: Sequence[str], sketches: dict[str, dict]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch's sketches are merged into the table at path.

    A batch writes version <batch id> of the table from the version before it, so a batch that is run again after a failure writes the
    same version again: sketches are never merged twice. The newest version is the one that latest() reads.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = latest(spark, path, below=number)
        upsert(before, batch, keys, sketches).write.mode("overwrite").parquet(f"{path}/version={number:012d}")

    return merge


def latest(spark: SparkSession, path: str, below: int | None = None) -> DataFrame | None:
    """The newest whole version of the table, or the newest one under a batch number."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    found = []
    for s in fs.listStatus(folder):
        name = s.getPath().getName()
        if name.startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            found.append(int(name.removeprefix("version=")))
    found = [n for n in found if below is None or n < below]
    return spark.read.parquet(f"{path}/version={max(found):012d}") if found else None
