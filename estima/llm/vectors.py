"""What the two vector searches share: clean vectors, and block joins of queries with buckets of vectors."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estima.llm.common import stored

PAGE = 4096  # vectors of a page at most, about: larger buckets are dealt over several pages by a hash of the id
BROADCAST_ROWS = 100_000  # a table of three longs a row with at most so many rows is broadcast
BLOCK = 1024  # queries that meet a page at a time, about


def clean_vectors(df: DataFrame, id_column: str = "vec_id", column: str = "embedding", keep_float: bool = False) -> DataFrame:
    """vec_id, v (array<double>, or of float if that is what it is and keep_float), dim of the rows whose id isn't null and whose vector isn't null,
    empty or holding null, NaN or infinity."""
    v = F.col(column).cast("array<float>" if keep_float and dict(df.dtypes)[column] == "array<float>" else "array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad).withColumn("dim", F.size("v"))


def matrix(column) -> np.ndarray:
    return np.array([np.asarray(x, np.float64) for x in column])


def _dealt(df: DataFrame, counts: DataFrame, own: str, n_own: str, n_other: str, other: str) -> DataFrame:
    """df with its own block number and once for each block of the other side."""
    out = df.join(counts, "bucket")
    out = out.withColumn(own, F.pmod(F.xxhash64("id"), F.col(n_own)).cast("int"))
    return out.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other).cast("int") - 1))).drop(n_own, n_other)


def block_join(queries: DataFrame, vectors: DataFrame, search: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, page: int = PAGE, block: int = BLOCK, counts: list[DataFrame] | None = None) -> DataFrame:
    """search(queries, vectors) for each block of queries and each page of vectors with the same bucket.

    Both frames have bucket and id. Buckets are counted (counts: bucket and n of either, if known); a bucket with more vectors than a page, or more queries
    than a block, is dealt over several, and each query block meets each page of its bucket, so nothing is left out and
    no task holds more than about a page and a block.
    """
    m, n = counts or [x.groupBy("bucket").agg(F.count("*").alias("n")) for x in (queries, vectors)]
    both = n.select("bucket", F.ceil(F.col("n") / page).alias("pages")).join(m.select("bucket", F.ceil(F.col("n") / block).alias("blocks")), "bucket")
    both = stored(both, "buckets")
    both = F.broadcast(both) if both.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else both
    left = _dealt(queries, both, "block", "blocks", "pages", "page")
    right = _dealt(vectors, both, "page", "pages", "blocks", "block")
    keys = ["bucket", "page", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, schema)


def best(found: DataFrame, k: int, descending: bool) -> DataFrame:
    """The k best of each query's rows (query_id, vec_id, score), of an id the best, ties to the smaller vec_id, with their rank."""
    found = found.groupBy("query_id", "vec_id").agg((F.max if descending else F.min)("score").alias("score"))
    order = [F.col("score").desc() if descending else F.col("score").asc(), F.col("vec_id")]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def power_of_two(n: int) -> int:
    return 1 << max(0, math.ceil(math.log2(n)))
