"""HLL sketches as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estima.functions import hll as fh
from estima.functions.hashing import array_bytes, canonical_double


def check_lg(lg_k: int) -> int:
    if not fh.LEAST_LG <= lg_k <= fh.MOST_LG:
        raise ValueError(f"lg_k must be {fh.LEAST_LG} to {fh.MOST_LG}")
    return lg_k


def updatable(df: DataFrame, column: str) -> DataFrame:
    """df with the column as a type that the aggregate takes and hashes as the sketch format asks.

    Doubles become their canonical bytes and arrays the bytes of their elements; timestamps become microseconds. Empty text is left out.
    """
    kind = df.schema[column].dataType
    c = F.col(column)
    if isinstance(kind, T.DoubleType | T.FloatType):
        return df.withColumn(column, canonical_double(c.cast("double")))
    if isinstance(kind, T.ArrayType):
        return df.withColumn(column, array_bytes(c.cast("array<bigint>")))
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return df.withColumn(column, F.unix_micros(c.cast("timestamp")))
    if isinstance(kind, T.StringType | T.BinaryType):
        return df.withColumn(column, F.when(F.length(c) > 0, c))
    return df.withColumn(column, c.cast("bigint"))


def sketch(column: Column, lg_k: int = 12) -> Column:
    """Aggregate: the HLL sketch of a bigint, int, text or binary column; see updatable() for others."""
    return F.hll_sketch_agg(column, check_lg(lg_k))


def sketch_of(df: DataFrame, keys: list[str], column: str, lg_k: int = 12) -> DataFrame:
    """keys, sketch of a column of any type that updatable() knows. Python sees distinct doubles only."""
    own = df.select(*keys, column)
    if isinstance(df.schema[column].dataType, T.DoubleType | T.FloatType):
        own = own.distinct()
    own = updatable(own, column)
    return (own.groupBy(*keys) if keys else own).agg(sketch(F.col(column), lg_k).alias("sketch"))


def union(image: Column) -> Column:
    """Aggregate: the union of images of any lg_k. The result has the smallest lg_k among those in HLL mode; cap it with downsample()."""
    return F.hll_union_agg(image, True)
