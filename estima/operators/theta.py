"""Theta sketches as aggregates."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estima.functions import theta as ft
from estima.functions.hashing import theta_hash
from estima.functions.headers import MAX_THETA, SEED

LEAST_LG, MOST_LG, DEFAULT_LG = 4, 26, 12
LEAST_ALPHA_LG = 9


def check_lg(lg_k: int) -> int:
    if not LEAST_LG <= lg_k <= MOST_LG:
        raise ValueError(f"lg_k must be {LEAST_LG} to {MOST_LG}")
    return lg_k


def lg_of_entries(entries: int) -> int:
    """Nominal entries, 16 to 2^26, rounded up to a power of two."""
    if not 1 << LEAST_LG <= entries <= 1 << MOST_LG:
        raise ValueError("nominal entries must be 16 to 2^26")
    return (entries - 1).bit_length()


def value_of(column: Column, data_type: T.DataType) -> Column:
    """A column as the type whose bytes are hashed: timestamps as microseconds, dates as days, decimals as text, booleans as 0 and 1."""
    if isinstance(data_type, T.TimestampType | T.TimestampNTZType):
        return F.unix_micros(column.cast("timestamp"))
    if isinstance(data_type, T.DateType):
        return F.unix_date(column).cast("long")
    if isinstance(data_type, T.DecimalType):
        return column.cast("string")
    if isinstance(data_type, T.BooleanType):
        return column.cast("int").cast("long")
    return column.cast("double") if isinstance(data_type, T.FloatType) else column


def sketch(column: Column, lg_k: int = DEFAULT_LG) -> Column:
    """Aggregate: the theta sketch of a column. Null and empty values change nothing."""
    return F.theta_sketch_agg(column, check_lg(lg_k))


def union(image: Column, lg_k: int = DEFAULT_LG, seed: int = SEED) -> Column:
    """Aggregate: the union of images made with one seed; null images are skipped."""
    return ft.with_seed(seed, lambda x: F.theta_union_agg(x, check_lg(lg_k)), image)


def intersect(image: Column, seed: int = SEED) -> Column:
    """Aggregate: the intersection of images made with one seed; null images are skipped. A group without any image has no intersection and
    fails; see intersect_all()."""
    return ft.with_seed(seed, F.theta_intersection_agg, image)


def intersect_all(df: DataFrame, keys: Sequence[str], column: str, seed: int = SEED) -> DataFrame:
    """keys, sketch: the intersection of each group's images. Groups without an image, or no rows at all, give no row."""
    own = df.where(F.col(column).isNotNull()).withColumn("whole", F.lit(0))
    return own.groupBy(*keys or ["whole"]).agg(intersect(F.col(column), seed).alias("sketch")).select(*keys, "sketch")


def kmv_sketch(df: DataFrame, keys: Sequence[str], column: str, lg_k: int = DEFAULT_LG, seed: int = SEED, p: float = 1.0) -> DataFrame:
    """keys, sketch: a theta sketch in relational form, for what the builtin lacks, other seeds and sampling probabilities.

    Each task hashes its rows once and keeps the k + 1 smallest hashes of a group, in bounded memory; only these are shuffled, once, by the keys. Of the k + 1
    smallest below p * 2^63 of all tasks the first k are kept, theta is the last. Groups without a value give empty sketches.
    """
    check_lg(lg_k)
    if not 0 < p <= 1:
        raise ValueError("the sampling probability must be above 0 and at most 1")
    kinds = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double", "array<bigint>": "array"}
    own = df.select(*keys, value_of(F.col(column), df.schema[column].dataType).alias("v"))
    kind = kinds.get(own.dtypes[-1][1], own.dtypes[-1][1])
    if kind not in ("bigint", "double", "string", "binary", "array"):
        raise TypeError(f"values of type {kind} can't be hashed")
    start = min(MAX_THETA, int(p * 2.0**63))
    k = 1 << lg_k
    hashed = own.select(*keys, theta_hash(F.col("v"), kind, seed).alias("h"))
    few = hashed.mapInArrow(lambda batches: _smallest(batches, len(keys), k + 1), hashed.schema)
    placed = few.withColumn("place", F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.col("h").asc_nulls_last()))).where(F.col("place") <= k + 1)
    below = F.when(F.col("h") < start, F.col("h"))
    packed = placed.groupBy(*keys).agg(
        F.collect_set(F.when(F.col("place") <= k, below)).alias("hashes"),
        F.max(F.when(F.col("place") == k + 1, below)).alias("next"),
        (F.count("h") == 0).alias("none"),  # a group all of whose values were sampled away isn't empty
    )
    return packed.select(*keys, ft.from_hashes(F.col("hashes"), F.coalesce("next", F.lit(start)), F.col("none"), seed).alias("sketch"))


def _smallest(batches: Iterator[pa.RecordBatch], n_keys: int, most: int, held: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The `most` smallest distinct hashes of each group, and a null if there is one; of at most about `held` rows at a time, so that with many
    groups one may come in parts."""

    def reduced(table: pa.Table) -> pa.Table:
        group = np.zeros(table.num_rows, np.int64)
        for i in range(n_keys):
            codes = table.column(i).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            group = np.unique(np.stack([group, codes]), axis=1, return_inverse=True)[1].reshape(-1)
        h = pc.fill_null(table.column(n_keys), MAX_THETA).to_numpy()  # no hash is that large
        order = np.lexsort((h, group))
        group, h = group[order], h[order]
        new_group = np.r_[True, group[1:] != group[:-1]]
        new = new_group | np.r_[True, h[1:] != h[:-1]]
        order, new_group, h = order[new], new_group[new], h[new]
        starts = np.flatnonzero(new_group)
        place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
        return table.take(pa.array(order[(place < most) | (h == MAX_THETA)]))

    kept: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        kept.append(batch)
        rows += batch.num_rows
        if rows > held:
            table = reduced(pa.Table.from_batches(kept))
            kept = table.to_batches()
            if table.num_rows > held // 2:
                yield from kept
                kept = []
            rows = sum(b.num_rows for b in kept)
    if rows:
        yield from reduced(pa.Table.from_batches(kept)).to_batches()


def update_results(df: DataFrame, column: str, order: str, kind: str, lg_k: int = DEFAULT_LG, seed: int = SEED) -> DataFrame:
    """What each update, in the order given, does to one sketch: Inserted, RejectedDuplicate, RejectedOverTheta or RejectedNullOrEmpty.

    A row-level report over one sketch's stream, in the trimmed form: theta before a row is the (k + 1)-th smallest distinct hash so
    far. It needs the stream in order, so it runs in one task, which reads sorted rows batch by batch and holds k + 1 hashes.
    """
    hashed = df.select(order, theta_hash(F.col(column), kind, seed).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[int] = []
        limit = MAX_THETA
        for batch in batches:
            out = []
            for h in batch.column(1).to_pylist():
                if h is None:
                    out.append("RejectedNullOrEmpty")
                elif h >= limit:
                    out.append("RejectedOverTheta")
                else:
                    i = bisect.bisect_left(kept, h)
                    if i < len(kept) and kept[i] == h:
                        out.append("RejectedDuplicate")
                    else:
                        kept.insert(i, h)
                        if len(kept) > 1 << lg_k:
                            limit = kept.pop()
                        out.append("Inserted")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[order, "result"])

    return hashed.repartition(1).sortWithinPartitions(order).mapInArrow(run, T.StructType([hashed.schema[order], T.StructField("result", T.StringType())]))


def alpha_sketch(df: DataFrame, keys: Sequence[str], column: str, order: str, kind: str, lg_k: int = DEFAULT_LG, seed: int = SEED, p: float = 1.0, deviations: int = 2) -> DataFrame:
    """keys, sketch (an image that set operations take), estimate, lower and upper bound at 1, 2 or 3 deviations, of the Alpha algorithm.

    It depends on the order of updates, which is that of the column `order`. A value counts where it comes first: theta only falls,
    so a repeat is either known or over theta. So each group is reduced to its distinct hashes before it goes, as it must, to one task, which
    reads them in order, batch by batch, and holds at most 2 k of one group. Without rows there is no group and no sketch.
    """
    if lg_k < LEAST_ALPHA_LG:
        raise ValueError("Alpha needs at least 512 nominal entries")
    if deviations not in (1, 2, 3):
        raise ValueError("bounds are for 1, 2 or 3 standard deviations")
    own = df.select(*keys, F.col(order).alias("at"), theta_hash(F.col(column), kind, seed).alias("h")).where("h is not null")
    firsts = own.groupBy(*keys, "h").agg(F.min("at").alias("at"))
    n, k, decay = len(keys), 1 << lg_k, (1 << lg_k) / ((1 << lg_k) + 1.0)
    start = min(MAX_THETA, int(p * 2.0**63))
    turn = int(p * (decay + 1.0) / 2.0 * 2.0**63)  # above it, fewer than k + 1 values have come in

    def row(key: list, limit: int, kept: list[int]) -> list:
        own = [h for h in kept if h < limit]
        estimate = (len(own) if limit > turn else k) * (2.0**63 / limit)
        spread = deviations * math.sqrt(alpha_variance(len(own), limit / 2.0**63, k, p))
        image = ft.encode(np.array(own, np.int64), limit, False, seed)
        if limit == MAX_THETA:
            return [*key, image, estimate, float(len(own)), float(len(own))]
        return [*key, image, estimate, max(0.0, estimate - spread) if own else 0.0, estimate + spread]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, key, limit, kept = None, None, start, []
        for batch in batches:
            schema = schema or pa.schema([*(batch.schema.field(i) for i in range(n)), ("sketch", pa.binary()), ("estimate", pa.float64()), ("lower", pa.float64()), ("upper", pa.float64())])
            columns = [batch.column(i).to_pylist() for i in range(n)]
            hashes = batch.column(n).to_pylist()
            same = zip(*columns, strict=True) if n else ((),) * len(hashes)
            done = []
            for found, h in zip(same, hashes, strict=True):
                if found != key and repr(found) != repr(key):  # by text too: a NaN is no other key than a NaN
                    if key is not None:
                        done.append(row(list(key), limit, kept))
                    key, limit, kept = found, start, []
                if h < limit:
                    kept.append(h)
                    if limit <= turn or len(kept) > k:
                        limit = int(limit * decay)
                        if len(kept) > 2 * k:
                            kept = [x for x in kept if x < limit]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row(list(key), limit, kept), schema, strict=True)], schema=schema)

    fields = [df.schema[x] for x in keys] + [T.StructField("sketch", T.BinaryType())] + [T.StructField(x, T.DoubleType()) for x in ("estimate", "lower", "upper")]
    dealt = firsts.select(*keys, "h", "at")
    dealt = dealt.repartition(*keys) if keys else dealt.repartition(1)
    return dealt.sortWithinPartitions(*keys, "at", "h").mapInArrow(run, T.StructType(fields))


def alpha_variance(n: int, theta: float, k: int, p: float = 1.0) -> float:
    """The variance of Alpha's estimate.

    Values come in at rate p until k + 1 have; up to then n of them say n / p, with the variance n (1 - p) / p^2 of a binomial count. From
    then on each one that comes in lowers theta by the factor k / (k + 1), and stands for 1 / theta values: the waiting time for it is geometric, of
    variance (1 - t) / t^2 at rate t. So what these steps add is the sum, over the rates t = s, s d, s d^2, .. > theta where s is the rate after the first
    step, of 1 / t^2 - 1 / t, two geometric series. Last, theta itself stands for a step that hasn't ended.
    """
    d = k / (k + 1.0)
    turn = p * (1.0 + d) / 2.0  # above it fewer than k + 1 values have come in
    rest = (1.0 - theta) / theta**2
    if theta > turn:
        return n * (1.0 - p) / p**2 + rest
    before = (k + 1.0) * (1.0 - p) / p**2
    if theta > d * turn:
        return before + rest
    series = lambda power: (theta**-power - (p * d) ** -power) / (d**-power - 1.0)  # noqa: E731  sum of t ** -power over the rates
    return before + series(2) - series(1) + rest
