"""Scalar functions over theta images."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from estima.functions.bounds import bound
from estima.functions.hashing import seed_hash
from estima.functions.headers import EMPTY_THETA, MAX_THETA, SEED, theta_header


def empty_image() -> Column:
    return F.lit(EMPTY_THETA)


def or_empty(image: Column) -> Column:
    """A null image counts as an empty sketch."""
    return F.coalesce(image, empty_image())


def retained(image: Column) -> Column:
    return theta_header(image)["retained"]


def theta_long(image: Column) -> Column:
    return theta_header(image)["theta_long"]


def theta(image: Column) -> Column:
    return theta_header(image)["theta_long"] / F.lit(2.0**63)


def estimate(image: Column) -> Column:
    """The unrounded estimate."""
    h = theta_header(image)
    return h["retained"] * (F.lit(2.0**63) / h["theta_long"])


def _bound(image: Column, deviations: int, upper: bool) -> Column:
    if deviations not in (1, 2, 3):
        raise ValueError("bounds are for 1, 2 or 3 standard deviations")

    @F.pandas_udf("double")
    def of(headers: pd.DataFrame) -> pd.Series:
        out = headers["retained"].astype("float64")  # null for a null image
        some = headers["is_estimating"].fillna(False).astype(bool).to_numpy()
        if some.any():
            out[some] = bound(out[some].to_numpy(), headers["theta_long"][some].to_numpy(np.float64) / 2.0**63, deviations, upper)
        return out

    return of(theta_header(image))


def lower_bound(image: Column, deviations: int = 2) -> Column:
    """The exact count if nothing was sampled away, else the binomial bound."""
    return _bound(image, deviations, False)


def upper_bound(image: Column, deviations: int = 2) -> Column:
    return _bound(image, deviations, True)


def decode(image: bytes) -> tuple[np.ndarray, int, bool]:
    """Retained hashes, theta and whether the sketch is empty, of a compact image of version 3 or 4."""
    raw = np.frombuffer(image, np.uint8)
    if len(raw) < 8:
        raise ValueError("theta image is truncated")
    longs, version, empty = int(raw[0]) & 0x3F, int(raw[1]), bool(raw[5] & 4)
    if raw[2] != 3 or version not in (3, 4):
        raise ValueError("not a compact theta image")
    at = lambda i, n: int.from_bytes(image[i : i + n], "little")
    if version == 4:
        width, size = int(raw[3]), int(raw[4])
        if not 1 <= width <= 63 or not 1 <= size <= 4:
            raise ValueError("theta image: width out of range")
        limit = at(8, 8) if longs > 1 else MAX_THETA
        if not 0 < limit <= MAX_THETA:
            raise ValueError("theta image: theta must be positive")
        start = 16 if longs > 1 else 8
        count = at(start, size)
        bits = np.unpackbits(raw[start + size :])[: count * width]
        if len(bits) < count * width:
            raise ValueError("theta image is truncated")
        padded = np.zeros((count, 64), np.uint8)
        padded[:, 64 - width :] = bits.reshape(count, width)
        gaps = np.packbits(padded, axis=1).view(">u8").reshape(-1).astype(np.int64)
        return np.cumsum(gaps), limit, empty
    if empty:
        return np.empty(0, np.int64), MAX_THETA, True
    if longs == 1:
        count, start, limit = 1, 8, MAX_THETA
    else:
        count, start = at(8, 4), 8 * longs
        limit = at(16, 8) if longs > 2 else MAX_THETA
    if not 0 < limit <= MAX_THETA:  # above it, a negative long
        raise ValueError("theta image: theta must be positive")
    if len(raw) < start + 8 * count:
        raise ValueError("theta image is truncated")
    return np.frombuffer(image, "<i8", count, start), limit, False


def encode(hashes: np.ndarray, limit: int = MAX_THETA, empty: bool = False, seed: int = SEED, compressed: bool = False) -> bytes:
    """A compact, ordered image, of version 3 or, compressed, 4. Nothing retained and nothing sampled away is the empty sketch."""
    hashes = np.sort(np.asarray(hashes, np.int64))
    n = len(hashes)
    if n == 0 and (empty or limit == MAX_THETA):
        return EMPTY_THETA
    mark = seed_hash(seed).to_bytes(2, "little")
    estimating = limit < MAX_THETA
    if compressed and (n > 1 or estimating) and n > 0:
        gaps = np.diff(np.concatenate([[0], hashes])).astype(np.uint64)
        width = max(1, int(np.bitwise_or.reduce(gaps)).bit_length())
        bits = np.unpackbits(gaps.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)[:, 64 - width :]
        size = max(1, -(-n.bit_length() // 8))
        head = bytes([2 if estimating else 1, 4, 3, width, size, 0x1A]) + mark
        return head + (limit.to_bytes(8, "little") if estimating else b"") + n.to_bytes(size, "little") + np.packbits(bits.reshape(-1)).tobytes()
    longs = 3 if estimating else 2 if n > 1 else 1
    flags = 0x1A | (32 if longs == 1 else 0)
    head = bytes([longs, 3, 3, 0, 0, flags]) + mark
    if longs > 1:
        head += n.to_bytes(4, "little") + b"\0\0\0\0"
    if longs > 2:
        head += limit.to_bytes(8, "little")
    return head + hashes.astype("<i8").tobytes()


def hashes(image: Column) -> Column:
    """The retained hashes, ascending in an ordered image."""

    @F.pandas_udf("array<long>")
    def of(images: pd.Series) -> pd.Series:
        return images.map(lambda x: None if x is None else decode(bytes(x))[0])

    return of(image)


def reencode(image: Column, compressed: bool = False, seed: int = SEED) -> Column:
    """The same sketch as a version 3 image, or, compressed, a version 4 one."""

    @F.pandas_udf("binary")
    def of(images: pd.Series) -> pd.Series:
        return images.map(lambda x: None if x is None else encode(*decode(bytes(x)), seed=seed, compressed=compressed))

    return of(image)


def from_hashes(values: Column, limit: Column, is_empty: Column, seed: int = SEED) -> Column:
    """The image of a set of hashes below limit."""

    @F.pandas_udf("binary")
    def of(v: pd.Series, t: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([encode(np.asarray(x if x is not None else [], np.int64), int(y), bool(z), seed) for x, y, z in zip(v, t, e, strict=True)])

    return of(values, limit, is_empty)


def with_seed(seed: int, operation: Callable[..., Column], *images: Column) -> Column:
    """operation over images of another seed than the builtins': each is checked, marked as theirs, and the result is marked as the seed's. A set
    operation looks at hashes only, whatever seed they come from."""
    if seed == SEED:
        return operation(*images)
    return _marked(operation(*[_marked(x, seed, SEED) for x in images]), SEED, seed)


def _marked(image: Column, seed: int, other: int) -> Column:
    """An image of a seed with the other one's hash in its place; an empty one carries none. A UDF, since it names its input once: native checks
    would copy the whole expression of a nested operation for each byte that they read."""
    want, put = (seed_hash(x).to_bytes(2, "little") for x in (seed, other))

    def one(x: bytes | None) -> bytes | None:
        if x is None or len(x) >= 8 and x[5] & 4:
            return x
        if len(x) < 8 or x[2] != 3:
            raise ValueError("not a theta image")
        if x[6:8] != want:
            raise ValueError("theta image: seed hash mismatch")
        return x[:6] + put + x[8:]

    @F.pandas_udf("binary")
    def of(images: pd.Series) -> pd.Series:
        return images.map(lambda x: one(None if x is None else bytes(x)))

    return of(image)


def union(*images: Column, lg_k: int = 12, seed: int = SEED) -> Column:
    """Null inputs count as empty."""

    def of(*some: Column) -> Column:
        out = some[0]
        for x in some[1:] or (empty_image(),):
            out = F.theta_union(out, x, lg_k)
        return out

    return with_seed(seed, of, *map(or_empty, images))


def intersection(*images: Column, seed: int = SEED) -> Column:
    """Null inputs are refused, as an intersection with nothing is undefined."""
    if not images:
        raise ValueError("an intersection needs at least one sketch")
    sure = [F.when(x.isNull(), F.raise_error(F.lit("theta intersection of a null sketch"))).otherwise(x) for x in images]
    return with_seed(seed, lambda *some: functools.reduce(F.theta_intersection, some), *sure)


def a_not_b(image: Column, *others: Column, seed: int = SEED) -> Column:
    """Null counts as empty: without A the result is empty, without B it is A."""
    return with_seed(seed, lambda *some: functools.reduce(F.theta_difference, some), or_empty(image), *map(or_empty, others or (empty_image(),)))
