"""murmur3_128 as a scalar function, vectorised in numpy, and the seed hash."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash.
C1, C2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
F1, F2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _fmix(x: np.ndarray) -> np.ndarray:
    for factor in (F1, F2):
        x = (x ^ (x >> np.uint64(33))) * factor
    return x ^ (x >> np.uint64(33))


def murmur3_words(words: np.ndarray, lengths: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """h1, h2 of keys of equal padded width: words (rows of zero-padded little-endian uint64), lengths in bytes.

    Rows of different lengths are hashed together: each step touches the rows that still have a block or tail there.
    """
    n = len(words)
    h1 = np.full(n, seed, np.uint64)
    h2 = h1.copy()
    blocks = lengths // 16
    with np.errstate(over="ignore"):
        for b in range((words.shape[1] + 1) // 2):
            k1 = words[:, 2 * b]
            k2 = words[:, 2 * b + 1] if 2 * b + 1 < words.shape[1] else np.zeros(n, np.uint64)
            m1, m2 = _rotl(k1 * C1, 31) * C2, _rotl(k2 * C2, 33) * C1
            whole = b < blocks
            a1 = (_rotl(h1 ^ m1, 27) + h2) * np.uint64(5) + np.uint64(0x52DCE729)
            a2 = (_rotl(h2 ^ m2, 31) + a1) * np.uint64(5) + np.uint64(0x38495AB5)
            tail = (b == blocks) & (lengths % 16 > 0)  # zero bytes of a tail mix to nothing
            h1, h2 = np.where(whole, a1, np.where(tail, h1 ^ m1, h1)), np.where(whole, a2, np.where(tail, h2 ^ m2, h2))
        size = lengths.astype(np.uint64)
        h1, h2 = h1 ^ size, h2 ^ size
        h1 = h1 + h2
        h2 = h2 + h1
        h1, h2 = _fmix(h1), _fmix(h2)
        h1 = h1 + h2
        h2 = h2 + h1
    return h1, h2


def murmur3_bytes(keys: list[bytes], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys are hashed in groups of like length, so that one long key doesn't widen all."""
    lengths = np.array([len(k) for k in keys], np.int64)
    h1, h2 = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
    width = np.ceil(np.log2(np.maximum(lengths, 16))).astype(int) if len(keys) else lengths
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        size = -(-int(lengths[at].max()) // 16) * 16 or 16
        flat = np.frombuffer(b"".join(keys[i].ljust(size, b"\0") for i in at), "<u8").reshape(len(at), -1)
        h1[at], h2[at] = murmur3_words(flat, lengths[at], seed)
    return h1, h2


def canonical_bytes(value) -> bytes | None:
    """The bytes that are hashed: 8 for a number (negative zero as zero, one NaN), UTF-8, or 8 for each array element. Null and
    what is empty give None."""
    if value is None:
        return None
    if isinstance(value, (bytes, bytearray)):
        return bytes(value) or None
    if isinstance(value, str):
        return value.encode("utf-8", "surrogatepass") or None
    if isinstance(value, np.ndarray | list):
        return np.asarray(value, "<i8").tobytes() or None
    if isinstance(value, (float, np.floating)):
        return (np.array(0x7FF8000000000000, "<u8").tobytes() if np.isnan(value) else np.array(float(value) + 0.0, "<f8").tobytes())
    return int(value).to_bytes(8, "little", signed=True)


def theta_hashes(values: pd.Series, kind: str, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """h1, h2 and which rows have a value. kind: bigint, double, string, binary or array."""
    if kind in ("bigint", "double"):
        some = values.notna().to_numpy() if kind == "bigint" else np.ones(len(values), bool)
        words = values.fillna(0).to_numpy(np.int64).view(np.uint64) if kind == "bigint" else double_bits(values.to_numpy(np.float64))
        h1, h2 = murmur3_words(words.reshape(-1, 1), np.full(len(values), 8), seed)
        return h1, h2, some
    keys = [canonical_bytes(v) for v in values]
    h1, h2 = murmur3_bytes([k or b"" for k in keys], seed)
    return h1, h2, np.array([k is not None for k in keys], bool)


def double_bits(x: np.ndarray) -> np.ndarray:
    bits = (x + 0.0).view(np.uint64).copy()
    bits[np.isnan(x)] = 0x7FF8000000000000
    return bits


def murmur3_128(column: Column, kind: str, seed: int = 9001) -> Column:
    """struct<h1, h2> (bit patterns as longs) of the value, null for null. Unlike sketch updates, empty text is hashed."""

    @F.pandas_udf("h1 long, h2 long")
    def of(values: pd.Series) -> pd.DataFrame:
        h1, h2, some = theta_hashes(values, kind, seed)
        some |= np.array([v is not None and not isinstance(v, float) for v in values]) if kind in ("string", "binary", "array") else some
        out = pd.DataFrame({"h1": pd.array(h1.view(np.int64), "Int64"), "h2": pd.array(h2.view(np.int64), "Int64")})
        out.loc[~some] = pd.NA
        return out

    return F.when(column.isNotNull(), of(column))


def theta_hash(column: Column, kind: str, seed: int = 9001) -> Column:
    """The 63-bit hash that a theta sketch keeps; null for what its updates reject."""

    @F.pandas_udf("long")
    def of(values: pd.Series) -> pd.Series:
        h1, _, some = theta_hashes(values, kind, seed)
        out = pd.Series(pd.array((h1 >> np.uint64(1)).view(np.int64), "Int64"))
        out[~some] = pd.NA
        return out

    return F.when(column.isNotNull(), of(column))


def seed_hash(seed: int) -> int:
    """The low 16 bits of the seed's own hash; a seed that gives zero is refused."""
    h1, _ = murmur3_words(np.array([[seed]], np.uint64), np.array([8]), 0)
    out = int(h1[0]) & 0xFFFF
    if out == 0:
        raise ValueError(f"seed {seed} has the seed hash 0, which marks no seed")
    return out


def canonical_double(column: Column) -> Column:
    """A double's 8 canonical bytes as BINARY, which HLL's aggregate takes; use it after distinct()."""

    @F.pandas_udf("binary")
    def of(values: pd.Series) -> pd.Series:
        raw = double_bits(values.to_numpy(np.float64)).tobytes()
        return pd.Series([raw[8 * i : 8 * i + 8] for i in range(len(values))])

    return F.when(column.isNotNull(), of(column))


def array_bytes(column: Column) -> Column:
    """array<bigint> as the little-endian bytes of its elements, natively; null if null or empty."""
    one = lambda x: F.concat(*[F.substring(F.lpad(F.hex(x), 16, "0"), 2 * i + 1, 2) for i in reversed(range(8))])
    return F.when(F.size(column) > 0, F.unhex(F.array_join(F.transform(column, one), "")))
