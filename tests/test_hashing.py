import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from estima.functions import hashing as hs
from estima.functions import theta as ft
from estima.operators import theta

M = (1 << 64) - 1


def plain_murmur(key: bytes, seed: int) -> tuple[int, int]:
    """A scalar version, from the published algorithm."""
    rotl = lambda x, r: ((x << r) | (x >> (64 - r))) & M
    c1, c2 = 0x87C37B91114253D5, 0x4CF5AD432745937F

    def fmix(k):
        for f in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            k = ((k ^ (k >> 33)) * f) & M
        return k ^ (k >> 33)

    h1 = h2 = seed
    for b in range(len(key) // 16):
        k1, k2 = (int.from_bytes(key[16 * b + 8 * i : 16 * b + 8 * i + 8], "little") for i in (0, 1))
        h1 ^= rotl(k1 * c1 & M, 31) * c2 & M
        h1 = ((rotl(h1, 27) + h2) * 5 + 0x52DCE729) & M
        h2 ^= rotl(k2 * c2 & M, 33) * c1 & M
        h2 = ((rotl(h2, 31) + h1) * 5 + 0x38495AB5) & M
    tail = key[len(key) // 16 * 16 :]
    k1, k2 = int.from_bytes(tail[:8], "little"), int.from_bytes(tail[8:], "little")
    h2 ^= rotl(k2 * c2 & M, 33) * c1 & M
    h1 ^= rotl(k1 * c1 & M, 31) * c2 & M
    h1, h2 = h1 ^ len(key), h2 ^ len(key)
    h1 = (h1 + h2) & M
    h2 = (h2 + h1) & M
    h1, h2 = fmix(h1), fmix(h2)
    h1 = (h1 + h2) & M
    return h1, (h2 + h1) & M


@given(st.lists(st.binary(max_size=70), min_size=1, max_size=20), st.integers(0, M))
@settings(max_examples=100, deadline=None)
def test_bytes_match_the_plain_version(keys, seed):
    h1, h2 = hs.murmur3_bytes(keys, seed)
    assert [(int(a), int(b)) for a, b in zip(h1, h2, strict=True)] == [plain_murmur(k, seed) for k in keys]


def test_default_seed_hash():
    assert hs.seed_hash(9001) == 0x93CC


def test_hash_agrees_with_the_builtin_sketch(spark):
    rows = spark.createDataFrame([(1, "a", 1.5), (-7, "café", -0.0), (1 << 60, "x" * 40, math.inf)], "i long, t string, d double")
    for column, kind in (("i", "bigint"), ("t", "string"), ("d", "double")):
        built = rows.agg(theta.sketch(F.col(column)).alias("s")).select(F.sort_array(ft.hashes(F.col("s"))).alias("h")).first()["h"]
        own = sorted(r["h"] for r in rows.select(hs.theta_hash(F.col(column), kind).alias("h")).collect())
        assert list(built) == own


def test_null_and_empty(spark):
    rows = spark.createDataFrame([(None,), ("",), ("a",)], "t string")
    got = rows.select("t", hs.theta_hash(F.col("t"), "string").alias("h"), hs.murmur3_128(F.col("t"), "string").alias("m")).collect()
    by = {r["t"]: r for r in got}
    assert by[None]["h"] is None and by[None]["m"] is None
    assert by[""]["h"] is None and by[""]["m"] is not None  # the hash knows empty text, a sketch's update doesn't
    assert by["a"]["h"] is not None


def test_double_bits_are_canonical():
    bits = hs.double_bits(np.array([0.0, -0.0, math.nan, -math.nan]))
    assert bits.tolist() == [0, 0, 0x7FF8000000000000, 0x7FF8000000000000]


def test_array_bytes(spark):
    got = spark.sql("SELECT array(1L, -2L) AS a UNION ALL SELECT array() UNION ALL SELECT null").select(hs.array_bytes(F.col("a")).alias("b")).collect()
    assert sorted(bytes(r["b"]) if r["b"] is not None else b"" for r in got) == [b"", b"", np.array([1, -2], "<i8").tobytes()]


def test_seed_hash_of_zero_is_refused(monkeypatch):
    monkeypatch.setattr(hs, "murmur3_words", lambda *a: (np.array([1 << 16], np.uint64), None))
    with pytest.raises(ValueError, match="seed hash 0"):
        hs.seed_hash(5)
