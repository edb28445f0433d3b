"""Native decoding of the fields in front of a sketch image. No Python runs: a Column in, Columns out.

BINARY must not be reversed with reverse(), which works on characters; little-endian fields are put together byte by byte.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_THETA = (1 << 63) - 1
SEED = 9001
#: Fixed values of the image formats: family ids and flag bits.
FAMILIES = {"theta": 3, "hll": 7, "kll": 15}
EMPTY_THETA = bytes.fromhex("0103030000" + "1e0000")
FLAG_EMPTY, FLAG_COMPACT, FLAG_ORDERED, FLAG_SINGLE = 4, 8, 16, 32
HLL_MODES = ("LIST", "SET", "HLL")
HLL_TYPES = ("HLL_4", "HLL_6", "HLL_8")


def field(image: Column, offset: int, size: int) -> Column:
    """The little-endian unsigned integer of size bytes at offset, as a long; size 8 must be below 2^63."""
    parts = [F.hex(F.substring(image, offset + i + 1, 1)) for i in reversed(range(size))]
    return F.conv(F.concat(*parts), 16, 10).cast("long")


def _refuse(test: Column, message: str, otherwise: Column) -> Column:
    return F.when(test, F.raise_error(F.lit(message))).otherwise(otherwise)


def _guarded(image: Column, family: str, value: Column) -> Column:
    """value, after the checks every reader makes once: length, family and version. Null for a null image."""
    versions = {"theta": (3, 4), "hll": (1,), "kll": (1, 2, 3)}[family]
    refuse = lambda message: F.raise_error(F.lit(message))
    return (
        F.when(image.isNull(), F.lit(None))
        .when(F.length(image) < 8, refuse(f"{family} image is truncated"))
        .when(F.substring(image, 3, 1) != F.lit(bytes([FAMILIES[family]])), refuse(f"not a {family} image"))
        .when(~F.substring(image, 2, 1).isin(*[F.lit(bytes([v])) for v in versions]), refuse(f"{family} image: unknown version"))
        .otherwise(value)
    )


def checked(image: Column, family: str) -> Column:
    """image itself, after its checks."""
    return _guarded(image, family, image)


def check_seed(image: Column, seed_hash: int) -> Column:
    """A theta image, refused if it was built with another seed. Empty images carry none."""
    found = field(image, 6, 2)
    return _refuse((found != seed_hash) & (field(image, 5, 1).bitwiseAND(FLAG_EMPTY) == 0), "theta image: seed hash mismatch", image)


def _flag(image: Column, at: int, bit: int) -> Column:
    return field(image, at, 1).bitwiseAND(bit) != 0


def theta_header(image: Column) -> Column:
    """struct of version, is_empty, is_ordered, is_estimating, retained, theta_long and seed_hash of a compact theta image."""
    longs = field(image, 0, 1).bitwiseAND(0x3F)
    version, empty = field(image, 1, 1), _flag(image, 5, FLAG_EMPTY)
    packed = version == 4
    theta = F.when(packed & (longs > 1), field(image, 8, 8)).when(~packed & (longs > 2), field(image, 16, 8)).otherwise(F.lit(MAX_THETA))
    count_bytes = field(image, 4, 1)
    count_at = F.when(longs > 1, 16).otherwise(8)
    packed_count = F.coalesce(*[F.when(count_bytes == n, F.when(count_at == 16, field(image, 16, n)).otherwise(field(image, 8, n))) for n in range(1, 5)])
    retained = F.when(packed, packed_count).when(empty, 0).when(longs == 1, 1).otherwise(field(image, 8, 4)).cast("long")
    return _guarded(
        image,
        "theta",
        F.struct(
            version.alias("version"), empty.alias("is_empty"), _flag(image, 5, FLAG_ORDERED).alias("is_ordered"),
            ((theta < MAX_THETA) & ~empty).alias("is_estimating"), retained.alias("retained"),
            theta.alias("theta_long"), field(image, 6, 2).alias("seed_hash"),
        ),
    )


def hll_header(image: Column) -> Column:
    """struct of lg_k, mode, type, is_empty, is_compact, is_out_of_order."""
    mode = field(image, 7, 1)
    return _guarded(
        image,
        "hll",
        F.struct(
            field(image, 3, 1).cast("int").alias("lg_k"),
            F.element_at(F.array(*map(F.lit, HLL_MODES)), (mode.bitwiseAND(3) + 1).cast("int")).alias("mode"),
            F.element_at(F.array(*map(F.lit, HLL_TYPES)), (F.shiftright(mode, 2).bitwiseAND(3) + 1).cast("int")).alias("type"),
            _flag(image, 5, 4).alias("is_empty"), _flag(image, 5, 8).alias("is_compact"), _flag(image, 5, 16).alias("is_out_of_order"),
        ),
    )


def kll_header(image: Column) -> Column:
    """struct of k, n, min_k, levels, is_empty, is_single, is_estimating, size (bytes)."""
    flags, full = field(image, 3, 1), field(image, 0, 1) == 5
    empty = flags.bitwiseAND(1) != 0
    single = ~empty & ~full
    k = field(image, 4, 2)
    levels = F.when(full, field(image, 18, 1)).otherwise(1)
    return _guarded(
        image,
        "kll",
        F.struct(
            k.cast("int").alias("k"),
            F.when(full, field(image, 8, 8)).when(single, 1).otherwise(0).cast("long").alias("n"),
            F.when(full, field(image, 16, 2)).otherwise(k).cast("int").alias("min_k"), levels.cast("int").alias("levels"),
            empty.alias("is_empty"), single.alias("is_single"), (levels > 1).alias("is_estimating"), F.length(image).alias("size"),
        ),
    )
