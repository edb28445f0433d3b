"""KLL sketches as aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("double", "float", "bigint")


def check_k(k: int) -> int:
    if not 8 <= k <= 65535:
        raise ValueError("k must be 8 to 65535")
    return k


def sketch(column: Column, k: int = 200, kind: str = "double") -> Column:
    """Aggregate: the KLL sketch of a column. Nulls and NaN are skipped, infinities kept."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    return getattr(F, f"kll_sketch_agg_{kind}")(column.cast(kind), F.lit(check_k(k)))


def merge(image: Column, kind: str = "double") -> Column:
    """Aggregate: the merge of images."""
    return getattr(F, f"kll_merge_agg_{kind}")(image)
