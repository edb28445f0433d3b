"""Coarser groups from finer sketches: the table is scanned once, at the finest grouping, and its sketches are merged."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estima.operators import hll, kll, theta


def merge_of(family: str, image: Column, **parameters) -> Column:
    if family == "theta":
        return theta.union(image, parameters.get("lg_k", theta.DEFAULT_LG))
    if family == "hll":
        return hll.union(image)
    if family == "kll":
        return kll.merge(image, parameters.get("kind", "double"))
    raise ValueError(f"no sketch family {family}")


def roll_up(fine: DataFrame, keys: Sequence[str], sketches: dict[str, dict]) -> DataFrame:
    """fine grouped by keys, a part of its keys. sketches: column -> {"family": .., parameters}."""
    merged = [merge_of(image=F.col(c), **p).alias(c) for c, p in sketches.items()]
    return (fine.groupBy(*keys) if keys else fine).agg(*merged)


def grouping_sets(fine: DataFrame, keys: Sequence[str], sketches: dict[str, dict], how: str = "cube", within: Sequence[str] = ()) -> DataFrame:
    """All the sets of a cube or rollup over keys, from the finest sketches, with grouping_id; each within the columns `within`, which no set
    leaves out."""
    merged = [merge_of(image=F.col(c), **p).alias(c) for c, p in sketches.items()]
    if not within:
        return getattr(fine, how)(*keys).agg(F.grouping_id().alias("grouping_id"), *merged)
    sets = [keys[:n] for n in range(len(keys) + 1)] if how == "rollup" else [s for n in range(len(keys) + 1) for s in itertools.combinations(keys, n)]
    own = fine.groupingSets([[F.col(c) for c in (*within, *s)] for s in sets], *within, *keys)
    return own.agg(F.grouping_id().alias("grouping_id"), *merged)


def upsert(stored: DataFrame | None, new: DataFrame, keys: Sequence[str], sketches: dict[str, dict]) -> DataFrame:
    """The stored sketches with new ones of the same keys merged in: resuming is a union."""
    return roll_up(new if stored is None else stored.unionByName(new), keys, sketches)
