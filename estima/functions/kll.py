"""Scalar functions over KLL images. Suffix: double, float or bigint, the type of the items, which an image doesn't tell."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from estima.functions.headers import kll_header

TYPES = {"double": "<f8", "float": "<f4", "bigint": "<i8"}
#: Fixed values of the fitted rank error, factor / k ** power, of ranks and of the mass between splits; the least error and the range of k.
RANK_ERROR, MASS_ERROR = (2.296, 0.9723), (2.446, 0.9433)
LEAST_ERROR, LEAST_K, MOST_K = 4.7634e-5, 8, 65535


def _native(name: str, kind: str):
    return getattr(F, f"{name}_{kind}")


def _some(image: Column, value: Column) -> Column:
    """value, but null for a null or empty sketch, which has no answer."""
    return F.when(~kll_header(image)["is_empty"], value)


def n(image: Column, kind: str = "double") -> Column:
    return _native("kll_sketch_get_n", kind)(image)


def quantiles(image: Column, ranks: list[float], kind: str = "double") -> Column:
    """Inclusive quantiles at constant ranks: all are answered from one decoding."""
    if any(not 0 <= r <= 1 for r in ranks):
        raise ValueError("ranks must be 0 to 1")
    return _some(image, _native("kll_sketch_get_quantile", kind)(image, F.array(*[F.lit(float(r)) for r in ranks])))


def _literals(values: list[float], kind: str) -> Column:
    return F.array(*[F.lit(v).cast(kind) for v in values])


def ranks(image: Column, items: list[float], kind: str = "double", inclusive: bool = True) -> Column:
    """Ranks of constant items. A rank that excludes x is the inclusive one of the number just below x."""
    if not inclusive:
        items = [v - 1 if kind == "bigint" else float(np.nextafter(np.float32(v), np.float32(-np.inf))) if kind == "float" else math.nextafter(v, -math.inf) for v in items]
    return _some(image, _native("kll_sketch_get_rank", kind)(image, _literals(items, kind)))


def _check_splits(splits: list[float]) -> None:
    if any(not a < b for a, b in zip(splits, splits[1:], strict=False)) or any(math.isnan(x) for x in splits):
        raise ValueError("split points must increase")


def cdf(image: Column, splits: list[float], kind: str = "double", inclusive: bool = True) -> Column:
    _check_splits(splits)
    return F.when(ranks(image, splits, kind, inclusive).isNotNull(), F.concat(ranks(image, splits, kind, inclusive), F.array(F.lit(1.0))))


def pmf(image: Column, splits: list[float], kind: str = "double", inclusive: bool = True) -> Column:
    c = cdf(image, splits, kind, inclusive)
    return F.transform(c, lambda x, i: F.when(i == 0, x).otherwise(x - F.try_element_at(c, F.greatest(i, F.lit(1)))))


def rank_error(image: Column, mass: bool = False) -> Column:
    """The normalised error of ranks, or, for mass, of the probability mass between splits."""
    factor, power = MASS_ERROR if mass else RANK_ERROR
    return F.lit(factor) / F.pow(kll_header(image)["min_k"].cast("double"), F.lit(power))


def k_from_epsilon(epsilon: Column, mass: bool = False) -> Column:
    """The k whose rank error is epsilon, at least 8, the least k that a sketch takes."""
    factor, power = MASS_ERROR if mass else RANK_ERROR
    k = F.exp(F.log(F.lit(factor) / F.greatest(epsilon.cast("double"), F.lit(LEAST_ERROR))) / F.lit(power))
    whole = F.when(F.abs(F.round(k) - k) < 1e-6, F.round(k)).otherwise(F.ceil(k))  # what should be whole isn't raised for rounding
    return F.greatest(F.lit(LEAST_K), F.least(F.lit(MOST_K), whole)).cast("int")


@dataclass
class View:
    """Items ascending with cumulative weights."""

    items: np.ndarray
    cumulative: np.ndarray
    n: int

    @property
    def top(self):
        return self.items[-1]

    def quantile(self, rank: float, inclusive: bool):
        if not 0 <= rank <= 1:
            raise ValueError("ranks must be 0 to 1")
        natural = rank * self.n
        if self.n <= 1e7:  # rounding, half away from zero, mends products that should be whole
            natural = math.floor(natural * 1e7 + 0.5) / 1e7
        if inclusive:
            at = int(np.searchsorted(self.cumulative, math.ceil(natural), side="left"))
        else:
            at = int(np.searchsorted(self.cumulative, math.floor(natural), side="right"))
        return self.items[min(at, len(self.items) - 1)]

    def rank(self, item, inclusive: bool) -> float:
        at = int(np.searchsorted(self.items, item, side="right" if inclusive else "left"))
        return float(self.cumulative[at - 1]) / self.n if at else 0.0


@dataclass
class Sketch:
    k: int
    min_k: int
    n: int
    least: object
    most: object
    items: np.ndarray
    weights: np.ndarray

    def view(self) -> View:
        """Retained items in order; the true least and most are put in where compaction lost them."""
        if not self.n:
            raise ValueError("an empty sketch has no items")
        order = np.argsort(self.items, kind="stable")
        items, cumulative = self.items[order], np.cumsum(self.weights[order])
        if self.least < items[0]:
            items, cumulative = np.concatenate([[self.least], items]), np.concatenate([[1], cumulative])
        if items[-1] < self.most:
            items = np.concatenate([items, [self.most]])
            cumulative = np.concatenate([cumulative[:-1], [cumulative[-1] - 1, cumulative[-1]]])
        return View(items, cumulative, self.n)


def level_capacity(k: int, levels: int, level: int, m: int) -> int:
    """Each level holds two thirds of the one above, m at least."""
    depth = levels - level - 1
    return max(m, int(math.floor(k * (2 / 3) ** depth + 0.5)))


def decode(image: bytes, kind: str = "double") -> Sketch:
    """All structures: empty, single item, full and updatable. The exact length of a full image is checked, as nothing else tells types apart."""
    if len(image) < 8:
        raise ValueError("kll image is truncated")
    ints, version, family, flags = image[:4]
    k, m = int.from_bytes(image[4:6], "little"), image[6]
    kind_of = np.dtype(TYPES[kind])
    if family != 15 or (ints, version) not in ((2, 1), (2, 2), (5, 1), (5, 3), (2, 3)):
        raise ValueError("not a kll image")
    none = np.empty(0, kind_of)
    if ints == 2 and version == 1:
        return Sketch(k, k, 0, None, None, none, np.empty(0, np.int64))
    if version == 2:
        if len(image) != 8 + kind_of.itemsize:
            raise ValueError("kll image: length doesn't fit the type")
        item = np.frombuffer(image, kind_of, 1, 8)
        return Sketch(k, k, 1, item[0], item[0], item, np.ones(1, np.int64))
    total, min_k, levels = int.from_bytes(image[8:16], "little"), int.from_bytes(image[16:18], "little"), image[18]
    updatable = version == 3
    stored = levels + 1 if updatable else levels
    bounds = np.frombuffer(image, "<i4", stored, 20).astype(np.int64)
    capacity = sum(level_capacity(k, levels, i, m) for i in range(levels))
    if not updatable:
        bounds = np.concatenate([bounds, [capacity]])
    start = 20 + 4 * stored
    held = bounds[-1] if updatable else bounds[-1] - bounds[0]
    if len(image) != start + (2 + held) * kind_of.itemsize:
        raise ValueError("kll image: length doesn't fit the type")
    if total == 0:
        return Sketch(k, min_k, 0, None, None, none, np.empty(0, np.int64))
    least, most = np.frombuffer(image, kind_of, 2, start)
    data = np.frombuffer(image, kind_of, int(held), start + 2 * kind_of.itemsize)
    if updatable:
        data = data[bounds[0] :]  # free space comes first
    sizes = np.diff(bounds)
    if (sizes < 0).any() or flags & 1:
        raise ValueError("kll image: levels are out of order")
    return Sketch(k, min_k, total, least, most, data, np.repeat(1 << np.arange(levels, dtype=np.int64), sizes))


def _sql_type(kind: str) -> str:
    return {"double": "double", "float": "float", "bigint": "long"}[kind]


def items(image: Column, kind: str = "double") -> Column:
    """array of struct<item, cumulative>: the sorted view, with the true least and most items; null for an empty sketch."""

    @F.pandas_udf(f"array<struct<item:{_sql_type(kind)},cumulative:long>>")
    def of(images: pd.Series) -> pd.Series:
        out = []
        for x in images:
            s = None if x is None else decode(bytes(x), kind)
            v = s.view() if s is not None and s.n else None
            out.append(None if v is None else [{"item": a, "cumulative": int(b)} for a, b in zip(v.items.tolist(), v.cumulative, strict=True)])
        return pd.Series(out)

    return of(image)


def extremes(image: Column, kind: str = "double") -> Column:
    """struct<least, most>, exact; null for an empty sketch."""

    @F.pandas_udf(f"least {_sql_type(kind)}, most {_sql_type(kind)}")
    def of(images: pd.Series) -> pd.DataFrame:
        rows = [None if x is None else decode(bytes(x), kind) for x in images]
        return pd.DataFrame({"least": [None if s is None or not s.n else s.least for s in rows], "most": [None if s is None or not s.n else s.most for s in rows]})

    return of(image)


def _ask(image: Column, argument: Column, kind: str, result: str, answer) -> Column:
    @F.pandas_udf(result)
    def of(images: pd.Series, arguments: pd.Series) -> pd.Series:
        out, last, view = [], None, None
        for x, a in zip(images, arguments, strict=True):
            if x is None or a is None or a != a:
                out.append(None)
                continue
            if x is not last:
                s = decode(bytes(x), kind)
                view, last = (s.view() if s.n else None), x
            out.append(None if view is None else answer(view, a))
        return pd.Series(out, dtype="object")

    return of(image, argument)


def quantile_at(image: Column, rank: Column, kind: str = "double", inclusive: bool = True) -> Column:
    """The quantile at a rank that is itself a column."""
    return _ask(image, rank.cast("double"), kind, _sql_type(kind), lambda v, a: v.quantile(a, inclusive).item())


def rank_of(image: Column, item: Column, kind: str = "double", inclusive: bool = True) -> Column:
    """The rank of an item that is itself a column."""
    return _ask(image, item.cast(kind), kind, "double", lambda v, a: v.rank(a, inclusive))


def compact_of_updatable(image: Column, kind: str = "double") -> Column:
    """An updatable image as the compact one that the builtins read; compact images stay as they are."""

    @F.pandas_udf("binary")
    def of(images: pd.Series) -> pd.Series:
        return images.map(lambda x: None if x is None else _compact(bytes(x), kind))

    return of(image)


def _compact(image: bytes, kind: str) -> bytes:
    if image[1] != 3:
        return image
    s = decode(image, kind)
    if s.n == 0:
        return bytes([2, 1, 15, 1]) + image[4:7] + b"\0"
    if s.n == 1:
        return bytes([2, 2, 15, 4]) + image[4:7] + b"\0" + s.items.tobytes()
    levels = image[18]
    bounds = np.frombuffer(image, "<i4", levels + 1, 20)
    return bytes([5, 1, 15, image[3] & 2]) + image[4:20] + bounds[:-1].tobytes() + np.array([s.least, s.most], TYPES[kind]).tobytes() + s.items.tobytes()
