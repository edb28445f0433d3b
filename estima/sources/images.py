"""Tables of sketches in Parquet: BINARY columns, with the family, type and parameters of each in the column's metadata."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estima.functions import hll, kll, theta
from estima.functions.headers import FAMILIES, FLAG_ORDERED, check_seed, checked


def tagged(df: DataFrame, column: str, family: str, **parameters) -> DataFrame:
    """df with the column's family and parameters (lg_k, k, kind, seed_hash) in its metadata."""
    if family not in FAMILIES:
        raise ValueError(f"family must be one of {tuple(FAMILIES)}")
    return df.withMetadata(column, {"sketch": {"family": family, **parameters}})


def write_sketches(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "error") -> None:
    """Write a table of sketches. Columns must be tagged, so that readers know what their bytes are."""
    for f in df.schema.fields:
        if f.dataType.typeName() == "binary" and "sketch" not in f.metadata:
            raise ValueError(f"column {f.name} isn't tagged as a sketch")
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def _require(holds: bool, message: str) -> None:
    if not holds:
        raise ValueError(message)


def _check_body(image: bytes, family: str, kind: str) -> None:
    if family == "hll":
        hll.Sketch(image).to_registers()
    elif family == "kll":
        s = kll.decode(image, kind)
        _require(int(s.weights.sum()) == s.n, "kll image: weights don't add up to n")
        _require(not s.n or bool(s.least <= s.items.min() and s.items.max() <= s.most), "kll image: items beyond the least and most")
    else:
        hashes, limit, _ = theta.decode(image)
        _require(bool(((hashes > 0) & (hashes < limit)).all()), "theta image: hashes out of range")
        _require(not image[5] & FLAG_ORDERED or bool((np.diff(hashes) > 0).all()), "theta image: hashes out of order")


def whole_checked(image: Column, family: str, kind: str = "double") -> Column:
    """image itself, after its whole body has been decoded and found sound: lengths, counts, order and ranges of what it holds."""

    @F.pandas_udf("binary")
    def of(images: pd.Series) -> pd.Series:
        for x in images:
            if x is not None:
                _check_body(bytes(x), family, kind)
        return images

    return of(image)


def read_sketches(spark: SparkSession, path: str, check: bool = True, whole: bool = False) -> DataFrame:
    """The table, each image checked natively against its column's family and seed, so that a corrupt or foreign one fails the query; with `whole`
    its body too, for which it passes through Python once."""
    df = spark.read.parquet(path)
    for f in df.schema.fields:
        told = f.metadata.get("sketch")
        if told and check:
            image = checked(F.col(f.name), told["family"])
            if "seed_hash" in told:
                image = check_seed(image, told["seed_hash"])
            if whole:
                image = whole_checked(image, told["family"], told.get("kind", "double"))
            df = df.withColumn(f.name, image.alias(f.name, metadata=f.metadata))
    return df
