"""Measured tables of the HLL estimators, read once a driver from the classes beside the one that Spark's own HLL aggregate keeps as its buffer."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import SparkSession

AGGREGATE = "org.apache.spark.sql.catalyst.expressions.aggregate.HllSketchAgg"


def _static(spark: SparkSession, name: str, field: str):
    of_name = spark.sparkContext._jvm.java.lang.Class.forName
    buffers = [m.getReturnType().getPackageName() for m in of_name(AGGREGATE).getMethods() if m.getName() == "createAggregationBuffer"]
    f = of_name(f"{next(x for x in buffers if x != 'java.lang')}.{name}").getDeclaredField(field)
    f.setAccessible(True)
    return f.get(None)


@functools.cache
def hll_tables() -> dict[str, object]:
    """composite: {lg_k: (x values, y stride)}; coupons: (x, y); errors: {(upper, out of order): values by 3 * (lg_k - 4) + sd - 1}."""
    spark = SparkSession.active()
    xs, strides = _static(spark, "CompositeInterpolationXTable", "xArrs"), _static(spark, "CompositeInterpolationXTable", "yStrides")
    errors = {key: np.array(list(_static(spark, "RelativeErrorTables", name))) for key, name in {(False, False): "HIP_LB", (True, False): "HIP_UB", (False, True): "NON_HIP_LB", (True, True): "NON_HIP_UB"}.items()}
    return {
        "composite": {4 + i: (np.array(list(xs[i])), int(strides[i])) for i in range(len(xs))},
        "coupons": (np.array(list(_static(spark, "CouponMapping", "xArr"))), np.array(list(_static(spark, "CouponMapping", "yArr")))),
        "errors": errors,
    }
