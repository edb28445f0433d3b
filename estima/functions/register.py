"""SQL names for the functions that Spark's SQL lacks; theta_*, hll_* and kll_* aggregates are there already."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from estima.functions import hll, kll, theta
from estima.functions.jvm_tables import hll_tables


def register(spark: SparkSession) -> list[str]:
    """Register the functions in the session; the names are returned."""
    tables = hll_tables()
    made = {}

    def add(name: str, result: str, of) -> None:
        @F.pandas_udf(result)
        def run(images: pd.Series) -> pd.Series:
            return pd.Series([None if x is None else of(bytes(x)) for x in images], dtype="float64" if result == "double" else "object")

        made[name] = run

    add("theta_hashes", "array<long>", lambda x: theta.decode(x)[0])
    add("theta_to_v3", "binary", lambda x: theta.encode(*theta.decode(x)))
    add("theta_to_v4", "binary", lambda x: theta.encode(*theta.decode(x), compressed=True))
    add("theta_estimate_double", "double", lambda x: (lambda h, t, e: len(h) * (2.0**63 / t))(*theta.decode(x)))
    add("hll_estimate_double", "double", lambda x: hll.estimate_of(hll.Sketch(x), tables))
    add("hll_composite_estimate", "double", lambda x: hll.composite(hll.Sketch(x), tables))
    for sd in (1, 2, 3):
        add(f"hll_lower_bound_{sd}", "double", lambda x, sd=sd: hll.bound_of(hll.Sketch(x), tables, False, sd))
        add(f"hll_upper_bound_{sd}", "double", lambda x, sd=sd: hll.bound_of(hll.Sketch(x), tables, True, sd))
    for kind in kll.TYPES:
        add(f"kll_min_{kind}", kll._sql_type(kind), lambda x, kind=kind: (lambda s: None if not s.n else s.least.item())(kll.decode(x, kind)))
        add(f"kll_max_{kind}", kll._sql_type(kind), lambda x, kind=kind: (lambda s: None if not s.n else s.most.item())(kll.decode(x, kind)))
    for name, f in made.items():
        spark.udf.register(name, f)
    return list(made)
