import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from estima.functions import kll as fk
from estima.functions.headers import kll_header
from estima.operators import kll

def sk():
    return F.col("s")


def built(spark, n, k=200, kind="double"):
    return spark.range(1, n + 1).agg(kll.sketch(F.col("id"), k, kind).alias("s"))


def test_inclusive_and_exclusive(spark):
    df = built(spark, 200)
    r = df.select(
        fk.quantiles(sk(), [0.5])[0].alias("qi"), fk.quantile_at(sk(), F.lit(0.5), inclusive=False).alias("qe"),
        fk.ranks(sk(), [100.0])[0].alias("ri"), fk.ranks(sk(), [100.0], inclusive=False)[0].alias("re"),
        fk.rank_of(sk(), F.lit(100.0)).alias("ci"), fk.rank_of(sk(), F.lit(100.0), inclusive=False).alias("ce"),
    ).first()
    assert (r["qi"], r["qe"], r["ri"], r["re"], r["ci"], r["ce"]) == (100.0, 101.0, 0.5, 0.495, 0.5, 0.495)


def test_rank_error_of_the_default(spark):
    r = built(spark, 10).select(fk.rank_error(sk()).alias("r"), fk.rank_error(sk(), mass=True).alias("m")).first()
    assert round(r["r"], 4) == 0.0133 and round(r["m"], 4) == 0.0165


@pytest.mark.parametrize("n", [1000, 100000])
def test_ranks_within_the_error(spark, n):
    own = built(spark, n)
    for q in (0.05, 0.5, 0.95):
        got = own.select(fk.quantiles(sk(), [q])[0].alias("q")).first()["q"]
        assert abs(got / n - q) <= 0.0133 * 1.5 + 1 / n


def test_cdf_and_pmf(spark):
    r = built(spark, 100).select(fk.cdf(sk(), [10.0, 60.0]).alias("c"), fk.pmf(sk(), [10.0, 60.0]).alias("p"), fk.pmf(sk(), [10.0], inclusive=False).alias("e"), fk.pmf(sk(), []).alias("all")).first()
    assert r["c"] == [0.1, 0.6, 1.0] and np.allclose(r["p"], [0.1, 0.5, 0.4]) and np.allclose(r["e"], [0.09, 0.91])
    with pytest.raises(ValueError):
        fk.cdf(sk(), [2.0, 1.0])


def test_special_values(spark):
    df = spark.sql("SELECT explode(array(double('NaN'), null, double('Infinity'), double('-Infinity'), 1.0D)) AS v").agg(kll.sketch(F.col("v")).alias("s"))
    r = df.select(fk.n(sk()).alias("n"), fk.extremes(sk()).alias("e")).first()
    assert r["n"] == 3 and r["e"]["least"] == -math.inf and r["e"]["most"] == math.inf


def test_empty_and_single(spark):
    none = built(spark, 0)
    r = none.select(fk.quantiles(sk(), [0.5]).alias("q"), fk.ranks(sk(), [1.0]).alias("r"), fk.cdf(sk(), [1.0]).alias("c"), fk.items(sk()).alias("i"), fk.extremes(sk())["least"].alias("e"), kll_header(sk())["is_empty"].alias("z")).first()
    assert (r["q"], r["r"], r["c"], r["i"], r["e"], r["z"]) == (None, None, None, None, None, True)
    one = built(spark, 1).select(fk.items(sk()).alias("i"), kll_header(sk()).alias("h")).first()
    assert one["i"][0]["item"] == 1.0 and one["h"]["is_single"] and one["h"]["n"] == 1


@pytest.mark.parametrize("kind", ["double", "float", "bigint"])
@pytest.mark.parametrize("n", [1, 2, 150, 5000])
def test_items_of_all_types(spark, kind, n):
    image = bytes(built(spark, n, 64, kind).first()["s"])
    v = fk.decode(image, kind).view()
    assert v.items[0] == 1 and v.items[-1] == n and v.cumulative[-1] == n and (np.diff(v.items) >= 0).all()
    if n > 1:
        for other in {"double", "float"} - {kind}:
            if np.dtype(fk.TYPES[other]).itemsize != np.dtype(fk.TYPES[kind]).itemsize:
                with pytest.raises(ValueError, match="length"):
                    fk.decode(image, other)


def test_own_view_answers_like_the_builtin(spark):
    made = bytes(built(spark, 20000, 100).first()["s"])  # building is random, so it is built once
    df = spark.createDataFrame([(made,)], "s binary")
    v = fk.decode(made).view()
    ranks = [0.0, 0.01, 0.3, 0.5, 0.999, 1.0]
    assert df.select(fk.quantiles(sk(), ranks).alias("q")).first()["q"] == [float(v.quantile(r, True)) for r in ranks]
    items = [0.0, 1.0, 777.5, 20000.0]
    assert df.select(fk.ranks(sk(), items).alias("q")).first()["q"] == [v.rank(x, True) for x in items]


@given(st.lists(st.integers(-50, 50), min_size=1, max_size=80), st.floats(0, 1))
@settings(max_examples=200, deadline=None)
def test_view_against_sorting(values, rank):
    data = np.sort(np.array(values, float))
    v = fk.Sketch(200, 200, len(data), data[0], data[-1], data, np.ones(len(data), np.int64)).view()
    natural = round(rank * len(data), 7)
    assert v.quantile(rank, True) == data[max(0, math.ceil(natural) - 1)]
    assert v.quantile(rank, False) == data[min(len(data) - 1, math.floor(natural))]
    assert v.rank(data[0], True) == (data <= data[0]).mean() and v.rank(data[0], False) == 0


def updatable(items, k=20, m=8, free=5):
    """An updatable image of one level, with rubbish in its free space."""
    n = len(items)
    bounds = np.array([free, free + n], "<i4")
    head = bytes([5, 3, 15, 0]) + k.to_bytes(2, "little") + bytes([m, 0]) + n.to_bytes(8, "little") + k.to_bytes(2, "little") + bytes([1, 0])
    data = np.concatenate([[min(items), max(items)], np.full(free, -999.0), items]).astype("<f8")
    return head + bounds.tobytes() + data.tobytes()


def test_updatable_images(spark):
    for items in ([4.0, 1.0, 3.0], [7.0]):
        image = updatable(items, free=20 - len(items))
        assert sorted(fk.decode(image).items.tolist()) == sorted(items)
        compact = fk._compact(image, "double")
        r = spark.createDataFrame([(compact,)], "s binary").select(fk.n(sk()).alias("n"), fk.quantiles(sk(), [0.0, 1.0]).alias("q")).first()
        assert r["n"] == len(items) and r["q"] == [min(items), max(items)]


def test_merge(spark):
    parts = spark.range(100000).groupBy((F.col("id") % 20).alias("g")).agg(kll.sketch(F.col("id")).alias("s"))
    r = parts.agg(kll.merge(sk()).alias("s")).select(fk.n(sk()).alias("n"), fk.quantiles(sk(), [0.5])[0].alias("q"), fk.extremes(sk()).alias("e")).first()
    assert r["n"] == 100000 and abs(r["q"] / 100000 - 0.5) < 0.03 and (r["e"]["least"], r["e"]["most"]) == (0, 99999)


def test_arguments(spark):
    for bad in (7, 65536):
        with pytest.raises(ValueError):
            kll.check_k(bad)
    with pytest.raises(ValueError):
        fk.quantiles(sk(), [1.5])
    with pytest.raises(ValueError):
        fk.decode(b"\5\1")
    got = spark.createDataFrame([(0.0133,), (0.9,)], "e double").select(fk.k_from_epsilon(F.col("e")).alias("k")).collect()
    assert [r["k"] for r in got] == [200, 8]
