import numpy as np
import pytest
from pyspark.sql import functions as F

from estima.functions import hll as fh
from estima.functions.headers import hll_header
from estima.operators import hll

def sk():
    return F.col("s")


def built(spark, n, lg_k=12, start=0):
    return spark.range(start, start + n).agg(hll.sketch(F.col("id"), lg_k).alias("s"))


@pytest.mark.parametrize("lg_k", [4, 8, 12, 16])
def test_estimates(spark, lg_k):
    r = built(spark, 100000, lg_k).select(fh.estimate(sk()).alias("e"), fh.composite_estimate(sk()).alias("c"), F.hll_sketch_estimate(sk()).alias("b")).first()
    assert abs(r["e"] / 100000 - 1) <= 4 / 2 ** (lg_k / 2) and abs(r["c"] / 100000 - 1) <= 4 / 2 ** (lg_k / 2)
    assert round(r["e"]) == r["b"]


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 100, 383, 400, 1000, 5000, 20000])
def test_agrees_with_the_builtin_in_all_modes(spark, n):
    one = built(spark, n)
    u = one.unionAll(built(spark, n)).agg(hll.union(sk()).alias("s"))
    for df in (one, u):
        r = df.select(fh.estimate(sk()).alias("e"), F.hll_sketch_estimate(sk()).alias("b"), fh.lower_bound(sk(), 2).alias("l"), fh.upper_bound(sk(), 2).alias("u")).first()
        assert round(r["e"]) == r["b"] and r["l"] <= r["e"] <= r["u"]


@pytest.mark.parametrize("n", [3, 50, 3000, 200000])
def test_widths_keep_registers(spark, n):
    image = bytes(built(spark, n, 11).first()["s"])
    want = fh.Sketch(image).to_registers()
    for kind in ("HLL_4", "HLL_6", "HLL_8"):
        other = fh._as(image, kind)
        assert np.array_equal(fh.Sketch(other).to_registers(), want)
        r = spark.createDataFrame([(other,)], "s binary").select(F.hll_sketch_estimate(sk()).alias("e"), hll_header(sk()).alias("h")).first()
        assert r["e"] == spark.createDataFrame([(image,)], "s binary").select(F.hll_sketch_estimate(sk())).first()[0]
        assert r["h"]["type"] == kind and r["h"]["is_compact"]


def test_union_of_different_sizes(spark):
    a, b = built(spark, 30000, 10), built(spark, 30000, 12, 20000)
    u = a.unionAll(b).agg(hll.union(sk()).alias("s"))
    want = np.maximum(fh.Sketch(bytes(a.first()["s"])).to_registers(), fh.fold(fh.Sketch(bytes(b.first()["s"])).to_registers(), 10))
    got = fh.Sketch(bytes(u.first()["s"]))
    assert got.lg_k == 10 and got.out_of_order and np.array_equal(got.to_registers(), want)


def test_downsample(spark):
    for n in (5, 100, 50000):
        r = built(spark, n, 12).select(fh.downsample(sk(), 8).alias("s")).select(sk(), F.hll_sketch_estimate(sk()).alias("e"), hll_header(sk())["lg_k"].alias("lg")).first()
        assert r["lg"] == 8 and abs(r["e"] - n) <= 0.3 * n
        assert np.array_equal(fh.Sketch(bytes(r["s"])).to_registers(), fh.Sketch(bytes(built(spark, n, 8).first()["s"])).to_registers())


def test_input_types(spark):
    df = spark.sql("SELECT explode(array(0.0D, -0.0D, double('NaN'), 1.5D)) AS d").withColumn("a", F.array(F.lit(1).cast("long"), F.col("d").cast("int").cast("long") if False else F.lit(2).cast("long")))
    r = hll.sketch_of(df, [], "d").select(fh.estimate(F.col("sketch")).alias("e")).first()
    assert round(r["e"]) == 3
    assert round(hll.sketch_of(df, [], "a").select(fh.estimate(F.col("sketch")).alias("e")).first()["e"]) == 1
    text = spark.createDataFrame([(None,), ("",), ("a",), ("a",)], "t string")
    assert round(hll.sketch_of(text, [], "t").select(fh.estimate(F.col("sketch")).alias("e")).first()["e"]) == 1


def test_nulls_in_unions(spark):
    row = built(spark, 10).select(sk(), F.lit(None).cast("binary").alias("n"))
    r = row.select(F.hll_sketch_estimate(fh.union(sk(), F.col("n"))).alias("a"), F.hll_sketch_estimate(fh.union(F.col("n"), sk())).alias("b"), fh.estimate(F.col("n")).alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == (10, 10, None)


@pytest.mark.parametrize("image", [b"\2\1", bytes([2, 1, 3, 12, 3, 4, 0, 0]), bytes([2, 9, 7, 12, 3, 4, 0, 0]), bytes([10, 1, 7, 12, 0, 8, 0, 10]) + bytes(40), bytes([2, 1, 7, 30, 3, 4, 0, 0])])
def test_corrupt_images(image):
    with pytest.raises((ValueError, IndexError)):
        fh.Sketch(image)


def test_arguments(spark):
    for bad in (3, 22):
        with pytest.raises(ValueError):
            hll.check_lg(bad)
    with pytest.raises(ValueError):
        fh.copy_as(sk(), "HLL_5")
