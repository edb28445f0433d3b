import pytest
from pyspark.sql import functions as F

from estima.functions import hll as fh
from estima.functions import theta as ft
from estima.functions.register import register
from estima.operators import hll, kll, theta
from estima.plans import rollup
from estima.sources import images as images_mod
from estima.sources.images import read_sketches, tagged, write_sketches
from estima.streaming import windows

def sk():
    return F.col("s")

HOW = {"s": {"family": "theta", "lg_k": 12}}


def test_tables_of_sketches(spark, tmp_path):
    df = spark.range(100).groupBy((F.col("id") % 4).alias("g")).agg(theta.sketch(F.col("id")).alias("s"))
    path = f"file://{tmp_path}/t"
    with pytest.raises(ValueError, match="tagged"):
        write_sketches(df, path)
    write_sketches(tagged(df, "s", "theta", lg_k=12, seed_hash=0x93CC), path)
    back = read_sketches(spark, path)
    assert back.schema["s"].metadata["sketch"]["lg_k"] == 12
    assert sorted(r["n"] for r in back.select(ft.retained(sk()).alias("n")).collect()) == [25] * 4
    write_sketches(tagged(df, "s", "hll"), f"{path}2")
    with pytest.raises(Exception, match="not a hll image"):
        read_sketches(spark, f"{path}2").collect()


def test_bodies_of_images_are_checked(spark):
    big = spark.range(3000).agg(theta.sketch(F.col("id"), 10).alias("t"), hll.sketch(F.col("id"), 10).alias("h"), kll.sketch(F.col("id").cast("double"), 200).alias("k"))
    big = big.withColumn("t", ft.reencode(F.col("t"))).withColumn("t4", ft.reencode(F.col("t"), compressed=True))  # versions 3 and 4
    r = {n: bytes(x) for n, x in big.first().asDict().items()}
    few = {n: bytes(x) for n, x in spark.range(3).agg(theta.sketch(F.col("id")).alias("t"), hll.sketch(F.col("id")).alias("h"), kll.sketch(F.col("id").cast("double")).alias("k")).first().asDict().items()}
    none = {n: bytes(x) for n, x in spark.range(0).agg(theta.sketch(F.col("id")).alias("t"), hll.sketch(F.col("id")).alias("h"), kll.sketch(F.col("id").cast("double")).alias("k")).first().asDict().items()}
    families = {"t": "theta", "t4": "theta", "h": "hll", "k": "kll"}
    for images in (r, few, none):
        for name, x in images.items():
            images_mod._check_body(x, families[name], "double")
    t = r["t"]
    wrong = [
        (t[:-8], "theta"), (r["t4"][:-40], "theta"), (t[:16] + bytes(8) + t[24:], "theta"), (t[:16] + b"\xff" * 8 + t[24:], "theta"), (t[:24] + t[32:40] + t[24:32] + t[40:], "theta"),
        (t[:-8] + b"\xff" * 7 + b"\x7f", "theta"), (r["h"][:100], "hll"), (r["k"][:-8], "kll"), (r["k"][:8] + b"\1" + r["k"][9:], "kll"), (r["t4"][:8] + bytes(8) + r["t4"][16:], "theta"),
    ]
    for x, family in wrong:
        with pytest.raises((ValueError, IndexError)):
            images_mod._check_body(x, family, "double")
    with pytest.raises(ValueError):
        images_mod._check_body(r["k"], "kll", "float")
    df = spark.createDataFrame([(t[:-8],)], "s binary")
    with pytest.raises(Exception, match="truncated"):
        df.select(images_mod.whole_checked(sk(), "theta")).collect()


def test_roll_up_and_upsert(spark):
    fine = spark.range(300).groupBy((F.col("id") % 3).alias("a"), (F.col("id") % 2).alias("b")).agg(theta.sketch(F.col("id")).alias("s"))
    assert {r["a"]: r["n"] for r in rollup.roll_up(fine, ["a"], HOW).select("a", ft.retained(sk()).alias("n")).collect()} == {0: 100, 1: 100, 2: 100}
    assert rollup.roll_up(fine, [], HOW).select(ft.retained(sk())).first()[0] == 300
    cube = rollup.grouping_sets(fine, ["a", "b"], HOW)
    assert cube.count() == 6 + 3 + 2 + 1
    more = spark.range(250, 400).select(F.lit(0).cast("long").alias("a"), "id").groupBy("a").agg(theta.sketch(F.col("id")).alias("s"))
    merged = rollup.upsert(rollup.roll_up(fine, ["a"], HOW), more, ["a"], HOW)
    assert {r["a"]: r["n"] for r in merged.select("a", ft.retained(sk()).alias("n")).collect()}[0] == 100 + 150 - 16
    with pytest.raises(ValueError):
        rollup.merge_of("bloom", sk())


def test_sketches_of_other_families_merge(spark):
    both = spark.range(1000).groupBy((F.col("id") % 5).alias("g")).agg(hll.sketch(F.col("id")).alias("h"), kll.sketch(F.col("id")).alias("k"))
    r = rollup.roll_up(both, [], {"h": {"family": "hll"}, "k": {"family": "kll"}}).select(fh.composite_estimate(F.col("h")).alias("h"), F.kll_sketch_get_n_double("k").alias("k")).first()
    assert abs(r["h"] - 1000) < 60 and r["k"] == 1000


def test_batches_that_run_again_change_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/merged"
    merge = windows.keep_merged(path, ["g"], {"n": {"family": "kll"}})
    batch = lambda a, b: spark.range(a, b).select((F.col("id") % 2).alias("g"), "id").groupBy("g").agg(kll.sketch(F.col("id")).alias("n"))
    merge(batch(0, 10), 0)
    merge(batch(10, 30), 1)
    merge(batch(10, 30), 1)  # after a failure
    assert {r["g"]: r["n"] for r in windows.latest(spark, path).select("g", F.kll_sketch_get_n_double("n").alias("n")).collect()} == {0: 15, 1: 15}
    assert windows.latest(spark, f"{path}-not-there") is None


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 7) AS ts, id % 13 AS u FROM range(500)")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    aggregates = {"users": theta.sketch(F.col("u"))}
    answer = lambda df: {r["start"]: r["n"] for r in df.select("start", ft.retained(F.col("users")).alias("n")).collect()}
    want = answer(windows.windowed(rows, "ts", aggregates, "1 hour"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = windows.windowed(source, "ts", aggregates, "1 hour", late="100 days").writeStream.outputMode("complete").format("memory").queryName("hourly").start()
    q.processAllAvailable()
    q.stop()
    assert answer(spark.table("hourly")) == want and len(want) == 59


def test_sql_functions(spark):
    names = register(spark)
    assert "theta_hashes" in names and "hll_upper_bound_3" in names
    spark.range(50).createOrReplaceTempView("fifty")
    r = spark.sql("SELECT size(theta_hashes(theta_sketch_agg(id, 12))) AS a, theta_estimate_double(theta_sketch_agg(id, 12)) AS b, hll_composite_estimate(hll_sketch_agg(id, 12)) AS c, kll_max_double(kll_sketch_agg_double(double(id))) AS d FROM fifty").first()
    assert r["a"] == 50 and r["b"] == 50.0 and abs(r["c"] - 50) < 1 and r["d"] == 49.0
