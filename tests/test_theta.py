import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from estima.functions import theta as ft
from estima.functions.bounds import TAILS, bound, equivalent_deviations
from estima.functions.headers import EMPTY_THETA, MAX_THETA, check_seed, theta_header
from estima.operators import theta
from estima.operators import theta as theta_operators


def sk():
    return F.col("s")


def built(spark, n, lg_k=12, start=0):
    return spark.range(start, start + n).agg(theta.sketch(F.col("id"), lg_k).alias("s"))


def test_empty_image(spark):
    image = bytes(built(spark, 0).first()["s"])
    assert image == EMPTY_THETA == bytes.fromhex("01030300001E0000")
    h = built(spark, 0).select(theta_header(sk()).alias("h")).first()["h"]
    assert h["is_empty"] and h["retained"] == 0 and h["theta_long"] == MAX_THETA and not h["is_estimating"]


def test_known_single_images(spark):
    one = spark.sql("SELECT 1L AS v").agg(theta.sketch(F.col("v")).alias("s")).first()["s"]
    assert bytes(one).hex().upper() == "01030300003ACC9315F97DCBBD86A105"
    real = spark.sql("SELECT 1.0D AS v").agg(theta.sketch(F.col("v")).alias("s")).first()["s"]
    assert bytes(real).hex().upper() == "01030300003ACC9385D2CEE5CAD7A37C"


@pytest.mark.parametrize("n", [1, 10, 100, 1000, 10000, 100000])
def test_estimate_and_bounds(spark, n):
    r = built(spark, n).select(ft.estimate(sk()).alias("e"), ft.lower_bound(sk(), 3).alias("l"), ft.upper_bound(sk(), 3).alias("u"), F.theta_sketch_estimate(sk()).alias("b")).first()
    assert abs(r["e"] - n) <= 0.03 * n and r["l"] <= n <= r["u"] and round(r["e"]) == r["b"]


def test_trimmed_at_k(spark):
    for n in (4096, 4097, 5000, 7680):
        h = built(spark, n).select(theta_header(sk()).alias("h")).first()["h"]
        assert h["retained"] == 4096 and h["is_estimating"] == (n > 4096)


@given(st.lists(st.integers(1, MAX_THETA - 1), unique=True, max_size=60), st.booleans())
@settings(max_examples=150, deadline=None)
def test_images_round_trip(values, compressed):
    image = ft.encode(np.array(values, np.int64), compressed=compressed)
    hashes, limit, empty = ft.decode(image)
    assert hashes.tolist() == sorted(values) and limit == MAX_THETA and empty == (not values)


@given(st.integers(1, 62), st.integers(2, 40))
@settings(max_examples=80, deadline=None)
def test_every_width_of_gaps(width, n):
    rng = np.random.default_rng(width * 100 + n)
    gaps = rng.integers(1, 1 << min(width, 57), n)
    values = np.cumsum(gaps)
    image = ft.encode(values, int(values[-1]) + 1, compressed=True)
    hashes, limit, _ = ft.decode(image)
    assert hashes.tolist() == values.tolist() and limit == values[-1] + 1


def test_own_images_read_by_the_builtin(spark):
    for n in (1, 2, 50, 20000):
        r = built(spark, n).select(sk(), ft.reencode(sk()).alias("v3"), ft.reencode(sk(), compressed=True).alias("v4")).select(*[F.theta_sketch_estimate(x).alias(x) for x in ("s", "v3", "v4")]).first()
        assert r["s"] == r["v3"] == r["v4"]


def test_compressed_is_the_builtins_form_and_smaller(spark):
    r = built(spark, 1_000_000).select(sk(), ft.reencode(sk()).alias("v3"), ft.reencode(sk(), compressed=True).alias("v4")).first()
    assert bytes(r["s"]) == bytes(r["v4"]) and 0.5 < len(r["v4"]) / len(r["v3"]) < 0.85


def test_set_operations_in_estimation_mode(spark):
    """The definitions, on hashes, against the builtins."""
    a, b = built(spark, 30000, 10), built(spark, 30000, 8, 15000)
    ha, ta, _ = ft.decode(bytes(a.first()["s"]))
    hb, tb, _ = ft.decode(bytes(b.first()["s"]))
    both = a.crossJoin(b.select(F.col("s").alias("t")))
    limit = min(ta, tb)
    x, y = {h for h in ha.tolist() if h < limit}, {h for h in hb.tolist() if h < limit}
    for op, want in ((ft.intersection, x & y), (ft.a_not_b, x - y), (ft.union, x | y)):
        image = bytes(both.select(op(F.col("s"), F.col("t")).alias("o")).first()["o"])
        hashes, t, _ = ft.decode(image)
        assert (set(hashes.tolist()), t) == (want, limit)


def test_null_policies(spark):
    row = built(spark, 10).select(sk(), F.lit(None).cast("binary").alias("n"))
    got = row.select(ft.retained(ft.union(F.col("n"), sk())).alias("u"), ft.retained(ft.a_not_b(F.col("n"), sk())).alias("a"), ft.retained(ft.a_not_b(sk(), F.col("n"))).alias("b")).first()
    assert (got["u"], got["a"], got["b"]) == (10, 0, 10)
    with pytest.raises(Exception, match="null sketch"):
        row.select(ft.intersection(sk(), F.col("n"))).collect()


def test_intersection_over_no_rows_gives_no_row(spark):
    assert theta.intersect_all(built(spark, 3).where("s is null"), [], "s").count() == 0
    assert theta.intersect_all(built(spark, 3).unionAll(built(spark, 2)), [], "s").select(ft.retained(F.col("sketch"))).first()[0] == 2


@pytest.mark.parametrize("image, message", [(b"\1\3", "truncated"), (bytes([1, 3, 7, 0, 0, 30, 0, 0]), "not a theta"), (bytes([1, 9, 3, 0, 0, 30, 0, 0]), "version")])
def test_corrupt_images(spark, image, message):
    with pytest.raises(Exception, match=message):
        spark.createDataFrame([(image,)], "s binary").select(ft.estimate(sk())).collect()
    with pytest.raises(ValueError):
        ft.decode(image)


def test_foreign_seed_is_refused(spark):
    made = theta.kmv_sketch(spark.range(5), [], "id", seed=5)
    with pytest.raises(Exception, match="seed hash"):
        made.select(check_seed(F.col("sketch"), 0x93CC)).collect()


def test_kmv_equals_the_builtin(spark):
    df = spark.range(20000).withColumn("g", F.col("id") % 3)
    own = {r["g"]: bytes(r["sketch"]) for r in theta.kmv_sketch(df, ["g"], "id", 9).withColumn("sketch", ft.reencode(F.col("sketch"), compressed=True)).collect()}
    native = {r["g"]: bytes(r["s"]) for r in df.groupBy("g").agg(theta.sketch(F.col("id"), 9).alias("s")).collect()}
    assert own == native


def test_kmv_edges(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("b", "x"), (None, "y"), (None, "y")], "g string, v string")
    got = {r["g"]: r["n"] for r in theta.kmv_sketch(df, ["g"], "v").select("g", ft.retained(F.col("sketch")).alias("n")).collect()}
    assert got == {"a": 0, "b": 1, None: 1}
    # one value that sampling rejects: not empty, nothing retained, theta below 1
    h = theta.kmv_sketch(spark.range(1), [], "id", p=0.0001).select(theta_header(F.col("sketch")).alias("h")).first()["h"]
    assert not h["is_empty"] and h["retained"] == 0 and h["theta_long"] < MAX_THETA
    with pytest.raises(ValueError):
        theta.kmv_sketch(df, ["g"], "v", p=0.0)


def test_arguments(spark):
    assert theta.lg_of_entries(16) == 4 and theta.lg_of_entries(17) == 5 and theta.lg_of_entries(4096) == 12
    for bad in (3, 27):
        with pytest.raises(ValueError):
            theta.check_lg(bad)
    with pytest.raises(ValueError):
        ft.lower_bound(F.lit(b""), 4)


def test_alpha(spark):
    df = spark.range(50000).withColumn("g", F.lit("x"))
    r = theta.alpha_sketch(df.unionAll(df), ["g"], "id", "id", "bigint", 12).first()  # repeats change nothing
    assert abs(r["estimate"] / 50000 - 1) < 0.03 and r["lower"] < 50000 < r["upper"]
    few = theta.alpha_sketch(spark.range(100).withColumn("g", F.lit("x")), ["g"], "id", "id", "bigint", 12).first()
    assert few["estimate"] == few["lower"] == few["upper"] == 100
    with pytest.raises(ValueError):
        theta.alpha_sketch(df, ["g"], "id", "id", "bigint", 8)


def test_update_results(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, None), (4, "")], "i int, v string")
    got = [r["result"] for r in theta.update_results(df, "v", "i", "string").orderBy("i").collect()]
    assert got == ["Inserted", "Inserted", "RejectedDuplicate", "RejectedNullOrEmpty", "RejectedNullOrEmpty"]


def test_two_sigma_intervals_cover(spark):
    trials = spark.range(60 * 20000).select((F.col("id") / 20000).cast("int").alias("t"), (F.col("id") + (F.col("id") / 20000).cast("long") * 10_000_000).alias("v"))
    made = trials.groupBy("t").agg(theta.sketch(F.col("v"), 9).alias("s"))
    hit = made.select(((ft.lower_bound(sk(), 2) <= 20000) & (ft.upper_bound(sk(), 2) >= 20000)).cast("int").alias("hit"))
    r = hit.agg(F.sum("hit").alias("n")).first()
    assert r["n"] >= 51


@pytest.mark.parametrize("deviations", [1, 2, 3])
def test_bounds_are_the_tails_of_the_binomial(deviations):
    """Brute force: the counts n at which as many kept, or as few, have the tail's probability."""
    tail = TAILS[deviations]
    for kept in (2, 5, 17, 60, 119):
        for theta in (kept / 300, 0.5, 0.9):
            n = np.arange(kept, 4000)
            logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 4100)))])
            i = np.arange(kept + 1)[:, None]
            of = np.exp(logs[n] - logs[i] - logs[n - i] + i * np.log(theta) + (n - i) * np.log1p(-theta))
            fewer, at_most = of[:-1].sum(0), of.sum(0)
            low = n[np.flatnonzero(1 - fewer <= tail)].max(initial=kept - 1)
            high = n[np.flatnonzero(at_most <= tail)].min()
            # the bounds are the first whole number on or next to the exact ones, within the estimate and what was kept
            assert abs(bound([kept], [theta], deviations, False)[0] - max(low, kept)) <= 1.5
            assert abs(bound([kept], [theta], deviations, True)[0] - high) <= 1.5


def test_bounds_known_values():
    """Effective deviations of a few counts, tabulated to 15 digits; the tails at one and no value kept."""
    assert equivalent_deviations(1, -1)[1] == pytest.approx(0.78733703534118149, rel=1e-6)
    assert equivalent_deviations(3, -1)[2] == pytest.approx(6.29302733018320737, rel=1e-6)
    assert equivalent_deviations(2, 1)[3] == pytest.approx(1.81047286499563143, rel=1e-6)
    assert bound([0, 0, 7], [1e-3, 1.0, 1.0], 2, True).tolist() == [np.ceil(np.log(TAILS[2]) / np.log1p(-1e-3)), 0, 7]
    assert bound([0, 1, 7], [1e-3, 0.5, 1.0], 2, False).tolist() == [0, 1, 7]


def test_bounds_grow_with_deviations_and_hold_the_estimate():
    rng = np.random.default_rng(1)
    kept, theta = rng.integers(0, 3000, 4000), np.exp(rng.uniform(-12, 0, 4000))
    estimate = kept / theta
    lows, highs = ([bound(kept, theta, d, up) for d in (1, 2, 3)] for up in (False, True))
    assert (lows[2] <= lows[1]).all() and (lows[1] <= lows[0]).all() and (lows[0] <= estimate).all()
    assert (estimate <= highs[0]).all() and (highs[0] <= highs[1]).all() and (highs[1] <= highs[2]).all()


@pytest.mark.parametrize("p", [1.0, 0.3])
def test_alpha_variance_against_simulated_runs(p):
    """Runs of Alpha over uniform hashes: its estimates spread as the variance says."""
    rng, k, n, found = np.random.default_rng(4), 512, 20_000, []
    said = []
    for _ in range(150):
        theta, kept = p, 0
        for h in rng.random(n):
            if h < theta:
                kept += 1
                if theta <= p * (1 + k / (k + 1)) / 2 or kept > k:
                    theta *= k / (k + 1)
        found.append(k / theta)
        said.append(theta_operators.alpha_variance(0, theta, k, p))
    assert np.std(found) == pytest.approx(np.sqrt(np.mean(said)), rel=0.25) and np.mean(found) == pytest.approx(n, rel=0.02)


def test_set_operations_of_other_seeds(spark):
    """In estimation mode, against the definitions on hashes; as aggregates and as scalar functions."""
    rows = spark.range(20_000).select(F.explode(F.array(F.struct(F.lit("a").alias("g"), F.col("id").alias("v")), F.struct(F.lit("b").alias("g"), (F.col("id") + 8_000).alias("v")))).alias("r")).select("r.*")
    made = theta.kmv_sketch(rows, ["g"], "v", lg_k=9, seed=77).cache()
    images = {r["g"]: bytes(r["sketch"]) for r in made.collect()}
    (ha, ta, _), (hb, tb, _) = ft.decode(images["a"]), ft.decode(images["b"])
    limit = min(ta, tb)
    x, y = {h for h in ha.tolist() if h < limit}, {h for h in hb.tolist() if h < limit}
    union = sorted(x | y)
    cut = union[512] if len(union) > 512 else limit
    pair = made.where("g = 'a'").select(F.col("sketch").alias("s")).crossJoin(made.where("g = 'b'").select(F.col("sketch").alias("t")))
    got = pair.select(ft.union(F.col("s"), F.col("t"), lg_k=9, seed=77).alias("u"), ft.intersection(F.col("s"), F.col("t"), seed=77).alias("i"), ft.a_not_b(F.col("s"), F.col("t"), seed=77).alias("d")).first()
    mark = ft.seed_hash(77).to_bytes(2, "little")
    for name, want, theta_ in (("u", set(union[:512]), cut), ("i", x & y, limit), ("d", x - y, limit)):
        assert bytes(got[name])[6:8] == mark
        hashes, t, _ = ft.decode(bytes(got[name]))
        assert (set(hashes.tolist()), t) == (want, theta_)
    whole = made.agg(theta.union(F.col("sketch"), 9, seed=77).alias("u")).first()
    assert ft.decode(bytes(whole["u"]))[0].tolist() == union[:512]
    assert set(ft.decode(bytes(theta.intersect_all(made, [], "sketch", seed=77).first()["sketch"]))[0].tolist()) == x & y
    with pytest.raises(Exception, match="seed hash"):
        pair.select(ft.union(F.col("s"), F.col("t"), seed=78)).collect()
    made.unpersist()


def test_smallest_hashes_of_tasks_in_parts():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    keys, hashes = rng.integers(0, 7, 20_000), rng.integers(1, 3000, 20_000)
    table = pa.table({"g": pa.array([None if k == 6 else float("nan") if k == 5 else float(k) for k in keys]), "h": pa.array([None if h % 50 == 0 else int(h) for h in hashes], pa.int64())})
    for held in (100, 5000, 1 << 20):
        out = pa.Table.from_batches(list(theta._smallest(iter(table.to_batches(max_chunksize=700)), 1, 40, held))).to_pylist()
        for k in range(7):
            name = repr(None if k == 6 else float("nan") if k == 5 else float(k))
            got = {r["h"] for r in out if repr(r["g"]) == name}
            want = sorted({int(h) for kk, h in zip(keys, hashes) if kk == k and h % 50})[:40]
            assert None in got and sorted(got - {None})[:40] == want
            assert held < 1 << 20 or len([r for r in out if repr(r["g"]) == name]) == 41
