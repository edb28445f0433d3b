import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from estima.llm import crosspolytope as cp
from estima.llm import mtree, vectors
from estima.llm.queries import op2_exact_top_k, op7_approximate_neighbours


def rows_of(n=700, d=16, seed=1, hot=120):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d)) + 3 * rng.normal(size=(8, d))[rng.integers(0, 8, n)]
    v[:hot] = v[0]  # one common vector
    out = [(int(i), [float(np.float32(x)) for x in r], 0) for i, r in enumerate(v)]
    out += [(9000, None, 0), (9001, [], 0), (9002, [math.nan] * d, 0), (9003, [math.inf] * d, 0), (9004, [1.0] * (d - 1) + [None], 0), (9005, [0.0] * d, 0), (None, [1.0] * d, 0), (9010, [1.0, 2.0], 0), (9020, [2.0, 1.0], 0), (50, out[50][1], 0)]
    return out


SCHEMA = "vec_id long, embedding array<float>, rank int"


def clean(rows, zero):
    return {i: np.array(v, np.float64) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))}


def plain_top_k(rows, every, k):
    v = {i: np.floor(256 * x) for i, x in clean(rows, True).items()}
    out = []
    for q in sorted(v):
        if q % every == 0:
            best = sorted((-int(v[q] @ x), i) for i, x in v.items() if i != q and len(x) == len(v[q]))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("seed, d, page", [(1, 16, 4096), (2, 3, 64), (3, 40, 100)])
def test_exact_top_k(spark, monkeypatch, seed, d, page):
    monkeypatch.setattr(mtree, "PAGE", page)
    monkeypatch.setattr(mtree, "BLOCK", 7)
    rows = rows_of(400, d, seed)
    df = spark.createDataFrame(rows, SCHEMA)
    got = mtree.exact_top_k(df, F.col("vec_id") % 10 == 0, k=5)
    assert sorted(map(tuple, got.collect())) == plain_top_k(rows, 10, 5)


@given(st.integers(0, 1 << 30), st.integers(1, 300), st.integers(1, 12), st.integers(1, 40))
@settings(max_examples=60, deadline=None)
def test_tree_search_is_exact(seed, n, d, values):
    rng = np.random.default_rng(seed)
    x = rng.integers(-values, values + 1, (n, d)).astype(np.float64)
    ids = rng.permutation(10 * n)[:n]
    tree = mtree.build(ids, x)
    assert sorted(tree.ids) == sorted(ids)
    q = rng.integers(-values, values + 1, (5, d)).astype(np.float64)
    found = mtree.Best(np.full(5, -1), 4, np.full(5, -np.inf))
    mtree.search(tree, q, found)
    for i in range(5):
        want = sorted((-int(q[i] @ r), int(j)) for r, j in zip(x, ids, strict=True))[:4]
        assert [(-int(s), int(j)) for s, j in zip(found.score[i], found.id[i], strict=True) if j < np.iinfo(np.int64).max] == want


def test_bounds_spare_computations():
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, 6)) * 100
    x = np.floor(centers[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 6)))
    stats = {}
    mtree.search(mtree.build(np.arange(4000), x), x[:50], mtree.Best(np.arange(50), 5, np.full(50, -np.inf)), stats)
    assert stats["pairs"] < 0.5 * 50 * 4000 and stats["computed"] <= stats["pairs"]


def test_radii_and_parent_distances():
    x = np.random.default_rng(6).integers(-50, 50, (900, 4)).astype(float)
    t = mtree.build(np.arange(900), x)
    for node in range(len(t.center)):
        todo, below = [node], []
        while todo:
            i = todo.pop()
            below += [t.rows[t.first[i] : t.last[i]]] if t.leaf[i] else []
            todo += [] if t.leaf[i] else list(range(t.first[i], t.last[i]))
        assert np.isclose(np.linalg.norm(np.concatenate(below) - t.center[node], axis=1).max(), t.radius[node])
        if not t.leaf[node]:
            for c in range(t.first[node], t.last[node]):
                assert np.isclose(t.to_parent[c], np.linalg.norm(t.center[c] - t.center[node]))


def test_huge_components_stay_exact(spark):
    df = spark.createDataFrame([(0, [1e12, 1.0]), (10, [1e12, -1.0]), (20, [1e12, 2.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, mtree.exact_top_k(df, F.col("vec_id") == 0, 5).collect()))
    big = (256 * 10**12) ** 2
    most = (1 << 63) - 1
    assert got == [(0, 1, 10, min(most, big - 256 * 256)), (0, 2, 20, min(most, big + 256 * 512))] or got == [(0, 1, 20, min(most, big + 131072)), (0, 2, 10, min(most, big - 65536))]


def plain_neighbours(rows, every, k):
    v = clean(rows, False)
    out = {}
    for q in v:
        if q % every == 0:
            out[q] = sorted((float(np.linalg.norm(x - v[q])), i) for i, x in v.items() if i != q and len(x) == len(v[q]))[:k]
    return out


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PAGE", 50)
    rows = rows_of(seed=4)
    got = cp.approximate_neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, 10, probes=3).collect()
    want, v = plain_neighbours(rows, 20, 10), clean(rows, False)
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    hits = 0
    for q, best in want.items():
        mine = sorted(by.get(q, []), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1)) and len(mine) == len(best)
        assert all(r["score"] == pytest.approx(np.linalg.norm(v[r["vec_id"]] - v[q]), rel=1e-12) and r["vec_id"] != q for r in mine)
        assert [(r["score"], r["vec_id"]) for r in mine] == sorted((r["score"], r["vec_id"]) for r in mine)
        hits += len({r["vec_id"] for r in mine} & {i for _, i in best})
    assert set(by) <= set(want) and hits >= 0.8 * sum(map(len, want.values()))  # of so few probes
    # among equal vectors the smallest ids come first
    assert [r["vec_id"] for r in sorted(by[0], key=lambda r: r["rank"])][:5] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("n, d, centers", [(3000, 8, 0), (3000, 64, 0), (3000, 64, 60), (1500, 256, 0), (6000, 100, 200)])
def test_recall_by_measured_probes(spark, n, d, centers):
    """Whatever the size, dimension and spread, 0.9 of the nearest are found; where vectors cluster, few others are looked at."""
    rng = np.random.default_rng(n + d)
    x = rng.normal(size=(n, d)) * (0.3 if centers else 1) + (rng.normal(size=(centers, d))[rng.integers(0, centers, n)] if centers else 0)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    got = cp.approximate_neighbours(df, F.col("vec_id") % 100 == 0, 10).collect()
    hits, asked = 0, range(0, n, 100)
    for q in asked:
        dist = ((x - x[q]) ** 2).sum(1)
        dist[q] = np.inf
        hits += len(set(np.argsort(dist, kind="stable")[:10].tolist()) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hits >= 0.9 * 10 * len(asked)
    if centers:
        assert cp.probes_needed(x[:2048], 10, cp.TABLES) < d / 2


def test_ids_with_different_vectors(spark):
    """As candidate the best of an id's vectors counts, as query its first; however rows are dealt."""
    rows = [(0, [1.0, 0.0], 0), (0, [0.5, 0.0], 0), (7, [1.0, 1.0], 0), (7, [9.0, 9.0], 0), (3, [1.0, 2.0], 0), (50, [0.5, 0.1], 0)]
    for parts in (1, 3):
        df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        near = {(r["query_id"], r["rank"], r["vec_id"]): r["score"] for r in cp.approximate_neighbours(df, F.col("vec_id") == 0, 10).collect()}
        assert near == {(0, 1, 50): pytest.approx(0.1), (0, 2, 7): pytest.approx(math.hypot(0.5, 1)), (0, 3, 3): pytest.approx(math.hypot(0.5, 2))}
        top = sorted(map(tuple, mtree.exact_top_k(df, F.col("vec_id") == 0, 5).collect()))
        assert top == [(0, 1, 7, 128 * 2304), (0, 2, 3, 128 * 256), (0, 3, 50, 128 * 128)]


def test_ties_beyond_the_range_of_doubles():
    ids, x = np.array([7, 3, 5]), np.array([[2.0**54 + 4, 0], [2.0**54 + 4, 0], [2.0**54, 0]])
    for order in ([0, 1, 2], [1, 0, 2], [2, 0, 1]):
        found = mtree.Best(np.array([-1]), 1, np.array([-np.inf]))
        for i in order:
            found.offer(np.array([0]), mtree.products(np.array([[2.0**54 + 4, 0]]), x[[i]]), ids[[i]])
        assert found.id[0, 0] == 3


@pytest.mark.parametrize("n, d", [(6, 64), (20, 64), (40, 64)])
def test_no_list_is_short(spark, n, d):
    """Queries whose buckets hold fewer than k vectors get the k nearest of all, or all there are."""
    rows = [(i, [float(x) for x in np.random.default_rng(i).normal(size=d)], 0) for i in range(n)]
    rows += [(100, [1.0, 2.0], 0), (104, [2.0, 1.0], 0), (108, [3.0] * 5, 0)] + [(1, rows[1][1], 0)] * 12  # other dimensions, repeated rows
    got = cp.approximate_neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 4 == 0, 10).collect()
    want = plain_neighbours(rows, 4, 10)
    for q, best in want.items():
        mine = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [k for k, _ in mine] == list(range(1, len(best) + 1))
        assert len(best) == 10 or [i for _, i in mine] == [i for _, i in best]


def test_pseudo_rotations_keep_lengths_and_angles():
    x = cp.unit_rows(np.random.default_rng(1).normal(size=(50, 20)))
    y = cp.rotated(x, 3, 0)
    assert np.allclose(y @ y.T, x @ x.T) and not np.allclose(y, x)
    h = cp.hadamard(np.eye(8))
    assert np.allclose(h @ h.T, np.eye(8)) and np.allclose(np.abs(h), 1 / math.sqrt(8))


def test_own_bucket_is_the_nearest_signed_axis():
    v = np.random.default_rng(2).normal(size=(40, 16))
    y = cp.rotated(cp.unit_rows(v), 0, 0)
    codes = cp.axes(v, 0, 5)
    for r, c in zip(y, codes[:, 0], strict=True):
        assert np.argmax(np.abs(r)) == c % 16 and (r[c % 16] < 0) == (c >= 16)
    assert all(len(set(c)) == 5 for c in codes)


def test_extreme_lengths():
    q = np.array([1e-200, 0.0])
    assert cp.exact_distance(q, np.array([[2e-200, 0.0], [1e200, 1e200], [1e-200, 0.0]])).tolist() == pytest.approx([1e-200, math.sqrt(2) * 1e200, 0.0])


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mtree.exact_top_k(none, F.col("vec_id") % 50 == 0).count() == 0
    assert cp.approximate_neighbours(none, F.col("vec_id") % 50 == 0).count() == 0
    one = spark.createDataFrame([(50, [1.0], 0)], SCHEMA)
    assert mtree.exact_top_k(one, F.col("vec_id") % 50 == 0).count() == 0
    assert cp.approximate_neighbours(one, F.col("vec_id") % 50 == 0).count() == 0


def test_queries_on_the_embeddings(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"], 0) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op2_exact_top_k(spark, d).collect())) == plain_top_k(rows, 50, 5)
    want = plain_neighbours(rows, 100, 10)
    got = op7_approximate_neighbours(spark, d).collect()
    hits = sum(r["vec_id"] in {i for _, i in want[r["query_id"]]} for r in got)
    assert hits >= 0.9 * sum(map(len, want.values()))
