"""Exact top-k by inner product with an M-tree.

Vectors are integers. In an M-tree each node has a routing object, a covering radius and the distance to its parent's
routing object; leaf entries store the distance to their leaf's. With |q - x| >= l and |x| <= m the score is bounded by
q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2 <= (|q|^2 + m^2 - l^2) / 2, so a lower bound of a distance is an upper bound of a score. Before a
distance to a child's routing object is computed, the triangle inequality with the stored parent distance bounds it.
Nodes are opened best bound first; a query leaves a node whose bound is below its k-th score.

The tree's top level is a list of routing objects of bounded length, taken from a bounded sample; below each hang pages, each
a tree of some thousand vectors, which are built once, written to the shared folder and searched by blocks of queries.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estima.llm.common import stored
from estima.llm.vectors import BLOCK, PAGE, best, clean_vectors, matrix

SAMPLE = 4096  # rows that routing objects are chosen from and first bounds of scores come from
TOP = 64  # routing objects of the top level
FANOUT, LEAF = 16, 64
EXACT = 2.0**53


def to_integers(v: np.ndarray) -> np.ndarray:
    """floor(256 * x); the integers are kept in doubles, cut at the largest double whose square sums don't overflow."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(256.0 * v), -1e140, 1e140)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products, exact; as doubles if each of them is below 2^53, else as Python integers."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    if most < EXACT:
        return q @ x.T
    return np.array([[int(a) for a in r] for r in q], object).reshape(q.shape) @ np.array([[int(a) for a in r] for r in x], object).reshape(x.shape).T


@dataclass
class Tree:
    """rows: vectors, leaf by leaf. Nodes in arrays; a node's children, or a leaf's rows, are first to last."""

    ids: np.ndarray
    rows: np.ndarray
    to_leaf: np.ndarray  # distance of each row to its leaf's routing object
    center: np.ndarray  # of each node, a vector
    radius: np.ndarray
    to_parent: np.ndarray
    norm: np.ndarray  # the largest length of a vector below
    first: np.ndarray
    last: np.ndarray
    leaf: np.ndarray

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.__dict__)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Tree:
        with np.load(io.BytesIO(raw)) as z:
            return cls(**{k: z[k] for k in z.files})


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(-1))


def build(ids: np.ndarray, x: np.ndarray, seed: int = 0) -> Tree:
    """Bulk loading: rows are dealt to the nearest of FANOUT routing objects drawn from them, again and again."""
    rng = np.random.default_rng(seed)
    nodes: list[list] = [[x[0], 0.0, 0.0, 0, 0, False, np.arange(len(x))]]
    order: list[np.ndarray] = []
    to_leaf: list[np.ndarray] = []
    done, filled = 0, 0
    while done < len(nodes):  # breadth first, so that a node's children lie together
        node = nodes[done]
        center, rows = node[0], node[6]
        d = lengths(x[rows] - center)
        node[1] = d.max(initial=0.0)
        node.append(lengths(x[rows]).max(initial=0.0))
        if len(rows) <= LEAF or node[1] == 0:  # equal vectors make one leaf, however many
            node[3:6] = filled, filled + len(rows), True
            filled += len(rows)
            order.append(rows)
            to_leaf.append(d)
        else:
            picked = x[rng.choice(rows, min(FANOUT, len(rows)), replace=False)]
            picked = np.unique(picked, axis=0)
            if len(picked) == 1:  # unlucky: add the row that is farthest from it
                picked = np.stack([picked[0], x[rows[lengths(x[rows] - picked[0]).argmax()]]])
            to = np.stack([lengths(x[rows] - c) for c in picked], 1).argmin(1)
            node[3] = len(nodes)
            for k in np.unique(to):
                nodes.append([picked[k], 0.0, float(lengths(picked[k] - center)), 0, 0, False, rows[to == k]])
            node[4] = len(nodes)
        node[6] = None
        done += 1
    at = np.concatenate(order)
    columns = list(zip(*nodes, strict=True))
    return Tree(ids[at], x[at], np.concatenate(to_leaf), np.array(columns[0]), np.array(columns[1]), np.array(columns[2]), np.array(columns[7]), np.array(columns[3]), np.array(columns[4]), np.array(columns[5]))


def at_most(score) -> float:
    """The largest double that isn't above score, which may be an integer beyond 2^53."""
    x = float(score)
    return x if x <= score else float(np.nextafter(x, -np.inf))


class Best:
    """The k best scores of each query so far, ties to the smaller id; floor: below it nothing is needed."""

    def __init__(self, own: np.ndarray, k: int, floor: np.ndarray):
        self.own, self.k, self.floor = own, k, floor.astype(np.float64)
        self.score = np.full((len(own), k), -np.inf, object)
        self.id = np.full((len(own), k), np.iinfo(np.int64).max)

    def offer(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: of queries `at` with ids; NaN-free; -inf marks a pair that was ruled out."""
        scores = np.where(ids[None, :] == self.own[at][:, None], -np.inf, scores)
        hit = (scores >= self.floor[at][:, None]) & (scores > -np.inf)
        for i in np.flatnonzero(hit.any(1)):
            q = at[i]
            s = np.concatenate([self.score[q], scores[i][hit[i]]])
            x = np.concatenate([self.id[q], ids[hit[i]]])
            order = np.lexsort((x, -s))
            _, once = np.unique(x[order], return_index=True)  # an id counts once, by its best score; empty places share one
            o = order[np.sort(once)][: self.k]
            n = len(o)
            self.score[q, :n], self.id[q, :n] = s[o], x[o]
            self.score[q, n:], self.id[q, n:] = -np.inf, np.iinfo(np.int64).max
            self.floor[q] = max(self.floor[q], at_most(self.score[q, -1]))


def _upper(qq: np.ndarray, m: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The bound of scores, a little raised for rounding."""
    base = qq + m * m
    return (base - np.maximum(low, 0) ** 2) / 2 + 1e-9 * base + 1e-6


def search(tree: Tree, q: np.ndarray, found: Best, stats: dict | None = None) -> None:
    """Best-first search of a page for a block of queries."""
    qn = lengths(q)
    qq = qn * qn
    d = lengths(q - tree.center[0])
    heap = [(-np.inf, 0, np.arange(len(q)), d, _upper(qq, tree.norm[0], d - tree.radius[0]))]
    while heap:
        _, node, at, d, bound = heapq.heappop(heap)
        open_ = bound >= found.floor[at]
        at, d = at[open_], d[open_]
        if not len(at):
            continue
        a, b = tree.first[node], tree.last[node]
        if tree.leaf[node]:
            rows = slice(a, b)
            norms = lengths(tree.rows[rows])
            # |q - x| >= | |q - leaf| - |leaf - x| |, both known
            low = np.abs(d[:, None] - tree.to_leaf[rows][None, :])
            need = _upper(qq[at][:, None], norms[None, :], low) >= found.floor[at][:, None]
            cols, who = need.any(0), need.any(1)
            if stats is not None:
                stats["pairs"] = stats.get("pairs", 0) + need.size
                stats["computed"] = stats.get("computed", 0) + int(cols.sum()) * int(who.sum())
            if cols.any():
                found.offer(at[who], products(q[at[who]], tree.rows[rows][cols]), tree.ids[rows][cols])
            continue
        # first with the stored parent distances alone
        low = np.abs(d[:, None] - tree.to_parent[a:b][None, :]) - tree.radius[a:b][None, :]
        maybe = _upper(qq[at][:, None], tree.norm[a:b][None, :], low) >= found.floor[at][:, None]
        for child in range(a, b):
            own = np.flatnonzero(maybe[:, child - a])
            if len(own):
                dist = lengths(q[at[own]] - tree.center[child])
                bound = _upper(qq[at[own]], tree.norm[child], dist - tree.radius[child])
                keep = bound >= found.floor[at[own]]
                if keep.any():
                    heapq.heappush(heap, (-float(bound[keep].max()), child, at[own[keep]], dist[keep], bound[keep]))


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """At most n different rows, each the farthest from those before."""
    picked, d = [0], lengths(x - x[0])
    while len(picked) < n and d.max() > 0:
        picked.append(int(d.argmax()))
        d = np.minimum(d, lengths(x - x[picked[-1]]))
    return x[picked]


def _by_dim(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        dims = batch.column(2).to_numpy(zero_copy_only=False)
        for dim in np.unique(dims):
            own = batch.filter(pa.array(dims == dim))
            yield own.column(0).to_numpy(zero_copy_only=False), to_integers(own.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def exact_top_k(df: DataFrame, is_query, k: int = 5) -> DataFrame:
    """df (vec_id, embedding) -> query_id, rank, vec_id, score: for each row where is_query holds, the k rows but its own id with
    the highest inner product of floor(256 * x), ties to the smaller vec_id.

    Null and empty vectors and those with null or non-finite components take no part, nor do rows without an id. Vectors
    are compared with those of the same dimension. Of an id's rows with different vectors, as candidates the best counts, as query the first vector in
    the order of arrays; repeated rows are listed once. Scores beyond a long are cut to its range. Columns of other
    names are ignored. An empty table gives an empty result.
    """
    spark = df.sparkSession
    vectors = clean_vectors(df)
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    top: dict[int, np.ndarray] = {}
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim, own in sample.groupby("dim"):
        x = to_integers(matrix(own["v"]))
        known[int(dim)] = own["vec_id"].to_numpy(), x
        top[int(dim)] = farthest_first(x, TOP)
    shared = spark.sparkContext.broadcast((top, known))  # SAMPLE vectors at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = shared.value[0]
        for ids, x in _by_dim(batches):
            dim = x.shape[1]
            near, d = np.full(len(x), -1), np.full(len(x), np.inf)
            for i, c in enumerate(centers.get(dim, [])):
                own = lengths(x - c)
                near, d = np.where(own < d, i, near), np.minimum(own, d)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array([f"{dim}:{i}" for i in near]), pa.array(ids), flat, pa.array(d), pa.array(lengths(x))], names=["bucket", "id", "v", "d", "norm"])

    placed = stored(vectors.select("vec_id", "v", "dim").mapInArrow(assign, "bucket string, id long, v array<double>, d double, norm double"), "placed")
    stats = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.max("d").alias("radius"), F.max("norm").alias("norm"))
    stats = stored(stats.withColumn("pages", F.ceil(F.col("n") / PAGE).cast("int")), "top")  # TOP rows a dimension

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = build(pdf["id"].to_numpy(), matrix(pdf["v"]))
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "page": pdf["page"].iloc[:1], "tree": [tree.dump()]})

    paged = placed.join(stats.select("bucket", "pages"), "bucket").withColumn("page", F.pmod(F.xxhash64("id"), F.col("pages")).cast("int"))
    trees = stored(paged.select("bucket", "page", "id", "v").groupBy("bucket", "page").applyInPandas(grow, "bucket string, page int, tree binary"), "pages")
    known_stats = {r["bucket"]: (r["radius"], r["norm"], r["pages"]) for r in stats.collect()}
    entries = spark.sparkContext.broadcast(known_stats)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pages that a query has to see, with what the sample says its k-th score is at least."""
        centers, samples = shared.value
        for ids, x in _by_dim(batches):
            dim = x.shape[1]
            qq = (x * x).sum(1)
            floor = np.full(len(x), -np.inf)
            if dim in samples:
                s_ids, s = samples[dim]
                _, once = np.unique(s_ids, return_index=True)
                scores = products(x, s[once])
                scores = np.where(s_ids[once][None, :] == ids[:, None], -np.inf, scores).astype(np.float64)
                if scores.shape[1] >= k:
                    floor = -np.sort(-scores, axis=1)[:, k - 1]
                    floor = floor - np.abs(floor) * 1e-12
            buckets, pages, rows = [], [], []
            for name, (radius, norm, n) in entries.value.items():
                d, i = name.split(":")
                if int(d) != dim:
                    continue
                low = lengths(x - centers[dim][int(i)]) - radius if int(i) >= 0 else np.zeros(len(x))
                need = np.flatnonzero(_upper(qq, np.float64(norm), low) >= floor)
                for page in range(n):
                    buckets += [name] * len(need)
                    pages += [page] * len(need)
                    rows.append(need)
            at = np.concatenate(rows) if rows else np.empty(0, np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * dim), pa.array(x[at].reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.string()), pa.array(pages, pa.int32()), pa.array(ids[at]), flat, pa.array(floor[at])], names=["bucket", "page", "id", "v", "floor"])

    queries = vectors.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "dim")).alias("x")).select("vec_id", "x.v", "x.dim")
    wanted = queries.select("vec_id", "v", "dim").mapInArrow(route, "bucket string, page int, id long, v array<double>, floor double")
    blocks = max(1, -(-queries.count() // BLOCK))
    wanted = wanted.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    wanted = stored(wanted, "wanted")
    where = wanted.select("bucket", "page", F.col("block").alias("to")).distinct()  # a tree goes only where a query has to see it
    laid = trees.join(where, ["bucket", "page"]).withColumnRenamed("to", "block")

    def look(pdf: pd.DataFrame, page: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0, np.int64)}
        if len(pdf) and len(page):
            found = Best(pdf["id"].to_numpy(), k, pdf["floor"].to_numpy())
            search(Tree.load(page["tree"].iloc[0]), matrix(pdf["v"]), found)
            some = found.id < np.iinfo(np.int64).max
            who = np.nonzero(some)[0]
            out = {"query_id": found.own[who], "vec_id": found.id[some], "score": np.array([min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in found.score[some]], np.int64)}
        return pd.DataFrame(out)

    keys = ["bucket", "page", "block"]
    hits = wanted.groupBy(*keys).cogroup(laid.groupBy(*keys)).applyInPandas(look, "query_id long, vec_id long, score long")
    return best(hits, k, descending=True)
