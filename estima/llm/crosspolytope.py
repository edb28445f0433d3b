"""Approximate nearest neighbours by cross-polytope hashing.

A table's hash turns a unit vector by a pseudo-rotation (three rounds of random signs and a fast Hadamard transform, the
vector padded to a power of two) and takes the nearest signed axis: the coordinate of largest size and its sign. Vectors lie in one bucket
a table; a query looks, in each table, into the buckets of its nearest axes (multiprobe). How many it takes is measured, for each dimension, on a
bounded sample: so many that the share TARGET of the sample's nearest pairs meet. Candidates are ranked by their exact Euclidean distance.
Queries whose buckets hold fewer than k others are searched again over all vectors of their dimension.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estima.llm.common import drop_stored, stored
from estima.llm.vectors import best, block_join, clean_vectors, matrix, power_of_two

TABLES = 4  # each sends every vector once
SAMPLE, ASKED = 2048, 64  # vectors of the sample that probes are measured on, and how many of them are queries there
LEAST_SAMPLE = 256  # vectors of a dimension in the sample, below which its queries look into all buckets
TARGET = 0.95  # share of the sample's nearest pairs that must meet; in the whole table, where neighbours are nearer, more do


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotated(unit: np.ndarray, table: int, number: int) -> np.ndarray:
    """unit (rows padded to a power of two) under the pseudo-rotation of a table's hash."""
    d = unit.shape[1]
    bits = np.unpackbits(np.frombuffer(hashlib.shake_128(f"signs {table} {number}".encode()).digest(3 * d // 8 + 3), np.uint8))[: 3 * d]
    for signs in np.where(bits.reshape(3, d), 1.0, -1.0):
        unit = hadamard(unit * signs)
    return unit


def axis_scores(y: np.ndarray) -> np.ndarray:
    """For each row the signed coordinates along the 2d half-axes: d positive ones, then d negative ones."""
    return np.concatenate([y, -y], axis=1)


def unit_rows(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow or underflow, padded to a power of two."""
    v = v / np.abs(v).max(1, keepdims=True)
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    return np.pad(v, ((0, 0), (0, power_of_two(v.shape[1]) - v.shape[1])))


def axes(v: np.ndarray, table: int, probes: int = 1) -> np.ndarray:
    """The nearest signed axes of each row in a table, its bucket first."""
    scores = axis_scores(rotated(unit_rows(v), table, 0))
    return np.argsort(-scores, axis=1, kind="stable")[:, :probes]


def probes_needed(v: np.ndarray, k: int, tables: int, target: float = TARGET) -> int:
    """How many axes a table queries must look at, that the share target of the pairs of one of the first rows with one of its k nearest
    among all rows meet."""
    asked = v[:ASKED]
    with np.errstate(over="ignore", invalid="ignore"):
        d = ((asked[:, None, :] - v[None, :, :]) ** 2).sum(2)
    d[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    near = np.argsort(d, axis=1, kind="stable")[:, : min(k, len(v) - 1)]
    first = np.full(near.shape, 1 << 30)
    for t in range(tables):
        order = axes(asked, t, 1 << 30)
        place = np.argsort(order, axis=1)
        first = np.minimum(first, np.take_along_axis(place, axes(v, t)[near, 0], 1))
    worst = np.sort(first.reshape(-1))
    return int(worst[max(0, int(np.ceil(target * len(worst))) - 1)]) + 1


def in_buckets(vectors: DataFrame, tables: int, probes: dict[int, int] | None, counted: bool = False) -> DataFrame:
    """bucket, id and v, a row for each table and, with probes (by dimension), each bucket that a query looks into; counted: bucket and n alone, a row
    for each task and bucket."""
    kind = dict(vectors.dtypes)["v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                dims = part.column(2).to_numpy(zero_copy_only=False)
                for dim in np.unique(dims).tolist():
                    own = part.filter(pa.array(dims == dim))
                    v = own.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
                    for t in range(tables):
                        codes = axes(v, t, 1 if probes is None else probes.get(dim, 1 << 30))
                        buckets = ((dim << 40) + (t << 32)) + codes.reshape(-1)  # dimension, table and axis in one number
                        if counted:
                            for b, n in zip(*(x.tolist() for x in np.unique(buckets, return_counts=True)), strict=True):
                                seen[b] = seen.get(b, 0) + n
                            continue
                        rows = own.take(pa.array(np.repeat(np.arange(len(v)), codes.shape[1])))
                        yield pa.RecordBatch.from_arrays([pa.array(buckets), rows.column(0), rows.column(1)], names=["bucket", "id", "v"])
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()))], names=["bucket", "n"])

    schema = "bucket long, n long" if counted else f"bucket long, id long, v {kind}"
    return vectors.select("vec_id", "v", "dim").mapInArrow(run, schema)


def nearest_in_block(k: int):
    def search(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(vectors):
            q, x, ids = matrix(queries["v"]), matrix(vectors["v"]), vectors["id"].to_numpy()
            with np.errstate(over="ignore", invalid="ignore"):
                xx, qq = (x * x).sum(1), (q * q).sum(1)
                rough = qq[:, None] + xx[None, :] - 2 * (q @ x.T)
            # rough distances err by rounding only: all within that error of the k-th are measured exactly
            slack = 1e-9 * (qq[:, None] + xx[None, :])
            rough = np.where(np.isfinite(rough), rough, -np.inf)
            once = len(np.unique(ids)) == len(ids)  # else the k nearest rows may be fewer ids
            for i, own in enumerate(queries["id"].to_numpy()):
                rough[i, ids == own] = np.inf
                low = rough[i] - slack[i]
                if len(ids) > k and once:
                    edge = np.partition(rough[i] + slack[i], k - 1)[k - 1]
                    at = np.flatnonzero(low <= edge)
                else:
                    at = np.arange(len(ids))
                at = at[ids[at] != own]
                d = exact_distance(q[i], x[at])
                first = np.lexsort((ids[at], d))
                first = (first if once else first[np.sort(np.unique(ids[at][first], return_index=True)[1])])[:k]
                out.append(pd.DataFrame({"query_id": own, "vec_id": ids[at][first], "score": d[first]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})

    return search


def exact_distance(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    d = x - q
    with np.errstate(over="ignore"):
        s = (d * d).sum(1)
    odd = ~np.isfinite(s) | ((s < 1e-290) & (np.abs(d).max(1, initial=0) > 0))
    s = np.sqrt(s)
    if odd.any():  # scaled, where squares leave the range of doubles
        most = np.abs(d[odd]).max(1, keepdims=True)
        s[odd] = most[:, 0] * np.sqrt(((d[odd] / most) ** 2).sum(1))
    return s


def approximate_neighbours(df: DataFrame, is_query, k: int = 10, tables: int = TABLES, probes: int | None = None) -> DataFrame:
    """df (vec_id, embedding) -> query_id, rank, vec_id, score: for each row where is_query holds, the k rows found that are
    nearest by Euclidean distance (doubles), but the query's own id, ties to the smaller vec_id. Fewer than k only where the
    table has no more.

    Null, empty and zero vectors and those with null or non-finite components take no part, nor do rows without an id.
    Vectors are compared with those of the same dimension. Equal vectors share all buckets; a bucket of any size is searched
    whole, page by page. Of an id's rows with different vectors, as candidates the nearest counts, as query the first vector in the order of
    arrays; repeated rows are listed once. Columns of other names are ignored. An empty table gives an empty result.
    """
    vectors = clean_vectors(df, keep_float=True).where(F.exists("v", lambda x: x != 0))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas() if probes is None else None
    ask = lambda own: probes_needed(matrix(own["v"]), k, tables) if len(own) >= LEAST_SAMPLE else 1 << 30
    looks = {int(dim): ask(own) for dim, own in sample.groupby("dim")} if sample is not None else {r["dim"]: probes for r in vectors.select("dim").distinct().collect()}
    asked = vectors.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "dim")).alias("x")).select("vec_id", "x.v", "x.dim")
    asked = stored(asked, "asked")
    counts = [in_buckets(x, tables, p, counted=True).groupBy("bucket").agg(F.sum("n").alias("n")) for x, p in ((asked, looks), (vectors, None))]
    found = block_join(in_buckets(asked, tables, looks), in_buckets(vectors, tables, None), nearest_in_block(k), "query_id long, vec_id long, score double", counts=counts)
    found = stored(best(found, k, descending=False), "neighbours")
    enough = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = stored(asked.join(enough, "vec_id", "left_anti"), "short")
    drop_stored(asked)
    if not short.limit(1).count():
        drop_stored(short)
        return found
    in_all = lambda x: x.select(F.col("dim").cast("long").alias("bucket"), F.col("vec_id").alias("id"), "v")
    every = vectors.join(F.broadcast(short.select("dim").distinct()), "dim", "left_semi")
    again = block_join(in_all(short), in_all(every), nearest_in_block(k), "query_id long, vec_id long, score double")
    return best(found.drop("rank").unionByName(again), k, descending=False)
