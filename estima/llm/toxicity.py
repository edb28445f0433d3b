"""Toxicity as severity grades by cumulative-link ordinal regression on sparse text features.

Grades: 0 for documents labelled clean; toxic ones get 1 to 3 by terciles, over the labelled sample, of the number of
distinct features that tell toxic from clean texts in them. The model has one weight a feature, shared by the ordered thresholds:
P(grade <= k | x) = logistic(threshold_k - w.x). A document's expected severity is the sum of P(grade > k).

Features: hashed character 4- and 5-grams of the lower-cased text, within words and one space around them, counted as
present or absent. Only those that the sample shows to tell something are given a weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estima.llm.common import row_chunks, stored

BITS = 20  # of a feature's hash
SIZES = (4, 5)
LABELLED = 6000  # bound of the labelled sample that the model is fitted on, half of it toxic where there are as many
FEATURES = 2048  # most features with a weight
PIECE = 1 << 18  # n-grams of a long text that are hashed at a time; features don't depend on it
GRADES = 4


def code_points(text: str) -> np.ndarray:
    """Lower-cased code points, everything but letters a space, with one at each end."""
    low = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(letters()[np.minimum(low, 0xFFFF)] | (low > 0xFFFF), low, 32).astype(np.uint32)


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(1 << 16)), bool, 1 << 16))
    return _LETTERS[0]


def gram_hashes(cp: np.ndarray, n: int, bits: int) -> np.ndarray:
    """A hash of each n code points in a row."""
    if len(cp) < n:
        return np.empty(0, np.uint32)
    h = np.full(len(cp) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for i in range(n):
        h = (h ^ cp[i : len(cp) - n + 1 + i]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return h >> np.uint32(32 - bits)


def features_of(text: str | None, keep: np.ndarray | None = None) -> np.ndarray:
    """Distinct hashed features; of those that keep (a table from hash to number, -1 for none) holds, the numbers."""
    if not text:
        return np.empty(0, np.int64)
    found: list[np.ndarray] = []
    whole = code_points(text)
    for n in SIZES:
        for at in range(0, len(whole) - n + 1, PIECE):
            cp = whole[at : at + PIECE + n - 1]  # the grams that begin in this piece
            h = gram_hashes(cp, n, BITS)
            blanks = np.concatenate([[0], np.cumsum(cp[1:-1] == 32)])  # no space but at an end: grams stay within a word
            inner = blanks[np.arange(len(h)) + n - 2] - blanks[np.arange(len(h))] if len(h) else h
            h = h[inner == 0]
            if keep is not None:
                h = keep[h]
                h = h[h >= 0]
            found.append(np.unique(h))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


@dataclass(frozen=True)
class OrdinalModel:
    """keep: from hash to feature or -1; weights by feature; thresholds ascending, one fewer than grades."""

    keep: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k but the last grade."""
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(self.thresholds[None, :] - scores[:, None]))


def sample_labelled(docs: DataFrame, labels: DataFrame, most: int = LABELLED, seed: int = 0) -> pd.DataFrame:
    """At most `most` labelled rows (doc_id, toxic, found: their features), up to half of them toxic, chosen by a hash of doc_id.

    A label of a document is the largest of its rows; null labels and ids take no part.
    """
    clean = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    clean = clean.withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    n = {r["toxic"]: r["n"] for r in clean.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    want = {1: min(n.get(1, 0), most // 2)}
    want[0] = min(n.get(0, 0), most - want[1])
    # a hash bound that lets some more pass than wanted, then the exact number: no sort of all labels
    picked = None
    for grade in (0, 1):
        share = min(1.0, (want[grade] * 1.2 + 100) / max(1, n.get(grade, 0)))
        some = clean.where((F.col("toxic") == grade) & (F.pmod("h", F.lit(1 << 30)) <= F.lit(int(share * (1 << 30))))).orderBy("h", "doc_id").limit(want[grade])
        picked = some if picked is None else picked.unionByName(some)
    picked = stored(picked.select("doc_id", "toxic"), "labelled")  # at most `most` rows
    own = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_chunks(batches):
            names = part.schema.names
            found = [features_of(t).astype("<u4").tobytes() for t in part.column(names.index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(names.index("doc_id")), part.column(names.index("toxic")), pa.array(found, pa.binary())], names=["doc_id", "toxic", "found"])

    rows = own.mapInArrow(of, "doc_id long, toxic int, found binary").toPandas()
    rows = rows.drop_duplicates("doc_id").sort_values("doc_id", ignore_index=True)  # a repeated document counts once
    rows["found"] = [np.frombuffer(x, "<u4") for x in rows["found"]]
    return rows


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED, features: int = FEATURES) -> OrdinalModel:
    """Fit on a bounded sample of labelled documents. Without labels of both kinds every document gets severity 0."""
    rows = sample_labelled(docs, labels, most)
    toxic = rows["toxic"].to_numpy() == 1
    if not toxic.any() or toxic.all():
        return OrdinalModel(np.full(1 << BITS, -1, np.int32), np.zeros(1), np.full(GRADES - 1, np.inf))
    by_class = np.zeros((2, 1 << BITS), np.int64)
    for found, kind in zip(rows["found"], toxic.astype(int), strict=True):
        by_class[kind, found] += 1
    rate0, rate1 = (by_class[0] + 0.5) / ((~toxic).sum() + 1), (by_class[1] + 0.5) / (toxic.sum() + 1)
    # how far the shares differ, in standard errors
    pooled = (by_class[0] + by_class[1] + 1) / (len(rows) + 2)
    z = (rate1 - rate0) / np.sqrt(pooled * (1 - pooled) * (1 / toxic.sum() + 1 / (~toxic).sum()))
    z[by_class[0] + by_class[1] < 4] = 0
    z[rate1 < 4 * rate0] = 0  # words of long texts are likelier in the class with longer texts; they tell nothing
    chosen = np.argsort(-z, kind="stable")[:features]
    chosen = chosen[z[chosen] > 2]
    keep = np.full(1 << BITS, -1, np.int32)
    keep[chosen] = np.arange(len(chosen), dtype=np.int32)
    x = np.zeros((len(rows), len(chosen)), np.float32)
    for i, found in enumerate(rows["found"]):
        k = keep[found]
        x[i, k[k >= 0]] = 1
    told = x.sum(1)
    edges = np.quantile(told[toxic], [1 / 3, 2 / 3])
    grade = np.where(toxic, 1 + np.searchsorted(edges, told, side="left"), 0)
    return OrdinalModel(keep, *fit_ordinal(x, np.minimum(grade, GRADES - 1), GRADES))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int, steps: int = 400, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that minimise the mean negative log-likelihood plus ridge * |w|^2 / 2, by accelerated
    gradient steps; thresholds are a first one and positive steps, so that they stay in order."""
    n, d = x.shape
    count = np.bincount(grade, minlength=grades)
    share = (np.cumsum(count)[:-1] + 0.5) / (n + 1)
    start = np.log(share / (1 - share))
    theta = np.concatenate([np.zeros(d), [start[0]], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    for t in range(1, steps + 1):
        w, gaps = theta[:d], np.exp(theta[d + 1 :])
        cuts = theta[d] + np.concatenate([[0], np.cumsum(gaps)])
        score = x @ w.astype(np.float32)
        upper = sig(np.concatenate([cuts, [60.0]])[grade] - score)
        lower = np.where(grade > 0, sig(np.concatenate([[-60.0], cuts])[grade] - score), 0.0)
        p = np.maximum(upper - lower, 1e-9)
        du, dl = np.where(grade < grades - 1, upper * (1 - upper), 0.0) / p, np.where(grade > 0, lower * (1 - lower), 0.0) / p
        g_cut = np.zeros(grades - 1)
        np.add.at(g_cut, np.minimum(grade, grades - 2), np.where(grade < grades - 1, -du, 0))
        np.add.at(g_cut, np.maximum(grade - 1, 0), np.where(grade > 0, dl, 0))
        g = np.concatenate([(x.T @ (du - dl).astype(np.float32)) / n + ridge * w, [g_cut.sum() / n], [g_cut[k + 1 :].sum() * gaps[k] / n for k in range(grades - 2)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) * min(1.0, 2 * (1 - t / (steps + 1)))
    cuts = theta[d] + np.concatenate([[0], np.cumsum(np.exp(theta[d + 1 :]))])
    return theta[:d], cuts


def _scores(model: OrdinalModel, texts: list[str | None]) -> np.ndarray:
    return np.array([float(model.weights[features_of(t, model.keep)].sum()) if t else -np.inf for t in texts]).reshape(-1)


def grade_documents(docs: DataFrame, model: OrdinalModel, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """columns of docs, then toxicity (P(grade > 0)), severity (expected grade, 0 to 3), grade (the likeliest), rejected.

    Whole texts are read. Null and empty texts have toxicity and severity 0; every row gives a row, repeated
    ones too; columns that aren't asked for are ignored.
    """
    bound = docs.sparkSession.sparkContext.broadcast(model)  # some 4 MB, whatever the input
    own = docs.select(*columns, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bound.value
        for part in row_chunks(batches):
            above = m.above(_scores(m, part.column(part.num_columns - 1).to_pylist()))
            each = -np.diff(np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(above[:, 0]), pa.array(above.sum(1)), pa.array(each.argmax(1).astype(np.int32)), pa.array(above[:, 0] >= 0.5)],
                names=[*part.schema.names[:-1], "toxicity", "severity", "grade", "rejected"],
            )

    return own.mapInArrow(score, f"{schema}, toxicity double, severity double, grade int, rejected boolean")


def keep_clean(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """docs, same columns, without the rows whose toxicity is one half or more."""
    bound = docs.sparkSession.sparkContext.broadcast(model)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bound.value
        for part in row_chunks(batches):
            toxic = m.above(_scores(m, part.column(part.schema.get_field_index("text")).to_pylist()))[:, 0] >= 0.5
            yield part.filter(pa.array(~toxic))

    return docs.mapInArrow(clean, docs.schema)
