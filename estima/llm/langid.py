"""Language ID: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log-probabilities, hash bucket x language, which is broadcast (2^16 x languages floats). A batch of texts
becomes a sparse list of buckets a text and is scored by gathering and summing rows of the matrix in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estima.llm.common import row_chunks, stored
from estima.llm.toxicity import code_points, gram_hashes

BITS = 16
SIZES = (1, 2, 3, 4)
PER_LANGUAGE = 3000  # bound of the documents of a language that its n-grams are counted over
PIECE = 1 << 18  # n-grams of a long text that are hashed at a time
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def buckets(text: str) -> Iterator[np.ndarray]:
    """Hash buckets of the text's n-grams, lower-cased, runs of other characters than letters taken as one space."""
    whole = code_points(text)
    whole = whole[np.concatenate([[True], (whole[1:] != 32) | (whole[:-1] != 32)])]
    for n in SIZES:
        for at in range(0, len(whole) - n + 1, PIECE):
            cp = whole[at : at + PIECE + n - 1]  # the grams that begin in this piece
            h = gram_hashes(cp, n, BITS)
            yield h[cp != 32] if n == 1 else h


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    prior: np.ndarray
    matrix: np.ndarray

    def log_scores(self, text: str) -> tuple[np.ndarray, int]:
        total, n = np.zeros(len(self.languages)), 0
        for h in buckets(text):
            total += self.matrix[h].sum(0, dtype=np.float64)
            n += len(h)
        return total, n

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its probability; ties go to the language that comes first by code point."""
        if not has_letter(text) or not self.languages:
            return UNKNOWN, 0.0
        total, _ = self.log_scores(text)
        total += self.prior
        e = np.exp(total - total.max())
        return self.languages[int(total.argmax())], float(e.max() / e.sum())


def held_out(id_column: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 4. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, most: int = PER_LANGUAGE) -> LanguageModel:
    """docs (doc_id, text, lang), rows to learn from only. Priors are counted over all of them; n-grams over at most about
    `most` documents of each language, chosen by a hash of the id. Null languages and null texts teach nothing. The matrix takes 256 kB a
    language on the driver and in each worker."""
    rows = docs.where("lang is not null and text is not null")
    # languages are a short list; their counts are what the driver needs to set each one's share
    counts = stored(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    part = rows.select("doc_id", "text", "lang").join(counts, "lang")  # a row a language: Spark sees its size and broadcasts it
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) * F.col("n").cast("double") <= F.lit(float(most << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in row_chunks(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = seen.setdefault(lang, np.zeros(1 << BITS, np.int64))
                for h in buckets(text):
                    own += np.bincount(h, minlength=1 << BITS)
        for lang, own in seen.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "bucket", "n"])

    sums = part.where(share).select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    total = {r["lang"]: r["n"] for r in counts.collect()}
    languages = sorted(total, key=lambda x: x.encode("utf-8", "surrogatepass"))
    matrix = np.full((1 << BITS, len(languages)), 0.5, np.float32)
    number = {k: i for i, k in enumerate(languages)}
    np.add.at(matrix, (sums["bucket"].to_numpy(), sums["lang"].map(number).to_numpy(dtype=np.int64)), sums["n"].to_numpy())
    prior = np.array([total[k] for k in languages], float)
    return LanguageModel(languages, np.log(prior / prior.sum()) if len(prior) else prior, np.log(matrix / matrix.sum(0, dtype=np.float64).astype(np.float32)))


def identify(docs: DataFrame, model: LanguageModel, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """columns of docs, then lang_pred and score (its probability, 0 to 1), from the text alone.

    A null text or one without a letter gets `und` and 0, and so does every text if nothing was learned. Whole texts are
    read; a row for each row; columns that aren't asked for are ignored.
    """
    bound = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(*columns, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bound.value
        for part in row_chunks(batches):
            found = [m.predict(t) for t in part.column(part.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*part.schema.names[:-1], "lang_pred", "score"])

    return own.mapInArrow(score, f"{schema}, lang_pred string, score double")
