"""From documents to token ids: STAGES in order, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estima.llm import bpe, jaccard, mixing, secret_scan, toxicity
from estima.llm.common import drop_stored, stored, table
from estima.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose probability of a grade above 0 is one half or more.

    Null and empty texts are clean; repeated rows share their fate. Without labels of both kinds nothing is rejected.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group linked by five-word shingles with a Jaccard similarity of 0.8 or more.

    Of repeated rows one stays. Rows without words are nobody's copy, and rows without an id are never the smallest one: they all stay.
    """
    return jaccard.keep_one(docs, width=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret's span of the text replaced; n_chars follows. Null and empty texts stay as they are."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, so some are left out and some come twice; texts without words are never taken. A null source is a
    source of its own; rows of one id are taken alike, as are rows without an id that have one text."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of whole texts, a row for each row; the texts themselves go."""
    out = bpe.encode_documents(docs, tokenizer_path())
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("secrets", mask_secrets),
    ("mix", mix),
    ("bpe", encode),
]

#: Toxicity is a fitted model and BPE a tokenizer: SQL can't express them. The tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages: doc_id, lang, source, n_tokens, ids.

    Further columns, whatever their names, are carried to the last stage and end there. An empty table gives an empty result. Texts are never cut. Ties
    between copies go to the smallest doc_id. Each stage's result is a Parquet table in the shared folder, deleted once the next one is written.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return kept
        kept = stored(kept, name.replace(" ", "-"))
        if k:
            drop_stored(docs)
        docs = kept
    return docs
