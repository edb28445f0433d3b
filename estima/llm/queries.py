"""The subpackage's queries, opN_<name>, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estima.llm import sql
from estima.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of source/language/hundred/: the table has no paths, so these stand for a tree of directories, where each tenth
    document is named like a licence file."""
    from estima.llm.licenses import scan_licenses

    name = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("LICENSE."), "doc_id")).otherwise(F.concat("doc_id", F.lit(".txt")))
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 100), name)
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), path.alias("path"), "text")
    return scan_licenses(files).withColumnRenamed("file", "doc_id")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from estima.llm.mtree import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from estima.llm.toxicity import fit, grade_documents

    docs = table(spark, sf_dir, "documents")
    return grade_documents(docs, fit(docs, table(spark, sf_dir, "labels")))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from estima.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from estima.llm.secret_scan import BASE_RULES, find_secrets

    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    listed = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = [r.kind for r in BASE_RULES]
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(listed(F.filter("secrets", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from estima.llm.html_text import render_pages

    return render_pages(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


def op7_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from estima.llm.crosspolytope import approximate_neighbours

    return approximate_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from estima.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from estima.llm.jaccard import join_components

    return join_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from estima.llm.langid import fit, held_out, identify

    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in sql.ORACLES.items() if k in queries()}
