"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a 60-bit hash of its id, or of its text if it has no id. A source takes the documents whose hash lies below a threshold,
so a larger budget takes a superset (nested thresholds) and no sort is needed: sizes are summed by source
and by the hash's leading digit, the digit where the sum crosses the budget is found, and only
that boundary bucket is summed again by the next digit, until the digit is the whole hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estima.llm.common import WORD, stored

DIGIT_BITS, DIGITS = 12, 5  # 5 digits of 12 bits: 15 hexadecimal characters of md5


def hash60() -> Column:
    """Of a row's id; rows without one are told apart by their texts."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.col("text")), F.lit("")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> with weight and target.

    Sources in code-point order, null last, get the weights in turn. With S all sizes, share * S is dealt by
    weight; a source stops at most * source_size and its excess is dealt again, which ends at the one level L
    with target = min(weight * L, most * source_size). L is found with running sums over sources ordered by
    source_size / weight; there is one row a source here, whatever the number of documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    w = sizes.withColumn("weight", weight).withColumn("ratio", F.col("source_size") / F.col("weight"))
    w = w.withColumn("at", F.row_number().over(by_ratio))
    w = w.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("capped", F.coalesce(F.sum("source_size").over(before), F.lit(0))).withColumn("capped_weight", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # the level if just the sources before this one are capped; the first source that stays under its cap sets it
    level = (F.lit(share) * F.col("total") - F.lit(most) * F.col("capped")) / (F.col("all_weight") - F.col("capped_weight"))
    w = w.withColumn("level", level)
    w = w.withColumn("found", F.min(F.when(F.col("weight") * F.col("level") <= F.lit(most) * F.col("source_size"), F.struct("at", "level"))).over(everything)["level"])
    target = F.when(F.col("found").isNull(), F.lit(most) * F.col("source_size")).otherwise(F.least(F.col("weight") * F.col("found"), F.lit(most) * F.col("source_size")))
    return w.select("source", "source_size", "weight", target.alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """For each source: copies (whole rounds that every document gets) and threshold (documents with a smaller
    hash get one more).

    sized: source, size, h. The boundary hash itself is taken if that brings the sum strictly nearer to the
    target, so a source misses its target by at most half of its boundary document (or of the
    documents that share one hash, such as repeated rows).
    """
    state = targets.where("source_size > 0").select(
        "source", F.floor(F.col("target") / F.col("source_size")).alias("copies"),
        (F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")).alias("budget"),
        F.lit(0).cast("long").alias("prefix"),
    )
    for digit in range(DIGITS):
        shift = DIGIT_BITS * (DIGITS - 1 - digit)
        bucket = F.shiftright(F.col("h"), shift)
        inside = sized.alias("d").join(state.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.shiftright(F.col("h"), shift + DIGIT_BITS) == F.col("prefix")))
        sums = inside.groupBy(F.col("s.source").alias("source"), "copies", "budget", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
        # at most 4096 rows a source from here on
        run = sums.withColumn("below", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n"))
        run = run.withColumn("at", F.when(F.col("below") + F.col("n") > F.col("budget"), F.col("bucket")))
        last = digit == DIGITS - 1
        left = F.col("budget") - F.col("at_below")
        edges = (
            run.groupBy("source", "copies", "budget")
            .agg(F.min("at").alias("at"), F.min(F.when(F.col("at").isNotNull(), F.struct("at", "below", "n"))).alias("edge"), F.max("bucket").alias("top"))
            .withColumn("at_below", F.col("edge.below"))
            .select(
                "source", "copies", left.alias("budget"),
                (F.when(F.col("edge.n") - left < left, F.col("at") + 1).otherwise(F.col("at")) if last else F.col("at")).alias("prefix"),
            )
        )
        state = stored(edges, "edges")  # a row a source: small, so that the next digit's join is planned as a broadcast
    return state.select("source", "copies", F.col("prefix").alias("threshold"))


def plan_mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """docs (doc_id, text, source) -> the mix's row for each source: mix_source, source_size, target, mix_copies, mix_threshold."""
    sized = stored(with_size(docs).select("doc_id", "source", F.col("mix_size").alias("size"), F.col("mix_hash").alias("h")), "sized")
    # texts are read once; the rest reads some 30 bytes a document
    targets = stored(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    cut = targets.join(thresholds(sized, targets).withColumnRenamed("source", "cut_source"), F.col("source").eqNullSafe(F.col("cut_source")), "left")
    return stored(cut.select(F.col("source").alias("mix_source"), "source_size", "target", F.col("copies").alias("mix_copies"), F.col("threshold").alias("mix_threshold")), "cut")


def with_size(docs: DataFrame) -> DataFrame:
    """docs with mix_size, the number of words, and mix_hash."""
    return docs.withColumn("mix_size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")).withColumn("mix_hash", hash60())


def with_copies(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """sized (source, mix_size, mix_hash) with the plan's columns and copies: how often the mix takes the document."""
    more = (F.col("mix_hash") < F.col("mix_threshold")).cast("long")
    copies = F.when(F.col("mix_size") == 0, 0).otherwise(F.col("mix_copies") + more)
    out = sized.join(plan, F.col("source").eqNullSafe(F.col("mix_source")), "left").drop("mix_source")
    return out.withColumn("copies", F.coalesce(copies, F.lit(0)).cast("long")).drop("mix_copies", "mix_threshold", "mix_hash")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, source, size, source_size, target, copies, taken; a row for each row.

    size is the number of words. copies says how often the mix repeats the document, taken = copies * size.
    Null or empty texts have size 0 and are never taken; a null source is a source of its own; repeated rows
    share their id's hash and so their fate, as do rows without an id that have one text; other columns are ignored. Texts of any
    length are counted whole. An empty table gives an empty result.
    """
    sized = with_size(docs).select("doc_id", "source", "mix_size", "mix_hash")
    out = with_copies(sized, plan_mix(docs, weights, share, most)).withColumnRenamed("mix_size", "size")
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of docs as often as the mix takes them, same columns, whatever their names."""
    rows = with_size(docs.select(F.struct("*").alias("mix_row"), "doc_id", "source", "text")).drop("text")
    kept = with_copies(rows, plan_mix(docs, weights, share, most)).where("copies > 0")
    return kept.withColumn("copies", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("mix_row.*")
