"""Token counts: an exact histogram of encoded lengths that answers for every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dataproof.llm.pieces import PieceEncoder
from dataproof.sources.shared import keep_table

#: Lengths summed up together on the way to suffix sums.
BLOCK = 1024


def encoded_lengths(df: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """The number of tokens of every whole text, one row per row; 0 for NULL and empty texts."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.load(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(encoder.lengths(batch.column(0)))], names=["length"])

    return df.select(df[text_col].alias("text")).mapInArrow(lengths, "length long")


def length_histogram(lengths: DataFrame, length_col: str = "length") -> DataFrame:
    """One row per distinct length, with sums over all documents at least as long.

    ``length``, ``n_docs`` and ``n_tokens`` at this length; ``docs_at_least`` and ``tokens_at_least``
    from this length on; ``docs_up_to`` (a quantile's rank); ``truncated_tokens``: what remains of all
    documents if each is cut at this length; ``all_docs``. NULL lengths count as 0. An empty table gives no rows.

    Documents are counted where they lie and only counts are shuffled, at most one for each length
    and task. Suffix sums are taken within blocks of lengths and between blocks, so no task sees
    more than BLOCK lengths or one row per block.
    """
    # The counts are read twice; written down, the texts are encoded once.
    counts, _ = keep_table(
        lengths.select(F.coalesce(lengths[length_col].cast("long"), F.lit(0)).alias("length"))
        .groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))
        .select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"),
                F.floor(F.col("length") / BLOCK).alias("block")),
        "length-counts",
    )
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("n_tokens").alias("block_tokens"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("block_tokens").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("block_docs").over(everything).alias("all_docs"),
        F.sum("block_tokens").over(everything).alias("all_tokens"),
    )
    own = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    docs = F.sum("n_docs").over(own) + F.col("later_docs")
    tokens = F.sum("n_tokens").over(own) + F.col("later_tokens")
    return (
        counts.join(sums, "block")
        .select("length", "n_docs", "n_tokens", docs.alias("docs_at_least"), tokens.alias("tokens_at_least"),
                "all_docs", "all_tokens")
        .select(
            "length", "n_docs", "n_tokens", "docs_at_least", "tokens_at_least",
            (F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_up_to"),
            (F.col("all_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least"))
            .alias("truncated_tokens"),
            "all_docs",
        )
    )


def totals_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents cut, tokens kept, and all tokens, from the histogram alone."""
    length, n_docs = F.col("length"), F.col("n_docs")
    sums = [
        F.struct(
            F.lit(limit).cast("long").alias("context_limit"),
            F.coalesce(F.sum(F.when(length > limit, n_docs)), F.lit(0)).alias("docs_cut"),
            F.coalesce(F.sum(F.least(length, F.lit(limit)) * n_docs), F.lit(0)).alias("tokens_kept"),
            F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"),
        )
        for limit in limits
    ]
    return histogram.agg(F.array(*sums).alias("sums")).select(F.inline("sums"))


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """The shortest length that at least each share of the documents does not exceed; NULL without documents."""
    found = [
        F.struct(
            F.lit(share).alias("share"),
            F.min(F.when(F.col("docs_up_to") >= F.ceil(F.lit(share) * F.col("all_docs")), F.col("length"))).alias("length"),
        )
        for share in shares
    ]
    return histogram.agg(F.array(*found).alias("found")).select(F.inline("found"))
