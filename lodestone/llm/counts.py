"""Token counts by an exact histogram of encoded lengths; suffix sums answer every context limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import scratch
from lodestone.llm.bpe import lengths

#: Lengths of one block; sums run inside blocks and over the blocks' totals, never over all lengths in one task.
BLOCK = 4096


def length_histogram(docs: DataFrame, path: str) -> DataFrame:
    """length and n_docs: how many documents encode to each length. Null and empty texts have length 0; every row counts."""
    return lengths(docs, path).groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, what holds when it is the context limit.

    Adds to length and n_docs: docs_longer (documents with more tokens),
    tokens_longer (their tokens), total_tokens (all), truncated_tokens (all
    tokens left when every document is cut at this length), docs_upto (rank
    that answers quantiles: a quantile q is the least length with
    docs_upto >= q * n_all), n_all.  An empty histogram gives no rows.
    """
    by_block = histogram.withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    # one row for each BLOCK lengths: with the longest text of n tokens, n / BLOCK rows
    totals = by_block.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "block",
        F.coalesce(F.sum("block_docs").over(after), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("block_tokens").over(after), F.lit(0)).alias("later_tokens"),
        F.sum("block_docs").over(everything).alias("n_all"),
        F.sum("block_tokens").over(everything).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    longer = by_block.withColumn("d", F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).withColumn("t", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    out = longer.join(totals, "block").withColumn("docs_longer", F.col("d") + F.col("later_docs")).withColumn("tokens_longer", F.col("t") + F.col("later_tokens"))
    return out.select(
        "length",
        "n_docs",
        "docs_longer",
        "tokens_longer",
        "total_tokens",
        (F.col("total_tokens") - F.col("tokens_longer") + F.col("length") * F.col("docs_longer")).alias("truncated_tokens"),
        (F.col("n_all") - F.col("docs_longer")).alias("docs_upto"),
        "n_all",
    )


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """length_histogram() with suffix_sums(); the histogram is written, so that its two readers don't encode twice."""
    return suffix_sums(scratch.keep(length_histogram(docs, path), "histogram"))
