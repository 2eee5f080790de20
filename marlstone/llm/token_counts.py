"""Exact token counts from a histogram of encoded lengths.

Method: documents are aggregated by encoded length; with suffix sums over the
lengths, totals, quantiles and totals truncated at any context limit are read
off exactly.  Running sums are taken per block of lengths and carried over
by the blocks' totals, so no task sees more than a block of distinct lengths.

Defined cases: null and empty texts have length 0; repeated rows and null ids
count as documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import stored, table
from marlstone.llm.tokens import default_tokenizer, text_groups, word_ids

#: Lengths in a block of the running sums.
BLOCK = 4096


def encoded_lengths(docs: DataFrame, tokenizer: str | None = None, text_col: str = "text") -> DataFrame:
    """One row per document: n_tokens of its whole text."""
    path = tokenizer or default_tokenizer()

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(path)
        for batch in text_groups(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(ids.encode_all(batch.column(0))[1]))], ["n_tokens"])

    return docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(lengths, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs, from one row per document; stored, as its readers go over it more than once."""
    return stored(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "histogram")


def context_totals(histogram: DataFrame) -> DataFrame:
    """For every occurring length as context limit, what the whole corpus holds below, above and cut to it.

    docs_longer and tokens_longer are suffix sums; tokens_truncated is the
    corpus total when every document is cut to the limit, doc_quantile the
    share of documents of at most that length.
    """
    h = histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("t"), F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("t").alias("bt"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # a row per BLOCK lengths
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0)
    blocks = blocks.select("block", F.coalesce(F.sum("bd").over(above), zero).alias("ad"), F.coalesce(F.sum("bt").over(above), zero).alias("at"), F.sum("bd").over(every).alias("all_docs"), F.sum("bt").over(every).alias("all_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = h.join(blocks, "block").select(
        F.col("n_tokens").alias("context_limit"), "n_docs", "all_docs", "all_tokens",
        (F.coalesce(F.sum("n_docs").over(inside), zero) + F.col("ad")).alias("docs_longer"),
        (F.coalesce(F.sum("t").over(inside), zero) + F.col("at")).alias("tokens_longer"),
    )
    return out.select(
        "context_limit", "n_docs", "docs_longer", "tokens_longer", "all_docs", "all_tokens",
        (F.col("all_tokens") - F.col("tokens_longer") + F.col("context_limit") * F.col("docs_longer")).alias("tokens_truncated"),
        ((F.col("all_docs") - F.col("docs_longer")) / F.col("all_docs")).alias("doc_quantile"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """Tokens left and documents cut when each document is cut to ``limit``, which need not occur as a length."""
    return histogram.agg(
        F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs")).alias("tokens"),
        F.sum(F.when(F.col("n_tokens") > limit, F.col("n_docs")).otherwise(0)).alias("docs_cut"),
    )


def length_quantiles(totals: DataFrame, quantiles: list[float]) -> DataFrame:
    """Smallest length that at least the given share of documents does not exceed, exactly."""
    q = F.explode(F.array(*[F.lit(float(x)) for x in quantiles])).alias("quantile")
    t = totals.select("context_limit", (F.col("all_docs") - F.col("docs_longer")).alias("upto"), "all_docs", q)
    return t.where(F.col("upto") >= F.ceil(F.col("quantile") * F.col("all_docs"))).groupBy("quantile").agg(F.min("context_limit").alias("n_tokens"))


def op9_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_totals(length_histogram(encoded_lengths(table(spark, sf_dir, "documents"))))
