"""Exact length histogram: token counts for every context limit from suffix sums.

Documents are counted by encoded length once; every question about a context limit is
then a question about the histogram, whose size is the number of distinct lengths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageloom.llm.common import staged_table
from pageloom.llm.tokens import VOCABULARY, token_counts

#: Lengths whose suffix sums are taken in one task.
BLOCK = 1024


def histogram(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``length, n_docs``: documents by their number of ids. A null or empty text has length 0."""
    return token_counts(docs.select(text), "length", text, vocabulary).groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Per length: ``n_docs, docs_at_least, tokens_at_least, docs_up_to, tokens_up_to, truncated_total``.

    ``truncated_total`` counts the ids that remain if every document is cut at this
    length. Blocks of lengths are summed first, so that one task sees one row a block.
    An empty histogram gives an empty result. The histogram has two readers, so it is
    written once; texts are encoded once.
    """
    hist = staged_table(hist, "length-histogram")
    rows = hist.withColumn("tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.floor(F.col("length") / BLOCK))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = W.orderBy(F.col("block").desc()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    blocks = blocks.select(F.col("block").alias("b"), F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_later"),
                           F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_later"), F.sum("d").over(whole).alias("d_all"),
                           F.sum("t").over(whole).alias("t_all"))
    inside = W.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("d_in", F.sum("n_docs").over(inside)).withColumn("t_in", F.sum("tokens").over(inside))
    rows = rows.join(blocks, F.col("block") == F.col("b"))
    docs_at_least, tokens_at_least = F.col("d_in") + F.col("d_later"), F.col("t_in") + F.col("t_later")
    return rows.select("length", "n_docs", docs_at_least.alias("docs_at_least"), tokens_at_least.alias("tokens_at_least"),
                       (F.col("d_all") - docs_at_least + F.col("n_docs")).alias("docs_up_to"),
                       (F.col("t_all") - tokens_at_least + F.col("tokens")).alias("tokens_up_to"),
                       (F.col("t_all") - tokens_at_least + F.col("length") * docs_at_least).alias("truncated_total"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """``context_limit, docs_longer, truncated_total`` for given limits, from ``suffix_sums``.

    The first length at or above a limit has the suffix sums that the limit needs.
    """
    asked = sums.sparkSession.createDataFrame([(int(x),) for x in limits], "context_limit long")
    total = sums.agg(F.max("tokens_at_least").alias("total"))
    reach = sums.select("length", "n_docs", "docs_at_least", "tokens_at_least")
    # As many rows as limits, each with the histogram: a stated list against the lengths.
    out = asked.join(F.broadcast(total)).join(reach, F.col("length") >= F.col("context_limit"), "left")
    first = F.min(F.struct("length", "n_docs", "docs_at_least", "tokens_at_least"))
    out = out.groupBy("context_limit", "total").agg(first.alias("f"))
    docs, tokens = F.coalesce("f.docs_at_least", F.lit(0)), F.coalesce("f.tokens_at_least", F.lit(0))
    longer = docs - F.when(F.col("f.length") == F.col("context_limit"), F.col("f.n_docs")).otherwise(0)
    return out.select("context_limit", longer.alias("docs_longer"),
                      (F.coalesce("total", F.lit(0)) - tokens + F.col("context_limit") * docs).alias("truncated_total"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row, ``length``: the least length that a share ``q`` of the documents doesn't exceed (null without documents)."""
    everything = sums.agg(F.max("docs_at_least").alias("n"))
    return sums.join(F.broadcast(everything)).where(F.col("docs_up_to") >= F.ceil(F.lit(q) * F.col("n"))).agg(F.min("length").alias("length"))
