"""Token counts from an exact histogram of encoded lengths.

Documents are aggregated to one row per encoded length. Everything asked of lengths afterwards
(totals, quantiles, what a context limit cuts off) comes from sums over that table's suffixes, so
one pass over the corpus answers every limit. The histogram has at most as many rows as the
longest document has tokens, whatever the number of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle
from .sentencepiece_codec import MODEL_PATH, encoded_lengths

#: Lengths whose suffixes are summed in one task; blocks are then chained by their totals.
BLOCK = 1024


def length_histogram(docs: DataFrame, path: str = MODEL_PATH, text: str = "text") -> DataFrame:
    """(n_tokens, n_docs): documents of each encoded length. Null and empty texts have length 0."""
    lengths = encoded_lengths(docs, path, text, keep=[])
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L of the histogram, taken as a context limit:

    docs_ge, tokens_ge: documents of at least L tokens and their tokens;
    truncated_total: tokens that remain if every document is cut to L;
    docs_share_le: share of the documents of at most L tokens (the quantile that L is).

    Sums run inside blocks of lengths; only block totals are ordered as a whole, one row per
    ``BLOCK`` lengths. An empty histogram gives an empty table.
    """
    tokens = F.col("n_tokens") * F.col("n_docs")
    rows = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    after = totals.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("later_docs"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("later_tokens"))
    everything = totals.agg(F.sum("d").alias("all_docs"), F.sum("t").alias("all_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    summed = (
        rows.withColumn("own_docs", F.sum("n_docs").over(inside))
        .withColumn("own_tokens", F.sum(tokens).over(inside))
        .join(after, "block")
        .join(F.broadcast(everything))
        .withColumn("docs_ge", F.col("own_docs") + F.col("later_docs"))
        .withColumn("tokens_ge", F.col("own_tokens") + F.col("later_tokens"))
    )
    return summed.select(
        "n_tokens",
        "n_docs",
        "docs_ge",
        "tokens_ge",
        (F.col("all_tokens") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_total"),
        ((F.col("all_docs") - F.col("docs_ge") + F.col("n_docs")) / F.col("all_docs")).alias("docs_share_le"),
    )


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context, total): tokens left when every document is cut to each context limit; 0 of no documents."""
    spark = sums.sparkSession
    asked = F.broadcast(spark.createDataFrame([(x,) for x in limits], "context long"))
    kept = sums.agg(F.max(F.col("tokens_ge")).alias("all_tokens"))
    above = sums.join(asked, F.col("n_tokens") > F.col("context")).groupBy("context").agg(F.max("docs_ge").alias("d"), F.max("tokens_ge").alias("t"))
    return asked.join(above, "context", "left").join(F.broadcast(kept)).select("context", (F.coalesce("all_tokens", F.lit(0)) - F.coalesce("t", F.lit(0)) + F.col("context") * F.coalesce("d", F.lit(0))).alias("total"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least this share of the documents doesn't exceed; no documents
    have no quantiles, and give no rows."""
    asked = F.broadcast(sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double"))
    return sums.join(asked, F.col("docs_share_le") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, path: str = MODEL_PATH, text: str = "text") -> DataFrame:
    """Histogram of encoded lengths with its suffix sums. Null and empty texts have length 0, repeated rows count
    each, and an empty table gives no rows; columns other than the text play no part."""
    return suffix_sums(settle(length_histogram(docs, path, text), "lengths"))
