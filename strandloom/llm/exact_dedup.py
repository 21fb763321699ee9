"""Exact deduplication with a heavy-hitter split.

Texts are compared by the SHA-256 digest of their normalised form. A Misra-Gries summary
(``freqItems``) over the digests names at most 1/support candidates, among them every digest of
more than that share of the rows. Counting the candidates exactly verifies them; their winners are
a table of bounded size and are broadcast, so copies of frequent texts are settled map-side. All
other digests have few rows each and take an ordinary shuffle. Only digests and ids are moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, scratch, settle, small, text_of

#: Digests above this share of the rows are certain to be split off; at most 1/SUPPORT are.
SUPPORT = 0.001


#: Dropped ids are broadcast up to this number; beyond it they are joined by a shuffle.
MOST_BROADCAST = 500_000


def digest_of(text: str = "text") -> Column:
    """SHA-256 of the lower-cased (A-Z only) text in UTF-8; null counts as empty."""
    return F.unhex(F.sha2(ascii_lower(text_of(text)), 256))


def digests(docs: DataFrame, id_column: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """(id, row, digest), settled, so that row (the column of that name, else a number) tells repeated
    rows apart for good."""
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    return settle(docs.select(F.col(id_column), number.alias("row"), digest_of(text).alias("digest")), "digests")


def frequent_winners(rows: DataFrame, id_column: str = "doc_id", support: float = SUPPORT) -> DataFrame:
    """(digest, winner, group_size) of the frequent digests: at most 1/support rows."""
    named = rows.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    return (
        rows.join(F.broadcast(named), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.max(F.struct(id_column, "row")).alias("winner"), F.count(F.lit(1)).alias("group_size"))
    )


def resolve(docs: DataFrame, id_column: str = "doc_id", text: str = "text", support: float = SUPPORT, row: str | None = None) -> DataFrame:
    """(id, row, keep_id, group_size, kept, digest) for each row of docs.

    Of rows with equal texts the one with the largest id stays, and of rows that repeat both the one
    with the largest row number (the column named by ``row``, if given); null ids lose against any other. An empty table gives an empty one. Columns other than id
    and text, whatever their names, play no part.
    """
    rows = digests(docs, id_column, text, row)
    winners = F.broadcast(settle(frequent_winners(rows, id_column, support), "winners"))
    settled = rows.join(winners, "digest")
    same = Window.partitionBy("digest")
    others = (
        rows.join(winners, "digest", "left_anti")
        .withColumn("winner", F.max(F.struct(id_column, "row")).over(same))
        .withColumn("group_size", F.count(F.lit(1)).over(same))
    )
    columns = ["digest", id_column, "row", "winner", "group_size"]
    return settled.select(*columns).unionByName(others.select(*columns)).select(
        id_column,
        "row",
        F.col("winner")[id_column].alias("keep_id"),
        "group_size",
        (F.col("winner.row") == F.col("row")).alias("kept"),
        "digest",
    )


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of docs that stay, with all their columns: exactly one for each distinct text."""
    with scratch() as own:
        answer = own.keep(resolve(docs, id_column, text, support), "resolved")
    if answer.groupBy(id_column).count().filter("count > 1").isEmpty():
        gone = small(answer.filter("NOT kept").select(F.col(id_column).alias("__gone")), MOST_BROADCAST)
        return docs.join(gone, F.col(id_column).eqNullSafe(F.col("__gone")), "left_anti")
    # ids repeat: rows are told apart by a number that is written with them
    numbered = settle(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    with scratch() as own:
        answer = own.keep(resolve(numbered, id_column, text, support, "__row").filter("NOT kept").select(F.col("row").alias("__gone")), "resolved")
    return numbered.join(small(answer, MOST_BROADCAST), F.col("__row") == F.col("__gone"), "left_anti").drop("__row")
