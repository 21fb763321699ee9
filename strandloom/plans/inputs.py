"""Domain inputs derived from the driver's tables, as DataFrames and as SQL for comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import from_letters


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(column: str) -> Column:
    """Days since 1970 of a timestamp without zone."""
    return F.unix_date(F.col(column).cast("date"))


def seconds(column: str) -> Column:
    """Seconds since 1970 of a timestamp without zone, read as UTC."""
    return F.unix_seconds(F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(column)).cast("timestamp"))


LETTERS = "translate(regexp_replace(lower({0}), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"
DAY = "date_diff('day', DATE '1970-01-01', CAST({0} AS DATE))"
SECONDS = "CAST(floor(epoch({0})) AS BIGINT)"


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chr, seq): one sequence per document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("chr"), from_letters(F.col("text")).alias("seq"))


GENOME = "SELECT doc_id AS chr, " + LETTERS.format("text") + " AS seq FROM documents"


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features for probe design: one per benchmark item, its middle third, in its own sequence."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("feature_id"), F.col("item_id").cast("string").alias("chr"), from_letters(F.col("text")).alias("seq"))
    size = F.length("seq")
    return items.select("feature_id", "chr", F.concat(F.lit("item"), F.col("chr")).alias("label"), "seq", F.lit(1).alias("seq_start"), size.alias("seq_stop"), (F.floor(size / 3) + 1).cast("int").alias("start_f"), F.floor(2 * size / 3).cast("int").alias("stop_f")).filter("start_f <= stop_f")


TARGETS = (
    "SELECT item_id AS feature_id, CAST(item_id AS VARCHAR) AS chr, seq, 1 AS seq_start, length(seq) AS seq_stop, length(seq) // 3 + 1 AS start_f, (2 * length(seq)) // 3 AS stop_f FROM (SELECT item_id, "
    + LETTERS.format("text")
    + " AS seq FROM benchmark) WHERE length(seq) // 3 + 1 <= (2 * length(seq)) // 3"
)
