"""What the training-data operators share: tables, word rules and cut points of long plans."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space: U+0020 and U+0009 to U+000D. A word is a run of anything else.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of a data folder, which may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. Pure ASCII texts take the quick built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for a text without words."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(
        F.split(inner, r"[\x20\x09-\x0D]+")
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one named in spark.checkpoint.dir, else the
    one given to ``setCheckpointDir``.

    Where neither is set, a local master (one machine, as in tests) takes the warehouse; a cluster
    gets an error, since no folder is then known to be shared.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = spark.conf.get("spark.sql.warehouse.dir")
    return named.rstrip("/") + "/settled"


#: Removes a query's shuffle files when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@dataclass
class Scratch:
    """Owner of the tables that are settled in a ``with scratch()`` block, removed at its end.

    A table that outlives the block is made by ``keep``: it belongs to the enclosing block, if any.
    Tables settled outside of all blocks stay until the driver ends.
    """

    outer: Scratch | None
    tables: list[DataFrame] = field(default_factory=list)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table of the enclosing block."""
        token = _scratch.set(self.outer)
        try:
            return settle(df, name)
        finally:
            _scratch.reset(token)


_scratch: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch() -> Iterator[Scratch]:
    """A block that owns what is settled in it."""
    own = Scratch(_scratch.get())
    token = _scratch.set(own)
    try:
        yield own
    finally:
        _scratch.reset(token)
        for df in own.tables:
            discard(df)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts its lineage.

    Lost executors then cost the running stage only, and the shuffle files behind df go at once. The
    table goes when it is discarded, with the ``scratch`` block that owns it, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    remove_at_end(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    if (own := _scratch.get()) is not None:
        own.tables.append(out)
    return out


#: How many rows go to a Python worker at once.
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """A block in which Python workers get so many rows at once; for rows of megabytes. What it is to hold
    for is run inside."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def discard(df: DataFrame) -> None:
    """Remove a settled table that no later step reads."""
    remove(df.sparkSession, df.settled_at)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder, if it is there."""
    at, files = _file_system(spark, path)
    files.delete(at, True)


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Remove a folder that is there when the driver ends."""
    at, files = _file_system(spark, path)
    files.deleteOnExit(at)


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: Rows and bytes of text that a Python worker unpacks at once; a longer text comes alone.
PIECE_ROWS, PIECE_BYTES = 512, 1 << 22


def pieces(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of batches of bounded size, each with the texts of its rows."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(size), 0
        while at < batch.num_rows:
            most = (ends[at - 1] if at else 0) + PIECE_BYTES
            stop = max(at + 1, min(at + PIECE_ROWS, int(np.searchsorted(ends, most, side="right"))))
            part = batch.slice(at, stop - at)
            yield part, part.column(text).to_pylist()
            at = stop


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcasting if it has at most so many rows; else Spark shuffles it.

    Call it on settled tables, where counting is cheap.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """df, settled, with place: how many rows come before each in that order.

    A range shuffle sorts the rows; a row's place is its place in its partition plus the sizes of the
    partitions before it. Only those sizes, a row per partition, meet in one task.
    """
    ordered = settle(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__at", 33)
    parts = ordered.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = parts.select("__part", (before - F.col("first")).alias("__shift"))
    return ordered.join(F.broadcast(shifts), part == F.col("__part")).withColumn("place", F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")
