"""Collapsing reads as they stream in.

Reads arrive sorted by position; a site is done once reads start behind its end. Position is event
time here: a chromosome's offset plus the position, in seconds. The watermark lags by the longest
probe, so tag groups are emitted when the watermark passes their site, and their state is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_time(offset: Column, position: Column) -> Column:
    """A timestamp that grows along the genome."""
    return F.timestamp_seconds(offset + position)


def collapse(reads: DataFrame, longest: int = 300) -> DataFrame:
    """(site_at, mip_key, barcode, mtag, n_reads) per tag group, in append mode.

    reads: site_at (the event time of their probe's start, see ``event_time``), mip_key, barcode,
    mtag, in the order of positions give or take the longest probe. Groups are keyed by their site's
    time, so the state holds open sites only. Reads later than the watermark are dropped: a site
    that is done isn't opened again.
    """
    groups = reads.withWatermark("site_at", f"{longest} seconds").groupBy("site_at", "mip_key", "barcode", "mtag")
    return groups.agg(F.count(F.lit(1)).alias("n_reads"))


def sessions(events: DataFrame, key: str = "user_id", at: str = "ts", gap: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Sessions of a stream of events: intervals that merge while their gap is short."""
    marked = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", delay)
    held = marked.groupBy(key, F.session_window("__at", gap).alias("s")).agg(F.count(F.lit(1)).alias("n_events"))
    return held.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "n_events")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write all that is there to Parquet and stop; state and progress stay in the checkpoint."""
    query = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
