"""Collapsing reads end to end as they stream in, with the state of open sites only.

Reads arrive sorted by position, give or take ``delay`` bases. A site (mip_key, barcode) keeps its reads in state
under a timer at its last base; when the watermark passes it, nothing more of the site can come: the site is
answered as in the batch (``operators.collapse``) and its state is dropped. The answer doesn't depend on how reads
are cut into micro-batches or mixed within them, since a site's reads are put in order first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.collapse import GROUP, OUT, SAM, SITE, annotate, site_reads
from ..params import CollapseParams
from .collapse import event_time

#: rname of the row that ends the input: every site is done behind it.
END = "="
#: Event time of that row, in seconds: behind the line of all chromosomes, and within what Arrow's timestamps hold.
LAST = 1 << 33
_HELD = (*SAM, *GROUP, "sample", "read_number", "cluster", "span", "draw", "done_at")


def _site_end(rname: Column) -> Column:
    """Last base of a read's site: that of its probe, or of the pair or read where it has none."""
    number = lambda g: F.regexp_extract("mip_key", r":(\d+)-(\d+)/", g).try_cast("long")
    paired = F.endswith("mip_key", F.lit("/g")) & (F.col("flag").bitwiseAND(1) != 0)
    return F.coalesce(F.when(paired, number(1) + number(2)).otherwise(number(2)), F.col("pos") + F.col("span"))


class _Sites(StatefulProcessor):
    """Reads of one site, answered when its timer goes off."""

    def __init__(self, params: CollapseParams, schema: str, columns: list[str]):
        self.params, self.schema, self.columns = params, schema, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reads = handle.getListState("reads", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        done: set[int] = set()
        for part in rows:
            part = part[part["rname"] != END]
            if len(part):
                held = part[list(_HELD)].astype(object).where(part[list(_HELD)].notna(), None)
                self.reads.appendList([tuple(r) for r in held.itertuples(index=False)])
                done |= set(part["done_at"])
        for at in done:
            self.handle.registerTimer(int(at))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reads = [dict(zip(_HELD, r, strict=True)) for r in self.reads.get()]
        if any(r["done_at"] > expiredTimerInfo.getExpiryTimeInMs() for r in reads):  # a later timer answers
            return
        rows, total, unique = site_reads(reads, self.params)
        rows.append(dict(zip(SITE, key, strict=True)) | {"sample": reads[0]["sample"] if reads else None, "route": "site", "total": total, "unique": unique})
        self.reads.clear()
        yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in self.columns})

    def close(self) -> None:
        pass


def collapse_sites(reads: DataFrame, params: CollapseParams, offsets: DataFrame, design: DataFrame | None = None, barcodes: DataFrame | None = None, delay: int = 1000) -> DataFrame:
    """Rows of ``operators.collapse`` with their route, and one row of route "site" per site with total and unique.

    reads: a stream with the columns of SAM; offsets: (rname, offset), where each chromosome starts on the line of
    all of them; a row whose rname is END ends the input. In append mode: a site's rows appear once, when the
    watermark (``delay`` behind the largest position) has passed its last base and flex. Reads that come later than
    that are dropped. Reads that aren't on target aren't held. Needs the RocksDB state store.
    """
    placed = reads.join(offsets, "rname", "left")
    at = F.when(F.col("rname") == END, F.lit(LAST)).otherwise(F.coalesce(F.col("offset") + F.col("pos"), F.lit(0)))
    timed = placed.withColumn("site_at", event_time(F.lit(0), at)).withWatermark("site_at", f"{delay} seconds")
    # the last row goes through, as Spark moves filters in front of the watermark
    on = annotate(timed, params, design, barcodes).filter((F.col("disposition") == "on_target") | (F.col("rname") == END))
    done = 1000 * (F.coalesce("offset", F.lit(0)) + _site_end(F.col("rname")) + params.flex)
    held = on.select(*[c for c in _HELD if c not in ("draw", "done_at")], F.xxhash64(F.lit(params.seed), F.col("qname")).alias("draw"), done.cast("long").alias("done_at"), "site_at")
    kinds = {f.name: f.dataType.simpleString() for f in held.schema}
    state = ", ".join(f"{c} {kinds[c]}" for c in _HELD)
    columns = [*SAM, *OUT, "total", "unique"]
    kinds |= {"route": "string", "total": "bigint", "unique": "bigint"}
    return held.groupBy(*SITE).transformWithStateInPandas(
        _Sites(params, state, columns), outputStructType=", ".join(f"{c} {kinds[c]}" for c in columns), outputMode="Append", timeMode="EventTime"
    )


def end_of_input(spark: SparkSession, schema) -> DataFrame:
    """The row that ends a stream of reads, with the columns of its schema."""
    filled = {"rname": END, "pos": 0, "flag": 4, "ord": 0}
    return spark.createDataFrame([tuple(filled.get(f.name) for f in schema)], schema)
