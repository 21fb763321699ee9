"""Intervals: merging, islands, exploding, joining, subtracting and coverage.

Intervals are closed [start, stop] unless stated. Keys may be skewed: what needs order runs in windows
over bins of a key, and what a bin takes over from those before it is found over one row a bin; the rest is
an equi-join on bins or positions, never a nested loop.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(per_bin: DataFrame, keys: list[str], of: Callable[[Column], Column], value: str) -> Column:
    """An aggregate over all earlier bins of a key; per_bin has one row a key and bin."""
    earlier = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    return of(F.col(value)).over(earlier)


def merge(intervals: DataFrame, keys: list[str], start: str = "start", stop: str = "stop", gap: Column | int = 0, label: str | None = None, tie: str | None = None, width: int | None = None) -> DataFrame:
    """Coalesce intervals of a key whose start lies at most ``gap`` behind the last stop so far.

    One row per merged interval: keys, start, stop, n_merged, and the label of the last interval
    merged into it (in the order of start, then tie). With a width, a key's intervals are dealt to bins of their
    starts: a bin is ordered by itself, and takes over from earlier bins how far they reach and how many
    merged intervals begin in them, so one key's rows run in many tasks. Without one a key is one bin, which suits
    many keys of few rows.
    """
    last = tie or stop
    rows = intervals.withColumn("__bin", F.floor(F.col(start) / width) if width else F.lit(0).cast("long"))
    if width:
        reached = rows.groupBy(*keys, "__bin").agg(F.max(stop).alias("__stop"))
        rows = _with_bins(rows, reached.withColumn("__carried", _before(reached, keys, F.max, "__stop")), keys, "__carried")
    else:
        rows = rows.withColumn("__carried", F.lit(None).cast(rows.schema[stop].dataType))
    order = Window.partitionBy(*keys, "__bin").orderBy(start, last)
    reach = F.greatest(F.max(stop).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("__carried"))
    rows = rows.withColumn("__fresh", F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0))
    rows = rows.withColumn("__island", F.sum("__fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    if width:
        begun = rows.groupBy(*keys, "__bin").agg(F.sum("__fresh").alias("__n"))
        rows = _with_bins(rows, begun.withColumn("__offset", _before(begun, keys, F.sum, "__n")), keys, "__offset")
        rows = rows.withColumn("__island", F.col("__island") + F.coalesce("__offset", F.lit(0)))
    out = [F.min(start).alias(start), F.max(stop).alias(stop), F.count(F.lit(1)).alias("n_merged")]
    if label:
        out.append(F.max_by(label, F.struct(start, last)).alias(label))
    return rows.groupBy(*keys, "__island").agg(*out).drop("__island")


def _with_bins(rows: DataFrame, per_bin: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows with a value of their key's bin; null keys are keys."""
    named = per_bin.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, "__bin"])], value)
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate([*keys, "__bin"])]
    return rows.join(named, same).drop(*[f"__k{i}" for i in range(len(keys) + 1)])


def merge_targets(regions: DataFrame, flank: int = 0, least_capture: int = 120) -> DataFrame:
    """Merge target regions (0-based start) of a chromosome that one capture could span.

    Two regions merge if less than half the least capture size lies between them beyond both flanks;
    starts become 1-based and the label is the last region's.
    """
    limit = least_capture // 2 + 2 * flank
    merged = merge(regions, ["chr"], gap=limit - 1, label="label", tie="ord", width=1 << 20)
    return merged.withColumn("start", F.col("start") + 1).withColumn("start_f", F.col("start") - flank).withColumn("stop_f", F.col("stop") + flank)


def islands(positions: DataFrame, keys: list[str], position: str = "pos", width: int | None = None) -> DataFrame:
    """Runs of consecutive positions as intervals: keys, start, stop, length. Repeats count once.

    With a width, runs are found in bins first and those that touch at the bins' borders are merged, one row a run:
    a key's positions run in many tasks.
    """
    rows = positions.select(*keys, position).distinct().withColumn("__bin", F.floor(F.col(position) / width) if width else F.lit(0))
    order = Window.partitionBy(*keys, "__bin").orderBy(position)
    rows = rows.withColumn("__run", F.col(position) - F.row_number().over(order))
    runs = rows.groupBy(*keys, "__bin", "__run").agg(F.min(position).alias("start"), F.max(position).alias("stop")).drop("__bin", "__run")
    if width:
        runs = merge(runs, keys, gap=1, width=64 * width).drop("n_merged")
    return runs.withColumn("length", (F.col("stop") - F.col("start") + 1).cast("long"))


def positions(intervals: DataFrame, start: str = "start", stop: str = "stop", position: str = "pos") -> DataFrame:
    """One row per position of each interval; empty intervals give none."""
    fit = intervals.filter(F.col(start) <= F.col(stop))
    return fit.withColumn(position, F.explode(F.sequence(F.col(start), F.col(stop))))


def point_join(points: DataFrame, intervals: DataFrame, keys: list[str], width: int, point: str = "pos", start: str = "start", stop: str = "stop") -> DataFrame:
    """Points with the intervals of their key that contain them.

    Intervals are dealt to the bins they touch and points to their one, so the join is an equi-join;
    choose a width near the intervals' usual length.
    """
    binned = intervals.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(stop) / width))))
    placed = points.withColumn("__bin", F.floor(F.col(point) / width))
    return placed.join(binned, [*keys, "__bin"]).filter((F.col(point) >= F.col(start)) & (F.col(point) <= F.col(stop))).drop("__bin")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int, names: tuple[str, str, str, str]) -> DataFrame:
    """Pairs of overlapping intervals of a key; names: start and stop of the left and of the right.

    A pair that meets in several bins is kept in the first bin that both touch.
    """
    ls, le, rs, re_ = names
    one = left.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(ls) / width), F.floor(F.col(le) / width))))
    two = right.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(rs) / width), F.floor(F.col(re_) / width))))
    both = one.join(two, [*keys, "__bin"]).filter((F.col(ls) <= F.col(re_)) & (F.col(rs) <= F.col(le)))
    return both.filter(F.col("__bin") == F.floor(F.greatest(F.col(ls), F.col(rs)) / width)).drop("__bin")


def subtract(intervals: DataFrame, holes: DataFrame, keys: list[str], width: int, start: str = "start", stop: str = "stop") -> DataFrame:
    """What remains of each interval without the holes of its key: the interval's columns with the
    remaining parts' bounds. Intervals without holes stay whole, covered ones go.
    """
    numbered = intervals.withColumn("__id", F.monotonically_increasing_id())
    cut = overlap_join(numbered.select(*keys, "__id", F.col(start).alias("__s"), F.col(stop).alias("__e")), holes.select(*keys, F.col(start).alias("__hs"), F.col(stop).alias("__he")), keys, width, ("__s", "__e", "__hs", "__he"))
    merged = merge(cut, ["__id", "__s", "__e"], "__hs", "__he", gap=1)
    order = Window.partitionBy("__id").orderBy("__hs")
    after = F.coalesce(F.lead("__hs").over(order) - 1, F.col("__e"))
    first = F.row_number().over(order) == 1
    parts = merged.withColumn("__after", F.struct((F.col("__he") + 1).alias("a"), after.alias("b"))).withColumn("__before", F.when(first, F.struct(F.col("__s").alias("a"), (F.col("__hs") - 1).alias("b"))))
    left = parts.select("__id", F.explode(F.array_compact(F.array("__before", "__after"))).alias("__p")).filter("__p.a <= __p.b")
    columns = [c for c in intervals.columns if c not in (start, stop)]
    touched = numbered.join(left, "__id").select(*columns, F.col("__p.a").alias(start), F.col("__p.b").alias(stop))
    whole = numbered.join(merged.select("__id").distinct(), "__id", "left_anti").select(*columns, start, stop)
    return touched.unionByName(whole)


def coverage(counts: DataFrame, targets: DataFrame, samples: DataFrame, value: str, keys: list[str], sample: str, width: int = 1 << 16) -> DataFrame:
    """Summed value of each sample at each target position, 0 where nothing covers it.

    counts: keys, start, stop, sample and value (a whole number or decimal, whose sums are exact); targets: keys,
    start, stop. The grid is targets' positions times samples. An interval is two events, its value from start on
    and less it behind stop, however long it is: a position's sum is that of the events up to it in its bin and of
    all earlier bins, which are summed over one row a bin.
    """
    if counts.schema[value].dataType.typeName() in ("double", "float"):
        raise ValueError("coverage sums whole numbers or decimals")
    event = lambda at, sign: F.struct(at.cast("long").alias("pos"), (sign * F.col(value)).alias("change"))
    ends = F.array(event(F.col("start"), 1), event(F.col("stop") + 1, -1))
    events = counts.filter("start <= stop").select(sample, *keys, F.explode(ends).alias("__e")).select(sample, *keys, "__e.*", F.lit(False).alias("__wanted"))
    events = events.groupBy(sample, *keys, "pos", "__wanted").agg(F.sum("change").alias("change"))
    kind = targets.schema["start"].dataType
    grid = positions(targets.select(*keys, "start", "stop")).select(*keys, F.col("pos").cast("long").alias("pos")).distinct().join(samples.select(sample).distinct(), how="cross")
    asked = grid.select(sample, *keys, "pos", F.lit(True).alias("__wanted"), F.lit(0).cast(events.schema["change"].dataType).alias("change"))
    rows = events.unionByName(asked).withColumn("__bin", F.floor(F.col("pos") / width))
    summed = rows.groupBy(sample, *keys, "__bin").agg(F.sum("change").alias("__sum"))
    rows = _with_bins(rows, summed.withColumn("__carried", _before(summed, [sample, *keys], F.sum, "__sum")), [sample, *keys], "__carried")
    upto = Window.partitionBy(sample, *keys, "__bin").orderBy("pos", "__wanted").rowsBetween(Window.unboundedPreceding, 0)
    covered = rows.withColumn("covered", F.sum("change").over(upto) + F.coalesce("__carried", F.lit(0)))
    return covered.filter("__wanted").select(sample, *keys, F.col("pos").cast(kind).alias("pos"), "covered")


def threshold_share(covered: DataFrame, by: list[str], threshold: int) -> DataFrame:
    """Share of positions covered at least so many times."""
    return covered.groupBy(*by).agg(F.avg(F.when(F.col("covered") >= threshold, 1.0).otherwise(0.0)).alias("share"))


def as_bed(intervals: DataFrame, chromosome: str = "chr", start: str = "start", stop: str = "stop") -> DataFrame:
    """BED bounds (0-based, half open) of 1-based closed intervals."""
    return intervals.withColumn(start, F.col(start) - 1).select(F.col(chromosome).alias("chr"), start, stop, *[c for c in intervals.columns if c not in (chromosome, start, stop)])
