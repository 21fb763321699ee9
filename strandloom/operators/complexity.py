"""Library complexity: totals and unique tags by probe and sample, saturation, coverage per base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import coverage, threshold_share

ALL_SAMPLES, ALL_POSITIONS = "ALL_SAMPLES", "ALL_POSITIONS"


def complexity(reads: DataFrame, sample: str = "sample", probe: str = "mip_key", tag: str = "mtag", cluster: str = "cluster") -> DataFrame:
    """(sample, mip, total, unique): distinct clusters, and distinct tags, of each sample and probe.

    Tags are counted per group first (clusters of one tag in one row), so a probe with most reads is
    aggregated map-side by tag.
    """
    per_tag = reads.groupBy(F.col(sample).alias("sample"), F.col(probe).alias("mip"), F.col(tag).alias("tag")).agg(F.count_distinct(cluster).alias("n"))
    return per_tag.groupBy("sample", "mip").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("unique"))


def collapse_free(reads: DataFrame, sample: str = "sample", probe: str = "mip_key") -> DataFrame:
    """(sample, mip, total, unique) where reads aren't collapsed: every read counts, no tag does."""
    return reads.groupBy(F.col(sample).alias("sample"), F.col(probe).alias("mip")).agg(F.count(F.lit(1)).alias("total"), F.lit(0).cast("long").alias("unique"))


def marginals(counts: DataFrame, design: DataFrame | None = None) -> DataFrame:
    """Totals by probe, by sample and over all, as rows (sample, mip, total, unique).

    Only probes of the design (mip) count if one is given, and those without reads get a row of 0.
    """
    rows = counts if design is None else counts.join(design.select("mip").distinct(), "mip", "left_semi")
    grouped = rows.groupingSets([[F.col("mip")], [F.col("sample")], []], F.col("mip"), F.col("sample")).agg(F.sum("total").alias("total"), F.sum("unique").alias("unique"), F.grouping_id().alias("__g"))
    named = grouped.select(F.when(F.col("__g").isin(1, 3), F.lit(ALL_SAMPLES)).otherwise(F.col("sample")).alias("sample"), F.when(F.col("__g").isin(2, 3), F.lit(ALL_POSITIONS)).otherwise(F.col("mip")).alias("mip"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("unique", F.lit(0)).alias("unique"))
    if design is None:
        return named
    silent = design.select("mip").distinct().join(named.select("mip"), "mip", "left_anti")
    return named.unionByName(silent.select(F.lit(ALL_SAMPLES).alias("sample"), "mip", F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("unique")))


def missed(pool: Column, total: Column, unique: Column) -> Column:
    """Tags a pool of a size would show in so many draws, less those that were seen."""
    return pool * (1 - F.pow(1 - 1 / pool, total)) - unique


def pool_size(total: Column, unique: Column, overall: bool = False, rounds: int = 200) -> Column:
    """Size of the pool of tags that explains the unique ones, by bisection; null outside 0 < u < n.

    Searched from u up to n u / (n - u + 0.1) or, over all, the whole part of n u / (n - u).
    """
    n, u = total.cast("double"), unique.cast("double")
    top = F.floor(n * u / F.nullif(n - u, F.lit(0.0))).cast("double") if overall else n * u / (n - u + 0.1)
    start = F.struct(u.alias("low"), F.greatest(top, u).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = (s["low"] + s["high"]) / 2
        upper, lower = F.struct(middle.alias("low"), s["high"].alias("high")), F.struct(s["low"].alias("low"), middle.alias("high"))
        return F.when(missed(middle, n, u) < 0, upper).otherwise(lower)

    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve, lambda s: (s["low"] + s["high"]) / 2)
    return F.when((unique > 0) & (unique < total), found)


def saturation_label(total: Column, unique: Column, pool: Column, overall: bool = False) -> Column:
    """NA without tags, ~0% if every read is its own tag, else the share of the pool that was seen."""
    share = F.floor(100 * unique / pool)
    known = F.when(share < 8, "<8%")
    if overall:
        known = known.when(share >= 99, ">99%")
    return F.when((unique == 0) | (total == 0), "NA").when(unique == total, "~0%").when(pool.isNull(), "NA").otherwise(known.otherwise(F.concat(share.cast("string"), F.lit("%"))))


def with_saturation(rows: DataFrame) -> DataFrame:
    everything = (F.col("sample") == ALL_SAMPLES) & (F.col("mip") == ALL_POSITIONS)
    pooled = rows.withColumn("pool", F.when(everything, pool_size(F.col("total"), F.col("unique"), True)).otherwise(pool_size(F.col("total"), F.col("unique"))))
    label = F.when(everything, saturation_label(F.col("total"), F.col("unique"), F.col("pool"), True)).otherwise(saturation_label(F.col("total"), F.col("unique"), F.col("pool")))
    return pooled.withColumn("saturation", label)


def distinct_probability(n: Column, tags: int) -> Column:
    """Probability that n molecules have different tags of so many: the product of 1 - k / tags, k < n."""
    return F.when(n <= 1, 1.0).when(n > tags, 0.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), n.cast("int") - 1)), F.lit(1.0), lambda p, k: p * (1 - k / F.lit(float(tags)))))


def basewise(counts: DataFrame, probes: DataFrame, targets: DataFrame) -> DataFrame:
    """Unique tags over each target base by sample, 0 where no probe's scan covers it.

    counts: (sample, mip, unique); probes: (mip, chr, start, stop); targets: (chr, start, stop).
    """
    placed = counts.join(probes, "mip").select("sample", "chr", "start", "stop", "unique")
    return coverage(placed, targets, counts, "unique", ["chr"], "sample")


def covered_share(bases: DataFrame, threshold: int) -> DataFrame:
    """Share of target bases with at least so many unique tags, by sample."""
    return threshold_share(bases, ["sample"], threshold)
