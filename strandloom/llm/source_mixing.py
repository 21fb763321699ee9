"""Mixing sources to target weights by repeating documents.

Words are aggregated per source; a source's target divided by its size is its repetition rate.
Each document is emitted floor(rate) times, plus once more if a draw hashed from its id and a seed
falls below the rate's fraction. Several seeds are weighed in one aggregation and each source takes
the one whose total comes nearest to its target: with any one seed the draws are Bernoulli trials
with the fraction as their probability, and the choice conditions them on a total near the target.
Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, settle, small, text_of, words_of

#: Weights by turns over the sources in code-point order (null last).
WEIGHTS = (3.0, 1.0, 2.0)
#: Size of the mix against that of all documents, and the most that a source may be repeated.
SHARE, MOST_REPEATED = 1.5, 2.0
#: Draws of 32 bits in one SHA-256 digest; each is a seed of its own.
SEEDS = 8
#: Rates are broadcast up to this number of sources; beyond it they are joined by a shuffle.
MOST_BROADCAST = 100_000


def sizes(docs: DataFrame, text: str = "text") -> Column:
    """Words of a text (null: 0)."""
    return F.size(words_of(text_of(text))).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """sources with place: the number of sources before each in code-point order, null last.

    A range shuffle sorts them; a source's place is its place in its partition plus the sizes of the
    partitions before it. Only those sizes, a row per partition, meet in one task.
    """
    ordered = sources.orderBy(F.col("source").isNull(), "source").withColumn("__at", F.monotonically_increasing_id())
    ordered = settle(ordered.withColumn("__part", F.shiftright("__at", 33)), "sources")
    parts = ordered.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("__part", (before - F.col("first")).alias("shift"))
    return ordered.join(F.broadcast(parts), "__part").withColumn("place", F.col("__at") + F.col("shift")).drop("__part", "__at", "shift")


def targets(per_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATED) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources share by weight; none gets above ``most`` times its size and what is cut off is shared
    by weight among the rest. That fixed point is min(most * size, weight * level) for one level. The
    level rises, by one aggregate a step, to what the sources not full yet can take, until no
    other becomes full; if all are full there is none.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = ranked(per_source).withColumn("weight", weight).withColumn("full_at", most * F.col("source_size") / F.col("weight"))
    rows = settle(rows.drop("place"), "weighed")
    total, level, n_full = rows.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while level is not None:
        full = F.col("full_at") <= level
        sums = rows.agg(F.count(F.when(full, 1)), F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("weight")))).first()
        if sums[0] == n_full:
            break
        n_full = sums[0]
        level = (share * total - most * (sums[1] or 0)) / sums[2] if sums[2] else None
    fair = F.col("weight") * level if level is not None else most * F.col("source_size")
    return rows.select("source", "source_size", F.least(most * F.col("source_size"), fair).alias("target"))


def _draw(id_column: str, seed: int) -> Column:
    """A number in [0, 1) hashed from the id for one of the seeds."""
    digest = F.sha2(F.coalesce(F.col(id_column).cast("string"), F.lit("null")), 256)
    return F.conv(F.substring(digest, 1 + 8 * seed, 8), 16, 10).cast("double") / float(1 << 32)


def _copies(rate: Column, draw: Column) -> Column:
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def plan(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(rows, rates): one row (id, source, size) per document, and per source its size, target,
    rate and seed. Sources are grouped with partial sums, so one that holds most rows is no burden.
    Null sources are a source of their own; sources without words get the rate 0.
    """
    rows = settle(docs.select(F.col(id_column).alias("doc_id"), F.col(source).alias("source"), sizes(docs, text).alias("size")), "sizes")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = settle(targets(per_source).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)), "targets")
    drawn = join_rates(rows, goals).groupBy("source").agg(
        *[F.sum(F.col("size") * _copies(F.col("rate"), _draw("doc_id", s))).alias(f"seed{s}") for s in range(SEEDS)]
    )
    misses = drawn.join(goals.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"seed{s}") - F.col("target")).alias("miss"), F.lit(s).alias("seed")) for s in range(SEEDS)]))
    rates = settle(misses.select("source", "source_size", "target", "rate", best["seed"].alias("seed")), "rates")
    return rows, rates


def join_rates(rows: DataFrame, rates: DataFrame, source: str = "source") -> DataFrame:
    """rows with the columns of their source's rates. Many sources: a shuffle that splits hot ones."""
    per = small(rates.withColumnRenamed("source", "__source"), MOST_BROADCAST)
    return rows.join(per, F.col(source).eqNullSafe(F.col("__source"))).drop("__source")


def copies(joined: DataFrame, id_column: str = "doc_id") -> Column:
    """How often a document is emitted, from its source's rate and seed."""
    draw = F.element_at(F.array(*[_draw(id_column, s) for s in range(SEEDS)]), F.col("seed") + 1)
    return _copies(F.col("rate"), draw)


def mix(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents of the mix, each as often as it is emitted, with the columns of docs.

    Rows that repeat an id draw alike; null ids draw as one id. An empty table gives an empty mix.
    """
    columns = docs.columns
    with scratch() as own:
        rates = own.keep(plan(docs, id_column, text, source)[1], "rates")
    whole = docs.select(F.struct(*columns).alias("__row"), F.col(id_column).alias("__id"), F.col(source).alias("__of"))
    joined = join_rates(whole, rates, "__of")
    emitted = joined.withColumn("__n", copies(joined, "__id")).filter("__n > 0")
    return emitted.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).select("__row.*")


def taken(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each document."""
    rows, rates = plan(docs, id_column, text, source)
    joined = join_rates(rows, rates)
    return joined.withColumn("copies", copies(joined)).withColumn("taken", F.col("size") * F.col("copies")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", "taken"
    )
