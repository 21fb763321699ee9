"""Windows and k-mers over a genome: generation, occurrence counts and uniqueness."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import canonical, reverse_complement, slice_at
from .superkmers import count_windows, single_windows

#: Window starts in a piece of a sequence.
PIECE = 4096


def pieces(sequences: DataFrame, size: int, seq: str = "seq", keys: tuple[str, ...] = ("chr",)) -> DataFrame:
    """(keys, first, piece): overlapping parts of a sequence that hold each window of a size once.

    Sequences are cut as bytes, at a cost in proportion to their length, and are ASCII. A piece is a row
    of its own, so the windows of one sequence are made by as many tasks as its rows are dealt to.
    """
    def cut(whole: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(whole) - size + 1, F.lit(PIECE))
        return F.when(F.length(whole) >= size, F.transform(starts, lambda i: F.struct(i.alias("first"), F.substr(whole, i, F.lit(PIECE + size - 1)).cast("string").alias("piece"))))

    # in one expression, so that a sequence that is itself made by one is made once
    return sequences.select(*keys, F.explode(once(F.col(seq).cast("binary"), cut)).alias("__p")).select(*keys, "__p.first", "__p.piece")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value made once, however often a lambda in it reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def windows(sequences: DataFrame, size: int, step: int = 1, seq: str = "seq", keys: tuple[str, ...] = ("chr",)) -> DataFrame:
    """(keys, start, kmer): every window of a size, start 1-based; sequences that are shorter give none."""
    inside = pieces(sequences, size, seq, keys)
    starts = F.sequence(F.lit(1), F.length("piece") - size + 1)
    made = once(F.col("piece").cast("binary"), lambda own: F.transform(starts, lambda i: F.struct((F.col("first") + i - 1).alias("start"), F.substr(own, i, F.lit(size)).cast("string").alias("kmer"))))
    if step > 1:
        made = F.filter(made, lambda w: (w["start"] - 1) % step == 0)
    return inside.select(*keys, F.explode(made).alias("w")).select(*keys, "w.start", "w.kmer")


def capture_windows(features: DataFrame, largest: int, smallest: int, step: int) -> DataFrame:
    """Capture windows of each size over features' surroundings: feature_id, chr, size, start, window.

    Starts run from start_f - size to before stop_f and windows end inside the known sequence.
    """
    sizes = features.withColumn("size", F.explode(F.sequence(F.lit(largest), F.lit(smallest), F.lit(-step))))
    starts = sizes.withColumn("start", F.explode(F.sequence(F.col("start_f") - F.col("size"), F.col("stop_f") - 1)))
    kept = starts.filter((F.col("start") > 0) & (F.col("start") >= F.col("seq_start")) & (F.col("start") + F.col("size") - 1 <= F.col("seq_stop")))
    return kept.select("feature_id", "chr", "size", "start", slice_at(F.col("seq"), F.col("seq_start"), F.col("start"), F.col("start") + F.col("size") - 1).alias("window"))


def copy_numbers(sequences: DataFrame, size: int, seq: str = "seq") -> DataFrame:
    """(kmer, copies): occurrences of each k-mer on either strand, named by its canonical form."""
    return count_windows(pieces(sequences, size, seq, ()), size)


def with_copies(oligos: DataFrame, counts: DataFrame, oligo: str, copies: str, default: int = 0) -> DataFrame:
    """oligos with the number of copies of one of their sequences; a default where it is unknown."""
    # counts are named by either strand's form, so that the oligos, which are more, join as they are
    forms = F.array_distinct(F.array(F.col("kmer"), reverse_complement(F.col("kmer"))))
    named = counts.select(F.explode(forms).alias("__kmer"), F.col("copies").alias(copies))
    joined = oligos.join(named, F.col(oligo) == F.col("__kmer"), "left").drop("__kmer")
    return joined.withColumn(copies, F.coalesce(F.col(copies), F.lit(default)))


def unique_windows(sequences: DataFrame, size: int, seq: str = "seq", keys: tuple[str, ...] = ("chr",), spell: bool = True) -> DataFrame:
    """(keys, start, kmer) of windows that occur once on either strand of the whole genome; without kmer, if they
    needn't be spelt."""
    return single_windows(pieces(sequences, size, seq, keys), size, keys, spell)


def near_windows(sequences: DataFrame, size: int, seq: str = "seq", keys: tuple[str, ...] = ("chr",)) -> DataFrame:
    """(kmer, near): distinct k-mers with another that differs from them, or from their reverse
    complement, in just one base.

    Of two that differ in one base, one half is the same: an equi-join on either half, then a check.
    Halves that very many share are joined like any other key; adaptive execution splits them.
    """
    found = windows(sequences, size, seq=seq, keys=()).select(F.col("kmer")).distinct()
    both = found.withColumn("strand", F.explode(F.array(F.lit("+"), F.lit("-")))).select(F.when(F.col("strand") == "+", F.col("kmer")).otherwise(reverse_complement(F.col("kmer"))).alias("other")).distinct()
    cut = size // 2
    halves = lambda df, c: df.withColumn("half", F.explode(F.array(F.concat(F.lit("l"), F.substring(c, 1, cut)), F.concat(F.lit("r"), F.substring(c, cut + 1, size)))))
    differing = F.aggregate(F.sequence(F.lit(1), F.lit(size)), F.lit(0), lambda s, i: s + F.when(F.substr("kmer", i, F.lit(1)) != F.substr("other", i, F.lit(1)), 1).otherwise(0))
    pairs = halves(found, "kmer").join(halves(both, "other"), "half").filter(differing == 1)
    return pairs.select("kmer", "other").distinct().groupBy("kmer").agg(F.count(F.lit(1)).alias("near"))


def unmappable(captures: DataFrame, genome: DataFrame) -> DataFrame:
    """(size, chr, pos) of capture windows that occur more than once in the genome, either strand.

    Windows of each size asked for are counted (a handful of sizes), and all sizes are joined at once.
    """
    repeated = None
    for (size,) in captures.select("size").distinct().collect():
        own = copy_numbers(genome, size).filter("copies > 1").select(F.lit(size).alias("size"), "kmer")
        repeated = own if repeated is None else repeated.unionByName(own)
    found = captures.select("size", "chr", F.col("start").alias("pos"), canonical(F.col("window")).alias("kmer"))
    return (found.limit(0) if repeated is None else found.join(repeated, ["size", "kmer"], "left_semi")).select("size", "chr", "pos").distinct()


def sequence_slices(features: DataFrame, genome: DataFrame, margin: int) -> DataFrame:
    """features with seq, seq_start and seq_stop: their part of the genome and a margin, clamped."""
    joined = features.join(genome.select("chr", F.col("seq").alias("__whole")), "chr")
    bounded = joined.withColumn("seq_start", F.greatest(F.lit(1), F.col("start_f") - margin)).withColumn("seq_stop", F.least(F.length("__whole"), F.col("stop_f") + margin))
    return bounded.withColumn("seq", F.upper(F.substr("__whole", F.col("seq_start").cast("int"), (F.col("seq_stop") - F.col("seq_start") + 1).cast("int")))).drop("__whole")
