"""Column expressions on nucleotide sequences."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def reverse_complement(seq: Column) -> Column:
    """Reverse complement of an upper-case sequence; characters other than A, C, G, T stay."""
    return F.reverse(F.translate(seq, BASES, "TGCA"))


def is_palindrome(seq: Column) -> Column:
    return seq == reverse_complement(seq)


def canonical(seq: Column) -> Column:
    """The smaller of a sequence and its reverse complement."""
    return F.least(seq, reverse_complement(seq))


def mers(longest: int) -> list[str]:
    """All sequences of one to so many bases, in lexicographic order."""
    return sorted("".join(x) for n in range(1, longest + 1) for x in product(BASES, repeat=n))


def count_overlapping(seq: Column, mer: str) -> Column:
    """Occurrences of a k-mer that may overlap one another."""
    if len(mer) == 1:
        return F.length(seq) - F.length(F.replace(seq, F.lit(mer), F.lit("")))
    return F.regexp_count(seq, F.lit(f"(?={mer})"))


def share_of_mer(seq: Column, mer: str) -> Column:
    """Occurrences of a k-mer against the places where one could start; 0 for shorter sequences."""
    places = F.length(seq) - len(mer) + 1
    return F.when(places > 0, count_overlapping(seq, mer) / places).otherwise(0.0)


def share_of_bases(seq: Column, bases: str) -> Column:
    """Share of characters among the given bases."""
    kept = sum((F.length(seq) - F.length(F.replace(seq, F.lit(b), F.lit(""))) for b in bases[1:]), F.length(seq) - F.length(F.replace(seq, F.lit(bases[0]), F.lit(""))))
    return F.when(F.length(seq) > 0, kept / F.length(seq)).otherwise(0.0)


def base_runs(seq: Column) -> Column:
    """Number of runs of G or C and of other bases."""
    return F.regexp_count(seq, F.lit("[GC]+|[^GC]+"))


def masked_share(ext_arm: Column, lig_arm: Column) -> Column:
    """Share of masked bases (N) in both arms of a probe."""
    both = F.concat(ext_arm, lig_arm)
    return (F.length(both) - F.length(F.replace(both, F.lit("N"), F.lit("")))) / F.length(both)


def slice_at(seq: Column, seq_start: Column, start: Column, stop: Column) -> Column:
    """Bases start to stop (1-based, inclusive) of a sequence whose first base has position seq_start."""
    return F.substr(seq, (start - seq_start + 1).cast("int"), (stop - start + 1).cast("int"))


def wrapped(seq: Column, width: int = 70) -> Column:
    """Lines of a sequence, each of at most so many characters."""
    return F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))


def from_letters(text: Column) -> Column:
    """A sequence derived from a text: its letters a-z in turn as A, C, G, T."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]+", ""), "abcdefghijklmnopqrstuvwxyz", "ACGT" * 6 + "AC")
