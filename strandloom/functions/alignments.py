"""Column expressions on alignments: CIGAR strings, qualities, read names and flags."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds of operations that use bases of a read, and of the reference.
READ, REFERENCE = "MIS=X", "MDN=X"


def cigar_operations(cigar: Column) -> Column:
    """array<struct<n, op>> of a CIGAR string; empty for "*"."""
    lengths = F.regexp_extract_all(cigar, F.lit(r"(\d+)([A-Z=])"), F.lit(1))
    kinds = F.regexp_extract_all(cigar, F.lit(r"(\d+)([A-Z=])"), F.lit(2))
    return F.zip_with(lengths, kinds, lambda n, op: F.struct(n.cast("int").alias("n"), op.alias("op")))


def _total(cigar: Column, kinds: str) -> Column:
    chosen = F.filter(cigar_operations(cigar), lambda x: F.contains(F.lit(kinds), x["op"]))
    return F.aggregate(chosen, F.lit(0), lambda s, x: s + x["n"])


def reference_span(cigar: Column) -> Column:
    """Bases of the reference that a read covers, by its M and D operations."""
    return _total(cigar, "MD")


def read_span(cigar: Column) -> Column:
    """Bases of the read that the operations M, I, S, = and X account for."""
    return _total(cigar, "MIS=X")


def cigar_fits(cigar: Column, seq: Column) -> Column:
    return read_span(cigar) == F.length(seq)


@lru_cache(1 << 16)
def operations(cigar: str) -> tuple[tuple[int, str], ...]:
    """(length, kind) of the operations of a CIGAR string."""
    return tuple((int(n), op) for n, op in re.findall(r"([0-9]+)([A-Z=])", cigar))


def total_once(cigar: Column, kinds: str) -> Column:
    """Bases that the operations of some kinds account for, made once a row however often the column is read: plans
    copy no nondeterministic column into what reads it, nor a filter to below it. Strings of a batch that are equal
    are parsed once."""

    def run(cigars: pa.Array) -> pa.Array:
        own = cigars.dictionary_encode()
        return pa.array([sum(n for n, op in operations(c) if op in kinds) for c in own.dictionary.to_pylist()], pa.int32()).take(own.indices)

    return F.arrow_udf(run, T.IntegerType()).asNondeterministic()(cigar)


@lru_cache(1 << 16)
def kept_part(cigar: str, low: int | None, high: int | None) -> tuple[int | None, int | None, str, int]:
    """(begin, end, text, size) of what of an alignment lies from low to high, reference bases from its first on: the
    part of the read (null if no bases are left), and its CIGAR string with the sum of its lengths. Null: no bound."""
    read = ref = size = 0
    begin = end = None
    text = ""
    for n, op in operations(cigar):
        uses, refs = op in READ, op in REFERENCE
        if refs:
            first = 0 if low is None else max(low - ref, 0)
            last = n if high is None else min(n, high - ref + 1)
        else:
            first = n if low is not None and ref < low else 0
            last = 0 if high is not None and ref > high else n
        if last > first and op != "H":
            size, text = size + last - first, f"{text}{last - first}{op}"
            if uses:
                begin, end = read + first if begin is None else begin, read + last
        read, ref = read + n * uses, ref + n * refs
    return begin, end, text, size


def kept_once(cigar: Column, low: Column, high: Column) -> Column:
    """struct<begin, end, text, size> of ``kept_part``, made once a row; null without a CIGAR string."""
    kind = T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("size", T.IntegerType())])

    def run(cigars: pa.Array, lows: pa.Array, highs: pa.Array) -> pa.Array:
        found = [(None,) * 4 if c is None else kept_part(c, a, b) for c, a, b in zip(cigars.to_pylist(), lows.to_pylist(), highs.to_pylist(), strict=True)]
        columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int32()), strict=True)] if found else [pa.array([], t) for t in (pa.int32(), pa.int32(), pa.string(), pa.int32())]
        return pa.StructArray.from_arrays(columns, names=["begin", "end", "text", "size"], mask=cigars.is_null())

    return F.arrow_udf(run, kind).asNondeterministic()(cigar, low, high)


def phred(quality: Column) -> Column:
    """array<int> of a quality string of offset 33."""
    return F.transform(F.filter(F.split(quality, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)


def phred_char(value: Column) -> Column:
    """Quality character of a sum: I above 40, # below 2."""
    return F.when(value > 40, "I").when(value < 2, "#").otherwise(F.char(value + 33))


def shift_quality(quality: Column, by: int = -31) -> Column:
    """A quality string with each character moved, as from offset 64 to offset 33."""
    return F.array_join(F.transform(F.filter(F.split(quality, ""), lambda c: c != ""), lambda c: F.char(F.ascii(c) + by)), "")


def cluster_of(name: Column) -> Column:
    """Read name without the trailing characters / and 1 to 4."""
    return F.rtrim(name, F.lit("/1234"))


def barcode_of(name: Column) -> Column:
    """What follows the last # up to a last dash; empty without one."""
    return F.regexp_extract(name, r"#([^#]*?)(?:-[^-#]*)?$", 1)


def tag_of(name: Column) -> Column:
    """Molecular tag: the leading bases after the last dash behind #."""
    return F.regexp_extract(name, r"#[^#]*-([ATCGN]*)[^-#]*$", 1)


def is_reverse(flag: Column) -> Column:
    return flag.bitwiseAND(16) != 0


def is_single(flag: Column) -> Column:
    return flag.bitwiseAND(1) == 0


def read_number(flag: Column) -> Column:
    return F.when(flag.bitwiseAND(128) != 0, 2).otherwise(1)


def soft_clipped(flag: Column, cigar: Column) -> Column:
    """Single reads: any clip; pairs: one at the arm's side."""
    return (
        F.when(is_single(flag), F.contains(cigar, F.lit("S")))
        .when(flag.isin(163, 99), F.rlike(cigar, F.lit(r"^\d+S")))
        .when(flag.isin(83, 147), F.rlike(cigar, F.lit(r"\d+S$")))
        .otherwise(False)
    )


def disposition(has_barcode: Column, tag_bad: Column, unmapped: Column, off_target: Column, wrong_length: Column, trim_status: Column, clipped: Column | None = None, single: bool = False) -> Column:
    """First case that holds of a read, from the columns flag, rnext, pnext, pos and cigar.

    The order is: skipped, bad tag, discordant (unless all reads are single), improper flag, soft-clipped, unmapped,
    off target, imperfect arms, on target.
    """
    flag = F.col("flag")
    apart = ~is_single(flag) & ((F.col("rnext") != "=") | ((F.col("pnext") != 0) & (F.abs(F.col("pos") - F.col("pnext")) > 1000)))
    return (
        F.when(~has_barcode, "skipped")
        .when(tag_bad, "bad_tag")
        .when(apart & ~F.lit(single), "discordant")
        .when(~flag.isin(0, 16, 147, 99, 83, 163), "improper")
        .when(soft_clipped(flag, F.col("cigar")) if clipped is None else clipped, "soft_clipped")
        .when(unmapped, "unmapped")
        .when(off_target | wrong_length, "off_target")
        .when(trim_status == 1, "improper")
        .when(trim_status == 2, "imperfect_arms")
        .otherwise("on_target")
    )
