"""Tandem repeats and the masks they make.

A stretch repeats with a period if its bases equal those one period on. For each period the comparison of a
sequence with itself, moved by the period, is a row of matches and mismatches; runs of matches that are long enough
are seeds, and a seed grows over mismatches to its neighbours while the score, a weight for each match less a
penalty for each mismatch, makes it worth it. Stretches that reach the least score, their last copy included,
are repeats.

Sequences are cut into pieces that overlap by more than the longest period and the shortest repeat, so each task
sees a bounded part and no repeat is lost at a border; stretches found in two pieces are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .genome import pieces
from .intervals import merge, overlap_join

#: Weight of a match, penalty of a mismatch, least score, longest period, and matches of a seed.
MATCH, MISMATCH, LEAST, LONGEST_PERIOD, SEED = 2, 7, 50, 500, 5
#: Bases of a stretch that are looked at to tell whether it may be a repeat, and of pieces that are searched at once.
HEAD, AT_ONCE = 24, 1 << 16
#: Bases by which pieces overlap, beyond the longest period.
MARGIN = 512

_CODE = np.full(256, 4, np.uint8)
_CODE[[ord(c) for c in "ACGT"]] = range(4)


def stretches(seq: bytes, longest: int = LONGEST_PERIOD, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(first, last, period) of every repeat of a sequence, 0-based and closed; N and other letters never match.

    A seed is where a word of as many bases as a seed has equals the word one period on, so one comparison of words a
    period finds all of them. Only seeds whose first bases already match well enough, and those near before them,
    which may have grown over them, are followed base by base.
    """
    codes = _CODE[np.frombuffer(seq, np.uint8)]
    if len(codes) < 2:
        return []
    ahead, behind = np.where(codes > 3, 4, codes), np.where(codes > 3, 5, codes)  # no unknown letter equals another
    words = {n: _words(codes, n) for n in {min(SEED, p) for p in range(1, longest + 1)} if n < len(codes)}
    out = []
    for period in range(1, min(longest, len(codes) - 1) + 1):
        size = min(SEED, period)
        if size not in words or len(codes) < period + size:
            continue
        here, there = words[size]
        found = np.flatnonzero(here[:-period] == there[period:])
        if not len(found):
            continue
        first = found[np.concatenate([[True], np.diff(found) > 1])]  # seeds are runs of equal words
        # a repeat has at least so many matches and mismatches, and more than half of its worth after each base
        head = min(HEAD, max(period, -(-(least - MATCH * period) // MATCH)))
        n = len(codes) - period
        open_ = first[first + head <= n]
        if not len(open_):
            continue
        same = ahead[:-period] == behind[period:]
        matches = same[open_[:, None] + np.arange(head)].sum(axis=1)
        likely = np.zeros(len(first), bool)
        likely[: len(open_)] = MATCH * matches > MISMATCH * (head - matches)
        if not likely.any():
            continue
        near = np.cumsum(np.concatenate([[0], np.diff(first) >= head]))  # a seed that isn't likely ends before the next group
        wanted = np.zeros(near[-1] + 1, bool)
        wanted[near[likely]] = True
        out += [(a, b + period, period) for a, b in _followed(same, first, near, wanted, period, least)]
    return out


def _words(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of every word of a size, twice: with numbers of their own, in which they differ, for words with
    another letter."""
    word, odd = np.zeros(len(codes) - size + 1, np.uint16), np.zeros(len(codes) - size + 1, bool)
    for i in range(size):
        part = codes[i : len(codes) - size + 1 + i]
        word = word * np.uint16(4) + (part & 3)
        odd |= part > 3
    return np.where(odd, np.uint16(65535), word), np.where(odd, np.uint16(65534), word)


def _followed(same: np.ndarray, seeds: np.ndarray, near: np.ndarray, wanted: np.ndarray, period: int, least: int) -> Iterator[tuple[int, int]]:
    """Runs of matches joined over mismatches where that raises the score, from a seed on, in the wanted groups of
    seeds; a stretch holds at least one whole period of matches and mismatches; a stretch that is open at a group's end goes on."""
    text, groups = same.tobytes(), np.flatnonzero(wanted)
    begins = seeds[np.searchsorted(near, groups)].tolist()
    ends = np.append(seeds, len(text))[np.searchsorted(near, groups, "right")].tolist()
    at = 0
    for begin, end in zip(begins, ends, strict=True):
        if begin < at:
            begin = at
        if begin >= end:
            continue
        at = yield from _grown_from(text, begin, end, period, least)


def _grown_from(text: bytes, begin: int, end: int, period: int, least: int) -> Iterator[tuple[int, int]]:
    """Stretches of the runs of matches (bytes of 1) that begin before end, and of what an open one adds to them; the
    place of the first run that isn't taken is returned."""
    seed, open_, reach, best, score, last = min(SEED, period), None, 0, 0, 0, 0
    a = text.find(b"\1", begin)
    while a >= 0 and (a < end or open_ is not None):
        b = text.find(b"\0", a) - 1
        if b < 0:
            b = len(text) - 1
        gain = MATCH * (b - a + 1)
        if open_ is not None and score > MISMATCH * (a - reach - 1):
            score += gain - MISMATCH * (a - reach - 1)
        else:
            if open_ is not None and best + MATCH * period >= least and last - open_ + 1 >= period:
                yield open_, last
            open_ = None
            if a >= end:
                return a
            if b - a + 1 >= seed:
                open_, score, best = a, gain, 0
        reach = b
        if open_ is not None and score > best:
            best, last = score, b
        a = text.find(b"\1", b + 1)
    if open_ is not None and best + MATCH * period >= least and last - open_ + 1 >= period:
        yield open_, last
    return len(text) if a < 0 else a


def tandem_repeats(sequences: DataFrame, longest: int = LONGEST_PERIOD, least: int = LEAST, keys: tuple[str, ...] = ("chr",)) -> DataFrame:
    """(keys, start, stop): merged stretches of tandem repeats, 1-based and closed. Sequences are upper-case ASCII.

    Sequences shorter than two bases, and empty tables, have none.
    """
    kinds = dict(sequences.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "start long", "stop long"])
    short = sequences.filter(F.length("seq") <= longest + MARGIN).select(*keys, F.lit(1).alias("first"), F.col("seq").alias("piece"))
    parts = pieces(sequences, longest + MARGIN + 1, "seq", keys).unionByName(short)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, stops = [], [], []
            firsts, pieces_ = batch["first"].to_pylist(), [(x or "").encode() for x in batch["piece"].to_pylist()]
            # so many unknown letters behind each that no score lasts to the next and no period reaches it
            own = [x + b"N" * max(longest, MATCH * len(x) // MISMATCH + 1) for x in pieces_]
            ends = np.cumsum([0, *map(len, own)])
            for k in np.unique(ends[:-1] // AT_ONCE):
                at = np.flatnonzero(ends[:-1] // AT_ONCE == k)
                begins = ends[at] - ends[at[0]]
                for a, b, _ in stretches(b"".join(own[at[0] : at[-1] + 1]), longest, least):
                    i = int(np.searchsorted(begins, a, "right")) - 1
                    rows.append(int(at[i]))
                    starts.append(firsts[at[i]] + a - int(begins[i]))
                    stops.append(firsts[at[i]] + b - int(begins[i]))
            yield pa.RecordBatch.from_arrays([*[batch[k].take(pa.array(rows, pa.int64())) for k in keys], pa.array(starts, pa.int64()), pa.array(stops, pa.int64())], names=[*keys, "start", "stop"])

    return merge(parts.mapInArrow(find, schema), list(keys), gap=1, width=1 << 20).drop("n_merged")


def with_mask(features: DataFrame, repeats: DataFrame, width: int = 4096) -> DataFrame:
    """features with masked_seq: their seq with N for the bases of repeats (chr, start, stop) of their chromosome.

    Features without repeats keep their sequence; feature_id tells them apart. A feature's repeats are gathered in
    one row, no more than its own length holds.
    """
    spans = features.filter("seq_start <= seq_stop").select("feature_id", "chr", F.col("seq_start").cast("long").alias("fs"), F.col("seq_stop").cast("long").alias("fe"))
    hits = overlap_join(spans, repeats.select("chr", F.col("start").alias("rs"), F.col("stop").alias("re")), ["chr"], width, ("fs", "fe", "rs", "re"))
    bound = F.struct((F.greatest("fs", "rs") - F.col("fs") + 1).cast("int").alias("at"), (F.least("fe", "re") - F.greatest("fs", "rs") + 1).cast("int").alias("n"))
    own = hits.groupBy(F.col("feature_id").alias("__id")).agg(F.collect_list(bound).alias("__masks"))
    covered: Column = F.aggregate("__masks", F.col("seq"), lambda s, m: F.overlay(s, F.repeat(F.lit("N"), m["n"]), m["at"], m["n"]))
    joined = features.join(own, F.col("feature_id") == F.col("__id"), "left")
    return joined.withColumn("masked_seq", F.when(F.col("__masks").isNull(), F.col("seq")).otherwise(covered)).drop("__id", "__masks")
