"""Importance resampling towards a target distribution by bit-sliced aggregation.

Features of a text are its runs of words, hashed to buckets. A bucket's gain is the logarithm of how much
more frequent it is in the target than in the documents, rounded to an integer. A document's weight
is the mean gain of its features, found from bit planes: plane j of a document has a bit for each bucket
whose count has bit j, plane k of the gains one for each bucket whose gain, in two's complement, has bit k.

    sum of gains = sum over j, k of 2^j * (2^k, or -2^k for the sign plane) * popcount(plane_j AND gain_k)

so a document of any length costs a few ANDs of 10,000 bits, and sums are exact. Documents are drawn by
Gumbel's rule: weight plus noise hashed from the id, highest first.

Counts of buckets are added up in tasks first: a task hands on one row a bucket at most. The gains, one
number a bucket, are all that goes to every task.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, pieces, scratch, settle

#: Buckets of features, the longest run of words, and units of a gain.
BUCKETS, LONGEST, UNITS = 10_000, 1, 1000
#: Documents with fewer words aren't drawn; share of the others that is, in per cent; seed of the noise.
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: Bytes of a text that are split at once, and words whose bucket is remembered.
BLOCK, REMEMBERED = 1 << 20, 1 << 17

# A word is a run of digits, letters and characters beyond ASCII; A-Z are lower-cased.
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Buckets(dict):
    """Bucket of a feature: the CRC-32 of its bytes, modulo their number."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = zlib.crc32(feature) % self.buckets
        if len(feature) < 64:
            self[feature] = found
        return found


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists of bounded size; a block ends where a word ends."""
    at = 0
    while at < len(text):
        block, stop = text[at : at + BLOCK].translate(_CLEAN), at + BLOCK
        if stop < len(text):
            cut = block.rfind(b" ")
            while cut < 0 and stop < len(text):  # a word longer than a block
                more = text[stop : stop + BLOCK].translate(_CLEAN)
                cut, block, stop = more.rfind(b" ") + len(block) if b" " in more else -1, block + more, stop + len(more)
            if cut >= 0:
                block, stop = block[:cut], stop - (len(block) - cut)
        at = stop
        if words := block.split():
            yield words


def counts_of(text: bytes, buckets: Buckets, longest: int) -> tuple[np.ndarray, int]:
    """(count of each bucket, number of words) of a text."""
    counts, n_words, tail = np.zeros(buckets.buckets, np.int64), 0, []
    for words in words_of(text):
        n_words += len(words)
        ids = [np.fromiter(map(buckets.__getitem__, words), np.int64, len(words))]
        joined, before = tail + words, len(tail)
        for n in range(2, longest + 1):  # runs that end in this block
            runs = [b" ".join(joined[i - n : i]) for i in range(max(n, before + 1), len(joined) + 1)]
            ids.append(np.fromiter(map(buckets.__getitem__, runs), np.int64, len(runs)))
        tail = joined[max(0, len(joined) - longest + 1) :] if longest > 1 else []
        counts += np.bincount(np.concatenate(ids), minlength=buckets.buckets)
    return counts, n_words


def planes_of(values: np.ndarray, bits: int) -> np.ndarray:
    """(bits, words of 64): plane k has the bits k of all values, in two's complement."""
    planes = np.packbits(((values >> np.arange(bits)[:, None]) & 1).astype(np.uint8), axis=1)
    return np.pad(planes, ((0, 0), (0, -planes.shape[1] % 8))).view(np.uint64)


def signed_planes(gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Planes of gains and what a bit of each is worth; the last is the sign plane."""
    bits = int(max(gains.max(initial=0), -gains.min(initial=0) - 1, 1)).bit_length() + 1
    worth = np.left_shift(1, np.arange(bits))
    worth[-1] *= -1
    return planes_of(gains, bits), worth


def gain_sum(counts: np.ndarray, planes: np.ndarray, worth: np.ndarray) -> int:
    """Sum of gains over a document's features."""
    bits = int(counts.max(initial=0)).bit_length()
    if not bits:
        return 0
    if bits < 16:  # only the buckets that occur are spread over the planes
        used = np.nonzero(counts)[0]
        spread = np.zeros((bits, len(counts)), np.uint8)
        spread[:, used] = (counts[used] >> np.arange(bits)[:, None]) & 1
        own = np.packbits(spread, axis=1)
        own = np.pad(own, ((0, 0), (0, -own.shape[1] % 8))).view(np.uint64)
    else:
        own = planes_of(counts, bits)
    ones = np.bitwise_count(own[:, None, :] & planes[None, :, :]).sum(axis=2, dtype=np.int64)
    return sum(int(w) << j for j, w in enumerate((ones * worth).sum(axis=1)))


def noise(seed: int, key: str) -> int:
    """Gumbel noise hashed from an id, in units."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-UNITS * math.log(-math.log((h + 0.5) / 4294967296)))


def _counting(buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for _, texts in pieces(batches, "text"):
            for text in texts:
                total += counts_of(text or b"", known, longest)[0]
        used = np.nonzero(total)[0]
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    return run


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n) over all features of all texts."""
    read = docs.select(F.col(text).cast("binary").alias("text"))
    return read.mapInArrow(_counting(buckets, longest), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Gain of every bucket, from counts over all documents and all of the target.

    Both counts start from one a bucket, so empty tables have a gain too. The driver gets one row a bucket.
    """
    both = [np.zeros(buckets, np.int64) for _ in range(2)]
    for counts, (df, column) in zip(both, ((docs, text), (target, target_text)), strict=True):
        for row in bucket_counts(df, column, buckets, longest).collect():
            counts[row["bucket"]] = row["n"]
    (s, t), (S, T) = both, (int(c.sum()) for c in both)
    return np.array([math.floor(UNITS * math.log(float((b + 1) * (S + buckets)) / float((a + 1) * (T + buckets)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def _weighing(found: np.ndarray, longest: int, seed: int):
    planes, worth = signed_planes(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(len(found))
        for part, texts in pieces(batches, "text"):
            rows = []
            for text, key in zip(texts, part.column("key").to_pylist(), strict=True):
                counts, n_words = counts_of(text or b"", known, longest)
                n = int(counts.sum())
                weight = gain_sum(counts, planes, worth) // n if n else 0
                rows.append((n_words, n, weight, weight + noise(seed, key)))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(part.num_columns - 2)], *columns], names=[*part.schema.names[:-2], "n_words", "n_features", "weight", "score"])

    return run


def weights(docs: DataFrame, found: np.ndarray, key: Column | str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",), longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """keep's columns with n_words, n_features, weight and score of each row. Narrow: no shuffle.

    Null texts have no features, texts without any a weight of 0; null keys hash as "null"; rows that repeat a
    key and text are alike.
    """
    value = F.col(key) if isinstance(key, str) else key
    read = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.coalesce(value.cast("string"), F.lit("null")).alias("key"), F.col(text).cast("binary").alias("text"))
    kinds = dict(docs.dtypes)
    schema = ", ".join([*[f"c{i} {kinds[c]}" for i, c in enumerate(keep)], *[f"{c} long" for c in ("n_words", "n_features", "weight", "score")]])
    return read.mapInArrow(_weighing(found, longest, seed), schema).toDF(*keep, "n_words", "n_features", "weight", "score")


def drawn(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(id, n_features, weight, score, rank) for each document; rank from 1 for those drawn, else null.

    Of the documents with at least ``least_words`` words the given share (rounded down) with the highest scores is
    drawn; ties go to the smaller id, null ids last. A range sort places all rows, so no task holds more than its
    share. An empty table gives an empty one; other columns play no part.
    """
    with scratch() as own:
        scored = weights(docs, gains(docs, target, text, target_text, buckets, longest), id_column, text, (id_column,), longest, seed)
        scored = scored.withColumn("__short", F.col("n_words") < least_words)
        placed = own.keep(numbered(scored, "__short", F.desc("score"), F.col(id_column).asc_nulls_last()), "placed")
    most = placed.filter("NOT __short").count() * percent // 100
    rank = F.when(~F.col("__short") & (F.col("place") < most), F.col("place") + 1)
    return placed.select(id_column, "n_features", "weight", "score", rank.cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """The documents drawn, with all their columns; rows that repeat an id are told apart by number."""
    rows = settle(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    return _resampled(rows, target, id_column, **options).drop("__row")


def _resampled(rows: DataFrame, target: DataFrame, id_column: str, text: str = "text", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    with scratch() as own:
        scored = weights(rows, gains(rows, target, text, target_text, buckets, longest), id_column, text, (id_column, "__row"), longest, seed).filter(F.col("n_words") >= least_words)
        placed = own.keep(numbered(scored, F.desc("score"), F.col(id_column).asc_nulls_last(), "__row").select("place", F.col("__row").alias("__drawn")), "placed")
    chosen = placed.filter(F.col("place") < placed.count() * percent // 100)
    return rows.join(chosen, F.col("__row") == F.col("__drawn"), "left_semi")
