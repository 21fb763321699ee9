"""Hard-negative mining with Four-Russians scoring.

Vectors are scored by exact integer inner products of their components, rounded down to steps. For
each anchor and each group of eight dimensions a table holds the sums of all 256 subsets of its eight
components. A candidate is packed as bit planes of its components in two's complement: byte (k, g) has bit
k of the eight components of group g, and indexes group g's table. A plane's lookups are added, planes are
added with a shift from the sign plane down, and the total is the full score; nothing is estimated.

Anchors (a stated query set) and rows meet in blocks: a packed block of anchors, whose tables are built in the
task, and a packed tile of rows. The first pass keeps each anchor's first rows of its own label in a tile,
merged over tiles to its positives; the second keeps, for each anchor and positive, the first rows of another
label in the positive's range of scores. A task returns no more than ``most`` rows for each of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, numbered, scratch, settle
from .vectors import PAIRS_AT_ONCE, facing, finite, first, matrix, tile_of

#: Steps of one unit of a component.
STEPS = 256
#: Positives of an anchor, and negatives of an anchor and positive.
POSITIVES, NEGATIVES = 5, 5
#: A negative's score is between this share of the positive's and the positive's, in per cent.
LEAST_PERCENT = 80
#: Anchors of a block.
BLOCK = 256
#: Components are below this, so that scores of up to 2 ** 11 dimensions fit a long.
LARGEST = 1 << 26
#: Rows and anchors that are scored at once: sums and one table stay in the cache.
ROWS, ANCHORS = 2048, 64

_TILE = "dims int, tile long, places binary, ids binary, labels binary, planes binary, bits int"
_ANCHORS = "dims int, block long, places binary, ids binary, labels binary, components binary, scores binary"
_POSITIVE = "anchor long, anchor_id long, positive long, positive_id long, positive_score long"
_NEGATIVE = f"{_POSITIVE}, negative long, negative_id long, negative_score long"
_NONE = np.iinfo(np.int64).min


# -- scoring


def planes_of(components: np.ndarray) -> np.ndarray:
    """(n, planes, groups) bytes: bits of integers in two's complement, the sign plane last."""
    n, dims = components.shape
    largest = int(max(components.max(initial=0), -components.min(initial=0) - 1))
    bits = largest.bit_length() + 1
    padded = np.zeros((n, -(-dims // 8) * 8), np.int64)
    padded[:, :dims] = components
    planes = (padded[:, None, :] >> np.arange(bits)[:, None]) & 1
    return np.packbits(planes.astype(np.uint8), axis=2, bitorder="little")


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): for each group of eight dimensions the sums of every subset, built by doubling."""
    n, dims = anchors.shape
    padded = np.zeros((-(-dims // 8) * 8, n), anchors.dtype)
    padded[:dims] = anchors.T
    tables = np.zeros((len(padded) // 8, 256, n), anchors.dtype)
    for bit in range(8):
        tables[:, 1 << bit : 2 << bit] = tables[:, : 1 << bit] + padded[bit::8, None, :]
    return tables


def scores(anchors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, anchors): inner products by lookups of plane bytes in the anchors' tables."""
    n, bits, groups = planes.shape
    out = np.zeros((n, len(anchors)), np.int64)
    most = int(np.abs(anchors).sum(axis=1).max(initial=0)) << bits
    kind = np.int32 if most < 1 << 31 else np.int64
    for a in range(0, len(anchors), ANCHORS):
        tables = subset_sums(anchors[a : a + ANCHORS].astype(kind))
        for r in range(0, n, ROWS):
            part = planes[r : r + ROWS]
            total, looked = np.zeros((len(part), tables.shape[2]), kind), np.empty((len(part), tables.shape[2]), kind)
            for k in range(bits - 1, -1, -1):
                total <<= 1
                for g in range(groups):
                    np.take(tables[g], part[:, k, g], axis=0, out=looked, mode="clip")
                    if k == bits - 1:
                        total -= looked
                    else:
                        total += looked
            out[r : r + ROWS, a : a + ANCHORS] = total
    return out


def _firsts(score: np.ndarray, ids: np.ndarray, places: np.ndarray, most: int) -> np.ndarray:
    """Indexes of the first rows: higher scores first, then smaller ids, then places."""
    if len(score) > 4 * most:  # only scores that reach the last one's can be among them
        few = np.nonzero(score >= np.partition(score, len(score) - most)[len(score) - most])[0]
    else:
        few = np.arange(len(score))
    return few[np.lexsort((places[few], ids[few], -score[few]))[:most]]


# -- packing


def _longs(group: pa.Table, name: str) -> np.ndarray:
    return group[name].to_numpy().astype(np.int64)


def _row(key: tuple[pa.Scalar, ...], names: list[str], arrays: list[np.ndarray], **more) -> pa.Table:
    cells = [pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), *[pa.array([a.tobytes()], pa.binary()) for a in arrays]]
    return pa.table([*cells, *more.values()], names=[*names, *more])


def _pack_rows(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    planes = planes_of(matrix(group["components"], key[0].as_py(), np.int64))
    arrays = [_longs(group, "place"), _longs(group, "id"), _longs(group, "label"), planes]
    return _row(key, ["dims", "tile", "places", "ids", "labels", "planes"], arrays, bits=pa.array([planes.shape[1]], pa.int32()))


def _pack_anchors(most: int):
    def pack(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        positives = np.full((group.num_rows, most, 3), _NONE)
        for i, own in enumerate(group["positives"].to_pylist()):
            for k, p in enumerate(own or ()):
                positives[i, k] = p["positive"], p["positive_id"], p["positive_score"]
        arrays = [_longs(group, "place"), _longs(group, "id"), _longs(group, "label"), matrix(group["components"], key[0].as_py(), np.int64), positives]
        return _row(key, ["dims", "block", "places", "ids", "labels", "components", "scores"], arrays)

    return pack


# -- the two passes


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Anchors and rows of one pair of packed rows, and their scores (anchors, rows)."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            get = lambda name: np.frombuffer(row[name], np.int64)  # noqa: B023, E731
            n = len(get("places"))
            planes = np.frombuffer(row["planes"], np.uint8).reshape(n, row["bits"], -(-row["dims"] // 8))
            anchors = get("a_components").reshape(len(get("a_places")), row["dims"])
            yield get, scores(anchors, planes).T


def _batch(schema: str, columns: list[list]) -> pa.RecordBatch:
    names = [part.split()[0] for part in schema.split(", ")]
    return pa.record_batch([pa.array(np.concatenate(c) if c else np.zeros(0), pa.int64()) for c in columns], names=names)


def _positives(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for get, score in _opened(batches):
            places, ids, labels, columns = get("places"), get("ids"), get("labels"), [[] for _ in range(5)]
            for i, (place, anchor, label) in enumerate(zip(get("a_places"), get("a_ids"), get("a_labels"), strict=True)):
                own = np.nonzero((labels == label) & (places != place))[0]
                best = own[_firsts(score[i][own], ids[own], places[own], most)]
                for column, values in zip(columns, (np.full(len(best), place), np.full(len(best), anchor), places[best], ids[best], score[i][best]), strict=True):
                    column.append(values)
            yield _batch(_POSITIVE, columns)

    return run


def _negatives(most: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for get, score in _opened(batches):
            places, ids, labels, columns = get("places"), get("ids"), get("labels"), [[] for _ in range(8)]
            positives = get("a_scores").reshape(len(get("a_places")), -1, 3)
            for i, (place, anchor, label) in enumerate(zip(get("a_places"), get("a_ids"), get("a_labels"), strict=True)):
                known = positives[i][positives[i][:, 0] != _NONE]
                known = known[known[:, 2] >= 0]  # below 0 the range is empty
                if not len(known):
                    continue
                least = -(-percent * known[:, 2] // 100)
                held = np.nonzero((labels != label) & (score[i] >= least.min()) & (score[i] <= known[:, 2].max()))[0]
                for (positive, positive_id, upper), lower in zip(known, least, strict=True):
                    own = held[(score[i][held] >= lower) & (score[i][held] <= upper)]
                    best = own[_firsts(score[i][own], ids[own], places[own], most)]
                    for column, values in zip(columns, (place, anchor, positive, positive_id, upper), strict=False):
                        column.append(np.full(len(best), values))
                    for column, values in zip(columns[5:], (places[best], ids[best], score[i][best]), strict=True):
                        column.append(values)
            yield _batch(_NEGATIVE, columns)

    return run


def rows_of(vectors: DataFrame, id_column: str, vector: str, label: str | Column, steps: int) -> DataFrame:
    """(place, id, label, dims, components) of the rows that take part."""
    value = F.transform(vector, lambda x: F.floor(steps * x.cast("double")))
    bounded = F.forall(vector, lambda x: F.abs(steps * x.cast("double")) < LARGEST)
    named = vectors.filter(finite(F.col(vector)) & bounded).select(F.col(id_column).cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), F.size(vector).alias("dims"), value.alias("components"))
    return numbered(named.filter("id IS NOT NULL AND label IS NOT NULL"), "dims", "id")


def mine(vectors: DataFrame, anchors: Column, id_column: str = "vec_id", vector: str = "embedding", label: str | Column = "label", n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, percent: int = LEAST_PERCENT, steps: int = STEPS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchors is a condition on id, label and dims that tells the anchors among the rows. Rows with a null id or
    label, a null vector, a null or non-finite component, or one that isn't below LARGEST when rounded take no part.
    Vectors are scored against anchors of their own length only. Rows that repeat an id are rows of their own: each
    may be an anchor, a positive of the other, or a negative. Equal scores go by smaller id. Ranges of positives
    with a negative score are empty. An empty table gives an empty one; other columns play no part.
    """
    with scratch() as own:
        rows = rows_of(vectors, id_column, vector, label, steps)
        tiles = settle(rows.withColumn("tile", tile_of(F.col("place"), F.col("dims"))).groupBy("dims", "tile").applyInArrow(_pack_rows, _TILE), "tiles")
        asked = rows.filter(anchors).withColumn("row", F.col("place")).drop("place")
        asked = numbered(asked, "dims", "row").withColumn("block", F.floor(F.col("place") / BLOCK).cast("long")).drop("place").withColumnRenamed("row", "place")
        asked = settle(asked, "anchors")

        def against(anchored: DataFrame) -> DataFrame:
            """Every packed block of anchors with every packed tile of its length."""
            blocks = settle(anchored.groupBy("dims", "block").applyInArrow(_pack_anchors(n_positives), _ANCHORS), "blocks")
            named = blocks.select("dims", F.col("block").alias("a"), *[F.col(c).alias(f"a_{c}") for c in blocks.columns[2:]])
            pairs = facing(blocks.withColumnRenamed("block", "tile"), tiles)
            return pairs.join(named, ["dims", "a"]).join(tiles.withColumnRenamed("tile", "b"), ["dims", "b"])

        none = F.array().cast("array<struct<positive:bigint,positive_id:bigint,positive_score:bigint>>")
        with batches_of(vectors.sparkSession, PAIRS_AT_ONCE):
            found = settle(against(asked.withColumn("positives", none)).mapInArrow(_positives(n_positives), _POSITIVE), "found")
        kept = first(found, ["anchor"], [F.desc("positive_score"), F.col("positive_id"), F.col("positive")], n_positives)
        per = kept.groupBy(F.col("anchor").alias("place")).agg(F.collect_list(F.struct("positive", "positive_id", "positive_score")).alias("positives"))
        with batches_of(vectors.sparkSession, PAIRS_AT_ONCE):
            found = own.keep(against(asked.join(per, "place")).mapInArrow(_negatives(n_negatives, percent), _NEGATIVE), "negatives")
    kept = first(found, ["anchor", "positive"], [F.desc("negative_score"), F.col("negative_id"), F.col("negative")], n_negatives)
    return kept.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
