"""Embedding near-duplicates by int8 tile products with error bounds.

Equal vectors are one node with a count of copies. Each node's unit vector is written as scale * code
+ error, code in int8, and the length of the error is kept with it. For two vectors x and y

    |x.y - scale_x * scale_y * code_x.code_y|  <=  error_x + |scale_x * code_x| * error_y,

so a tile product of the codes, whose sums of integers are exact, tells which pairs may reach the
threshold; only these are recomputed in double precision. No link is lost and none is made up.

Nodes are sorted by their nearest pivot (pivots are a bounded sample), so tiles hold near vectors: two
tiles further apart than their radii and the threshold's angle allow aren't multiplied, nor are rows of a
tile that are too far from the other tile's centre. Those are bounds too; how many tiles they spare depends
on the data (none for directions without structure, where the work is the square of the tiles).

A task returns one row per linked vector of its two tiles, the number of its links and the smallest node
that it is linked to through them, never the pairs: a group of near copies costs rows, not its square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import batches_of, numbered, scratch, settle
from .graph import components
from .vectors import PAIRS_AT_ONCE, facing, finite, matrix, tile_of

#: Cosine from which two vectors are linked.
THRESHOLD = 0.95
#: Pivots that order the vectors: a sample by hash of so many distinct vectors. They change no result.
PIVOTS = 64
#: Rows of a tile that are multiplied at once, and pairs that are recomputed at once.
STRIP, PAIRS = 512, 1 << 16
#: Sums of products of int8 numbers below 2 ** 24 are exact in single precision.
EXACT_DIMS = (1 << 24) // (127 * 127)
#: More than all rounding of the estimates in single precision.
SLACK = 4e-6

_PACKED = "dims int, tile long, nodes binary, copies binary, codes binary, scales binary, errors binary, raw binary, centre array<double>, radius double"
_FOUND = "node long, n_links long, root long"


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; largest components first go to 1, so nothing overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes int8, scales, errors) of unit vectors: x = scale * code + a rest no longer than error."""
    scales = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scales[:, None]).astype(np.int8)
    return codes, scales, np.sqrt(((x - scales[:, None] * codes) ** 2).sum(axis=1)) + 1e-12


def _pack(wide: bool):
    kind = np.float64 if wide else np.float32

    def pack(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        dims = key[0].as_py()
        raw = matrix(group["vector"], dims, kind)
        x = unit(raw.astype(np.float64))
        codes, scales, errors = quantised(x)
        centre = x.sum(axis=0)
        length = math.sqrt((centre * centre).sum())
        centre = centre / length if length > 1e-9 else x[0]
        radius = math.acos(min(1.0, max(-1.0, float((x @ centre).min())))) + 1e-6
        arrays = [group["place"].to_numpy().astype(np.int64), group["copies"].to_numpy().astype(np.int64), codes, scales, errors, raw]
        row = [pa.array([dims], pa.int32()), pa.array([key[1].as_py()], pa.int64()), *[pa.array([a.tobytes()], pa.binary()) for a in arrays]]
        return pa.table([*row, pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([radius])], names=["dims", "tile", "nodes", "copies", "codes", "scales", "errors", "raw", "centre", "radius"])

    return pack


class _Side:
    """The vectors of a tile that can be near enough to another tile's centre."""

    def __init__(self, row: dict, tail: str, wide: bool, other: tuple[np.ndarray, float] | None, reach: float):
        dims = row["dims"]
        get = lambda name, kind: np.frombuffer(row[f"{name}_{tail}"], kind)
        self.x = unit(get("raw", np.float64 if wide else np.float32).reshape(-1, dims).astype(np.float64))
        self.nodes, self.copies = get("nodes", np.int64), get("copies", np.int64)
        self.codes, self.scales, self.errors = get("codes", np.int8).reshape(-1, dims), get("scales", np.float64), get("errors", np.float64)
        if other is not None:
            centre, radius = other
            angle = np.arccos(np.clip(self.x @ centre, -1, 1))
            self._keep(angle <= radius + reach + 1e-6)
        self.lengths = self.scales * np.sqrt((self.codes.astype(np.float64) ** 2).sum(axis=1))

    def _keep(self, which: np.ndarray) -> None:
        if not which.all():
            for name in ("x", "nodes", "copies", "codes", "scales", "errors"):
                setattr(self, name, getattr(self, name)[which])


def _products(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Exact products of int8 codes."""
    if one.shape[1] <= EXACT_DIMS:
        return one.astype(np.float32) @ two.astype(np.float32).T
    cuts = range(0, one.shape[1], EXACT_DIMS)
    return sum((one[:, i : i + EXACT_DIMS].astype(np.float32) @ two[:, i : i + EXACT_DIMS].astype(np.float32).T).astype(np.float64) for i in cuts)


def links(one: _Side, two: _Side, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of linked pairs, strip by strip; of one tile with itself only i < j."""
    if not len(one.x) or not len(two.x):
        return
    other, worst = two.codes.astype(np.float32) if one.codes.shape[1] <= EXACT_DIMS else two.codes, two.errors.max()
    scales = two.scales.astype(np.float32)
    for at in range(0, len(one.x), STRIP):
        part = slice(at, min(at + STRIP, len(one.x)))
        product = _products(one.codes[part], other)
        least = (threshold - SLACK - one.errors[part] - one.lengths[part] * worst) / one.scales[part]
        i, j = np.nonzero(product * scales >= least[:, None].astype(np.float32))
        near = product[i, j] * one.scales[part][i] * two.scales[j] + one.errors[part][i] + one.lengths[part][i] * two.errors[j]
        held = (near >= threshold - SLACK) & (~np.bool_(same) | (i + at < j))
        i, j = i[held], j[held]
        if not len(i):
            continue
        if len(i) > product.size // 16:  # most of the strip: one product in double precision
            cosine = (one.x[part] @ two.x.T)[i, j]
        else:
            cuts = range(0, len(i), PAIRS)
            cosine = np.concatenate([np.einsum("ij,ij->i", one.x[part][i[c : c + PAIRS]], two.x[j[c : c + PAIRS]]) for c in cuts])
        linked = cosine >= threshold
        yield i[linked] + at, j[linked]


def _joined(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """labels (each an index of a smaller or the same place) after joining i with j."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(labels, up := labels[labels]):
            labels = up


def _multiply(threshold: float, wide: bool):
    reach = math.acos(min(1.0, max(-1.0, threshold)))

    def of(row: dict) -> pa.RecordBatch:
        same = row["tile_a"] == row["tile_b"]
        bound = lambda t: None if same else (np.array(row[f"centre_{t}"]), row[f"radius_{t}"])
        one = _Side(row, "a", wide, bound("b"), reach)
        two = one if same else _Side(row, "b", wide, bound("a"), reach)
        nodes = one.nodes if same else np.concatenate([one.nodes, two.nodes])
        order = np.argsort(nodes, kind="stable")  # so that the smallest place is the smallest node
        rank = np.empty(len(nodes), np.int64)
        rank[order] = np.arange(len(nodes))
        second = rank if same else rank[len(one.nodes) :]
        labels, counts = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
        for i, j in links(one, two, same, threshold):
            counts += np.bincount(rank[i], two.copies[j], len(nodes)).astype(np.int64)
            counts += np.bincount(second[j], one.copies[i], len(nodes)).astype(np.int64)
            labels = _joined(labels, rank[i], second[j])
        linked, nodes = counts > 0, nodes[order]
        return pa.record_batch([pa.array(nodes[linked]), pa.array(counts[linked]), pa.array(nodes[labels[linked]])], names=["node", "n_links", "root"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield of(batch.slice(k, 1).to_pylist()[0])

    return multiply


def _cells(pivots: list[list[float]]):
    by_dims: dict[int, list[list[float]]] = {}
    for p in pivots:
        by_dims.setdefault(len(p), []).append(p)
    known = {dims: unit(np.array(own, np.float64)) for dims, own in by_dims.items()}

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, flat, at = batch["dims"].to_numpy(), batch["vector"].flatten().to_numpy(zero_copy_only=False), 0
            ends = np.cumsum(lengths)
            cell, near = np.zeros(len(lengths), np.int32), np.zeros(len(lengths))
            for dims in np.unique(lengths):
                if dims in known:
                    rows = np.nonzero(lengths == dims)[0]
                    x = unit(flat[(ends[rows] - dims)[:, None] + np.arange(dims)].astype(np.float64))
                    cosine = x @ known[dims].T
                    cell[rows], near[rows] = cosine.argmax(axis=1), cosine.max(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(near)], names=[*batch.schema.names, "cell", "near"])

    return cells


def nodes_of(rows: DataFrame, wide: bool) -> DataFrame:
    """(place, vector, copies, least, dims): distinct vectors in an order that keeps near ones together."""
    distinct = settle(rows.groupBy("vector").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least")).withColumn("dims", F.size("vector")), "vectors")
    pivots = [r["vector"] for r in distinct.orderBy(F.xxhash64("vector")).limit(PIVOTS).select("vector").collect()]
    kind = "double" if wide else "float"
    placed = distinct.mapInArrow(_cells(pivots), f"vector array<{kind}>, copies long, least {dict(rows.dtypes)['id']}, dims int, cell int, near double")
    return numbered(placed, "dims", "cell", F.desc("near")).drop("cell", "near")


def tiles_of(nodes: DataFrame, wide: bool) -> DataFrame:
    """Nodes packed with codes, scales and errors, one row a tile."""
    tiled = nodes.select("dims", tile_of(F.col("place"), F.col("dims")).alias("tile"), "place", "copies", "vector")
    return settle(tiled.groupBy("dims", "tile").applyInArrow(_pack(wide), _PACKED), "tiles")


def tile_pairs(tiles: DataFrame, threshold: float) -> DataFrame:
    """(dims, a, b) of tiles that can hold a linked pair, a <= b."""
    shape = lambda side: tiles.select("dims", F.col("tile").alias(side), F.col("centre").alias(f"c{side}"), F.col("radius").alias(f"r{side}"))
    both = facing(tiles, tiles, after=True).join(shape("a"), ["dims", "a"]).join(shape("b"), ["dims", "b"])
    cosine = F.aggregate(F.zip_with("ca", "cb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    return both.filter(angle <= F.col("ra") + F.col("rb") + math.acos(min(1.0, max(-1.0, threshold))) + 1e-6).select("dims", "a", "b")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for each row: how many other rows have a cosine of at least the
    threshold with it, and the smallest id that such links lead to, its own included.

    Null and zero vectors and those with a null or non-finite component are linked with nothing; so are vectors
    of different lengths with one another. Equal vectors are linked. Rows that repeat an id are vectors of their own;
    null ids count as links and are never the smallest id, unless no other is there. An empty table gives an
    empty one. Columns other than these two, whatever their names, play no part. The threshold is above 0.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    element = vectors.schema[vector].dataType.elementType
    wide = not isinstance(element, FloatType)
    value = F.col(vector).cast("array<double>") if wide else F.col(vector)
    rows = vectors.select(F.col(id_column).alias("id"), value.alias("vector"))
    usable = finite(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("vector", F.when(usable, F.col("vector")))
    with scratch() as own:
        nodes = nodes_of(rows.filter("vector IS NOT NULL"), wide)
        tiles = tiles_of(nodes, wide)
        pairs = tile_pairs(tiles, threshold)
        side = lambda s: tiles.select("dims", *[F.col(c).alias(f"{c}_{s}") for c in tiles.columns if c != "dims"])
        named = pairs.withColumnsRenamed({"a": "tile_a", "b": "tile_b"})
        both = named.join(side("a"), ["dims", "tile_a"]).join(side("b"), ["dims", "tile_b"])
        with batches_of(vectors.sparkSession, PAIRS_AT_ONCE):
            found = settle(both.mapInArrow(_multiply(threshold, wide), _FOUND), "links")
        counts = found.groupBy("node").agg(F.sum("n_links").alias("n"))
        linked = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
        members = nodes.select(F.col("place").alias("node"), "vector", "copies", "least").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
        members = settle(members.join(counts, "node", "left"), "members")
        least = members.groupBy("component").agg(F.min("least").alias("component_id"))
        judged = own.keep(members.join(least, "component").select("vector", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "judged")
    joined = rows.join(judged, "vector", "left")
    component = F.when(F.col("vector").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return joined.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
