"""Tables of vectors as tiles: what the operators on embeddings share.

A tile is one row that holds up to a few thousand vectors of one length as packed arrays. Tiles are
bounded in rows and in bytes, so a task that multiplies two of them has bounded memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a tile, and numbers in it (longer vectors make smaller tiles).
TILE, TILE_NUMBERS = 8192, 1 << 20
#: Pairs of tiles, of some megabytes each, that a Python worker gets at once.
PAIRS_AT_ONCE = 4
#: Largest finite double.
_LARGEST = 1.7976931348623157e308


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    good = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= _LARGEST))
    return vector.isNotNull() & F.coalesce(good, F.lit(False))


def tile_of(place: Column, dims: Column, rows: int = TILE, numbers: int = TILE_NUMBERS) -> Column:
    """Number of the tile of a place."""
    return F.floor(place / F.greatest(F.lit(1), F.least(F.lit(rows), F.floor(F.lit(numbers) / F.greatest(dims, F.lit(1)))))).cast("long")


def matrix(column: pa.ChunkedArray | pa.Array, dims: int, kind: type = np.float64) -> np.ndarray:
    """A column of lists without nulls, all of one length, as rows of a matrix."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in chunks]
    return (np.concatenate(flat) if flat else np.zeros(0)).astype(kind).reshape(len(column), dims)


def facing(tiles: DataFrame, others: DataFrame, after: bool = False) -> DataFrame:
    """(dims, a, b): each tile number of tiles with those of others of its length; ``after``: from its own on.

    Both have dims and tile. Numbers are exploded from the range of each length, one row a pair of tiles.
    """
    range_ = others.groupBy("dims").agg(F.min("tile").alias("low"), F.max("tile").alias("high"))
    low = F.col("tile") if after else F.col("low")
    return tiles.select("dims", "tile").join(F.broadcast(range_), "dims").select("dims", F.col("tile").alias("a"), F.explode(F.sequence(low, F.col("high"))).alias("b"))


def first(df: DataFrame, keys: list[str], order: list[Column], most: int, rank: str = "rank") -> DataFrame:
    """The first rows of each key, with their rank from 1."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, place).filter(F.col(rank) <= most)
