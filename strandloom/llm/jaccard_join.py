"""N-gram Jaccard join by parity sketches.

A document is the set of hashes of its distinct word shingles. Sketches are made of it by XOR, so what
two sets have in common cancels out and only the elements in which they differ count:

* a block sketch per size band deals each element to one of k blocks and XORs it into that block. Two sets
  that differ in at most D elements differ in at most D blocks, so with k = D + 1 + s blocks at
  least s + 1 are equal in both (pigeonhole). Nodes meet in buckets of equal blocks. Each node may
  leave out its s most frequent blocks: with all blocks in one order, the rarest of the s + 1 that two
  similar sets share is left out by neither. What strangers share (a passage, a common line) are few
  and frequent blocks, so most strangers meet nowhere;
* a bit sketch flips one bit for each element. The Hamming distance of two bit sketches is at most the
  number of elements in which the sets differ, so pairs above the bound are no links, and only the
  others are verified on the exact sets.

A band takes the sizes between its borders and those that can be similar to them, so any two similar
sets share a band. Documents with equal sets are one node from the start. In each bucket nodes are
compared with its smallest node; those that aren't in its component are compared with one another only
if they share rare differences from it, which two similar sets must. No link is lost, and a group of
thousands of near copies takes about as many comparisons as it has members, not its square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, discard, pieces, scratch, settle, small
from .graph import components

#: Ratio between the borders of size bands.
BAND = 1.25
#: Share of a sketch's blocks, above those that may be empty, that a set leaves out.
SPARE = 0.1
#: How often a sketch is refined under an empty block, which by itself would bring strangers together.
LEVELS = 4
#: Ids are broadcast up to this number; beyond it they are joined by a shuffle.
MOST_BROADCAST = 500_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Low bits of a signature that name its sketch among those of a set; the last name is for signatures
#: that are never left out. Sets take part in far fewer neighbouring bands.
NAMES = 16


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of 64-bit numbers (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x + _ODD * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text, its words lower-cased (A-Z only).

    Words are runs without ASCII white space. A text of fewer words than a shingle is one shingle;
    null texts and texts without words give an empty set.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(words))
    rows = len(words) - n + 1
    with np.errstate(over="ignore"):
        joined = np.full(rows, n, np.uint64)
        for i in range(n):
            joined = _mixed(joined, 1) + hashes[i : i + rows]
    return np.unique(_mixed(joined, 2))


class Bands:
    """Sketch shapes by set size, for pairs of a similarity of at least percent / 100."""

    def __init__(self, percent: int):
        self.percent = percent
        self.similarity = percent / 100
        #: Pairs of equal sizes n differ at most in 2n (1-t)/(1+t) elements; below this size in none.
        self.least = max(1, math.floor(self.similarity * (1 + self.similarity) / (2 * (1 - self.similarity))) if percent < 100 else 1 << 62)

    def border(self, band: int) -> int:
        return round(self.least * BAND**band)

    def most(self, band: int) -> int:
        """Largest set of a band: one that can be similar to the largest below the border."""
        return (self.border(band + 1) - 1) * 100 // self.percent

    def blocks(self, band: int) -> tuple[int, int]:
        """Blocks of the sketches of a band, and how many of them each set leaves out.

        The latter are enough for the blocks that stay empty (which are the most frequent of all and go
        first), and for a tenth of the blocks besides.
        """
        smaller = self.border(band + 1) - 1
        least = (smaller + self.most(band)) * (100 - self.percent) // (100 + self.percent) + 1
        if least == 1:
            return 1, 0
        empty = least * math.exp(-self.border(band) / (1.2 * least))
        return least + (spare := math.ceil(1.2 * empty + 2 * math.sqrt(empty) + SPARE * least)), spare

    def shapes(self, n: int) -> list[tuple[int, tuple[int, int]]]:
        """(band, its blocks) of the bands that a set of n elements takes part in.

        A band is for pairs whose smaller set lies between its borders, so it also takes larger sets
        that can be similar to those.
        """
        if n < self.least:
            return []
        band = 0
        while self.border(band + 1) <= n:
            band += 1
        return [(b, self.blocks(b)) for b in range(band, -1, -1) if n <= self.most(b)]


def signatures(elements: np.ndarray, bands: Bands) -> tuple[dict[int, int], np.ndarray]:
    """How many of the most frequent signatures of each sketch may be left out, by the sketch's name, and a
    64-bit signature with that name for each block. Empty blocks have none; where more of them are
    empty than may be left out, each is told apart by a sketch of the whole set under its name."""
    out: list[np.ndarray] = []
    spares: dict[int, int] = {}

    def named(signature: np.ndarray, name: int) -> np.ndarray:
        return (signature & ~np.uint64(NAMES - 1)) | np.uint64(name)

    def sketch(shape: int, blocks: int, spare: int, tag: int, level: int) -> None:
        block = (_mixed(elements, 11 + 7 * level + 131 * shape) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        dealt = block[order]
        starts = np.flatnonzero(np.diff(dealt, prepend=-1))
        sums = np.bitwise_xor.reduceat(elements[order], starts)
        filled = dealt[starts]
        key = np.uint64(tag) + filled.astype(np.uint64) + np.uint64(shape << 40)
        with np.errstate(over="ignore"):
            name = shape % (NAMES - 1) if not level else NAMES - 1
            out.append(named(_mixed(_mixed(key, 3 + level) ^ sums, 5), name))
        if not level:
            spares[name] = max(0, spare - blocks + len(filled))
        for empty in set(range(blocks)).difference(filled.tolist()) if len(filled) < blocks - spare else ():
            under = int(_mixed(np.array([tag + empty + (shape << 40)], np.uint64), 77 + level)[0]) >> 8
            if level + 1 < LEVELS:
                sketch(shape, blocks, spare, under, level + 1)
            else:
                out.append(named(_mixed(np.array([under], np.uint64), 6), NAMES - 1))

    for shape, (blocks, spare) in bands.shapes(len(elements)):
        sketch(shape, blocks, spare, 0, 0)
    return spares, np.concatenate(out) if out else np.zeros(0, np.uint64)


def parity_bits(elements: np.ndarray) -> np.ndarray:
    """The bit sketch of a set as 64-bit words: as many bits as a power of two not below its size.

    Halves of a sketch XORed are the sketch of half as many bits, so any two can be compared.
    """
    bits = max(64, 1 << (max(1, len(elements)) - 1).bit_length())
    place = (_mixed(elements, 31) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def hamming(one: Column, two: Column) -> Column:
    """Hamming distance of two bit sketches of which one has at most twice the words of the other."""
    words = F.least(F.size(one), F.size(two))
    xor = lambda x, y: x.bitwiseXOR(y)
    folded = lambda x: F.when(F.size(x) > words, F.zip_with(F.slice(x, 1, words), F.slice(x, words + 1, words), xor)).otherwise(x)
    return F.aggregate(F.zip_with(folded(one), folded(two), lambda x, y: F.bit_count(xor(x, y))), F.lit(0), lambda total, n: total + n)


def _set_hash(elements: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return tuple(int(_mixed(elements, s).sum(dtype=np.uint64).astype(np.int64)) for s in (21, 22))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64), pa.int64()))


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(row, n, items): the shingle sets of (row, fa, fb, text) whose hashes are fa and fb."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in pieces(batches, "text"):
            own = zip(rows.column("row").to_pylist(), rows.column("fa").to_pylist(), rows.column("fb").to_pylist(), (shingle_set(x, size) for x in texts))
            found = [(row, items) for row, fa, fb, items in own if _set_hash(items) == (fa, fb)]
            yield pa.RecordBatch.from_arrays([pa.array([row for row, _ in found], pa.int64()), pa.array([len(x) for _, x in found], pa.int64()), _lists([x for _, x in found])], names=["row", "n", "items"])

    return docs.select("row", "fa", "fb", "text").mapInArrow(run, "row long, n long, items array<long>")


def _sketches(docs: DataFrame, size: int, bands: Bands) -> DataFrame:
    """(doc_id, n, fa, fb, bits, spares, signatures): two hashes of the set, its bit sketch, what each of
    its block sketches may leave out, and their signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in pieces(batches, "text"):
            sets = [shingle_set(x, size) for x in texts]
            hashes = np.array([_set_hash(s) for s in sets], np.int64).reshape(-1, 2)
            made = [signatures(s, bands) for s in sets]
            offsets = np.cumsum([0] + [len(spares) for spares, _ in made], dtype=np.int32)
            columns = [
                rows.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(hashes[:, 0]),
                pa.array(hashes[:, 1]),
                _lists([parity_bits(s) for s in sets]),
                pa.MapArray.from_arrays(pa.array(offsets), pa.array([k for spares, _ in made for k in spares], pa.int64()), pa.array([v for spares, _ in made for v in spares.values()], pa.int32())),
                _lists([x for _, x in made]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "fa", "fb", "bits", "spares", "signatures"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, fa long, fb long, bits array<long>, spares map<long,int>, signatures array<long>")


def _verified(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose sets are similar. Sizes and the Hamming distance of the bit sketches
    bound what two sets can have in common; the sets of the pairs within both bounds are compared."""
    side = lambda df, row, *columns: df.select(F.col("row").alias(row), *[F.col(c).alias(c + row) for c in columns])
    near = pairs.join(side(nodes, "a", "n", "bits"), "a").join(side(nodes, "b", "n", "bits"), "b")
    near = near.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    near = near.filter((100 + percent) * hamming(F.col("bitsa"), F.col("bitsb")) <= (100 - percent) * (F.col("na") + F.col("nb")))
    near = settle(near.select("a", "b"), "near")
    both = F.size(F.array_intersect("itemsa", "itemsb")).cast("long")
    compared = near.join(side(sets, "a", "n", "items"), "a").join(side(sets, "b", "n", "items"), "b")
    return compared.filter(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")


def similar_components(docs: DataFrame, shingle: int = 3, percent: int = 90, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs.

    Two rows link when 100 * |intersection| >= percent * |union| of their shingle sets;
    component_id is the smallest id among the rows that links reach. Rows without words link with
    nothing. Rows that repeat an id stay rows of their own; a null id isn't smaller than any other, and
    component_id is null only if all ids it could be are null. An empty table gives an empty one.
    """
    with scratch() as own:
        return _components(docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")), shingle, percent, own)


def _components(plain: DataFrame, shingle: int, percent: int, own: Scratch) -> DataFrame:
    nodes = settle(_sketches(plain, shingle, Bands(percent)).withColumn("row", F.monotonically_increasing_id()), "sketches")

    # rows with equal sets are one node, named by its smallest row
    groups = nodes.filter("n > 0").groupBy("fa", "fb", "n").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("copies"))
    groups = settle(groups.filter("copies > 1").select("fa", "fb", "n", "first"), "equal_sets")
    named = nodes.join(small(groups, MOST_BROADCAST), ["fa", "fb", "n"], "left").withColumn("node", F.coalesce("first", "row"))
    buckets = _buckets(named.filter("node = row").select("row", "spares", "signatures"))
    named = settle(named.select("doc_id", "n", "fa", "fb", "bits", "node", "row"), "nodes")
    discard(nodes)

    members = settle(buckets.select("row").union(buckets.select("hub")).distinct(), "members")
    rows = settle(named.join(small(members, MOST_BROADCAST), "row", "left_semi").select("row", "doc_id", "fa", "fb", "n", "bits"), "rows")
    wanted = small(rows.select(F.col("doc_id").alias("__id"), "row", "fa", "fb"), MOST_BROADCAST)
    sets = _sets(plain.join(wanted, F.col("doc_id").eqNullSafe(F.col("__id"))), shingle)
    if not named.groupBy("doc_id").count().filter("count > 1").isEmpty():  # rows that repeat an id may have equal sets
        sets = sets.groupBy("row").agg(F.first("n").alias("n"), F.first("items").alias("items"))
    sets = settle(sets, "sets")

    linked, labels = _resolve(buckets, rows.select("row", "n", "bits"), sets, percent)
    answer = named.select("doc_id", "n", "node", "row")
    if linked:
        answer = answer.join(labels.withColumnRenamed("component", "of"), "node", "left").withColumn("node", F.coalesce("of", "node"))
    answer = own.keep(answer.select("doc_id", "n", "node", "row"), "answer")
    # only components of more than one row need their smallest id
    least = answer.groupBy("node").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("node", "component_id")
    least = small(own.keep(least, "components"), MOST_BROADCAST)
    found = answer.join(least.withColumn("several", F.lit(True)), "node", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("several"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _buckets(nodes: DataFrame) -> DataFrame:
    """(signature, hub, row) of nodes (row, spares, signatures): each node of a bucket with the bucket's
    smallest. Hot signatures are counted with partial sums and joined, never gathered."""
    dealt = nodes.select("row", F.explode("signatures").alias("signature"))
    often = settle(dealt.groupBy("signature").agg(F.count(F.lit(1)).alias("often")).filter("often > 1"), "often")
    met = dealt.join(often, "signature").withColumn("name", F.col("signature").bitwiseAND(NAMES - 1))
    rank = F.row_number().over(Window.partitionBy("row", "name").orderBy(F.desc("often"), "signature"))
    met = met.withColumn("rank", rank).join(nodes.select("row", "spares"), "row").filter(F.col("rank") > F.coalesce(F.try_element_at("spares", F.col("name")), F.lit(0)))
    met = settle(met.select("signature", "row"), "met")
    discard(often)
    hubs = settle(met.groupBy("signature").agg(F.min("row").alias("hub"), F.max("row").alias("last")).filter("hub < last").select("signature", "hub"), "hubs")
    buckets = settle(met.join(hubs, "signature").filter("row <> hub").select("signature", "hub", "row"), "buckets")
    discard(met)
    discard(hubs)
    return buckets


def _resolve(buckets: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> tuple[bool, DataFrame | None]:
    """Compare nodes of buckets until every two are in one component or known not to be similar.

    First each node is compared with its smallest hub, then with the hub of each of its buckets. Any
    two nodes of a bucket have its hub in common; where they are still in different components, their
    differences from that hub tell which of them to compare (``_shared_differences``).
    """
    edges, checked, labels = None, None, None

    def compare(pairs: DataFrame) -> None:
        nonlocal edges, checked, labels
        fresh = pairs.select(F.col("hub").alias("a"), F.col("row").alias("b")).distinct()
        if checked is not None:
            fresh = fresh.join(checked, ["a", "b"], "left_anti")
        fresh = settle(fresh, "pairs")
        checked = fresh if checked is None else checked.unionByName(fresh)
        found = settle(_verified(fresh, nodes, sets, percent), "linked")
        if not found.isEmpty():
            edges = found if edges is None else edges.unionByName(found)
            labels = components(edges)

    def labelled(rows: DataFrame, node: str, name: str) -> DataFrame:
        if labels is None:
            return rows.withColumn(name, F.col(node))
        return rows.join(labels.select(F.col("node").alias(node), F.col("component").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))

    star = settle(buckets.select("hub", "row").distinct(), "star")
    compare(star.groupBy("row").agg(F.min("hub").alias("hub")))
    compare(labelled(labelled(star, "row", "of_row"), "hub", "of_hub").filter("of_row <> of_hub"))
    members = labelled(buckets, "row", "component")
    mixed = members.groupBy("signature").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("signature")
    rest = settle(members.join(mixed, "signature", "left_semi").select("hub", "row", "component").distinct(), "unsettled")
    if not rest.isEmpty():
        shared = _shared_differences(rest, sets, percent)
        for pivot in (F.min, F.max):  # members of a group of copies that the hub isn't in soon have a component
            rows = labelled(shared.drop("component"), "row", "component")
            pivots = rows.groupBy("hub", "element").agg(pivot(F.struct("row", "component")).alias("pivot"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
            far = rows.join(pivots.drop("low", "high"), ["hub", "element"]).filter("component <> pivot.component")
            compare(far.select(F.least("row", "pivot.row").alias("hub"), F.greatest("row", "pivot.row").alias("row")))
        compare(_pairs_by_differences(settle(labelled(shared.drop("component"), "row", "component"), "prefixes"), percent))
    return edges is not None, labels


def _shared_differences(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(hub, element, row, component, n, place, size) of members (hub, row, component): the rarest elements in
    which a member and its hub differ, of those that members of several components share.

    Let d(x) be the elements in which x and the hub differ. Of x and y the differing elements are those
    in just one of d(x) and d(y), so if at most D differ, the two have at least (|d(x)| + |d(y)| - D) / 2
    of them in common. That is at least one unless both are similar to the hub and so in one component,
    and with the elements ordered from the hub's rarest on, the first D + 1 of each have one in common.
    Members of one hub differ from it mostly in their own ways: elements of one member or of one
    component are counted, not joined, and the rest are few.
    """
    mine = sets.select("row", "n", F.col("items").alias("mine"))
    its = sets.select(F.col("row").alias("hub"), F.col("items").alias("its"))
    both = members.join(mine, "row").join(its, "hub")
    differ = both.select("hub", "row", "component", "n", F.concat(F.array_except("mine", "its"), F.array_except("its", "mine")).alias("elements"))
    # D for the largest partner that could be similar
    most = F.floor(F.col("n") * (100 + percent) * (100 - percent) / (percent * (100 + percent))).cast("int") + 1
    apart = differ.select("hub", "row", "component", "n", most.alias("most"), F.size("elements").alias("size"), F.explode("elements").alias("element"))
    counts = apart.groupBy("hub", "element").agg(F.count(F.lit(1)).alias("often"), F.min("component").alias("low"), F.max("component").alias("high"))
    counts = settle(counts.filter("often > 1"), "shared_differences")
    own = Window.partitionBy("hub", "row")
    shared = apart.join(counts, ["hub", "element"])
    # elements of one member alone come first
    place = F.col("size") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("often", "element"))
    first = shared.withColumn("place", place).filter("place <= most + 1 AND low < high")
    return settle(first.select("hub", "element", "row", "component", "n", "place", "size"), "prefixes")


def _pairs_by_differences(first: DataFrame, percent: int) -> DataFrame:
    """(hub, row) pairs of members in different components that share one of their rarest differences from
    a hub: a superset of all that are similar, of those in different components that share a hub."""
    mixed = first.groupBy("hub", "element").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("hub", "element")
    first = first.join(mixed, ["hub", "element"], "left_semi")
    other = first.select("hub", "element", *[F.col(c).alias(f"{c}2") for c in ("row", "component", "n", "place", "size")])
    # with sizes known, what two have in common at least leaves each only so long a beginning
    differ = F.floor((F.col("n") + F.col("n2")) * (100 - percent) / (100 + percent))
    common = F.ceil((F.col("size") + F.col("size2") - differ) / 2)
    near = (F.col("place") <= F.col("size") - common + 1) & (F.col("place2") <= F.col("size2") - common + 1)
    pairs = first.join(other, ["hub", "element"]).filter((F.col("row") < F.col("row2")) & (F.col("component") != F.col("component2")) & near)
    return pairs.select(F.col("row").alias("hub"), F.col("row2").alias("row")).distinct()
