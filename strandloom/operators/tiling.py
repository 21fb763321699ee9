"""Greedy tiling of targets with probes.

What is picked first occupies arm positions and so decides what may be picked next. Features that lie
farther apart than two captures can't compete for arms, so chromosomes are split into clusters of near
features, and a cluster is one group of ``applyInPandas``. Groups hold condensed probes only (one per
scan start and strand), never candidates. Strands are tried in a fixed turn, so reruns agree.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator
from itertools import takewhile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import DesignParams
from .svm import SvmModel, predicted

TILED = "chr string, feature_id long, turn int, scan_start int, strand string, phase string, start int, stop int, kind string"
_NEEDED = ["chr", "feature_id", "start_f", "stop_f", "scan_start", "scan_stop", "strand", "score", "snp_count", "ext_probe_start", "ext_probe_stop", "lig_probe_start", "lig_probe_stop", "ext_probe_copy", "lig_probe_copy", "arm_fraction_masked"]


class _Board:
    """The arm positions that a cluster's picks occupy, by strand."""

    def __init__(self, rows: pd.DataFrame, params: DesignParams):
        ends = rows[["ext_probe_start", "lig_probe_start", "ext_probe_stop", "lig_probe_stop"]].to_numpy()
        self.params, self.low = params, int(ends.min())
        self.used = {s: np.zeros(int(ends.max()) - self.low + 1, bool) for s in "+-"}

    def arms(self, p: Probes, i: int) -> list[slice]:
        return [slice(a - self.low, b - self.low + 1) for a, b in ((p.ext_start[i], p.ext_stop[i]), (p.lig_start[i], p.lig_stop[i]))]

    def free(self, p: Probes, i: int) -> bool:
        return not any(self.used[p.strand[i]][arm].any() for arm in self.arms(p, i))

    def all_free(self, p: Probes) -> np.ndarray:
        """Whether each probe's arms are unused, from running sums of used positions."""
        sums = {s: np.concatenate([[0], np.cumsum(used)]) for s, used in self.used.items()}
        busy = lambda s, a, b: sums[s][b - self.low + 1] - sums[s][a - self.low]
        taken = {s: busy(s, p.ext_start, p.ext_stop) + busy(s, p.lig_start, p.lig_stop) for s in "+-"}
        return np.where(p.strand == "+", taken["+"], taken["-"]) == 0

    def occupy(self, p: Probes, i: int) -> None:
        own, other = p.strand[i], "-" if p.strand[i] == "+" else "+"
        for arm in self.arms(p, i):
            self.used[own][arm] = True
            if self.params.seal_both_strands:
                self.used[other][arm] = True
            elif self.params.half_seal_both_strands:
                self.used[other][(arm.start + arm.stop - 1 + 2 * self.low) // 2 - self.low] = True


class Probes:
    """The condensed probes of one feature as arrays, and what is preferred among them.

    With a model, a probe's score is the model's from the first time that tiling looks at it.
    """

    def __init__(self, rows: pd.DataFrame, params: DesignParams, model: SvmModel | None = None):
        self.params, self.model = params, model
        self.features, self.looked_at = (rows["svm_features"].to_numpy() if model is not None else None), np.zeros(len(rows), bool)
        self.feature, self.first, self.last = (int(rows[c].iloc[0]) for c in ("feature_id", "start_f", "stop_f"))
        names = {"place": "scan_start", "stop": "scan_stop", "ext_start": "ext_probe_start", "ext_stop": "ext_probe_stop", "lig_start": "lig_probe_start", "lig_stop": "lig_probe_stop", "snps": "snp_count", "masked": "arm_fraction_masked", "strand": "strand"}
        for name, column in names.items():
            setattr(self, name, rows[column].to_numpy())
        self.score = rows["score"].fillna(-np.inf).to_numpy(dtype=float, copy=True)
        self.copies = rows[["ext_probe_copy", "lig_probe_copy"]].max(axis=1).to_numpy()
        self.product = rows["ext_probe_copy"].to_numpy() * rows["lig_probe_copy"].to_numpy()
        self.at: dict[int, list[int]] = {}
        for i in np.lexsort((self.strand, self.place)):  # "+" sorts before "-"
            self.at.setdefault(int(self.place[i]), []).append(int(i))

    def look_at(self, which: list[int]) -> None:
        """Score these anew by the model, once each."""
        if self.model is not None and (new := [i for i in which if not self.looked_at[i]]):
            self.score[new] = predicted(np.stack([np.asarray(self.features[i], float) for i in new]), self.model)
            self.looked_at[new] = True

    def best_over(self, strand: str) -> np.ndarray:
        """The best usable probe over each position of the feature: fewest variants, then the highest
        score, then the earliest scan start; -1 where there is none."""
        q = self.params
        usable = (self.strand == strand) & (self.product <= q.max_arm_copy_product) & (self.copies <= q.target_arm_copy) & (self.masked <= q.masked_arm_threshold)
        top = np.full(self.last - self.first + 1, -1)
        for i in np.lexsort((self.place, -self.score, self.snps))[::-1]:  # the best last, over all others
            if usable[i]:
                top[max(0, self.place[i] - self.first) : max(0, self.stop[i] - self.first + 1)] = i
        return top

    def improves(self, new: int, old: int) -> bool:
        """A higher score or fewer variants, unless arms get too frequent or too masked by it."""
        q = self.params
        frequent = self.copies[new] > q.target_arm_copy and self.copies[new] > self.copies[old]
        masked = self.masked[new] > q.masked_arm_threshold and self.masked[new] > self.masked[old]
        return (self.score[new] > self.score[old] or self.snps[new] < self.snps[old]) and not frequent and not masked

    def places_from(self, position: int) -> tuple[list[int], range]:
        """The places to try for the first uncovered position, in order, and the window of overlap.

        Near the feature's end they go up from the last place that a smallest scan could take; else
        they go down from the position less the starting overlap. The first must be in the window
        (or, going up, at most one past the position).
        """
        q = self.params
        smallest = q.min_capture_size - max(total for total, _, _ in q.arms())
        rising = self.last - position < smallest - 10 - q.starting_mip_overlap
        near = position - q.starting_mip_overlap
        window = range(self.last - smallest + 1 if rising else position - q.max_mip_overlap, near + 1)
        known = sorted(p for p in self.at if (p >= window.start if rising else p <= near))
        places = known if rising else known[::-1]
        if not places or (places[0] > position + 1 if rising else places[0] < window.start):
            return [], window
        return places, window


def _reachable(p: Probes, places: list[int], position: int, strands: str) -> Iterator[tuple[int, int]]:
    """(place, probe) that may come first: inside the feature's reach, up to the first place whose last
    probe ends before the position."""
    for place in takewhile(lambda x: p.first - p.params.min_capture_size < x < p.last, places):
        own = [i for i in p.at[place] if p.strand[i] in strands]
        p.look_at(own)
        yield from ((place, i) for i in own)
        if own and p.stop[own[-1]] <= position:
            return


def _next_probe(p: Probes, board: _Board, left: np.ndarray, strands: str) -> int | None:
    """The probe that goes on from the first uncovered position: the first free one in reach, or one
    that improves on it and lies in the window of overlap."""
    position, end = p.first + int(np.flatnonzero(left)[0]), p.first + int(np.flatnonzero(left)[-1])
    places, window = p.places_from(position)
    start, chosen = next(((place, i) for place, i in _reachable(p, places, position, strands) if board.free(p, i)), (None, None))
    if chosen is None:
        return None
    rising = len(places) > 1 and places[1] > places[0]
    for before, place in zip([None, *places], places, strict=False):
        if (place < start) if rising else (place > start):
            continue
        if place != start:
            wanted = p.score[chosen] < p.params.upper_limit or p.snps[chosen] > 0
            reaches = not rising or before + 1 + p.stop[chosen] - p.place[chosen] + 1 > end
            if not (wanted and place in window and reaches):
                break
        p.look_at([i for i in p.at[place] if p.strand[i] in strands])
        for i in p.at[place]:
            if p.strand[i] in strands and i != chosen and p.improves(i, chosen) and board.free(p, i):
                chosen = i
    return chosen


def _priority(p: Probes, board: _Board, left: np.ndarray, strands: str) -> int | None:
    """The free probe of the position whose better strand scores lowest, if below the limit (then by the model, if
    there is one). Equal strands: minus; equal positions: the first."""
    free = np.append(board.all_free(p), False)
    score, top = np.append(p.score, -np.inf), {s: p.tops[s] for s in strands}
    fits = {s: left & free[i] for s, i in top.items()}
    worth = np.stack([np.where(fits[s], score[top[s]], np.nan) for s in strands])
    some = np.stack(list(fits.values())).any(axis=0)
    if not some.any():
        return None
    best = np.where(some, np.fmax.reduce(worth), np.inf)
    at = int(np.argmin(best))
    if not some[at]:  # every one scores infinitely badly
        at = int(np.flatnonzero(some)[0])
    found = int(next(top[s][at] for s in sorted(strands, reverse=True) if fits[s][at] and score[top[s][at]] == best[at]))
    p.look_at([found])
    return found if p.score[found] < p.params.lower_limit else None


def _tile_feature(p: Probes, board: _Board) -> Iterator[dict]:
    """Picks and gaps of one feature in the order of its passes."""
    q = p.params
    separate = q.double_tile_strands_separately
    passes = [("first", "coverage_failed", "+" if separate else "+-")] + [("minus", "minus_strand_failed", "-")] * separate
    if q.double_tile_strand_unaware:
        passes += [("double", "double_tile_failed", "+" if separate else "+-")] + [("minus_double", "minus_strand_double_tile_failed", "-")] * separate
    p.tops = {s: p.best_over(s) for s in "+-"}
    left = {name: np.ones(p.last - p.first + 1, bool) for name, _, _ in passes}

    def take(i: int, name: str, phase: str) -> dict:
        board.occupy(p, i)
        left[name][max(0, p.place[i] - p.first) : max(0, p.stop[i] - p.first + 1)] = False
        return {"scan_start": int(p.place[i]), "strand": p.strand[i], "phase": phase}

    for name, _, strands in passes:
        if "double" not in name:
            while (i := _priority(p, board, left[name], strands)) is not None:
                yield take(i, name, f"{name}_priority")
    for name, kind, strands in passes:
        own = left[name]
        while own.any():
            before = int(own.sum())
            if (i := _next_probe(p, board, own, strands)) is not None:
                yield take(i, name, name)
                if int(own.sum()) == before:  # it covers nothing new and can't lead on
                    break
                continue
            uncovered = np.flatnonzero(own)
            if uncovered[-1] - uncovered[0] <= q.max_capture_size:
                break
            cut = slice(uncovered[0], uncovered[0] + q.max_capture_size // 2 + 1)
            yield {"start": p.first + int(cut.start), "stop": p.first + int(cut.stop) - 1, "kind": kind}
            own[cut] = False
        edges = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            yield {"start": p.first + int(a), "stop": p.first + int(b) - 1, "kind": kind}


def _tiled(condensed: DataFrame, params: DesignParams, model: SvmModel | None = None) -> DataFrame:
    """Picks and gaps of all features, with turn, their order within a feature."""
    columns = [c.split()[0] for c in TILED.split(", ")]
    needed, shared = _NEEDED, None
    if params.score_method == "mixed":
        if model is None:
            raise ValueError("score_method mixed needs a model")
        params, needed = dataclasses.replace(params, score_method="svr"), [*_NEEDED, "svm_features"]  # its limits from here on
        shared = condensed.sparkSession.sparkContext.broadcast(model)

    def tile(rows: pd.DataFrame) -> pd.DataFrame:
        board, out = _Board(rows, params), []
        for feature, own in rows.groupby("feature_id", sort=True):
            made = _tile_feature(Probes(own.reset_index(drop=True), params, shared and shared.value), board)
            out += [dict.fromkeys(columns) | {"chr": own["chr"].iloc[0], "feature_id": feature, "turn": i} | x for i, x in enumerate(made)]
        return pd.DataFrame(out, columns=columns, dtype=object)

    features = condensed.select("chr", "feature_id", F.col("start_f").alias("start"), F.col("stop_f").alias("stop")).distinct()
    # a probe reaches at most one capture beyond its feature on either side
    order = Window.partitionBy("chr").orderBy("start", "stop", "feature_id")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = features.withColumn("apart", F.when(F.col("start") > reach + 2 * params.max_capture_size, 1).otherwise(0))
    clusters = apart.select("chr", "feature_id", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cluster"))
    placed = condensed.select(*needed).join(clusters, ["chr", "feature_id"])
    return placed.groupBy("chr", "cluster").applyInPandas(tile, TILED)


def pick(condensed: DataFrame, params: DesignParams, model: SvmModel | None = None) -> DataFrame:
    """Picked probes, numbered by chromosome in the order of features and of their picks.

    By score_method "mixed" condensed has svm_features (``probes.with_rescoring``), and the model scores only the
    probes that tiling looks at.

    First the probes of positions that score below the priority limit, then tiles from the first
    uncovered position on; further passes for separate strands and for double tiling.
    """
    order = Window.partitionBy("chr").orderBy("feature_id", "turn")
    picks = _tiled(condensed, params, model).filter("phase IS NOT NULL").withColumn("number", F.row_number().over(order))
    return picks.select("chr", "feature_id", "number", "scan_start", "strand", "phase")


def uncovered(condensed: DataFrame, params: DesignParams, model: SvmModel | None = None) -> DataFrame:
    """Intervals that no pick covers, and gaps cut to go on, by kind of pass."""
    return _tiled(condensed, params, model).filter("kind IS NOT NULL").select("chr", "feature_id", "start", "stop", "kind")
