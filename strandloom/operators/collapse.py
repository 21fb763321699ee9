"""Collapsing reads end to end: one read, or pair of reads, per molecular tag of each probe and sample.

``annotate`` says what becomes of each read (its disposition) and takes its probe's arms off; it is narrow
but for the joins with barcodes and probes. ``collapse`` answers for the reads on target, by groups
(mip_key, barcode, mtag):

* where the tags of a site (mip_key, barcode) are few enough to be distinct molecules, each mate is the
  consensus of its reads in the group's dominant place and form, else one read drawn by a seeded hash;
* groups without one of their mates are "unpaired", those with a read whose form doesn't fit its bases
  "strange", all others "unique" with their mates' positions and lengths set to one another's.

Everything is grouped by tag before it is grouped by site, so a site that holds most of the reads is
aggregated map-side. ``site_reads`` is the same answer for the reads of one site in memory, for streams whose
state holds open sites only (see ``streaming.sites``).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alignments as A
from ..params import CollapseParams
from ..tables import written
from . import reads as R
from .complexity import ALL_POSITIONS, ALL_SAMPLES, complexity, distinct_probability, marginals, with_saturation
from .complexity import collapse_free as counted_free

SITE = ("mip_key", "barcode")
GROUP = (*SITE, "mtag")
#: Columns of a SAM line, with the order in which reads arrived.
SAM = ("ord", "qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", "tags")
#: What else a collapsed read carries.
OUT = (*GROUP, "sample", "read_number", "route")


class Collapsed(NamedTuple):
    """reads: SAM and OUT columns; complexity: (sample, mip, total, unique) of every site."""

    reads: DataFrame
    complexity: DataFrame


def with_barcodes(reads: DataFrame, barcodes: DataFrame | None, tolerant: bool = False) -> DataFrame:
    """Reads with sample and the barcode they are counted for; both null for a barcode that isn't listed.

    Without barcodes every barcode is its own sample, and a read without one has the barcode N. Tolerant: one base
    may differ.
    """
    named = reads.withColumn("barcode", F.when(F.col("barcode") == "", "N").otherwise(F.col("barcode")))
    if barcodes is None:
        return named.withColumn("sample", F.col("barcode"))
    latest = barcodes.groupBy("sequence").agg(F.max_by("label", "ord").alias("sample"), F.max("ord").alias("ord"))
    exact = latest.select(F.col("sequence").alias("barcode"), F.col("sequence").alias("__to"), "sample")
    if tolerant:
        near = R.barcode_neighbours(latest.withColumnRenamed("sample", "label")).select(F.col("variant").alias("barcode"), F.col("sequence").alias("__to"), F.col("label").alias("sample"))
        exact = exact.unionByName(near.join(exact.select("barcode"), "barcode", "left_anti"))
    return named.join(exact, "barcode", "left").withColumn("barcode", F.col("__to")).drop("__to")


def arms_of(design: DataFrame) -> DataFrame:
    """(mip_key, first_arm, second_arm) of a design as reads on the plus strand show them."""
    plus = F.col("probe_strand") == "+"
    back = lambda c: F.reverse(F.translate(c, "ACGTacgt", "TGCAtgca"))
    return design.select("mip_key", F.when(plus, F.col("ext_probe_sequence")).otherwise(back("lig_probe_sequence")).alias("first_arm"), F.when(plus, F.col("lig_probe_sequence")).otherwise(back("ext_probe_sequence")).alias("second_arm"))


def annotate(reads: DataFrame, params: CollapseParams, design: DataFrame | None = None, barcodes: DataFrame | None = None) -> DataFrame:
    """Reads with cluster, barcode, sample, mtag, read_number, mip_key, span and disposition.

    design: probes (mip_key, chr, mip_start, mip_stop, strand, ord), with arms (first_arm, second_arm) where
    params.exact_arms; without a design nothing is off target or trimmed. With a design and params.trim the reads on
    target come without their arms, and pos, cigar, seq, qual and span are those of what is left. Null fields are
    read as SAM's own signs for "not there", so every row has a disposition.
    """
    filled = reads.fillna({"qname": "", "rname": "*", "cigar": "*", "rnext": "*", "seq": "*", "qual": "*"}).fillna({"flag": 4, "pos": 0, "pnext": 0, "tlen": 0, "mapq": 0})
    filled = filled if "tags" in reads.columns else filled.withColumn("tags", F.lit(""))
    filled = filled.withColumn("span", A.total_once(F.col("cigar"), "MD"))
    named = with_barcodes(R.parse_names(filled), barcodes, params.tolerant)
    if params.key_by_reference:
        named = named.withColumn("mip_key", F.col("rname"))
    elif design is None:
        named = R.assign_probes(named, R.probe_sites(_no_probes(reads), 0))
    else:
        named = R.assign_probes(named, R.probe_sites(design, params.flex))
    trimmed = design is not None and params.trim
    if trimmed:
        if params.exact_arms:
            named = named.join(design.select("mip_key", "first_arm", "second_arm").dropDuplicates(["mip_key"]), "mip_key", "left")
        named = R.trim_arms(R.with_numbers(named), exact=params.exact_arms)
    judged = R.without_numbers(R.dispositions(named, params, known_probes=design is not None, trimmed=trimmed))
    if trimmed:
        cut = (F.col("disposition") == "on_target") & (F.col("cigar") != "*")
        judged = judged.withColumn("span", F.when(cut & (F.col("new_seq") != ""), F.col("new_size")).otherwise(F.col("span")))
        on = F.col("disposition") == "on_target"
        judged = judged.withColumns({c: F.when(on, F.col(f"new_{c}")).otherwise(F.col(c)) for c in ("pos", "cigar", "seq", "qual")}).drop("new_pos", "new_cigar", "new_seq", "new_qual", "new_size", "trim_status", "first_arm", "second_arm")
    return judged


def _no_probes(reads: DataFrame) -> DataFrame:
    return reads.sparkSession.createDataFrame([], "mip_key string, chr string, mip_start int, mip_stop int, strand string, ord long")


# -- batch


def collapse(annotated: DataFrame, params: CollapseParams) -> Collapsed:
    """What is left of the reads on target, and the complexity of every site.

    annotated: as ``annotate`` returns it. Reads are taken in the order of ord; ties between rows that repeat go
    by name. With params.collapse_free reads are passed on as they are and counted one by one. No reads give none.
    """
    on = annotated.filter("disposition = 'on_target'").select(*SAM, *GROUP, "sample", "read_number", "cluster", "span")
    on = written(on.withColumn("uses", A.total_once(F.col("cigar"), A.READ)), "on_target")  # read several times below
    if params.collapse_free:
        return Collapsed(on.select(*SAM, *GROUP, "sample", "read_number", F.lit("uncollapsed").alias("route")), counted_free(on))
    counts = complexity(on)
    fields, made = F.struct(*SAM, "span", "uses"), ("pos", "cigar", "uses", "seq", "qual")
    of = lambda n, value: F.when(F.col("read_number") == n, value)
    first = lambda n: F.min_by(of(n, fields), of(n, F.struct("ord", "qname"))).alias(f"first{n}")
    draw = F.struct(F.xxhash64(F.lit(params.seed), F.col("qname")), F.col("qname"), F.col("ord"))
    drawn = lambda n: F.min_by(of(n, F.struct(*made)), of(n, draw)).alias(f"drawn{n}")
    groups = on.groupBy(*GROUP).agg(F.max("sample").alias("sample"), first(1), first(2), drawn(1), drawn(2))
    per_site = on.select(*GROUP).distinct().groupBy(*SITE).agg((distinct_probability(F.count(F.lit(1)), params.tags) > params.confidence).alias("distinct"))
    forms = R.consensus_of_forms(on.join(per_site.filter("distinct"), list(SITE), "left_semi"), (*GROUP, "read_number"), ("uses",))
    best = lambda n: F.max(of(n, F.struct("n", "quality", *made))).alias(f"best{n}")
    both = groups.join(forms.groupBy(*GROUP).agg(best(1), best(2)), list(GROUP), "left")
    chosen = lambda n: F.when(F.col(f"best{n}").isNotNull(), F.struct(*[F.col(f"best{n}")[c].alias(c) for c in made])).otherwise(F.col(f"drawn{n}"))
    both = both.select(*GROUP, "sample", "first1", "first2", *[chosen(n).alias(f"made{n}") for n in (1, 2)])
    return Collapsed(_routed(both, params.single_end), counts)


def _fits(read: Column) -> Column:
    return read["uses"] == F.length(read["seq"])


def _routed(groups: DataFrame, single: bool) -> DataFrame:
    """Both mates of each group with their route, as rows.

    Where the first reads' forms don't fit their bases the group keeps these reads. A form that doesn't fit is "*",
    but of first reads only that of one.
    """
    one, two, made1, made2 = (F.col(c) for c in ("first1", "first2", "made1", "made2"))
    there = one.isNotNull() if single else one.isNotNull() & two.isNotNull()
    judged = groups.withColumns({"__there": there, "__fit1": _fits(one), "__fit2": F.lit(True) if single else _fits(two), "__made1": _fits(made1), "__made2": F.lit(True) if single else _fits(made2)})
    fit1, fit2, fits1, fits2 = (F.col(c) for c in ("__fit1", "__fit2", "__made1", "__made2"))
    remade = F.col("__there") & fit1 & fit2
    route = F.when(~F.col("__there"), "unpaired").when(remade & fits1 & fits2, "unique").otherwise("strange")
    star1, star2 = F.when(remade, ~fits1).otherwise(F.col("__there") & fit2), F.when(remade, ~fits2).otherwise(F.col("__there") & ~fit2)
    length = F.greatest(made1["pos"] + one["span"], made2["pos"] + two["span"]) - F.least(made1["pos"], made2["pos"])
    sign = F.when((two["flag"] == 99) | (one["flag"] == 163), -1).when((one["flag"] == 99) | (two["flag"] == 163), 1)
    judged = judged.select(*GROUP, "sample", "first1", "first2", "made1", "made2", remade.alias("__remade"), route.alias("route"), star1.alias("__star1"), star2.alias("__star2"), (length * sign).alias("__length"))
    mates = F.array(*[F.struct(F.lit(n).alias("read_number"), F.col(f"first{n}").alias("first"), F.col(f"made{n}").alias("made"), F.col(f"__star{n}").alias("star"), F.col(f"made{3 - n}")["pos"].alias("mate"), (F.col("__length") * (3 - 2 * n)).alias("length")) for n in (1, 2)])
    rows = judged.select(*GROUP, "sample", "route", "__remade", F.explode(mates).alias("o")).filter("o.first IS NOT NULL")
    if single:
        rows = rows.filter("o.read_number = 1 OR route = 'unpaired'")
    first = {c: F.col(f"o.first.{c}") for c in SAM}
    out = first | {c: F.when(F.col("__remade"), F.col(f"o.made.{c}")).otherwise(first[c]) for c in ("pos", "cigar", "seq", "qual")}
    out["cigar"] = F.when(F.col("o.star"), "*").otherwise(out["cigar"])
    if not single:
        unique = F.col("route") == "unique"
        out["pnext"], out["tlen"] = F.when(unique, F.col("o.mate")).otherwise(first["pnext"]), F.when(unique, F.coalesce("o.length", first["tlen"])).otherwise(first["tlen"])
    return rows.select(*[out[c].alias(c) for c in SAM], *GROUP, "sample", "o.read_number", "route")


def summary(counts: DataFrame, design: DataFrame | None = None) -> DataFrame:
    """(sample, mip, total, unique, saturation): totals by probe, by sample and over all.

    With a design only its probes count, and those without reads have a row.
    """
    probes = None if design is None else design.select(F.col("mip_key").alias("mip"))
    counts = counts if design is None else written(counts, "complexity")  # read twice: once for probes without reads
    return with_saturation(marginals(counts, probes)).select("sample", "mip", "total", "unique", "saturation")


# -- one site in memory


def site_reads(reads: Iterable[dict], params: CollapseParams) -> tuple[list[dict], int, int]:
    """(rows as of ``collapse``, total, unique) of all reads of one site.

    reads: rows as ``annotate`` returns them, with draw, their seeded hash.
    """
    groups: dict[str, list[dict]] = defaultdict(list)
    for read in sorted(reads, key=lambda r: (r["ord"], r["qname"])):
        groups[read["mtag"]].append(read)
    total, unique = sum(len({r["cluster"] for r in own}) for own in groups.values()), len(groups)
    chance = 1.0
    for k in range(1, unique):
        chance *= max(0.0, 1 - k / params.tags)
    out: list[dict] = []
    for tag in sorted(groups):
        mates = {n: [r for r in groups[tag] if r["read_number"] == n] for n in (1, 2)}
        out += _group_reads(mates, chance > params.confidence, params.single_end)
    return out, total, unique


def _group_reads(mates: dict[int, list[dict]], distinct: bool, single: bool) -> list[dict]:
    """One group's rows with their route."""
    first = {n: own[0] for n, own in mates.items() if own}
    wanted = (1,) if single else (1, 2)
    rows = lambda route, reads: [{c: r[c] for c in (*SAM, *GROUP, "sample")} | {"read_number": n, "route": route} for n, r in sorted(reads.items())]
    fits = lambda r: sum(n for n, op in _operations(r["cigar"]) if op in "MIS=X") == len(r["seq"])
    if any(n not in first for n in wanted):
        return rows("unpaired", first)
    first = {n: first[n] for n in wanted}
    bad = next((n for n in reversed(wanted) if not fits(first[n])), None)
    if bad:
        return rows("strange", first | {bad: first[bad] | {"cigar": "*"}})
    made = {n: first[n] | (_consensus(mates[n]) if distinct else _drawn(mates[n])) for n in wanted}
    if not all(map(fits, made.values())):
        return rows("strange", {n: r if fits(r) else r | {"cigar": "*"} for n, r in made.items()})
    if not single:
        length = max(r["pos"] + r["span"] for r in made.values()) - min(r["pos"] for r in made.values())
        sign = -1 if made[2]["flag"] == 99 or made[1]["flag"] == 163 else 1 if made[1]["flag"] == 99 or made[2]["flag"] == 163 else 0
        made = {n: r | {"pnext": made[3 - n]["pos"], "tlen": length * sign * (3 - 2 * n) if sign else r["tlen"]} for n, r in made.items()}
    return rows("unique", made)


def _operations(cigar: str) -> list[tuple[int, str]]:
    out, n = [], ""
    for c in cigar:
        if c.isdigit():
            n += c
        else:
            out, n = [*out, (int(n), c)] if n else out, ""
    return out


def _drawn(reads: list[dict]) -> dict:
    best = min(reads, key=lambda r: (r["draw"], r["qname"]))
    return {c: best[c] for c in ("pos", "cigar", "seq", "qual")}


def _consensus(reads: list[dict]) -> dict:
    places: dict[tuple[int, str], list[dict]] = defaultdict(list)
    for r in reads:
        places[r["pos"], r["cigar"]].append(r)
    quality = lambda own: sum(ord(c) - 33 for r in own for c in r["qual"])
    (pos, cigar), own = max(places.items(), key=lambda x: (len(x[1]), quality(x[1]), *x[0]))
    fold = R.Fold(min(len(r["seq"]) for r in own))
    for r in own:
        fold.add(r["seq"], r["qual"])
    seq, qual = fold.result()
    return {"pos": pos, "cigar": cigar, "seq": seq, "qual": qual}
