"""Sequencing reads: pairing files, barcodes and tags, dispositions, arm trimming, tag groups, consensus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alignments as A
from ..params import CollapseParams, CutParams

BASES = "ATGC"


# -- FASTQ records (ord, header, seq, plus, qual)


def zip_reads(one: DataFrame, two: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Records of two files, and of an index file, side by side by their ordinal."""
    named = lambda df, tail: df.select("ord", *[F.col(c).alias(f"{c}{tail}") for c in ("header", "seq", "qual")])
    both = named(one, "1").join(named(two, "2"), "ord")
    return both if index is None else both.join(index.select("ord", F.col("seq").alias("index_seq")), "ord", "left")


def strip_mate(header: Column) -> Column:
    return F.regexp_replace(header, r"/\d$", "")


def unified_header(one: Column, two: Column) -> Column:
    """The longer of two headers without their mate numbers; read 1's of equals."""
    a, b = strip_mate(one), strip_mate(two)
    return F.when(F.length(a) >= F.length(b), a).otherwise(b)


def header_barcode(header: Column) -> Column:
    """Barcode behind the last #, before an optional dash; N without one."""
    found = F.regexp_extract(header, r"#([ATGCN]+)(?:-[^#]*)?$", 1)
    return F.when(found == "", "N").otherwise(found)


def pair_barcode(one: Column, two: Column) -> Column:
    """The barcode that both headers carry; N if they differ."""
    a, b = header_barcode(one), header_barcode(two)
    return F.when(a == b, a).otherwise("N")


def all_hash(quality: Column) -> Column:
    return F.rlike(quality, F.lit("^#+$"))


def tag_pair(rows: DataFrame, first: int, second: int) -> DataFrame:
    """Molecular tag of a pair: leading bases of both reads, cut off them."""
    cut = lambda c, n: F.substr(F.col(c), F.lit(n + 1))
    tagged = rows.withColumn("tag", F.concat(F.left("seq1", F.lit(first)), F.left("seq2", F.lit(second))))
    return tagged.withColumns({"seq1": cut("seq1", first), "qual1": cut("qual1", first), "seq2": cut("seq2", second), "qual2": cut("qual2", second)})


def tag_single(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Molecular tag of a single read: its first and its last bases, cut off it."""
    inner = lambda c: F.substr(F.col(c), F.lit(first + 1), F.greatest(F.lit(0), F.length(c) - first - last))
    tagged = rows.withColumn("tag", F.concat(F.left("seq", F.lit(first)), F.right("seq", F.lit(last))))
    return tagged.withColumns({"seq": inner("seq"), "qual": inner("qual")})


def trim(seq: Column, quality: Column, longest: int | None = None, skip: int = 0) -> tuple[Column, Column]:
    """Sequence and quality cut to a length, without trailing # qualities, and without the first bases."""
    cut = quality if longest is None else F.left(quality, F.lit(longest))
    kept = F.rtrim(cut, F.lit("#"))
    return F.substr(F.substr(seq, F.lit(1), F.length(kept)), F.lit(skip + 1)), F.substr(kept, F.lit(skip + 1))


def barcode_neighbours(barcodes: DataFrame) -> DataFrame:
    """(variant, sequence, label): every barcode with each base exchanged for A, T, C, G or N.

    barcodes: (label, sequence, ord); of barcodes that share a variant the later one has it.
    """
    at = barcodes.withColumn("i", F.explode(F.sequence(F.lit(1), F.length("sequence"))))
    changed = at.withColumn("base", F.explode(F.array(*map(F.lit, "ATCGN")))).withColumn("variant", F.overlay("sequence", "base", F.col("i")))
    return changed.groupBy("variant").agg(F.max_by("sequence", "ord").alias("sequence"), F.max_by("label", "ord").alias("label"))


def select_barcodes(rows: DataFrame, neighbours: DataFrame, barcode: str = "barcode") -> DataFrame:
    """Rows with a known barcode, which is replaced by the one it stands for."""
    known = neighbours.select(F.col("variant").alias(barcode), F.col("sequence").alias("__to"), "label")
    return rows.join(known, barcode).withColumn(barcode, F.col("__to")).drop("__to")


def _named(rows: DataFrame, header: Column, params: CutParams, barcodes: DataFrame | None) -> DataFrame:
    """Rows with header, which has a barcode, and its barcode; only those with a listed barcode, if any are listed.

    The barcode is that of the index read, cut to its length, else the header's own, else N. A header that has none
    or comes with an index read gets it appended, with blanks as underscores.
    """
    own = F.regexp_extract(header, r"#([ATGCN]+)(?:-[ATGCN]*)?$", 1)
    indexed = "index_seq" in rows.columns
    read = F.col("index_seq") if indexed and params.index_length is None else F.left("index_seq", F.lit(params.index_length)) if indexed else F.when(own == "", "N").otherwise(own)
    made = rows.withColumn("barcode", read)
    appended = F.translate(F.concat(header, F.lit("#"), F.col("barcode")), " ", "_")
    made = made.withColumn("header", appended if indexed else F.when(own == "", appended).otherwise(header))
    return made if barcodes is None else made.join(barcodes.select(F.col("sequence").alias("barcode")).distinct(), "barcode", "left_semi")


def _tagged(header: Column) -> Column:
    return F.rlike(header, F.lit("#[ATGCN]+-[ATGCN]+$"))


def _cut(rows: DataFrame, params: CutParams, mates: tuple[str, ...]) -> DataFrame:
    """Sequences and qualities cut to a length, without trailing # qualities, and without the first bases."""
    for m in mates:
        seq, qual = F.col(f"seq{m}"), F.col(f"qual{m}")
        if params.trim_hash:
            seq, qual = trim(seq, qual, params.longest, params.skip)
        else:
            whole = (lambda c: c) if params.longest is None else (lambda c: F.left(c, F.lit(params.longest)))
            seq, qual = F.substr(whole(seq), F.lit(params.skip + 1)), F.substr(whole(qual), F.lit(params.skip + 1))
        rows = rows.withColumns({f"seq{m}": seq, f"qual{m}": qual})
    return rows.select("ord", "header", "barcode", *[f"{c}{m}" for m in mates for c in ("seq", "qual")])


def cut_pairs(one: DataFrame, two: DataFrame, params: CutParams, index: DataFrame | None = None, barcodes: DataFrame | None = None) -> DataFrame:
    """(ord, header, barcode, seq1, qual1, seq2, qual2): pairs under one header with barcode and molecular tag, cut.

    Both mates get the longer of their headers. A tag that a header already has is kept and nothing is cut for it.
    Records are matched by their ordinal in the files, also behind pairs that are dropped.
    """
    rows = zip_reads(one, two, index)
    if params.drop_all_hash:
        rows = rows.filter(~all_hash(F.col("qual1")) & ~all_hash(F.col("qual2")))
    rows = _named(rows, unified_header(F.col("header1"), F.col("header2")), params, barcodes)
    if params.tags is not None:
        rows = rows.withColumns({f"__{c}": F.col(c) for c in ("seq1", "qual1", "seq2", "qual2")})
        tagged, has = tag_pair(rows, *params.tags), _tagged(F.col("header"))
        kept = {c: F.when(has, F.col(f"__{c}")).otherwise(F.col(c)) for c in ("seq1", "qual1", "seq2", "qual2")}
        rows = tagged.withColumns(kept | {"header": F.when(has, F.col("header")).otherwise(F.concat("header", F.lit("-"), "tag"))})
    return _cut(rows, params, ("1", "2"))


def cut_singles(reads: DataFrame, params: CutParams, index: DataFrame | None = None, barcodes: DataFrame | None = None) -> DataFrame:
    """(ord, header, barcode, seq, qual): single reads with barcode and molecular tag of both ends, cut."""
    rows = reads if index is None else reads.join(index.select("ord", F.col("seq").alias("index_seq")), "ord", "left")
    if params.drop_all_hash:
        rows = rows.filter(~all_hash(F.col("qual")))
    rows = _named(rows, strip_mate(F.col("header")), params, barcodes)
    if params.tags is not None:
        first, last = params.tags
        has, inner = _tagged(F.col("header")), lambda c: F.substr(F.col(c), F.lit(first + 1), F.greatest(F.lit(0), F.length(c) - first - last))
        tag = F.concat(F.left("seq", F.lit(first)), F.right("seq", F.lit(last)))
        rows = rows.withColumns({"header": F.when(has, F.col("header")).otherwise(F.concat("header", F.lit("-"), tag)), "seq": F.when(has, F.col("seq")).otherwise(inner("seq")), "qual": F.when(has, F.col("qual")).otherwise(inner("qual"))})
    return _cut(rows, params, ("",))


def qseq_records(rows: DataFrame, run: str) -> DataFrame:
    """FASTQ records of qseq rows (lane, tile, x, y, seq, qual, passed): qualities to offset 33, "." to N."""
    header = F.concat_ws(":", F.lit(f"@{run}"), "lane", "tile", "x", "y", "passed")
    return rows.select("ord", header.alias("header"), F.translate("seq", ".", "N").alias("seq"), F.lit("+").alias("plus"), A.shift_quality(F.col("qual")).alias("qual"))


# -- alignments (ord, qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual)


def parse_names(reads: DataFrame) -> DataFrame:
    """Reads with cluster, barcode and mtag from their names, and read_number from their flags."""
    return reads.withColumns({"cluster": A.cluster_of(F.col("qname")), "barcode": A.barcode_of(F.col("qname")), "mtag": A.tag_of(F.col("qname")), "read_number": A.read_number(F.col("flag"))})


def probe_sites(design: DataFrame, flex: int) -> DataFrame:
    """(chr, side, pos, strand, mip_key): outer starts and stops of probes, each give or take flex bases.

    Where probes meet in a place the later one of the design has it.
    """
    sides = F.array(F.struct(F.lit("start").alias("side"), F.col("mip_start").alias("at")), F.struct(F.lit("stop").alias("side"), F.col("mip_stop").alias("at")))
    all_ = design.withColumn("__s", F.explode(sides)).withColumn("pos", F.explode(F.sequence(F.col("__s.at") - flex, F.col("__s.at") + flex)))
    return all_.groupBy("chr", F.col("__s.side").alias("side"), "pos", "strand").agg(F.max_by("mip_key", "ord").alias("mip_key"))


def _numbers() -> dict[str, Column]:
    """First and last base and arm lengths of probes, by their keys."""
    at = {"__start": (r":(\d+)-(\d+)/", 1), "__stop": (r":(\d+)-(\d+)/", 2), "__ext": (r"/(\d+),(\d+)", 1), "__lig": (r"/(\d+),(\d+)", 2)}
    return {c: F.regexp_extract("mip_key", *x).try_cast("int") for c, x in at.items()}


def with_numbers(reads: DataFrame) -> DataFrame:
    """Reads with the numbers in their probes' keys, for ``trim_arms`` and ``dispositions`` to share."""
    return reads.withColumns(_numbers())


def without_numbers(reads: DataFrame) -> DataFrame:
    return reads.drop(*_numbers())


def _span(reads: DataFrame) -> Column:
    """Bases of the reference that a read covers: its span, if reads have one, else by its CIGAR string."""
    return F.col("span") if "span" in reads.columns else A.reference_span(F.col("cigar"))


def assign_probes(reads: DataFrame, sites: DataFrame) -> DataFrame:
    """Reads with the key of the probe they start (or, reversed, end) at; "chr:start-stop/0,0/g" without one.

    Without one, start and stop are those of a single read, or a pair's first position and its length.
    Single reads: flag 16 is a plus probe found by its start, 0 a minus one; pairs by flag: 83 and 163
    plus, 99 and 147 minus. Reverse reads are placed by their last base.
    """
    flag = F.col("flag")
    end = F.col("pos") + _span(reads) - 1
    strand = F.when(A.is_single(flag), F.when(A.is_reverse(flag), "+").otherwise("-")).otherwise(F.when(flag.isin(83, 163), "+").otherwise("-"))
    stop = F.when(A.is_single(flag), F.lit(False)).otherwise(A.is_reverse(flag))
    placed = reads.withColumns({"__strand": strand, "__side": F.when(stop, "stop").otherwise("start"), "__at": F.when(stop, end).otherwise(F.col("pos"))})
    of = sites.select(F.col("chr").alias("rname"), F.col("side").alias("__side"), F.col("pos").alias("__at"), F.col("strand").alias("__strand"), "mip_key")
    joined = placed.join(of, ["rname", "__side", "__at", "__strand"], "left")
    other = F.format_string("%s:%d-%d/0,0/g", F.col("rname"), F.when(A.is_single(flag), F.col("pos")).otherwise(F.least("pos", "pnext")), F.when(A.is_single(flag), end + 1).otherwise(F.abs("tlen")))
    return joined.withColumn("mip_key", F.coalesce("mip_key", other)).drop("__side", "__at", "__strand")


def dispositions(reads: DataFrame, params: CollapseParams, known_probes: bool = True, trimmed: bool = False) -> DataFrame:
    """Reads with their disposition: the first case that holds, counted by ``disposition_counts``.

    Without known probes no key is off target. A pair is, if its length neither equals what the read spans
    nor is within flex of its probe's. ``trimmed``: trim_status counts.
    """
    start, stop = (F.col(c) if c in reads.columns else n for c, n in list(_numbers().items())[:2])
    length, flag = F.try_subtract(stop, start), F.col("flag")
    paired = ~A.is_single(flag) & ~F.lit(params.single_end)
    far = paired & (F.abs("tlen") != _span(reads)) & F.coalesce(F.abs(F.abs("tlen") - length) > params.flex, F.lit(False))
    bad_tag = F.rlike("mtag", F.lit("[^ATCG]")) if params.picky_tags else F.lit(False)
    clipped = F.lit(False) if not params.drop_soft_clipped else F.contains("cigar", F.lit("S")) if params.single_end else A.soft_clipped(flag, F.col("cigar"))
    off, status = (F.endswith("mip_key", F.lit("/g")) if known_probes else F.lit(False)), (F.col("trim_status") if trimmed else F.lit(0))
    column = A.disposition(F.coalesce(F.col("barcode") != "", F.lit(False)), bad_tag, F.col("rname") == "*", off, far, status, clipped, params.single_end)
    return reads.withColumn("disposition", column)


def disposition_counts(reads: DataFrame) -> DataFrame:
    return reads.groupBy("disposition").agg(F.count(F.lit(1)).alias("n_reads"))


# -- trimming probe arms off reads


def trim_arms(reads: DataFrame, exact: bool = False) -> DataFrame:
    """Reads without their probe's arms: new_pos, new_cigar, new_seq, new_qual, trim_status and
    new_size, the sum of new_cigar's lengths.

    What lies from the scan's first base to its last stays (``alignments.kept_part``).
    Status 1: a flag that has no strand; an alignment that ends in the first arm keeps "0M" and no bases.
    Status 2, if ``exact``: the bases before the scan aren't the head of first_arm, or those behind it, as far as
    the read goes, aren't the head of second_arm (a read without these columns' values passes).
    """
    flag = F.col("flag")
    numbered = "__start" in reads.columns
    reads = reads if numbered else reads.withColumns(_numbers())
    start, stop, ext, lig = map(F.col, _numbers())
    plus = F.when(A.is_single(flag), A.is_reverse(flag)).otherwise(flag.isin(83, 163))
    known = A.is_single(flag) | flag.isin(83, 163, 99, 147)
    first = F.when(plus, ext).otherwise(lig) + start
    last = stop - F.when(plus, lig).otherwise(ext)
    placed = reads.withColumns({"__first": first, "__last": last})
    at = F.col("pos").cast("int")
    cutted = placed.withColumn("__kept", A.kept_once(F.col("cigar"), F.col("__first") - at, F.col("__last") - at))
    lo, hi = F.col("__kept.begin"), F.col("__kept.end")
    none, trimmed = F.col("__kept").isNotNull() & lo.isNull(), known & (F.col("cigar") != "*")
    part = lambda c: F.when(none, "").otherwise(F.substr(F.col(c), lo + 1, hi - lo))
    text = F.col("__kept.text")
    moved = F.when(F.col("__first") > F.col("pos"), F.col("__first")).otherwise(F.col("pos"))
    status = F.when(known, 0).otherwise(1)
    if exact:
        before, behind = F.when(none, F.length("seq")).otherwise(lo).cast("int"), F.when(none, F.lit("")).otherwise(F.substr(F.col("seq"), (hi + 1).cast("int")))
        shared = F.least(F.length("second_arm"), F.length(behind))
        wrong = (F.left("seq", before) != F.left("first_arm", before)) | (F.left("second_arm", shared) != F.left(behind, shared))
        status = F.when(status == 1, 1).when(trimmed & F.coalesce(wrong, F.lit(False)), 2).otherwise(0)
    return cutted.withColumns({"trim_status": status, "new_pos": F.when(known, moved).otherwise(F.col("pos")), "new_cigar": F.when(~trimmed, F.col("cigar")).when(none, "0M").otherwise(text), "new_seq": F.when(trimmed, part("seq")).otherwise(F.col("seq")), "new_qual": F.when(trimmed, part("qual")).otherwise(F.col("qual")), "new_size": F.col("__kept.size")}).drop("__first", "__last", "__kept", *([] if numbered else _numbers()))


# -- tag groups


def tag_groups(reads: DataFrame, keys: tuple[str, ...] = ("mip_key", "barcode", "mtag")) -> DataFrame:
    """One row per tag-defined group: its reads' clusters and how many of each read number."""
    number = lambda n: F.count(F.when(F.col("read_number") == n, 1))
    return reads.groupBy(*keys).agg(F.count_distinct("cluster").alias("clusters"), number(1).alias("reads1"), number(2).alias("reads2"))


def dominant(reads: DataFrame, keys: tuple[str, ...] = ("mip_key", "barcode", "mtag", "read_number")) -> DataFrame:
    """The most frequent (pos, cigar) of each group; of equals that of the larger quality sum, then the
    larger pair. Quality sums are of Phred values; shortest is the length of its shortest read."""
    quality = F.aggregate(A.phred(F.col("qual")), F.lit(0), lambda s, q: s + q)
    length = F.min(F.length("seq")) if "seq" in reads.columns else F.lit(None).cast("int")
    counted = reads.groupBy(*keys, "pos", "cigar").agg(F.count(F.lit(1)).alias("n"), F.sum(quality).alias("quality"), length.alias("shortest"))
    best = counted.groupBy(*keys).agg(F.max(F.struct("n", "quality", "pos", "cigar", "shortest")).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in ("pos", "cigar", "n", "quality", "shortest")])


class Fold:
    """Consensus of reads, taken one by one: what ``consensus`` does to a group, for all places at once."""

    _CODES = np.full(256, len(BASES), np.uint8)
    _CODES[[ord(b) for b in BASES]] = range(len(BASES))

    def __init__(self, length: int):
        self.length, self.place = length, np.arange(length)
        self.sums = np.zeros((len(BASES) + 1, length), np.int64)  # the last, of N, stays 0
        self.lead = np.full(length, len(BASES), np.uint8)

    def add(self, seq: str, qual: str) -> None:
        """Places that seq or qual doesn't have count as N."""
        bases = self._CODES[np.frombuffer(seq[: self.length].encode("latin-1", "replace").ljust(self.length, b"N"), np.uint8)]
        values = np.frombuffer(qual[: self.length].encode("latin-1", "replace").ljust(self.length, b"!"), np.uint8).astype(np.int64) - 33
        known = bases < len(BASES)
        self.sums[bases[known], self.place[known]] += values[known]
        mine, leads = self.sums[bases, self.place], self.sums[self.lead, self.place]
        tied = known & (mine == leads) & (bases != self.lead)
        self.lead = np.where(known & (mine > leads), bases, np.where(tied, len(BASES), self.lead)).astype(np.uint8)

    def result(self) -> tuple[str, str]:
        total = 2 * self.sums[self.lead, self.place] - self.sums.sum(axis=0)
        qual = np.where(total > 40, ord("I"), np.where(total < 2, ord("#"), total + 33)).astype(np.uint8)
        return np.frombuffer(f"{BASES}N".encode(), np.uint8)[self.lead].tobytes().decode(), qual.tobytes().decode()


class _Folds:
    """``Fold`` of many groups side by side: the first read of each, then the second of each, and so on. The last
    group stays open for more reads."""

    def __init__(self) -> None:
        self.sums, self.lead = np.zeros((0, len(BASES) + 1, 0), np.int64), np.zeros((0, 0), np.uint8)
        self.n = self.quality = self.shortest = np.zeros(0, np.int64)

    def add(self, seqs: list[str], quals: list[str], new: np.ndarray) -> tuple[np.ndarray, ...] | None:
        """Reads in the order of their groups, of which new ones begin where new is true; what groups came to that are
        done, if any: number of reads, sum of qualities, shortest length, and their sequences and qualities."""
        seqs, wide = [x.encode("latin-1", "replace") for x in seqs], quals
        quals = [x.encode("latin-1", "replace") for x in quals]
        sizes, longest = np.fromiter(map(len, seqs), np.int64, len(seqs)), max(self.lead.shape[1], *map(len, seqs))
        bases = Fold._CODES[self._matrix(seqs, longest, b"N")]
        values = self._matrix(quals, longest, b"!").astype(np.int64) - 33
        total = np.fromiter((sum(q) - 33 * len(q) if w.isascii() else sum(map(ord, w)) - 33 * len(w) for q, w in zip(quals, wide, strict=True)), np.int64, len(quals))
        group = np.cumsum(new) - 1 + len(self.n)
        self._widen(int(group[-1]) + 1, longest)
        np.add.at(self.n, group, 1)
        np.add.at(self.quality, group, total)
        np.minimum.at(self.shortest, group, sizes)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        rank = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        turn = np.argsort(rank, kind="stable")
        places = np.arange(longest)
        sums = self.sums.reshape(-1)
        for rows in np.split(turn, np.cumsum(np.bincount(rank))[:-1]):
            at, mine = group[rows], bases[rows]
            start = (at * (len(BASES) + 1))[:, None]
            known, lead = mine < len(BASES), self.lead[at]
            own = (start + mine) * longest + places
            sums[own] += np.where(known, values[rows], 0)
            have, leads = sums[own], sums[(start + lead) * longest + places]
            tied = known & (have == leads) & (mine != lead)
            self.lead[at] = np.where(known & (have > leads), mine, np.where(tied, len(BASES), lead))
        return self.done(len(self.n) - 1)

    @staticmethod
    def _matrix(texts: list[bytes], longest: int, blank: bytes) -> np.ndarray:
        return np.frombuffer(b"".join(x[:longest].ljust(longest, blank) for x in texts), np.uint8).reshape(len(texts), longest)

    def _widen(self, groups: int, longest: int) -> None:
        more, wider = groups - len(self.n), longest - self.lead.shape[1]
        self.sums = np.ascontiguousarray(np.pad(self.sums, ((0, more), (0, 0), (0, wider))))
        self.lead = np.pad(self.lead, ((0, more), (0, wider)), constant_values=len(BASES))
        self.n, self.quality = np.pad(self.n, (0, more)), np.pad(self.quality, (0, more))
        self.shortest = np.pad(self.shortest, (0, more), constant_values=np.iinfo(np.int64).max)

    def done(self, groups: int) -> tuple[np.ndarray, ...] | None:
        """What the first groups came to, which are let go."""
        if groups <= 0:
            return None
        sums, lead, shortest = self.sums[:groups], self.lead[:groups], self.shortest[:groups]
        total = 2 * np.take_along_axis(sums, lead[:, None, :].astype(np.int64), 1)[:, 0] - sums.sum(axis=1)
        qual = np.where(total > 40, ord("I"), np.where(total < 2, ord("#"), total + 33)).astype(np.uint8)
        seq = np.frombuffer(f"{BASES}N".encode(), np.uint8)[lead]
        kept = np.arange(lead.shape[1]) < shortest[:, None]
        offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(shortest)]).astype(np.int32))
        texts = [pa.StringArray.from_buffers(groups, offsets, pa.py_buffer(x[kept].tobytes())) for x in (seq, qual)]
        out = self.n[:groups], self.quality[:groups], shortest, *texts
        self.sums, self.lead = self.sums[groups:].copy(), self.lead[groups:].copy()
        self.n, self.quality, self.shortest = self.n[groups:], self.quality[groups:], self.shortest[groups:]
        return out


#: Bases that are folded side by side.
CELLS = 1 << 18


def consensus(reads: DataFrame, keys: tuple[str, ...] = ("mip_key", "barcode", "mtag", "read_number"), order: str = "ord") -> DataFrame:
    """Consensus sequence and quality of each group, reads taken in order.

    All reads are cut to the shortest. At each position bases gather their qualities; a base leads as
    soon as its sum exceeds the leader's, a tie with another base puts N in the lead, whose own sum is 0.
    The quality is the leader's sum less all others'. A leader depends on what came before, so a group is read
    once in order: sorted partitions pass by in batches, and of a group only sums per position are held.
    """
    return _folded(reads.filter("seq IS NOT NULL"), keys, keys, [order]).filter("shortest > 0").select(*keys, "seq", "qual")


def consensus_of_dominant(reads: DataFrame, keys: tuple[str, ...] = ("mip_key", "barcode", "mtag", "read_number"), order: str = "ord") -> DataFrame:
    """keys, pos, cigar, seq and qual: each group's dominant place and form and the consensus of the reads that
    have it. Groups whose shortest such read is empty have empty ones."""
    best = F.max(F.struct("n", "quality", "pos", "cigar", "seq", "qual")).alias("b")
    return consensus_of_forms(reads, keys, order=order).groupBy(*keys).agg(best).select(*keys, *[F.col(f"b.{c}").alias(c) for c in ("pos", "cigar", "seq", "qual")])


def consensus_of_forms(reads: DataFrame, keys: tuple[str, ...] = ("mip_key", "barcode", "mtag", "read_number"), also: tuple[str, ...] = (), order: str = "ord") -> DataFrame:
    """keys, pos, cigar, n, quality, seq and qual: the consensus of every place and form of each group, how many reads
    have it and the sum of their Phred values. also: columns that the others determine."""
    return _folded(reads, keys, (*keys, "pos", "cigar", *also), [order, "qname"])


def _folded(rows: DataFrame, dealt: tuple[str, ...], keys: tuple[str, ...], order: list[str]) -> DataFrame:
    """keys, n, quality, shortest, seq and qual of each group, its reads taken in order."""
    names = list(keys)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folds, held = _Folds(), None  # held: the keys of the group that is open

        def made(own: pa.RecordBatch, out: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*own.columns, *[pa.array(c, pa.int64()) for c in out[:3]], *out[3:]], names=[*names, "n", "quality", "shortest", "seq", "qual"])

        for whole in batches:
            longest = pc.max(pc.utf8_length(whole["seq"])).as_py() or 1
            step = max(1, CELLS // max(1, longest, folds.lead.shape[1]))
            for i in range(0, len(whole), step):
                batch = whole.slice(i, step)
                own = batch.select(names)
                before = own if held is None else pa.Table.from_batches([held, own]).combine_chunks().to_batches()[0]
                new = _changes(before) if held is not None else np.concatenate([[True], _changes(before)])
                heads = pc.filter(own, pa.array(new))
                open_ = heads if held is None else pa.Table.from_batches([held, heads]).combine_chunks().to_batches()[0]
                out = folds.add(batch["seq"].to_pylist(), batch["qual"].to_pylist(), new)
                if out is not None:
                    yield made(open_.slice(0, len(open_) - 1), out)
                held = open_.slice(len(open_) - 1)
        if held is not None:
            yield made(held, folds.done(1))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in names], "n long, quality long, shortest long, seq string, qual string"])
    sorted_ = rows.repartition(*dealt).sortWithinPartitions(*names, *order)
    return sorted_.select(*names, "seq", F.coalesce("qual", F.lit("")).alias("qual")).mapInArrow(fold, schema)


def _changes(rows: pa.RecordBatch) -> np.ndarray:
    """Whether each row but the first differs from the one before it; nulls are equal."""
    n = max(0, len(rows) - 1)
    out = np.zeros(n, bool)
    for c in rows.columns:
        a, b = c.slice(0, n), c.slice(1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        out |= differ.to_numpy(zero_copy_only=False)
    return out


def chosen_read(reads: DataFrame, keys: tuple[str, ...] = ("mip_key", "barcode", "mtag", "read_number"), seed: int = 0) -> DataFrame:
    """One read per group by a seeded hash of its name, where tags are too few for a consensus; of one name the
    first that arrived."""
    ties = [F.col("ord")] if "ord" in reads.columns else []
    best = F.min_by(F.struct(*reads.columns), F.struct(F.xxhash64(F.lit(seed), F.col("qname")), F.col("qname"), *ties))
    return reads.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(best.alias("r")).select("r.*")


def mate_fields(pairs: DataFrame) -> DataFrame:
    """Both mates of a group as rows again, each with its mate's position and the signed length."""
    length = F.greatest(F.col("pos1") + F.col("span1"), F.col("pos2") + F.col("span2")) - F.least("pos1", "pos2")
    sign = lambda c: F.when(F.col(c).isin(99, 163), 1).otherwise(-1)
    both = F.array(*[F.struct(F.lit(n).alias("read_number"), F.col(f"flag{n}").alias("flag"), F.col(f"pos{n}").alias("pos"), F.col(f"pos{3 - n}").alias("pnext"), (length * sign(f"flag{n}")).alias("tlen")) for n in (1, 2)])
    return pairs.withColumn("__r", F.explode(both)).select(*[c for c in pairs.columns if c[-1] not in "12"], "__r.*")


def with_read_group(tags: Column, group: Column) -> Column:
    """Optional fields of a SAM line with a read group where they have none."""
    return F.when(F.contains(tags, F.lit("RG:Z:")), tags).when(tags == "", F.concat(F.lit("RG:Z:"), group)).otherwise(F.concat(tags, F.lit("\tRG:Z:"), group))
