import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import alignments as A
from strandloom.operators import collapse as C
from strandloom.operators import complexity
from strandloom.operators import reads as R
from strandloom.params import CollapseParams
from strandloom.plans import read_queries
from strandloom.sources import readers, writers
from strandloom.streaming import sites
from strandloom.streaming.collapse import run_once
from strandloom.tables import written

SCHEMA = "ord long, qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags string"
PROBES = [("1", 1000, "+"), ("1", 1090, "-"), ("1", 4000, "+"), ("2", 500, "-"), ("2", 9000, "+")]
EXT, LIG, LENGTH = 17, 23, 150
BACK = str.maketrans("ACGT", "TGCA")


def _span(cigar):
    return sum(n for n, op in C._operations(cigar) if op in "MD")


def _design(rng):
    rows = []
    for i, (chrom, start, strand) in enumerate(PROBES):
        stop = start + LENGTH - 1
        arms = ["".join(rng.choice("ACGT") for _ in range(n)) for n in ((EXT, LIG) if strand == "+" else (LIG, EXT))]
        rows.append((f"{chrom}:{start}-{stop}/{EXT},{LIG}/{strand}", chrom, start, stop, strand, i, *arms))
    return rows


def _reads(rng, design, n=400):
    rows = []
    for i in range(n):
        key, chrom, start, stop, strand, _, first, second = rng.choice(design)
        barcode, tag = rng.choice(["ACGTAC", "ACGTAC", "TTGGCC", "TTGGCA", "GGGGGG", ""]), "".join(rng.choice("AC") for _ in range(3))
        if rng.random() < 0.03:
            tag = "AN" + tag
        name = f"c{i}#{barcode}-{tag}"
        flags = (163, 83) if strand == "+" else (99, 147)
        cigars = [rng.choice(["60M", "60M", "60M", "30M2I28M", "30M1D30M", "17M3I40M", "4S56M", "60S"]) for _ in range(2)]
        seqs = []
        for cigar, left in zip(cigars, (True, False)):
            bases = sum(m for m, op in C._operations(cigar) if op in "MIS")
            seq = "".join(rng.choice("ACGTN") if rng.random() < 0.03 else "ACGT"[(i * 7 + j) % 4] if rng.random() < 0.02 else "ACGT"[j % 4] for j in range(bases - (rng.random() < 0.02)))
            seq = first + seq[len(first) :] if left else seq[: -len(second)] + second
            seqs.append(seq[:bases])
        ends = (start, stop - _span(cigars[1]) + 1)
        for k in (0, 1):
            if rng.random() < 0.06:
                continue
            flag, pos, mate = flags[k], ends[k], ends[1 - k]
            odd = rng.random()
            flag = 81 if odd < 0.02 else flag
            chrom_, rnext = ("*" if 0.02 < odd < 0.03 else chrom), ("2x" if 0.03 < odd < 0.05 else "=")
            pos = pos + 40 if 0.05 < odd < 0.07 else pos
            seq = "T" + seqs[k][1:] if odd > 0.95 else seqs[k]
            qual = "".join(chr(33 + rng.randint(0, 40)) for _ in seq)
            rows.append([name, flag, chrom_, pos, 60, cigars[k], rnext, mate, (LENGTH if k == 0 else -LENGTH), seq, qual, "NM:i:0"])
    rows.sort(key=lambda r: (r[2], r[3]))
    return [(i, *r) for i, r in enumerate(rows)]


BARCODES = [("sampleA", "ACGTAC", 0), ("sampleB", "TTGGCC", 1)]


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(21)
    design = _design(rng)
    rows = _reads(rng, design)
    return (
        spark.createDataFrame(design, "mip_key string, chr string, mip_start int, mip_stop int, strand string, ord int, first_arm string, second_arm string"),
        spark.createDataFrame(BARCODES, "label string, sequence string, ord int"),
        spark.createDataFrame(rows, SCHEMA),
        design,
        rows,
    )


def _rows(df):
    return sorted(tuple(r[c] for c in (*C.SAM, *C.OUT)) for r in df.collect())


def _plain(annotated, params):
    """Sites answered one by one from collected reads."""
    by_site = {}
    drawn = annotated.filter("disposition = 'on_target'").withColumn("draw", F.xxhash64(F.lit(params.seed), F.col("qname")))
    for r in drawn.collect():
        by_site.setdefault((r.mip_key, r.barcode), []).append(r.asDict())
    rows, counts = [], []
    for (key, _), own in by_site.items():
        found, total, unique = C.site_reads(own, params)
        rows += [tuple(r[c] for c in (*C.SAM, *C.OUT)) for r in found]
        counts.append((own[0]["sample"], key, total, unique))
    return sorted(rows), sorted(counts)


@pytest.mark.parametrize("options", [{}, {"confidence": 0.999}, {"tolerant": True, "picky_tags": True}, {"exact_arms": True}, {"trim": False, "drop_soft_clipped": False}, {"single_end": True}])
def test_collapse_against_plain_sites(spark, world, options):
    design, barcodes, reads, *_ = world
    params = CollapseParams(tag_size=5, flex=1, **options)
    annotated = written(C.annotate(reads, params, design, barcodes), "annotated")
    got = C.collapse(annotated, params)
    rows, counts = _plain(annotated, params)
    assert _rows(got.reads) == rows
    assert sorted((r["sample"], r.mip, r.total, r.unique) for r in C.complexity(annotated.filter("disposition = 'on_target'")).collect()) == counts
    assert "unique" in {r["route"] for r in got.reads.select("route").distinct().collect()}
    pairs = [r for r in got.reads.filter("route = 'unique'").collect()]
    if not options.get("single_end"):
        by_group = {}
        for r in pairs:
            by_group.setdefault((r.mip_key, r.barcode, r.mtag), {})[r.read_number] = r
        for own in by_group.values():
            assert own[1].pnext == own[2].pos and own[2].pnext == own[1].pos and own[1].tlen == -own[2].tlen


def test_options_change_the_reads(spark, world):
    design, barcodes, reads, *_ = world
    count = lambda **o: {r["disposition"]: r["n_reads"] for r in R.disposition_counts(C.annotate(reads, CollapseParams(flex=1, **o), design, barcodes)).collect()}
    plain, exact, tolerant, kept = count(), count(exact_arms=True), count(tolerant=True), count(drop_soft_clipped=False)
    assert exact["imperfect_arms"] > 0 and "imperfect_arms" not in plain
    assert tolerant["skipped"] < plain["skipped"] and "soft_clipped" not in kept
    assert plain["unmapped"] and plain["improper"] and plain["discordant"] and plain["off_target"]
    free = C.collapse(C.annotate(reads, CollapseParams(flex=1, collapse_free=True), design, barcodes), CollapseParams(collapse_free=True))
    assert free.reads.count() == plain["on_target"] == free.complexity.agg(F.sum("total")).first()[0]
    keyed = C.annotate(reads.withColumn("rname", F.lit("1:1000-1149/17,23/+")), CollapseParams(key_by_reference=True))
    assert {r.mip_key for r in keyed.select("mip_key").distinct().collect()} == {"1:1000-1149/17,23/+"}
    table = C.summary(C.collapse(C.annotate(reads, CollapseParams(flex=1), design, barcodes), CollapseParams(flex=1)).complexity, design)
    assert table.filter("sample = 'ALL_SAMPLES'").count() == len(PROBES) + 1 and table.filter("mip = 'ALL_POSITIONS'").count() == 3


def _walked(cigar, pos, seq, first, last):
    """Bases of a read between two reference positions, by walking it base by base."""
    at, read, kept = pos, 0, []
    for n, op in C._operations(cigar):
        for _ in range(n):
            if op in "M=X":
                if first <= at <= last:
                    kept.append((op, seq[read : read + 1]))
                at, read = at + 1, read + 1
            elif op in "IS":
                if (at >= first and at <= last) and (at > first or kept or at >= first):
                    kept.append((op, seq[read : read + 1]))
                read += 1
            elif op == "D":
                if first <= at <= last:
                    kept.append((op, ""))
                at += 1
    return "".join(b for _, b in kept), read


def test_arms_are_cut_at_the_scan(spark):
    key = "1:100-249/20,25/+"
    rows = [("60M", 100, 163), ("20M2I38M", 100, 163), ("10M3D50M", 100, 163), ("25M35M", 100, 163), ("60M", 190, 83), ("30M5D30M", 185, 83), ("15M", 100, 163), ("40M4I16M", 190, 83), ("60M", 90, 163)]
    seq = "ACGTTGCAAC" * 6
    df = spark.createDataFrame([(i, c, p, f, key, seq[: sum(n for n, op in C._operations(c) if op in "MIS")]) for i, (c, p, f) in enumerate(rows)], "i int, cigar string, pos int, flag int, mip_key string, seq string").withColumn("qual", F.col("seq"))
    for r in R.trim_arms(df).collect():
        want, _ = _walked(r.cigar, r.pos, r.seq, 120, 224)
        assert (r.trim_status, r.new_seq) == (0, want), r
        assert r.new_qual == r.new_seq and r.new_pos == max(r.pos, 120)


def test_exact_arms(spark):
    key, first, second = "1:100-249/20,25/+", "ACGTTGCAACACGTTGCAAC", "GATTACAGATTACAGATTACAGATT"
    scan = "TTTTTTTTTT" * 10
    whole = first + scan[:105] + second if len(scan) >= 105 else first + (scan + "TTTTT")[:105] + second
    cases = [("60M", 100, 163, whole[:60], 0), ("60M", 100, 163, "T" + whole[1:60], 2), ("60M", 190, 83, whole[90:150], 0), ("60M", 190, 83, whole[90:149] + "A", 2), ("40M", 190, 83, whole[90:130], 0), ("40M", 190, 83, whole[90:129] + "C", 2), ("60M", 100, 81, whole[:60], 1)]
    df = spark.createDataFrame([(i, c, p, f, key, s, s, first, second) for i, (c, p, f, s, _) in enumerate(cases)], "i int, cigar string, pos int, flag int, mip_key string, seq string, qual string, first_arm string, second_arm string")
    got = {r.i: r.trim_status for r in R.trim_arms(df, exact=True).collect()}
    assert [got[i] for i in range(len(cases))] == [c[-1] for c in cases]


def test_empty_and_null_reads(spark, world):
    design, barcodes, reads, *_ = world
    params = CollapseParams(flex=1)
    for df in (reads.limit(0), spark.createDataFrame([(None,) * 13] * 2, SCHEMA)):
        annotated = C.annotate(df, params, design, barcodes)
        assert annotated.count() == df.count() and annotated.filter("disposition IS NULL").count() == 0
        assert C.collapse(annotated, params).reads.count() == 0


def test_streamed_sites_equal_the_batch(spark, world, tmp_path):
    design, barcodes, reads, _, rows = world
    params = CollapseParams(flex=1)
    offsets = spark.createDataFrame([("1", 0), ("2", 20_000)], "rname string, offset long")
    rng, schema = random.Random(4), reads.schema
    cuts = [r for r in rows if r[3] != "*"] + [r for r in rows if r[3] == "*"]
    parts = [cuts[i : i + 150] for i in range(0, len(cuts), 150)]
    for i, part in enumerate(parts):
        rng.shuffle(part)  # mixed within a micro-batch
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:03d}"))
    sites.end_of_input(spark, schema).coalesce(1).write.parquet(str(tmp_path / "in" / "999"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        run_once(sites.collapse_sites(stream, params, offsets, design, barcodes, delay=400), str(tmp_path / "out"), str(tmp_path / "state"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    out = spark.read.parquet(str(tmp_path / "out"))
    annotated = C.annotate(reads, params, design, barcodes)
    batch = C.collapse(annotated, params)
    assert _rows(out.filter("route <> 'site'")) == _rows(batch.reads)
    got = sorted((r["sample"], r.mip_key, r.total, r.unique) for r in out.filter("route = 'site'").collect())
    assert got == sorted((r["sample"], r.mip, r.total, r.unique) for r in C.complexity(annotated.filter("disposition = 'on_target'")).collect())


def test_the_query_against_plain_sites(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, rng.randint(1, 12), rng.choice(["click", "view", "buy"])) for i in range(400)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    params = CollapseParams(flex=1, tag_size=3, tolerant=True, confidence=0.5)
    inputs = read_queries.sequenced(spark, str(tmp_path))
    rows, counts = _plain(written(C.annotate(inputs[0], params, *inputs[1:]), "annotated"), params)
    got = read_queries.collapsed_reads(spark, str(tmp_path))
    kept = [i for i, c in enumerate((*C.SAM, *C.OUT)) if c not in ("tags", "mapq", "rnext")]
    names = [c for c in (*C.SAM, *C.OUT) if c not in ("tags", "mapq", "rnext")]
    a, b = sorted(tuple(r[c] for c in names) for r in got.collect()), sorted(tuple(r[i] for i in kept) for r in rows)
    assert a == b
    assert {r["route"] for r in got.select("route").distinct().collect()} == {"unique", "unpaired", "strange"}
    total = {(r["sample"], r.mip): (r.total, r.unique) for r in read_queries.collapse_summary(spark, str(tmp_path)).collect()}
    assert total["ALL_SAMPLES", "ALL_POSITIONS"] == (sum(c[2] for c in counts), sum(c[3] for c in counts))


def test_collapsed_reads_are_written_by_route_or_sample(spark, world, tmp_path):
    design, barcodes, reads, *_ = world
    params = CollapseParams(flex=1)
    found = C.collapse(C.annotate(reads, params, design, barcodes), params).reads
    counts = {(r["sample"], r["route"]): r["count"] for r in found.groupBy("sample", "route").count().collect()}
    for split in (False, True):
        path = str(tmp_path / str(split))
        writers.write_collapsed(found, path, split)
        sizes = {r.disposition: r["count"] for r in spark.read.text(path).groupBy("disposition").count().collect()}
        want = {}
        for (sample, route), n in counts.items():
            folder = f"{sample}.{route}" if split and route == "unique" else route
            want[folder] = want.get(folder, 0) + n
        assert sizes == want
    back, _ = readers.read_sam(spark, str(tmp_path / "False"))
    assert sorted(r.qname for r in back.collect()) == sorted(r.qname for r in found.collect())


def test_alignments_are_walked_once_a_read(spark, world):
    design, barcodes, reads, *_ = world
    on = C.annotate(reads, CollapseParams(flex=1), design, barcodes).filter("disposition = 'on_target'")
    plan = on._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "lambda" not in plan  # each copy of such a walk is paid again
    assert plan.count("ArrowEvalPython [") == 2


def test_kept_part_against_a_walk():
    rng = random.Random(3)
    for _ in range(500):
        cigar = "".join(f"{rng.randint(0, 6)}{rng.choice('MMMIDNSHP=X')}" for _ in range(rng.randint(1, 6)))
        low, high = rng.choice([None, rng.randint(-3, 12)]), rng.choice([None, rng.randint(-3, 20)])
        ref = read = 0
        bases, ops = [], []
        for n, op in A.operations(cigar):
            for _ in range(n):
                inside = (low is None or ref >= low) and (high is None or ref <= high)
                if inside and op != "H":
                    ops.append(op)
                    bases += [read] if op in "MIS=X" else []
                read, ref = read + (op in "MIS=X"), ref + (op in "MDN=X")
        begin, end, text, size = A.kept_part(cigar, low, high)
        assert (begin, end) == ((bases[0], bases[-1] + 1) if bases else (None, None)), (cigar, low, high)
        assert "".join(op * n for n, op in A.operations(text)) == "".join(ops) and size == len(ops)


def test_folds_side_by_side_equal_one_by_one():
    rng = random.Random(6)
    groups = [[("".join(rng.choice("AACGTN") for _ in range(rng.randint(0, 9))), "".join(chr(33 + rng.randint(0, 30)) for _ in range(rng.randint(0, 9)))) for _ in range(rng.choice([1, 1, 2, 5, 40]))] for _ in range(60)]
    rows = [(seq, qual, i == 0) for own in groups for i, (seq, qual) in enumerate(own)]
    folds, found = R._Folds(), []
    keep = lambda out: found.extend(zip(*[c.tolist() for c in out], strict=True)) if out is not None else None
    at = 0
    while at < len(rows):
        part = rows[at : at + rng.randint(1, 30)]
        at += len(part)
        keep(folds.add([r[0] for r in part], [r[1] for r in part], np.array([r[2] for r in part])))
    keep(folds.done(1))
    for own, got in zip(groups, found, strict=True):
        fold = R.Fold(min(len(seq) for seq, _ in own))
        for seq, qual in own:
            fold.add(seq, qual)
        assert got == (len(own), sum(ord(c) - 33 for _, q in own for c in q), fold.length, *fold.result())


def test_groups_over_many_batches(spark):
    rows = [(g, i, 1, "60M" if i % 3 else "30M", f"r{i}", "ACGT"[(i + g) % 4] * (5 + g % 3), "5" * (5 + g % 3)) for g in range(40) for i in range(1 + 7 * (g % 4))]
    df = spark.createDataFrame(rows, "g int, ord int, pos int, cigar string, qname string, seq string, qual string").repartition(3)
    whole = sorted(map(tuple, R.consensus_of_dominant(df, ("g",)).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert sorted(map(tuple, R.consensus_of_dominant(df, ("g",)).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(whole) == 40 and {len(r[3]) for r in whole} == {5, 6, 7}


def test_summary_counts_reads_once_and_searches_pools_once(spark, world):
    design, barcodes, reads, *_ = world
    on = C.annotate(reads, CollapseParams(flex=1), design, barcodes).filter("disposition = 'on_target'")
    found = C.summary(C.complexity(on), design)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "cluster" not in plan and "mtag" not in plan
    pool = spark.range(1).select(complexity.pool_size(F.col("id") + 50, F.col("id") + 30).alias("p"))
    assert pool._jdf.queryExecution().optimizedPlan().toString().lower().count("power(") == 1
    at, n, u = pool.first().p, 50, 30
    assert abs(at * (1 - (1 - 1 / at) ** n) - u) < 1e-9
