import math
import functools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import alignments as A
from strandloom.functions import scores, sequences
from strandloom.operators import complexity, genome, intervals, probes, reads, svm, tiling
from strandloom.params import CollapseParams, DesignParams, parse_options
from strandloom.sources import readers, writers
from strandloom.streaming import collapse

RC = str.maketrans("ACGT", "TGCA")


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# -- sequences and scores


def test_sequence_functions(spark):
    lit = F.lit
    assert _one(spark, sequences.reverse_complement(lit("AACGTN"))) == "NACGTT"
    assert _one(spark, sequences.count_overlapping(lit("AAAA"), "AA")) == 3
    assert _one(spark, sequences.is_palindrome(lit("ACGT"))) and not _one(spark, sequences.is_palindrome(lit("AAGT")))
    assert _one(spark, sequences.base_runs(lit("GGCATTTG"))) == 3
    assert _one(spark, sequences.share_of_bases(lit("GGCA"), "GC")) == 0.75
    assert _one(spark, sequences.masked_share(lit("NNAC"), lit("ACGTAC"))) == 0.2
    assert _one(spark, sequences.wrapped(lit("A" * 150), 70)) == ["A" * 70, "A" * 70, "A" * 10]
    assert len(sequences.mers(2)) == 20 and len(sequences.mers(3)) == 84 and len(scores.PROFILE_MERS) == 44


def test_profile_names_each_pair_of_strands_once():
    named = set(scores.PROFILE_MERS)
    for mer in sequences.mers(3):
        back = mer[::-1].translate(RC)
        assert (mer in named) + (back in named) == (2 if mer == back else 1)


def _logistic(ext, lig, target, ce, cl):
    share = lambda s, bases: sum(c in bases for c in s) / len(s)
    runs = 1 + sum((a in "GC") != (b in "GC") for a, b in zip(target, target[1:]))
    log = lambda n: 2.0 if n > 100 else math.log10(n)
    value = {"bps": len(target) / runs, "el": len(ext), "ll": len(lig), "tl": min(250, len(target)), "j": scores.JUNCTION.get(lig[:2], 0.0), "ce": log(ce), "cl": log(cl)}
    for p, s in (("e", ext), ("l", lig), ("t", target)):
        value |= {p + "g": share(s, "G"), p + "GC": share(s, "GC"), p + "a": share(s, "A")}
    x = scores.INTERCEPT + sum(c * math.prod(value[n] for n in names) for names, c in scores.terms())
    return scores.POWER_BASE**x / (1 + scores.POWER_BASE**x)


def test_logistic_score_against_arithmetic(spark):
    rng = random.Random(3)
    seq = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    rows = [(seq(rng.randint(16, 27)), seq(rng.randint(18, 29)), seq(120), rng.randint(1, 300), rng.randint(1, 50)) for _ in range(30)] + [("ACGTN", "ACGT", "ACGT", 1, 1)]
    df = spark.createDataFrame(rows, "ext_probe_sequence string, lig_probe_sequence string, scan_target_sequence string, ext_probe_copy int, lig_probe_copy int")
    got = [r.score for r in probes.scored(df).collect()]
    assert got[-1] == scores.UNJUDGED
    assert np.allclose(got[:-1], [_logistic(*r) for r in rows[:-1]], rtol=1e-9)


def test_feature_vector_has_192_entries(spark):
    vector = scores.feature_vector(F.lit("ACGTACGTACGTACGT"), F.lit("GCTAGCTAGCTAGCTAGC"), F.lit("ACGT" * 30), F.lit(1), F.lit(101), scores.profile(F.lit("ACGT" * 10), F.lit(1), F.lit(40)))
    got = _one(spark, vector)
    assert len(got) == 192 and got[-1] == 2.0 and got[-2] == 0.0 and got[-18:-2].count(1.0) == 1
    assert _one(spark, scores.feature_vector(F.lit("AN"), F.lit("GC"), F.lit("AC"), F.lit(1), F.lit(1), F.array(*[F.lit(1.0)] * 44))) == [0.0] * 192


# -- intervals and genome


def test_merge_targets(spark):
    rows = [("1", 100, 200, "a", 0), ("1", 259, 300, "b", 1), ("1", 360, 400, "c", 2), ("10", 5, 9, "d", 3), ("1", 120, 150, "n", 4)]
    got = intervals.merge_targets(spark.createDataFrame(rows, "chr string, start int, stop int, label string, ord int")).orderBy("chr", "start").collect()
    assert [(r.chr, r.start, r.stop, r.label) for r in got] == [("1", 101, 300, "b"), ("1", 361, 400, "c"), ("10", 6, 9, "d")]


def test_subtract_islands_and_coverage_against_sets(spark):
    rng = random.Random(5)
    spans = [(k, s, s + rng.randint(0, 30)) for k in "ab" for s in (rng.randint(0, 200) for _ in range(20))]
    holes = [(k, s, s + rng.randint(0, 8)) for k in "ab" for s in (rng.randint(0, 200) for _ in range(25))]
    df = lambda rows: spark.createDataFrame(rows, "k string, start int, stop int")
    numbered = spark.createDataFrame([(i, *r) for i, r in enumerate(spans)], "i int, k string, start int, stop int")
    got = {}
    for r in intervals.subtract(numbered, df(holes), ["k"], 16).collect():
        got.setdefault(r.i, set()).update(range(r.start, r.stop + 1))
    for i, (k, s, e) in enumerate(spans):
        assert got.get(i, set()) == set(range(s, e + 1)) - {p for hk, hs, he in holes if hk == k for p in range(hs, he + 1)}
    runs = intervals.islands(intervals.positions(df(spans)), ["k"]).collect()
    assert {(r.k, p) for r in runs for p in range(r.start, r.stop + 1)} == {(k, p) for k, s, e in spans for p in range(s, e + 1)}
    pairs = intervals.overlap_join(df(spans), df(holes).toDF("k", "hs", "he"), ["k"], 16, ("start", "stop", "hs", "he"))
    assert pairs.count() == sum(a[0] == b[0] and a[1] <= b[2] and b[1] <= a[2] for a in spans for b in holes)


def test_kmers_and_uniqueness(spark):
    rng = random.Random(6)
    seqs = [(i, "".join(rng.choice("ACGT") for _ in range(n))) for i, n in enumerate((60, 5, 80, 0))] + [(9, "ACGT" * 10)]
    df = spark.createDataFrame(seqs, "chr int, seq string")
    count = {}
    for _, s in seqs:
        for i in range(len(s) - 5):
            k = s[i : i + 6]
            name = min(k, k[::-1].translate(RC))
            count[name] = count.get(name, 0) + 1
    assert {r.kmer: r.copies for r in genome.copy_numbers(df, 6).collect()} == count
    unique = {(r.chr, r.start) for r in genome.unique_windows(df, 6).collect()}
    assert unique == {(c, i + 1) for c, s in seqs for i in range(len(s) - 5) if count[min(s[i : i + 6], s[i : i + 6][::-1].translate(RC))] == 1}
    kmers = {s[i : i + 6] for _, s in seqs for i in range(len(s) - 5)}
    both = kmers | {k[::-1].translate(RC) for k in kmers}
    near = {k: sum(sum(a != b for a, b in zip(k, o)) == 1 for o in both) for k in kmers}
    assert {r.kmer: r.near for r in genome.near_windows(df, 6).collect()} == {k: n for k, n in near.items() if n}


# -- probes and tiling


PARAMS = DesignParams(min_capture_size=70, max_capture_size=80, capture_increment=10, arm_length_sums=(40,), max_arm_copy_product=10**6, target_arm_copy=10**3)


def _feature(spark, size=260, start=90, stop=170, chromosome="7"):
    rng = random.Random(7)
    seq = "".join(rng.choice("ACGT") for _ in range(size))
    return seq, spark.createDataFrame([(1, chromosome, "gene", seq, 1, size, start, stop)], "feature_id long, chr string, label string, seq string, seq_start int, seq_stop int, start_f int, stop_f int")


def test_candidates_geometry(spark):
    seq, feature = _feature(spark)
    rows = probes.with_sequences(probes.candidate_bounds(feature, PARAMS), PARAMS).collect()
    assert len({(r.mip_key, r.capture_size) for r in rows}) == len(rows) > 1000
    for r in rows[::97]:
        ext, lig, scan = seq[r.ext_probe_start - 1 : r.ext_probe_stop], seq[r.lig_probe_start - 1 : r.lig_probe_stop], seq[r.scan_start - 1 : r.scan_stop]
        if r.strand == "-":
            ext, lig, scan = (x[::-1].translate(RC) for x in (ext, lig, scan))
            assert r.lig_probe_stop + 1 == r.scan_start and r.ext_probe_start == r.scan_stop + 1
        assert (r.ext_probe_sequence, r.lig_probe_sequence, r.scan_target_sequence) == (ext, lig, scan)
        assert len(ext) == r.ext_len and len(lig) == r.lig_len and r.mip_stop - r.mip_start + 1 == r.capture_size
        assert r.mip_sequence == lig + PARAMS.backbone + "N" * 5 + ext


def _condense_model(rows, p):
    """The fold in plain Python over one place's candidates, last made first."""
    best = None
    for r in sorted(rows, key=lambda r: -r["generation"]):
        copies = max(r["e"], r["l"])
        if r["e"] * r["l"] > p.max_arm_copy_product or r["bad"]:
            continue
        if best is None:
            best, mask, count = r, r["mask"], copies
        elif (r["mask"] > p.masked_arm_threshold and r["mask"] < mask) or (copies > p.target_arm_copy and copies < count):
            best, mask, count = r, r["mask"], copies
        elif copies <= p.target_arm_copy:
            if (r["score"] < p.lower_limit and r["score"] > best["score"]) or (r["score"] > p.lower_limit and r["snp"] < best["snp"]):
                best, mask, count = r, r["mask"], copies
            elif r["score"] > p.lower_limit and r["snp"] == best["snp"] and r["score"] > best["score"]:
                best = r
                if r["score"] > p.upper_limit:
                    break
    return best and best["generation"]


def test_condense_against_plain_fold(spark):
    rng = random.Random(8)
    p = DesignParams(target_arm_copy=20, max_arm_copy_product=75)
    rows = [{"place": i % 60, "generation": i // 60, "score": round(rng.random() ** 0.2, 3), "snp": rng.randint(0, 2), "e": rng.choice([1, 2, 25, 40]), "l": rng.choice([1, 2, 3]), "mask": rng.choice([0.0, 0.3, 0.6, 0.8]), "bad": rng.random() < 0.1} for i in range(1200)]
    df = spark.createDataFrame([(1, r["place"], "+", r["generation"], r["score"], r["snp"], r["e"], r["l"], r["mask"], r["bad"]) for r in rows], "feature_id long, scan_start int, strand string, generation int, score double, snp_count int, ext_probe_copy int, lig_probe_copy int, arm_fraction_masked double, mapping_failed boolean")
    got = {r.scan_start: r.generation for r in probes.condense(df, p).collect()}
    want = {k: _condense_model([r for r in rows if r["place"] == k], p) for k in range(60)}
    assert got == {k: v for k, v in want.items() if v is not None}


@pytest.mark.parametrize("options", [{}, {"double_tile_strand_unaware": True}, {"double_tile_strands_separately": True}, {"seal_both_strands": True}])
def test_tiling_covers_or_reports(spark, options):
    p = DesignParams(**{**PARAMS.__dict__, **options})
    _, feature = _feature(spark)
    rows = probes.with_sequences(probes.candidate_bounds(feature, p), p).withColumns({"ext_probe_copy": F.lit(1), "lig_probe_copy": F.lit(1), "mapping_failed": F.lit(False), "snp_count": F.lit(0), "arm_fraction_masked": F.lit(0.0), "score": F.rand(4)})
    condensed = spark.createDataFrame(probes.condense(rows, p).drop("seq", "rc").toPandas())
    picks = tiling.pick(condensed, p).toPandas().merge(condensed.toPandas(), on=["feature_id", "scan_start", "strand"])
    gaps = tiling.uncovered(condensed, p).toPandas()
    for name, kind in (("first", "coverage_failed"), ("minus", "minus_strand_failed"), ("double", "double_tile_failed")):
        own = picks[picks.phase.str.startswith(name) & ~((name == "minus") & picks.phase.str.startswith("minus_double"))]
        if name == "first" or len(own):
            covered = {q for r in own.itertuples() for q in range(r.scan_start, r.scan_stop + 1)} | {q for g in gaps[gaps.kind == kind].itertuples() for q in range(g.start, g.stop + 1)}
            assert set(range(90, 171)) <= covered
    for strand in "+-":
        bases = [b for r in picks[picks.strand == strand].itertuples() for b in [*range(r.ext_probe_start, r.ext_probe_stop + 1), *range(r.lig_probe_start, r.lig_probe_stop + 1)]]
        assert len(bases) == len(set(bases))


def test_tiling_of_near_and_far_features(spark):
    """Features whose probes compete are tiled in turn; those far apart give the same as each alone."""
    p = DesignParams(min_capture_size=60, max_capture_size=60, arm_length_sums=(40,))

    def rows(feature, start):
        made = []
        for place in range(start - 30, start + 60):
            for strand in "+-":
                left, right = (18, 22) if strand == "+" else (22, 18)
                one, two = (place - left, place - 1), (place + 20, place + 19 + right)
                ext, lig = (one, two) if strand == "+" else (two, one)
                made.append(("1", feature, start, start + 50, place, place + 19, strand, 0.99, 0, *ext, *lig, 1, 1, 0.0))
        return made

    schema = "chr string, feature_id long, start_f int, stop_f int, scan_start int, scan_stop int, strand string, score double, snp_count int, ext_probe_start int, ext_probe_stop int, lig_probe_start int, lig_probe_stop int, ext_probe_copy int, lig_probe_copy int, arm_fraction_masked double"
    picks = lambda *own: [(r.feature_id, r.scan_start, r.strand, r.phase) for r in tiling.pick(spark.createDataFrame([x for o in own for x in o], schema), p).orderBy("number").collect()]
    one, near, far = rows(1, 1000), rows(2, 1055), rows(3, 9000)
    assert picks(one, far) == picks(one) + picks(far)
    assert picks(one, near)[: len(picks(one))] == picks(one) != [] and picks(one, near) != picks(one) + picks(near)


def test_variants(spark):
    seq, feature = _feature(spark)
    rows = probes.with_sequences(probes.candidate_bounds(feature, PARAMS), PARAMS)
    probe = rows.filter("strand = '-'").first()
    at = probe.ext_probe_start + 3
    base = seq[at - 1]
    snps = spark.createDataFrame([("7", at, base + base.translate(str.maketrans("ACGT", "CATG")))], "chr string, pos int, alleles string")
    got = probes.with_variants(rows.filter((F.col("mip_key") == probe.mip_key) & (F.col("capture_size") == probe.capture_size)), snps, ["feature_id", "mip_key"]).first()
    turned = base.translate(str.maketrans("ACGT", "CATG")).translate(RC)
    i = probe.ext_probe_stop - at
    assert got.snp_count == 1 and not got.snp_failed
    assert got.snp_ext_sequence == probe.ext_probe_sequence[:i] + turned + probe.ext_probe_sequence[i + 1 :] and got.snp_lig_sequence == probe.lig_probe_sequence


# -- reads


def test_names_cigars_and_clips(spark):
    assert _one(spark, A.barcode_of(F.lit("r1#ACGT-TTGCA"))) == "ACGT" and _one(spark, A.tag_of(F.lit("r1#ACGT-TTGCA"))) == "TTGCA"
    assert _one(spark, A.cluster_of(F.lit("r5:7/1"))) == "r5:7"
    assert _one(spark, A.reference_span(F.lit("10M2I3D5M"))) == 18 and _one(spark, A.read_span(F.lit("10M2I3D5M"))) == 17
    assert _one(spark, A.soft_clipped(F.lit(163), F.lit("5S10M"))) and not _one(spark, A.soft_clipped(F.lit(163), F.lit("10M5S")))
    assert _one(spark, A.shift_quality(F.lit("hB"))) == "I#"


def _vote(state, vote):
    """Leader and sums after one more base: ahead of the leader it leads, level with another's sum none does."""
    (lead, sums), (base, quality) = state, vote
    sums = {**sums, base: sums.get(base, 0) + quality}
    ahead = sums[base] - sums.get(lead, 0)
    return (base if ahead > 0 else lead if ahead < 0 or base == lead else "N"), sums


def _consensus_model(group):
    out = []
    for column in zip(*[list(zip(s, (ord(c) - 33 for c in q))) for s, q in group]):
        lead, sums = functools.reduce(_vote, [v for v in column if v[0] != "N"], ("N", {}))
        margin = 2 * sums.get(lead, 0) - sum(sums.values())
        out.append((lead, chr(33 + margin) if 2 <= margin <= 40 else "#I"[margin > 40]))
    return tuple("".join(x) for x in zip(*out))


def test_consensus_against_plain_fold(spark):
    rng = random.Random(9)
    groups = {g: [("".join(rng.choice("ACGTN") for _ in range(n)), "".join(rng.choice("#+5?I") for _ in range(n))) for n in [rng.randint(5, 9) for _ in range(rng.randint(1, 6))]] for g in range(25)}
    rows = [(g, i, s, q) for g, own in groups.items() for i, (s, q) in enumerate(own)]
    got = {r.g: (r.seq, r.qual) for r in reads.consensus(spark.createDataFrame(rows, "g int, ord int, seq string, qual string"), ("g",)).collect()}
    assert got == {g: _consensus_model(own) for g, own in groups.items()}


def test_trimming_arms(spark):
    rows = [(1, 16, 100, "60M", "7:100-159/10,12/+"), (2, 0, 100, "60M", "7:100-159/10,12/-"), (3, 16, 100, "5M2D53M", "7:100-159/10,12/+"), (4, 16, 100, "8M", "7:100-159/10,12/+"), (5, 4, 100, "60M", "7:100-159/10,12/+"), (6, 16, 104, "30M2I20M", "7:100-159/10,12/+")]
    df = spark.createDataFrame(rows, "ord int, flag int, pos int, cigar string, mip_key string").withColumn("seq", F.substring(F.repeat(F.lit("ACGTTGCAAC"), 7), 1, 60)).withColumn("qual", F.repeat(F.lit("I"), 60))
    got = {r.ord: (r.trim_status, r.new_pos, r.new_cigar, len(r.new_seq)) for r in reads.trim_arms(df).collect()}
    assert got[1] == (0, 110, "38M", 38) and got[2] == (0, 112, "38M", 38)
    assert got[3] == (0, 110, "38M", 38) and got[4] == (0, 110, "0M", 0)
    assert got[6] == (0, 110, "24M2I14M", 40)


def test_fastq_and_barcodes(spark):
    rows = spark.createDataFrame([(0, "@r#ACGT-x/1", "ACGTACGTAC", "IIIIIII###")], "ord long, header string, seq string, qual string")
    tagged = reads.tag_single(rows, 2, 1).first()
    assert (tagged.tag, tagged.seq, tagged.qual) == ("ACC", "GTACGTA", "IIIII##")
    seq, qual = reads.trim(F.col("seq"), F.col("qual"), 9, 2)
    assert tuple(rows.select(seq, qual).first()) == ("GTACG", "IIIII")
    table = spark.createDataFrame([("a", "AC", 0), ("b", "AG", 1)], "label string, sequence string, ord int")
    got = {r.variant: r.label for r in reads.barcode_neighbours(table).collect()}
    assert got["AC"] == "b" and got["TC"] == "a" and got["AN"] == "b"


def test_complexity_and_saturation(spark):
    rows = [("s1", "m1", "AA", "c1"), ("s1", "m1", "AA", "c2"), ("s1", "m1", "AC", "c3"), ("s2", "m1", "AA", "c4"), ("s2", "m2", "AA", "c5")]
    counts = complexity.complexity(spark.createDataFrame(rows, "sample string, mip_key string, mtag string, cluster string"))
    design = spark.createDataFrame([("m1",), ("m3",)], "mip string")
    got = {(r.sample, r.mip): (r.total, r.unique) for r in complexity.marginals(counts, design).collect()}
    assert got == {("ALL_SAMPLES", "m1"): (4, 3), ("s1", "ALL_POSITIONS"): (3, 2), ("s2", "ALL_POSITIONS"): (1, 1), ("ALL_SAMPLES", "ALL_POSITIONS"): (4, 3), ("ALL_SAMPLES", "m3"): (0, 0)}
    pool = _one(spark, complexity.pool_size(F.lit(100), F.lit(50)))
    assert abs(pool - 62.4084) < 1e-3
    assert _one(spark, complexity.saturation_label(F.lit(100), F.lit(50), complexity.pool_size(F.lit(100), F.lit(50)))) == "80%"
    assert abs(_one(spark, complexity.distinct_probability(F.lit(3), 100)) - 0.99 * 0.98) < 1e-12
    assert CollapseParams().tags == 1024


# -- support vectors


def test_svm_round_trip_and_prediction(spark, tmp_path):
    rng = np.random.default_rng(1)
    model = svm.SvmModel("epsilon_svr", svm.RBF, gamma=0.3, rho=[0.25], coef=rng.normal(size=(1, 4)), sv=rng.normal(size=(4, 3)))
    path = tmp_path / "m.model"
    path.write_text("\n".join(writers.svm_model_lines(model)) + "\n")
    back = readers.read_svm_model(spark, str(path))
    assert np.allclose(back.sv, model.sv) and np.allclose(back.coef, model.coef) and back.rho == model.rho
    x = rng.normal(size=(5, 3))
    want = [sum(c * math.exp(-0.3 * ((v - s) ** 2).sum()) for c, s in zip(model.coef[0], model.sv)) - 0.25 for v in x]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "i int, features array<double>")
    assert np.allclose([r.prediction for r in svm.predict(df, back).orderBy("i").collect()], want)
    two = svm.SvmModel("c_svc", svm.LINEAR, rho=[0.0], labels=[1, -1], counts=[1, 1], prob_a=[-2.0], prob_b=[0.0], coef=np.array([[1.0, -1.0]]), sv=np.array([[1.0], [-1.0]]))
    values = svm.decisions(np.array([[2.0], [-3.0]]), two)
    assert list(svm.votes(values, two)) == [1, -1]
    chances = svm.probabilities(values, two)
    assert np.allclose(chances.sum(1), 1) and chances[0, 0] > 0.9 > 0.1 > chances[1, 0]
    a, b = svm.fit_sigmoid(np.r_[np.full(20, -2.0), np.full(20, 2.0)], np.r_[np.zeros(20, bool), np.ones(20, bool)])
    assert a < 0 and abs(b) < 1e-6


# -- formats, options, streams


def test_formats(spark, tmp_path):
    def file(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    bed = readers.read_bed(spark, file("a.bed", "# c\nchr7 100 220 geneA\n7\t5\t9\n\n")).orderBy("ord").collect()
    assert [tuple(r)[:4] for r in bed] == [("7", 100, 220, "geneA"), ("7", 5, 9, "region")]
    fasta = readers.read_fasta(spark, file("a.fa", ">chr7 x\nacgt\nAC\n>8\nTT\n")).orderBy("chr").collect()
    assert [(r.chr, r.seq) for r in fasta] == [("7", "ACGTAC"), ("8", "TT")]
    vcf = readers.read_vcf(spark, file("a.vcf", "##x\nchr7\t130\t.\tA\tG\n7\t140\t.\tACG\tA\n7\t130\t.\tA\tT\n")).orderBy("pos").collect()
    assert [tuple(r) for r in vcf] == [("7", 130, "AT"), ("7", 141, "ACGA"), ("7", 142, "ACGA")]
    fastq = readers.read_fastq(spark, file("a.fq", "@r1\nACGT\n+\nIIII\n@r2\nAA\n+\nI#\n")).orderBy("ord")
    assert [(r.ord, r.header, r.seq, r.qual) for r in fastq.collect()] == [(0, "@r1", "ACGT", "IIII"), (1, "@r2", "AA", "I#")]
    several = readers.read_fastq(spark, [file("b1.fq", "@a1\nA\n+\nI\n"), file("b2.fq", "@b1\nC\n+\nI\n@b2\nG\n+\nI\n")]).orderBy("ord")
    assert [(r.ord, r.header) for r in several.collect()] == [(0, "@a1"), (1, "@b1"), (2, "@b2")]
    writers.write_fastq(fastq, str(tmp_path / "out"), compress=True)
    assert readers.read_fastq(spark, str(tmp_path / "out")).count() == 2
    sam, head = readers.read_sam(spark, file("a.sam", "@HD\tx\nchr7:10-25\t0\tchr7\t10\t60\t16M\t*\t0\t0\tA\tI\tX0:i:3\nchr7:1-9\t0\tchr7\t10\t60\t16M\t*\t0\t0\tA\tI\n"))
    routed = sam.withColumn("disposition", F.when(F.col("ord") == 1, "used").otherwise("unmapped"))
    writers.write_routed(routed, str(tmp_path / "routed"), head)
    lines = {d: [x for part in sorted((tmp_path / "routed" / f"disposition={d}").glob("part-*")) for x in part.read_text().splitlines()] for d in ("used", "unmapped")}
    assert lines["used"] == ["@HD\tx", "chr7:10-25\t0\t7\t10\t60\t16M\t*\t0\t0\tA\tI\tX0:i:3"]
    assert lines["unmapped"] == ["@HD\tx", "chr7:1-9\t0\t7\t10\t60\t16M\t*\t0\t0\tA\tI"]
    assert head.count() == 1 and [tuple(r) for r in readers.copy_counts(sam).orderBy("start").collect()] == [("7", 1, 9, 100), ("7", 10, 25, 3)]
    qseq = readers.read_qseq(spark, [file("a.qseq", "m\t1\t3\t1101\t5\t6\t0\t1\tAC.T\thhhB\t1\n")])
    assert tuple(reads.qseq_records(qseq, "run").first())[1:] == ("@run:3:1101:5:6:1", "ACNT", "+", "III#")
    genes = readers.read_refgene(spark, file("g.txt", "0\tNM1\tchr1\t+\t0\t0\t150\t380\t3\t100,300,500,\t200,400,600,\t0\tGENE\n"))
    wanted = spark.createDataFrame([("GENE",)], "symbol string")
    assert [(r.start, r.stop, r.name) for r in readers.coding_exons(genes, wanted).collect()] == [(150, 200, "GENE/NM1"), (300, 380, "GENE/NM1")]
    assert readers.exons_with_utrs(genes, wanted).first().start == 99


def test_design_file_round_trip(spark, tmp_path):
    _, feature = _feature(spark)
    rows = probes.with_sequences(probes.candidate_bounds(feature, PARAMS), PARAMS).limit(3).withColumns({"ext_probe_copy": F.lit(1), "lig_probe_copy": F.lit(2), "snp_count": F.lit(0), "score": F.lit(0.5), "mapping_failed": F.lit(False), "masking_failed": F.lit(True), "snp_failed": F.lit(False)})
    record = probes.design_record(rows, F.lit(7))
    writers.write_design(record.coalesce(1), str(tmp_path / "design"))
    back = readers.read_design(spark, str(tmp_path / "design"))
    assert back.count() == 3 and back.first().mip_name == "gene_0007" and back.first().failure_flags == "010"
    assert {r.mip_key for r in readers.probes_of(back).collect()} == {r.mip_key for r in rows.collect()}
    assert tuple(readers.tag_sizes(back).first()) == (0, 5)
    assert writers.target_fasta(back).first().value.startswith(">7:")
    track = writers.track_rows(back).first()
    assert track.start < track.thick_start <= track.thick_end < track.end


def test_options():
    assert len(DesignParams().arms()) == 57
    p = parse_options(["-tag_sizes", "4,4", "-arm_lengths", "16:24", "-double_tile_strand_unaware", "on"], ["-tag_sizes 8,0", "ignored"])
    assert p.tag_sizes == (8, 0) and p.arms() == [(40, 16, 24)] and p.double_tile_strand_unaware
    with pytest.raises(ValueError):
        parse_options(["-nope", "1"])


def test_streaming_collapse_equals_batch(spark, tmp_path):
    rng = random.Random(10)
    sites = sorted(rng.randint(1, 50_000) for _ in range(40))
    rows = [(s, f"m{s}", rng.choice("ab"), rng.choice(["AA", "AC"])) for s in sites for _ in range(rng.randint(1, 6))] + [(10_000_000, "end", "a", "AA")]
    batch = spark.createDataFrame(rows, "start long, mip_key string, barcode string, mtag string")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")).withColumn("site_at", collapse.event_time(F.lit(0), F.col("start")))
    collapse.run_once(collapse.collapse(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted((r.mip_key, r.barcode, r.mtag, r.n_reads) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted((r.mip_key, r.barcode, r.mtag, r["count"]) for r in batch.filter("mip_key <> 'end'").groupBy("mip_key", "barcode", "mtag").count().collect())
    assert got == want
