import random

from pyspark.sql import functions as F

from strandloom.operators import genome, probes, repeats
from strandloom.params import DesignParams


def _random(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def _planted(rng, unit, copies, errors=0):
    seq = list((unit * (int(copies) + 1))[: int(len(unit) * copies)])
    for i in rng.sample(range(len(seq)), errors):
        seq[i] = {"A": "C", "C": "G", "G": "T", "T": "A"}[seq[i]]
    return "".join(seq)


def test_planted_repeats_are_found_and_random_bases_are_not(spark):
    rng = random.Random(3)
    rows, spans = [], {}
    for i, (period, copies, errors) in enumerate([(1, 40, 0), (2, 20, 0), (3, 15, 1), (7, 8, 1), (25, 4, 2), (120, 3, 3), (400, 2.5, 2)]):
        left, unit = _random(rng, 3990 + 40 * i), _random(rng, period)
        core = _planted(rng, unit, copies, errors)
        rows.append((f"c{i}", left + core + _random(rng, 900)))
        spans[f"c{i}"] = (len(left) + 1, len(left) + len(core))
    rows += [("plain", _random(rng, 9000)), ("short", "AC"), ("empty", ""), ("unknown", "N" * 300), ("long", "ACGTTG" * 3000)]
    df = spark.createDataFrame(rows, "chr string, seq string")
    got = {}
    for r in repeats.tandem_repeats(df).collect():
        got.setdefault(r.chr, []).append((r.start, r.stop))
    for c, (a, b) in spans.items():
        inside = sum(min(b, y) - max(a, x) + 1 for x, y in got.get(c, []) if x <= b and y >= a)
        outside = sum(y - x + 1 for x, y in got.get(c, [])) - inside
        assert inside >= 0.9 * (b - a + 1) and outside <= 20, (c, a, b, got.get(c))
    assert got["long"] == [(1, 18_000)] and not {"plain", "short", "empty", "unknown"} & set(got)


def test_one_piece_equals_many(spark, monkeypatch):
    rng = random.Random(8)
    seq = "".join(_random(rng, 900) + _planted(rng, _random(rng, rng.choice([1, 4, 30])), 12) for _ in range(30))
    whole = set()
    for a, b, _ in repeats.stretches(seq.encode(), 40):
        whole |= set(range(a + 1, b + 2))
    found = repeats.tandem_repeats(spark.createDataFrame([("c", seq)], "chr string, seq string"), longest=40)
    pieced = {p for r in found.collect() for p in range(r.start, r.stop + 1)}
    assert pieced == whole


def test_masks_and_flags(spark):
    rng = random.Random(5)
    seq = _random(rng, 60) + "AC" * 20 + _random(rng, 120)
    features = spark.createDataFrame([(1, "c", seq[10:], 11, len(seq), 80, 130), (2, "d", "ACGT", 1, 4, 1, 4)], "feature_id long, chr string, seq string, seq_start int, seq_stop int, start_f int, stop_f int")
    found = spark.createDataFrame([("c", 5, 12), ("c", 61, 100)], "chr string, start long, stop long")
    masked = repeats.with_mask(features, found)
    got = {r.feature_id: r.masked_seq for r in masked.collect()}
    assert got == {1: "NN" + seq[12:60] + "N" * 40 + seq[100:], 2: "ACGT"}
    params = DesignParams(min_capture_size=70, max_capture_size=70, arm_length_sums=(34,), ext_min_length=16, lig_min_length=17)
    bounds = probes.candidate_bounds(features.filter("feature_id = 1"), params)
    for r in probes.with_masking(bounds, params, masked).collect():
        arms = [set(range(r.ext_probe_start, r.ext_probe_stop + 1)), set(range(r.lig_probe_start, r.lig_probe_stop + 1))]
        share = sum(p <= 12 or 61 <= p <= 100 for arm in arms for p in arm) / sum(map(len, arms))
        assert abs(r.arm_fraction_masked - share) < 1e-9 and r.masking_failed == (share > 0.5)


def test_unmappable_windows(spark):
    rng = random.Random(2)
    core = _random(rng, 40)
    genome_ = spark.createDataFrame([("a", _random(rng, 50) + core + _random(rng, 50)), ("b", core[::-1].translate(str.maketrans("ACGT", "TGCA")))], "chr string, seq string")
    seq = genome_.filter("chr = 'a'").first().seq
    captures = spark.createDataFrame([(n, "a", i + 1, seq[i : i + n]) for n in (35, 40) for i in range(len(seq) - n + 1)], "size int, chr string, start int, window string")
    got = sorted(map(tuple, genome.unmappable(captures, genome_).collect()))
    assert got == [(35, "a", i) for i in range(51, 57)] + [(40, "a", 51)]
    assert genome.unmappable(captures.filter(F.lit(False)), genome_).collect() == []


def _plain_stretches(seq, longest, least):
    """Run by run, as the module's text says."""
    out = []
    for period in range(1, min(longest, len(seq) - 1) + 1):
        same = [a == b and a in "ACGT" for a, b in zip(seq, seq[period:], strict=False)]
        seed, begin, i = min(repeats.SEED, period), None, 0
        found = lambda: begin is not None and best + 2 * period >= least and end - begin + 1 >= period  # noqa: E731, B023
        while i < len(same):
            if not same[i]:
                i += 1
                continue
            a = i
            while i < len(same) and same[i]:
                i += 1
            if begin is not None and score > 7 * (a - reach - 1):
                score += 2 * (i - a) - 7 * (a - reach - 1)
            else:
                if found():
                    out.append((begin, end + period, period))
                begin, score, best = (a, 2 * (i - a), 0) if i - a >= seed else (None, 0, 0)
            reach = i - 1
            if begin is not None and score > best:
                best, end = score, i - 1
        if found():
            out.append((begin, end + period, period))
    return out


def test_stretches_equal_those_found_run_by_run(monkeypatch):
    rng, n = random.Random(4), 0
    followed = []
    plain = repeats._grown_from
    monkeypatch.setattr(repeats, "_grown_from", lambda text, begin, *rest: followed.append(begin) or plain(text, begin, *rest))
    for _ in range(60):
        parts = [_random(rng, rng.randint(0, 150)) + _planted(rng, "".join(rng.choice("ACGTN" if rng.random() < 0.2 else "ACT") for _ in range(rng.choice([1, 2, 3, 5, 6, 13, 26, 50]))), rng.randint(1, 7)).replace("T", rng.choice("TTN")) for _ in range(4)]
        seq = "".join(c if rng.random() > 0.04 else rng.choice("ACGT") for c in "".join(parts))
        for longest, least in ((60, 50), (30, 40)):
            want = _plain_stretches(seq, longest, least)
            assert sorted(repeats.stretches(seq.encode(), longest, least)) == sorted(want)
            n += len(want)
    assert n > 150
    followed.clear()
    assert repeats.stretches(_random(rng, 20_000).encode(), 100) == []
    assert len(followed) < 2_000  # of about 1,500 seeds of five bases a period


def test_repeats_of_one_batch_keep_to_their_sequences(spark):
    rows = [(f"c{i}", "ACGTTG" * 300) for i in range(4)] + [("d", "AC" * 20), ("e", "AC" * 20), ("f", None)]
    found = repeats.tandem_repeats(spark.createDataFrame(rows, "chr string, seq string").coalesce(1), longest=40)
    assert sorted(map(tuple, found.collect())) == [("c0", 1, 1800), ("c1", 1, 1800), ("c2", 1, 1800), ("c3", 1, 1800), ("d", 1, 40), ("e", 1, 40)]
