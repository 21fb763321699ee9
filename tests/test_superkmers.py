import random
from collections import Counter

import numpy as np
import pytest

from strandloom.operators import genome, superkmers

BACK = str.maketrans("ACGT", "TGCA")


def _genome(rng):
    seqs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (300, 3, 0, 150)]
    seqs += ["A" * 120, "ACGT" * 40, seqs[0][40:160], seqs[0][::-1].translate(BACK), "ACGTNNACG" * 12, "".join(rng.choice("ACGTNR") for _ in range(200)), "".join(rng.choice("ACGT") for _ in range(5000))]
    return list(enumerate(seqs))


@pytest.mark.parametrize("size", [4, 6, 12, 31, 45])
def test_counts_and_single_windows(spark, size):
    rows = _genome(random.Random(size))
    df = spark.createDataFrame(rows, "chr int, seq string").repartition(3)
    canonical = lambda k: min(k, k[::-1].translate(BACK))
    places = [(c, i + 1, s[i : i + size]) for c, s in rows for i in range(len(s) - size + 1)]
    count = Counter(canonical(k) for _, _, k in places)
    assert {r.kmer: r.copies for r in genome.copy_numbers(df, size).collect()} == count
    want = sorted(p for p in places if count[canonical(p[2])] == 1)
    assert sorted((r.chr, r.start, r.kmer) for r in genome.unique_windows(df, size).collect()) == want
    assert genome.copy_numbers(df.limit(0), size).collect() == []


def test_runs_hold_each_window_once_and_strands_agree():
    rng = random.Random(5)
    text = "".join(rng.choice("ACGT") for _ in range(700))
    for size, m in ((12, 6), (30, 11), (5, 4)):
        found = {}
        for key, at, run in superkmers.runs(text.encode(), size, m):
            assert text[at : at + len(run)].encode() == run
            for i in range(len(run) - size + 1):
                assert at + i not in found
                found[at + i] = key
        assert sorted(found) == list(range(len(text) - size + 1))
        back = text[::-1].translate(BACK)
        other = {}
        for key, at, run in superkmers.runs(back.encode(), size, m):
            other |= {len(text) - size - (at + i): key for i in range(len(run) - size + 1)}
        assert other == found
    assert sum(len(r) for *_, r in superkmers.runs(text.encode(), 30, 11)) < 8 * len(text)  # not 30 bases a window


def test_least_of_runs():
    x = np.random.default_rng(1).integers(0, 1000, 50).astype(np.uint64)
    for width in range(1, 20):
        assert (superkmers._least(x, width) == [x[i : i + width].min() for i in range(50 - width + 1)]).all()


def test_whole_buckets_are_counted_at_once_and_kmers_need_not_be_spelt(spark, monkeypatch):
    rows = _genome(random.Random(2))
    df = spark.createDataFrame(rows, "chr int, seq string").repartition(3)
    spelt = {(r.chr, r.start) for r in genome.unique_windows(df, 30).collect()}
    plain = genome.unique_windows(df, 30, spell=False)
    assert plain.columns == ["chr", "start"] and sorted(map(tuple, plain.collect())) == sorted(spelt)
    seen = []
    monkeypatch.setattr(superkmers, "AT_ONCE", 50)
    bucket = np.repeat(np.arange(40), np.random.default_rng(3).integers(1, 9, 40))
    forms = [b"ACGTACGTAC"] * len(bucket)
    whole = superkmers.pa.RecordBatch.from_arrays([superkmers.pa.array(bucket), superkmers.pa.array(forms, superkmers.pa.binary())], names=["bucket", "form"])
    use = lambda table: seen.append(table["bucket"].to_numpy()) or table
    out = list(superkmers._by_bucket(8, use)(whole.slice(i, 7) for i in range(0, len(bucket), 7)))
    assert np.concatenate([b["bucket"].to_numpy() for b in out]).tolist() == bucket.tolist()
    assert len(seen) > 3 and not any(set(a) & set(b) for a, b in zip(seen, seen[1:], strict=False))


def test_short_windows_are_counted_by_code_without_minimisers(spark, monkeypatch):
    def none(*_):
        raise AssertionError("a window of 12 bases has few codes")

    monkeypatch.setattr(superkmers, "super_kmers", none)
    df = spark.createDataFrame([(1, "ACGTACGTACGTNACGTACGTACGT"), (2, "ACG"), (3, None)], "chr int, seq string").repartition(2)
    found = {r.kmer: r.copies for r in genome.copy_numbers(df, 12).collect()}
    assert found["ACGTACGTACGT"] == 2 and sum(found.values()) == 14 and sum(n for k, n in found.items() if "N" in k) == 12


def test_a_task_hands_on_each_short_window_once(spark, monkeypatch):
    monkeypatch.setattr(superkmers, "CUT", 50)  # few bases are counted at a time
    df = spark.createDataFrame([(i, "ACGTTGCAACGGNACGTTGCAACGG") for i in range(40)], "chr int, seq string").coalesce(1)
    held = superkmers._count_short(genome.pieces(df, 6, "seq", ()), 6)
    rows = held._jdf.queryExecution().toRdd().count()
    found = {r.kmer: r.copies for r in held.collect()}
    assert rows == len(found) and sum(found.values()) == 40 * 20
    plan = held._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(plan) if "MapInArrow count" in line)
    assert "RepartitionByExpression" in plan[at - 1]  # no map-side table of all codes
