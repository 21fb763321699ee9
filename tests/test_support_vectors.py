import dataclasses
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import scores
from strandloom.operators import genome, probes, svm, tiling
from strandloom.params import DesignParams

BACK = str.maketrans("ACGT", "TGCA")
PARAMS = DesignParams(min_capture_size=70, max_capture_size=80, capture_increment=10, arm_length_sums=(34, 35), ext_min_length=16, lig_min_length=17, max_arm_copy_product=10_000)


def _features(spark, rng, n=3, size=150, first=60, last=95):
    rows = [(i, "c", "".join(rng.choice("ACGT") for _ in range(size)), 1, size, first, last) for i in range(n)]
    return spark.createDataFrame(rows, "feature_id long, chr string, seq string, seq_start int, seq_stop int, start_f int, stop_f int")


def _counts(features):
    sizes = sorted({n for _, e, g in PARAMS.arms() for n in (e, g)})
    out = genome.copy_numbers(features, sizes[0])
    for n in sizes[1:]:
        out = out.unionByName(genome.copy_numbers(features, n))
    return out


def _model(rng, n=6):
    sv = rng.random((n, 192))
    sv[:, [21, 173]] += 18
    sv[:, 151] += 45
    return svm.SvmModel("epsilon_svr", svm.RBF, gamma=0.004, rho=[-1.0], coef=rng.normal(size=(1, n)), sv=sv)


def _plain_vector(ext, lig, scan, ce, cl, seq):
    words = lambda n: ["".join(p) for p in itertools.product("ACGT", repeat=n)]
    count = lambda s, m: sum(s[i : i + len(m)] == m for i in range(len(s)))

    def shares(s, longest):
        out = []
        for mer in sorted(m for n in range(1, longest + 1) for m in words(n)):
            if mer == "T":
                out.append((s.count("G") + s.count("C")) / len(s))
            out.append(count(s, mer) / (len(s) - len(mer) + 1))
        return [*out, float(len(s))]

    around = []
    for mer in scores.PROFILE_MERS:
        back = mer[::-1].translate(BACK)
        around.append((count(seq, mer) + (count(seq, back) if back != mer else 0)) / (len(seq) - 1 + 2001))
    log = lambda n: 2.0 if n > 100 else math.log10(n)
    return [*shares(ext, 2), *around, *shares(scan, 3), *shares(lig, 2), *[float(lig[:2] == p) for p in words(2)], log(ce), log(cl)]


@pytest.fixture(scope="module")
def designed(spark):
    rng = random.Random(17)
    features = _features(spark, rng)
    return features, _counts(features).cache(), _model(np.random.default_rng(3))


def test_vectors_entry_by_entry_and_scores(spark, designed):
    features, counts, model = designed
    seqs = {r.feature_id: r.seq for r in features.collect()}
    bounds = probes.candidate_bounds(features, PARAMS)
    params = dataclasses.replace(PARAMS, score_method="svr")
    rows = probes.with_svm_features(bounds, features, counts).collect()
    scored = {(r.feature_id, r.mip_key, r.scan_start): r.score for r in probes.scored_by(bounds, features, counts, params, model).collect()}
    assert len(rows) == len(scored) == bounds.count()
    for r in random.Random(1).sample(rows, 60):
        want = _plain_vector(r.ext_probe_sequence, r.lig_probe_sequence, r.scan_target_sequence, r.ext_probe_copy, r.lig_probe_copy, seqs[r.feature_id])
        assert len(want) == 192 and np.allclose(r.svm_features, want, atol=1e-12)
        value = sum(c * math.exp(-0.004 * sum((a - b) ** 2 for a, b in zip(want, s))) for c, s in zip(model.coef[0], model.sv)) + 1.0
        assert abs(scored[r.feature_id, r.mip_key, r.scan_start] - value) < 1e-9
    with pytest.raises(ValueError, match="needs a model"):
        probes.scored_by(bounds, features, counts, params)


def _condensed(designed, method):
    features, counts, model = designed
    params = dataclasses.replace(PARAMS, score_method=method, svr_priority_score=1.0, svr_optimal_score=2.0)
    bounds = probes.candidate_bounds(features, params)
    rows = probes.scored_by(bounds, features, counts, params, model).withColumns({"snp_count": F.lit(0), "mapping_failed": F.lit(False), "arm_fraction_masked": F.lit(0.0)})
    return probes.condense(rows, params), params


def test_methods_change_the_design(spark, designed):
    features, counts, model = designed
    picks = {}
    for method in ("logistic", "svr", "mixed"):
        condensed, params = _condensed(designed, method)
        if method == "mixed":
            condensed = probes.with_rescoring(condensed, features, counts)
        picks[method] = sorted(tuple(r) for r in tiling.pick(condensed, params, model).select("feature_id", "number", "scan_start", "strand").collect())
        assert picks[method]
    assert picks["logistic"] != picks["svr"] and picks["mixed"] != picks["svr"]
    with pytest.raises(ValueError, match="needs a model"):
        tiling.pick(condensed, params)


def test_mixed_tiling_scores_only_what_it_looks_at(spark, designed, monkeypatch):
    features, counts, model = designed
    condensed, params = _condensed(designed, "mixed")
    rows = probes.with_rescoring(condensed, features, counts).toPandas()
    eager = svm.predicted(np.stack(rows["svm_features"]), model)
    asked = []

    def looked_up(x, _):
        at = [int(np.flatnonzero((np.stack(rows["svm_features"]) == v).all(axis=1))[0]) for v in x]
        asked.extend(at)
        return eager[at]

    def tiled(of):
        monkeypatch.setattr(tiling, "predicted", of)
        q = dataclasses.replace(params, score_method="svr")
        out = []
        for _, own in rows.groupby("feature_id", sort=True):
            board = tiling._Board(own, q)
            out += list(tiling._tile_feature(tiling.Probes(own.reset_index(drop=True), q, model), board))
        return out

    assert tiled(svm.predicted) == tiled(looked_up)
    assert 0 < len(asked) == len(set(asked)) < len(rows)


def test_prediction_of_nulls_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(svm, "BLOCK", 3)
    model = svm.SvmModel("epsilon_svr", svm.LINEAR, rho=[0.5], coef=np.array([[2.0, -1.0]]), sv=np.array([[1.0, 0.0], [0.0, 1.0]]))
    rows = [(i, [float(i), 1.0] if i % 4 else None) for i in range(20)]
    got = {r.i: r.prediction for r in svm.predict(spark.createDataFrame(rows, "i int, features array<double>"), model).collect()}
    assert got == {i: 2.0 * v[0] - v[1] - 0.5 if v else None for i, v in rows}
    assert svm.predict(spark.createDataFrame([], "features array<double>"), model).collect() == []


def test_probabilities_of_three_classes():
    """The coupling against a search: p minimises the pairwise disagreement, for every row."""
    rng = np.random.default_rng(2)
    model = svm.SvmModel("c_svc", svm.LINEAR, labels=[0, 1, 2], counts=[1, 1, 1], prob_a=[-1.0, -0.7, -1.3], prob_b=[0.1, 0.0, -0.2])
    values = rng.normal(size=(6, 3)) * 2
    got = svm.probabilities(values, model)
    assert np.allclose(got.sum(1), 1) and (got >= 0).all()
    sigmoid = lambda f, k: 1 / (1 + math.exp(f * model.prob_a[k] + model.prob_b[k]))
    for row, p in zip(values, got):
        r = np.zeros((3, 3))
        for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
            r[i, j], r[j, i] = sigmoid(row[k], k), 1 - sigmoid(row[k], k)
        loss = lambda q: sum((r[j, i] * q[i] - r[i, j] * q[j]) ** 2 for i in range(3) for j in range(3) if i != j)  # noqa: E731, B023
        grid = [np.array([a, b, 1 - a - b]) for a in np.linspace(0, 1, 101) for b in np.linspace(0, 1, 101) if a + b <= 1]
        assert loss(p) <= min(map(loss, grid)) + 1e-9
    votes = svm.votes(values, model)
    assert set(votes) <= {0, 1, 2}


@pytest.mark.parametrize(("optimal", "heuristic"), [(0.3, True), (0.05, False), (2.0, True)])
def test_pruning_against_a_plain_search(spark, optimal, heuristic):
    rng = random.Random(int(optimal * 100))
    params = dataclasses.replace(PARAMS, logistic_optimal_score=optimal, logistic_heuristic=heuristic)
    features = _features(spark, rng, 2, 180, 60, 120)
    rows = [r.asDict() for r in probes.candidate_bounds(features, params).drop("seq", "rc").collect()]
    for r in rows:
        r["score"] = rng.choice([-1000.0, float("nan"), rng.random(), rng.random() * 0.3])
    df = spark.createDataFrame([(r["feature_id"], r["scan_start"], r["strand"], r["generation"], r["capture_size"], r["ext_len"], r["lig_len"], r["score"]) for r in rows], "feature_id long, scan_start int, strand string, generation int, capture_size int, ext_len int, lig_len int, score double")
    got = {(r.feature_id, r.scan_start, r.generation) for r in probes.pruned(df, params).collect()}
    number = lambda x: -math.inf if math.isnan(x) else x
    want = set()
    for start in {(r["feature_id"], r["scan_start"]) for r in rows}:
        own = [r for r in rows if (r["feature_id"], r["scan_start"]) == start]
        best = 0.0
        for size in sorted({r["capture_size"] for r in own}, reverse=True):
            if best > optimal:
                continue
            totals = sorted({a for a, _, _ in params.arms()}, reverse=True)
            for total in totals:
                if best > optimal and total != totals[-1]:
                    continue
                before = (0, 0)
                for ext in sorted({r["ext_len"] for r in own if r["capture_size"] == size and r["ext_len"] + r["lig_len"] == total}):
                    pair = {r["strand"]: r for r in own if r["capture_size"] == size and r["ext_len"] == ext and r["lig_len"] == total - ext}
                    want |= {(*start, r["generation"]) for r in pair.values()}
                    plus, minus = number(pair["+"]["score"]), number(pair["-"]["score"])
                    stop = heuristic and plus < before[0] and minus < before[1]
                    best, before = max(plus, minus), tuple(x if x == -math.inf else math.trunc(x) for x in (plus, minus))
                    if stop:
                        break
    assert got == want and (optimal > 1 or len(want) < len(rows))
