import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from strandloom.llm import embedding_dedup as E
from strandloom.llm import hard_negatives as H
from strandloom.llm import resampling as R
from strandloom.llm import vectors as V

VECTORS = "vec_id long, embedding array<float>, label int, node long, tile int, dims string, copies int"


def _embeddings(rng, n=160, dims=12):
    """Random directions, near copies, chains, exact copies, scaled copies and rows that link with nothing."""
    rows = []
    for i in range(n):
        v = rng.normal(size=dims)
        if i % 4 == 1:
            v = np.array(rows[-1]) + rng.normal(size=dims) * rng.choice([0.05, 0.2, 0.35])
        elif i % 10 == 2:
            v = np.array(rows[-1]) * 3.0
        elif i % 10 == 3:
            v = np.array(rows[rng.integers(0, 3)])
        rows.append(list(np.float32(v)))
    rows = [[float(x) for x in r] for r in rows]
    odd = [None, [0.0] * dims, [float("nan")] + [1.0] * (dims - 1), [float("inf")] * dims, [None] + [1.0] * (dims - 1), [], [1e38] * dims, [1e-38] * dims, rows[0][:5], rows[0][:5]]
    return rows + odd


def _links(rows, threshold):
    """For each row the others it is linked with."""
    good = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    unit = [np.array(v) / max(map(abs, v)) if good(v) else None for v in rows]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    return [{j for j, w in enumerate(unit) if j != i and u is not None and w is not None and len(u) == len(w) and float(u @ w) >= threshold} for i, u in enumerate(unit)]


def _reach(links, start):
    seen, todo = {start}, [start]
    while todo:
        for j in links[todo.pop()] - seen:
            seen.add(j)
            todo.append(j)
    return seen


def test_near_duplicates_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(E, "STRIP", 16)
    rows = _embeddings(np.random.default_rng(5))
    ids = [3 * i + 7 for i in range(len(rows))]
    df = spark.createDataFrame([(i, v, 1, 2, 3, "x", 4) for i, v in zip(ids, rows)], VECTORS)
    for threshold, tile in ((0.95, 8192), (0.9, 16), (0.999, 7)):
        links = _links(rows, threshold)
        monkeypatch.setattr(E, "tile_of", lambda place, dims, t=tile: V.tile_of(place, dims, t))
        got = {r.vec_id: r for r in E.near_duplicates(df, threshold).collect()}
        assert len(got) == len(rows)
        for k, i in enumerate(ids):
            least = min(ids[j] for j in _reach(links, k))
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links[k]), least, least == i), (threshold, i)


def test_near_duplicates_with_wide_null_and_repeated_ids(spark):
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, v), (1, v), (None, v), (2, w), (None, w), (5, w), (5, [0.0, 0.0, 1.0]), (None, None), (7, None)]
    got = sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (-1, 2, 1, False), (2, 2, 2, True), (-1, 2, 2, False), (5, 2, 2, False), (5, 0, 5, True), (-1, 0, -1, False), (7, 0, 7, True)])
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_error_bounds_hold_and_few_pairs_are_recomputed():
    rng = np.random.default_rng(1)
    x = E.unit(rng.normal(size=(300, 64)))
    codes, scales, errors = E.quantised(x)
    exact, estimate = x @ x.T, (scales[:, None] * codes) @ (scales[:, None] * codes).T
    lengths = np.linalg.norm(scales[:, None] * codes, axis=1)
    assert (np.abs(exact - estimate) <= errors[:, None] + lengths[:, None] * errors[None, :]).all()
    assert errors.max() < 0.02
    long = rng.integers(-127, 128, size=(3, 2500)).astype(np.int8)  # beyond what one single-precision sum holds
    assert (E._products(long, long) == long.astype(np.int64) @ long.astype(np.int64).T).all()


# -- hard negatives


def _negatives(rows, anchor, steps=256):
    used = []
    for i, (vec, v, label) in enumerate(rows):
        if vec is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v) or any(abs(math.floor(steps * x)) >= H.LARGEST for x in v):
            continue
        used.append((i, vec, [math.floor(steps * x) for x in v], label))
    out = []
    for i, vec, q, label in used:
        if not anchor(vec):
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, p)), other, j, own) for j, other, p, own in used if j != i and len(p) == len(q))
        positives = [s for s in scored if s[3] == label][: H.POSITIVES]
        for score, positive, _, _ in positives:
            held = [s for s in scored if s[3] != label and 80 * -score <= 100 * -s[0] <= 100 * -score][: H.NEGATIVES]
            out += [(vec, positive, k + 1, other, -score, -s) for k, (s, other, *_) in enumerate(held)]
    return sorted(out)


def test_hard_negatives_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(4, 11))
    rows = [(i, [float(x) for x in np.float32(base[rng.integers(0, 4)] + rng.normal(size=11) * rng.choice([0.1, 0.5, 3.0]))], int(rng.integers(0, 3))) for i in range(220)]
    rows += [(300, None, 1), (301, [float("nan")] * 11, 1), (302, [1.0] * 11, None), (None, [1.0] * 11, 1), (303, [None] * 11, 1), (304, [1e30] * 11, 1), (305, [1.0] * 5, 1), (400, [1.0] * 5, 1), (402, [0.9] * 5, 2), (500, [], 1), (501, [], 2), (502, [], 1)]
    rows += [rows[3], rows[3], (20, rows[20][1], 2)]
    df = spark.createDataFrame([(i, v, x, 1, 2, "x", 3) for i, v, x in rows], VECTORS)
    want = _negatives(rows, lambda i: i % 20 == 0)
    for tile, block, wide in ((8192, 256, 64), (17, 3, 2)):
        monkeypatch.setattr(H, "tile_of", lambda place, dims, t=tile: V.tile_of(place, dims, t))
        monkeypatch.setattr(H, "BLOCK", block)
        got = sorted(tuple(r) for r in H.mine(df, F.col("id") % 20 == 0).collect())
        assert got == want
    assert H.mine(df.limit(0), F.col("id") % 20 == 0).collect() == []


def test_scores_are_inner_products():
    rng = np.random.default_rng(2)
    for low, high, dims in ((-256, 256, 64), (0, 1, 3), (-1, 0, 9), (-(1 << 25), 1 << 25, 17)):
        a, b = rng.integers(low, high, size=(70, dims)), rng.integers(low, high, size=(90, dims))
        assert (H.scores(a, H.planes_of(b)) == b @ a.T).all()
    table = H.subset_sums(np.arange(1, 17).reshape(1, 16))
    assert all(table[g, byte, 0] == sum(8 * g + d + 1 for d in range(8) if byte >> d & 1) for g in range(2) for byte in range(256))


# -- resampling


def _features(text, longest):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)


def _drawn(docs, target, longest=1, buckets=10_000, percent=10, least=20, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [(i, *_features(t, longest)) for i, t in docs]
    s, t = Counter(bucket(f) for _, fs, _ in own for f in fs), Counter(bucket(f) for x in target for f in _features(x, longest)[0])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for i, fs, n in own:
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


def _texts(rng, n):
    words = ["Zeta", "beta", "é漢", "x1", "a-b", "The", "the", " ", "Ünï"] + [f"w{i}" for i in range(300)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 90))) for _ in range(n)]


def test_resampling_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    docs = list(enumerate(_texts(rng, 150))) + [(500, None), (501, ""), (502, " .,! "), (503, "same word " * 40), (504, "same word " * 40), (None, "null id " * 30), (505, "x" * 5000), (506, "long " * 9000)]
    target = _texts(rng, 20) + [None, "w1 w2 w3 " * 50]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, weight int, key string")
    goal = spark.createDataFrame([(t, 0) for t in target], "text string, doc_id int")
    for longest, block in ((1, 1 << 20), (3, 64)):
        monkeypatch.setattr(R, "BLOCK", block)
        got = sorted((tuple(r) for r in R.drawn(df, goal, longest=longest).collect()), key=str)
        assert got == _drawn(docs, target, longest)
    chosen = R.resample(df, goal, percent=30)
    want = [r for r in _drawn(docs, target, percent=30) if r[4]]
    assert chosen.columns == df.columns and sorted(str(r.doc_id) for r in chosen.collect()) == sorted(str(r[0]) for r in want)


def test_resampling_of_empty_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    goal = spark.createDataFrame([(1, "a b")], schema)
    assert R.drawn(goal.limit(0), goal).collect() == [] and R.resample(goal.limit(0), goal).collect() == []
    docs = spark.createDataFrame([(1, "word " * 25)] * 30, schema)
    got = R.drawn(docs, goal.limit(0)).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3] and len({r.score for r in got}) == 1
    assert R.resample(docs, goal).count() == 3


def test_bit_planes_add_up():
    rng = np.random.default_rng(4)
    gains = rng.integers(-9000, 9000, size=1000)
    planes, worth = R.signed_planes(gains)
    for most in (1, 5, 1 << 20):
        counts = rng.integers(0, most + 1, size=1000) * (rng.random(1000) < 0.3)
        assert R.gain_sum(counts, planes, worth) == int((counts * gains).sum())
