import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from strandloom.llm import exact_dedup as E
from strandloom.llm import graph
from strandloom.llm import jaccard_join as J


def test_exact_against_brute_force(spark):
    rng = random.Random(3)
    texts = ["Common TEXT"] * 300 + [rng.choice(["Äb", "äb", "x", "X", "", None, "long " * 500]) for _ in range(200)]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, kept int")
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[lower(t)].append(i)
    for support in (0.2, 0.001):
        got = E.resolve(docs, support=support).collect()
        assert len(got) == len(rows)
        for r in got:
            own = groups[lower(texts[r.doc_id])]
            assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), r.doc_id == max(own))
            assert bytes(r.digest) == hashlib.sha256(lower(texts[r.doc_id]).encode()).digest()
    kept = E.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(max(g) for g in groups.values())


def test_exact_with_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "c"), (None, "c")], "doc_id long, text string")
    got = E.resolve(docs).collect()
    assert Counter(r.kept for r in got)[True] == 3
    assert sorted((r.doc_id or 0, r.text) for r in E.deduplicate(docs).collect()) == [(0, "c"), (1, "a"), (1, "b")]
    assert E.resolve(docs.limit(0)).collect() == [] and E.deduplicate(docs.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[x] == root(x) for x in got)
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}


def brute(rows, shingle, percent):
    """doc_id -> (set size, smallest reachable id), by all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)) if len(w) >= shingle else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return {doc: (len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(rows)}


def _family(rng, n_words, copies, edits, start):
    base = [rng.choice("abcdefghij") + rng.choice("klmnopqrst") + rng.choice("uvwxyz") for _ in range(n_words)]
    out = []
    for i in range(copies):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(n_words)] = f"w{rng.randrange(10**6)}"
        out.append((start + i, " ".join(words)))
    return out


def test_jaccard_against_brute_force(spark):
    rng = random.Random(11)
    rows = _family(rng, 60, 60, 2, 0) + _family(rng, 150, 40, 6, 100) + _family(rng, 12, 30, 1, 200) + _family(rng, 700, 12, 30, 300) + _family(rng, 35, 40, 3, 400)
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "One"), (504, "one"), (505, "one two"), (506, "one two three"), (507, "x " * 5000), (508, "X " * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash"))
    for shingle, percent in ((3, 90), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.similar_components(docs, shingle, percent).collect()}
        assert got == brute(rows, shingle, percent)
    assert J.similar_components(docs.limit(0)).collect() == []


def test_jaccard_with_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(7, "same text here now"), (7, "other words are there"), (None, "same text here now"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.n_shingles, r.component_id) for r in J.similar_components(docs).collect()))
    assert got == [(-1, 0, None), (-1, 2, 7), (7, 2, 7), (7, 2, 7)]


def _kept(spares, signatures):
    own = [np.sort(signatures[signatures % np.uint64(J.NAMES) == name]) for name in range(J.NAMES)]
    return {x for name, of in enumerate(own) for x in of[: len(of) - spares.get(name, 0)].tolist()}


def test_sketches_meet_by_pigeonhole():
    rng = np.random.default_rng(2)
    for percent in (80, 90):
        bands = J.Bands(percent)
        for n in (9, 14, 40, 130, 600):
            base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            for _ in range(20):
                gone = len(base) - int(np.ceil(len(base) * percent / 100))
                cut = rng.choice(base, len(base) - rng.integers(0, gone + 1), replace=False)
                # each leaves out what it may, the largest in an order common to both
                one, two = (_kept(*J.signatures(e, bands)) for e in (base, np.sort(cut)))
                assert len(cut) == len(base) or one & two


def test_bit_sketches_bound_the_difference(spark):
    rng = np.random.default_rng(4)
    rows, apart = [], []
    for n in (1, 3, 64, 65, 100, 1000):
        base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for m in sorted({n, max(1, n * 9 // 10), (n + 1) // 2}):
            other = np.union1d(rng.choice(base, m, replace=False), rng.integers(0, 2**63, rng.integers(0, max(1, n - m) + 1), dtype=np.uint64))
            if max(len(other), len(base)) <= 2 * min(len(other), len(base)):
                rows.append((len(rows), J.parity_bits(base).tolist(), J.parity_bits(other).tolist()))
                apart.append(len(np.setxor1d(base, other)))
    found = spark.createDataFrame(rows, "i int, a array<long>, b array<long>").select("i", J.hamming(F.col("a"), F.col("b")).alias("d")).collect()
    assert len(found) == len(apart) and all(r.d <= apart[r.i] and (r.d - apart[r.i]) % 2 == 0 for r in found)
