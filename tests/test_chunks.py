import random

from strandloom.operators import intervals as I
from strandloom.sources import chunks


def test_ranges_read_touched_chunks_only(spark, tmp_path):
    rng = random.Random(2)
    genome = {c: "".join(rng.choice("ACGTacgt") for _ in range(n)) for c, n in (("1", 20_000), ("2", 777), ("X", 64), ("Y", 0))}
    df = spark.createDataFrame(list(genome.items()), "chr string, seq string")
    path = str(tmp_path / "genome")
    chunks.write_chunks(df, path, chunk=64, folders=16)
    rows = [(i, c, rng.randint(-20, len(s) + 20), rng.randint(0, 300)) for i, (c, s) in enumerate(rng.choices(list(genome.items()), k=60))]
    rows = [(i, c, a, a + n) for i, c, a, n in rows] + [(100, "1", 50, 40), (101, "none", 1, 5), (102, "1", None, 5), (103, "X", 64, 64), (104, "1", 1, 20_000)]
    ranges = spark.createDataFrame(rows, "id int, chr string, start int, stop int")
    got = {r.id: r for r in chunks.read_ranges(spark, path, ranges, ["id"]).collect()}
    assert len(got) == len(rows)
    for i, c, a, b in rows:
        want = genome.get(c, "")[max(a, 1) - 1 : max(b, 0)].upper() if a is not None and a <= b else ""
        assert (got[i].seq or "") == want, (i, c, a, b)
        if want:
            assert (got[i].seq_start, got[i].seq_stop) == (max(a, 1), max(a, 1) + len(want) - 1)
    one = chunks.touched(spark, path, ranges.filter("id = 103"))
    assert one.count() == 1 and "dynamicpruning" in one._jdf.queryExecution().executedPlan().toString()
    read = chunks.touched(spark, path, ranges.filter("id < 3"))
    assert read.count() <= sum((n[3] - n[2]) // 64 + 2 for n in rows[:3])


def _merged(rows, gap):
    out = []
    for key, start, stop, label in sorted(rows, key=lambda r: (str(r[0]), r[1], r[3])):
        if out and out[-1][0] == key and start <= out[-1][2] + gap:
            out[-1] = [key, out[-1][1], max(out[-1][2], stop), out[-1][3] + 1, label]
        else:
            out.append([key, start, stop, 1, label])
    return sorted(map(tuple, out), key=str)


def test_merging_in_bins_equals_one_pass(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), s := rng.randint(-500, 4000), s + rng.choice([0, 3, 40, 900]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, start int, stop int, i int")
    for width in (None, 7, 100, 100_000):
        for gap in (0, 5):
            got = I.merge(df, ["k"], gap=gap, label="i", tie="i", width=width).select("k", "start", "stop", "n_merged", "i").collect()
            assert sorted(map(tuple, got), key=str) == _merged(rows, gap), (width, gap)
    points = spark.createDataFrame([(rng.choice("ab"), rng.randint(-300, 600)) for _ in range(900)], "k string, pos int")
    whole = sorted(map(tuple, I.islands(points, ["k"]).collect()))
    for width in (1, 9, 250):
        assert sorted(map(tuple, I.islands(points, ["k"], width=width).collect())) == whole


def test_coverage_by_events(spark):
    rng = random.Random(10)
    counts = [(rng.choice("xy"), rng.choice("ab"), s := rng.randint(1, 900), s + rng.choice([-1, 0, 5, 400]), rng.randint(1, 9)) for _ in range(120)]
    targets = [(rng.choice("abc"), s := rng.randint(1, 800), s + rng.randint(0, 60)) for _ in range(12)]
    df = spark.createDataFrame(counts, "sample string, chr string, start int, stop int, n int")
    goal = spark.createDataFrame(targets, "chr string, start int, stop int")
    want = {(s, c, p): sum(n for s2, c2, a, b, n in counts if (s2, c2) == (s, c) and a <= p <= b) for s in "xy" for c, a0, b0 in targets for p in range(a0, b0 + 1)}
    for width in (1, 50, 1 << 16):
        got = {(r["sample"], r.chr, r.pos): r.covered for r in I.coverage(df, goal, df, "n", ["chr"], "sample", width).collect()}
        assert got == want
