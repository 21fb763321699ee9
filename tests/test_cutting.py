import re

from strandloom.operators import reads as R
from strandloom.params import CutParams

FASTQ = "ord long, header string, seq string, plus string, qual string"


def _plain(pairs, index, tags, index_length, longest, skip, drop, trim):
    out = []
    for (o, h1, s1, q1), (_, h2, s2, q2), own in zip(*pairs, index):
        if drop and (re.fullmatch("#+", q1) or re.fullmatch("#+", q2)):
            continue
        h1, h2 = (re.sub(r"/\d$", "", h) for h in (h1, h2))
        header = h1 if len(h1) >= len(h2) else h2
        found = re.search("#([ATGCN]+)(-[ATGCN]*)?$", header)
        barcode = own[:index_length] if own is not None else found[1] if found else "N"
        if own is not None or not found:
            header = (header + "#" + barcode).replace(" ", "_")
        if tags and not re.search("#[ATGCN]+-[ATGCN]+$", header):
            header += "-" + s1[: tags[0]] + s2[: tags[1]]
            s1, q1, s2, q2 = s1[tags[0] :], q1[tags[0] :], s2[tags[1] :], q2[tags[1] :]
        mates = []
        for s, q in ((s1, q1), (s2, q2)):
            s, q = s[:longest], q[:longest]
            if trim:
                q = q.rstrip("#")
                s = s[: len(q)]
            mates += [s[skip:], q[skip:]]
        out.append((o, header, barcode, *mates))
    return sorted(out)


def test_pairs_against_a_plain_loop(spark):
    heads = ["@a/1", "@b x/1", "@c#ACGT/1", "@d#ACGT-TTT/1", "@e#AC-/1", "@f#acgt/1", "@gg/1"]
    quals = ["IIIIIIIII#", "##########", "II##II####", "IIIIIIIIII", "#I########", "IIIIIIIIII", "II"]
    one = [(i, h, "ACGTACGTAC"[: len(q)], q) for i, (h, q) in enumerate(zip(heads, quals))]
    two = [(i, h.replace("/1", "long/2") if i == 6 else h.replace("/1", "/2"), "TTGCATTGCA"[: len(q)], q[::-1]) for i, (h, q) in enumerate(zip(heads, quals))]
    frame = lambda rows: spark.createDataFrame([(o, h, s, "+", q) for o, h, s, q in rows], FASTQ)
    indexes = ["GGGGTTTT"] * len(one)
    for options in (dict(tags=(3, 2), index_length=None, longest=None, skip=0, drop=True, trim=False), dict(tags=None, index_length=4, longest=6, skip=1, drop=False, trim=True), dict(tags=(0, 4), index_length=None, longest=5, skip=2, drop=True, trim=True)):
        params = CutParams(options["tags"], options["index_length"], options["longest"], options["skip"], options["drop"], options["trim"])
        for own in (None, indexes):
            index = None if own is None else frame([(i, "@i", x, "I" * len(x)) for i, x in enumerate(own)])
            got = sorted(map(tuple, R.cut_pairs(frame(one), frame(two), params, index).collect()))
            assert got == _plain((one, two), own or [None] * len(one), **options), (options, own)


def test_singles_and_listed_barcodes(spark):
    rows = spark.createDataFrame([(0, "@a b/1", "ACGTACGT", "+", "IIIIII##"), (1, "@c#TT", "ACGTACGT", "+", "########"), (2, "@d#TT-AC", "ACGTACGT", "+", "IIIIIIII")], FASTQ)
    got = {r.ord: tuple(r)[1:] for r in R.cut_singles(rows, CutParams(tags=(2, 1), trim_hash=True)).collect()}
    assert got == {0: ("@a_b#N-ACT", "N", "GTAC", "IIII"), 1: ("@c#TT-ACT", "TT", "", ""), 2: ("@d#TT-AC", "TT", "ACGTACGT", "IIIIIIII")}
    listed = spark.createDataFrame([("s", "TT")], "label string, sequence string")
    assert {r.ord for r in R.cut_singles(rows, CutParams(drop_all_hash=True), barcodes=listed).collect()} == {2}
