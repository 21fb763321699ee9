"""Readers of the text formats: each gives a typed table with an ordinal where order matters.

All read through Spark, from any store, any number of files, gzip included. Plain files are split among
tasks. A line's number comes from its place in its split and the lines of the splits before it, which
one aggregation counts; files follow one another by path.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.svm import LINEAR, POLY, PRECOMPUTED, RBF, SIGMOID, SvmModel

DESIGN_COLUMNS = (
    "mip_key score chr ext_probe_start ext_probe_stop ext_probe_copy ext_probe_sequence lig_probe_start lig_probe_stop lig_probe_copy "
    "lig_probe_sequence mip_scan_start_position mip_scan_stop_position scan_target_sequence mip_sequence feature_start_position "
    "feature_stop_position probe_strand failure_flags mip_name"
).split()


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, value): the lines of files, counted from 0 in each."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"), "value")
    splits = raw.groupBy("file", "__block").agg(F.min("__id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "__block", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return raw.join(splits, ["file", "__block"]).select("file", (F.col("__id") + F.col("shift")).alias("line"), "value")


def _fields(value: Column, blanks: str = r"[ \t]+") -> Column:
    return F.split(F.btrim(value, F.lit(" \t\r")), blanks)


def without_prefix(chromosome: Column) -> Column:
    return F.regexp_replace(chromosome, "^chr", "")


def read_bed(spark: SparkSession, path: str, default_label: str = "region") -> DataFrame:
    """(chr, start, stop, label, ord): regions, start 0-based; comments and short lines are left out."""
    rows = _lines(spark, path).withColumn("value", F.btrim("value", F.lit(" \t\r"))).filter((F.length("value") > 1) & ~F.startswith("value", F.lit("#")))
    parts = rows.withColumn("f", _fields(F.col("value")))
    return parts.select(without_prefix(F.col("f")[0]).alias("chr"), F.col("f")[1].cast("int").alias("start"), F.col("f")[2].cast("int").alias("stop"), F.coalesce(F.get("f", F.lit(3)), F.lit(default_label)).alias("label"), F.col("line").alias("ord"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chr, seq, ord): records of FASTA files, upper-cased; the name ends at the first blank."""
    parts = spark.read.option("lineSep", "\n>").text(path)
    records = parts.select(F.regexp_replace("value", "^>", "").alias("r"), F.monotonically_increasing_id().alias("ord")).filter(F.btrim("r", F.lit(" \t\r\n")) != "")
    head = F.regexp_extract("r", r"^(\S+)", 1)
    body = F.regexp_replace(F.regexp_replace("r", r"^[^\n]*\n?", ""), r"\s", "")
    return records.select(without_prefix(head).alias("chr"), F.upper(body).alias("seq"), "ord")


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """(chr, pos, alleles): variants; a longer reference marks the bases after its first. Later lines win."""
    rows = _lines(spark, path).filter((F.length("value") > 1) & ~F.startswith("value", F.lit("#"))).withColumn("f", F.split("value", "\t"))
    parts = rows.select("line", without_prefix(F.col("f")[0]).alias("chr"), F.col("f")[1].cast("int").alias("pos"), F.col("f")[3].alias("ref"), F.col("f")[4].alias("alt"))
    n = F.length("ref")
    marked = parts.withColumn("pos", F.explode(F.when(n > 1, F.sequence(F.col("pos") + 1, F.col("pos") + n - 1)).otherwise(F.array("pos"))))
    return marked.groupBy("chr", "pos").agg(F.max_by(F.concat("ref", "alt"), "line").alias("alleles"))


def variants_near(variants: DataFrame, features: DataFrame, margin: int = 500, width: int = 4096) -> DataFrame:
    """Variants within so many bases of a feature: the ranges are merged, binned, and semi-joined."""
    from ..operators.intervals import merge, point_join

    ranges = merge(features.select("chr", (F.col("start_f") - margin).alias("start"), (F.col("stop_f") + margin).alias("stop")), ["chr"], gap=0)
    return point_join(variants, ranges, ["chr"], width).select(*variants.columns)


def read_sam(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(alignments, header lines); alignments have the eleven fields, further ones in tags, and ord."""
    rows = _lines(spark, path).filter(F.length("value") > 0)
    header = rows.filter(F.startswith("value", F.lit("@"))).select("line", "value")
    f = F.col("f")
    body = rows.filter(~F.startswith("value", F.lit("@"))).withColumn("f", F.split("value", "\t"))
    fields = body.select(
        F.col("line").alias("ord"), f[0].alias("qname"), f[1].cast("int").alias("flag"), without_prefix(f[2]).alias("rname"), f[3].cast("int").alias("pos"), f[4].cast("int").alias("mapq"),
        f[5].alias("cigar"), f[6].alias("rnext"), f[7].cast("int").alias("pnext"), f[8].cast("int").alias("tlen"), f[9].alias("seq"), f[10].alias("qual"), F.array_join(F.slice(f, 12, F.size(f)), "\t").alias("tags"),
    )
    return fields, header


def copy_counts(alignments: DataFrame) -> DataFrame:
    """(chr, start, stop, n) of oligos named chr<c>:<a>-<b>; n is the tag X0, 100 without it."""
    name = lambda g: F.regexp_extract("qname", r"^(?:chr)?([^:]+):(\d+)-(\d+)", g)
    found = F.regexp_extract("tags", r"X0:i:(\d+)", 1)
    return alignments.select(name(1).alias("chr"), name(2).cast("int").alias("start"), name(3).cast("int").alias("stop"), F.when(found == "", 100).otherwise(found.try_cast("int")).alias("n"))


def unmappable_captures(alignments: DataFrame) -> DataFrame:
    """(size, chr, pos) of captures named <size>_<chr>_<start> that aren't unique (X0 1 and X1 0)."""
    tag = lambda t: F.regexp_extract("tags", rf"{t}:i:(\d+)", 1)
    name = lambda g: F.regexp_extract("qname", r"^(\d+)_(.+)_(\d+)$", g)
    return alignments.filter(~((tag("X0") == "1") & (tag("X1") == "0"))).select(name(1).cast("int").alias("size"), name(2).alias("chr"), name(3).cast("int").alias("pos"))


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(ord, header, seq, plus, qual): records of four lines, numbered through all files by path."""
    rows = _lines(spark, path).withColumn("record", F.floor(F.col("line") / 4)).withColumn("k", F.col("line") % 4)
    one = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    records = rows.groupBy("file", "record").agg(one(0).alias("header"), one(1).alias("seq"), one(2).alias("plus"), one(3).alias("qual")).filter("qual IS NOT NULL AND header <> ''")
    sizes = rows.groupBy("file").agg(F.floor((F.max("line") + 1) / 4).alias("n"))
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))  # a row per file
    numbered = records.join(sizes.select("file", F.coalesce(before, F.lit(0)).alias("before")), "file")
    return numbered.select((F.col("before") + F.col("record")).alias("ord"), "header", "seq", "plus", "qual")


def read_qseq(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(ord, lane, tile, x, y, seq, qual, passed) of qseq files, in the order of the paths, files of a folder by name."""
    whole = [p.split(":", 1)[-1].rstrip("/").lstrip("/") for p in paths]  # a path is a file or a folder
    inside = lambda p: F.rlike("file", F.lit(rf"/{re.escape(p)}(/|$)"))
    place = F.coalesce(*[F.when(inside(p), i) for i, p in enumerate(whole)])
    f = F.col("f")
    rows = _lines(spark, paths).filter(F.length("value") > 0).withColumn("f", F.split("value", "\t"))
    order = F.struct(place.alias("file"), F.col("file").alias("path"), "line")
    return rows.select(order.alias("ord"), f[2].alias("lane"), f[3].alias("tile"), f[4].alias("x"), f[5].alias("y"), f[8].alias("seq"), f[9].alias("qual"), f[10].alias("passed"))


def read_barcodes(spark: SparkSession, path: str, dual: bool = False) -> DataFrame:
    """(label, sequence, ord); dual index: both sequences joined."""
    rows = _lines(spark, path).filter(F.btrim("value", F.lit(" \t\r")) != "").withColumn("f", _fields(F.col("value")))
    return rows.select(F.col("f")[0].alias("label"), (F.concat(F.col("f")[1], F.col("f")[2]) if dual else F.col("f")[1]).alias("sequence"), F.col("line").alias("ord"))


def read_design(spark: SparkSession, path: str) -> DataFrame:
    """Design records by column name, from the header if there is one (">mip_key ..."), else by place.

    The driver reads the header line alone.
    """
    rows = _lines(spark, path).filter(F.length("value") > 0)
    head = rows.filter(F.startswith("value", F.lit(">mip_key"))).select("value").first()
    names = head["value"][1:].split("\t") if head else DESIGN_COLUMNS
    body = rows.filter(~F.rlike("value", F.lit("^[#>]"))).withColumn("f", F.split("value", "\t"))
    ints = {c for c in DESIGN_COLUMNS if re.search("start|stop|copy", c)}
    columns = [F.get("f", F.lit(i)).try_cast("int" if n in ints else "double" if n.endswith("score") else "string").alias("score" if n.endswith("_score") else n) for i, n in enumerate(names)]
    return body.select(F.col("line").alias("ord"), *columns)


def probes_of(design: DataFrame) -> DataFrame:
    """(mip_key, chr, mip_start, mip_stop, strand, ord) read off the keys of a design."""
    part = lambda g: F.regexp_extract("mip_key", r"^(.+):(\d+)-(\d+)/\d+,\d+/([+-])$", g)
    return design.select("mip_key", part(1).alias("chr"), part(2).cast("int").alias("mip_start"), part(3).cast("int").alias("mip_stop"), part(4).alias("strand"), "ord")


def tag_sizes(design: DataFrame) -> DataFrame:
    """(lig_tag, ext_tag): runs of N around the backbone in the first record."""
    first = design.orderBy("ord").limit(1)
    run = lambda g: F.length(F.regexp_extract("mip_sequence", r"^[ACGT]*(N*)[ACGT]{30}(N*)[ACGT]*$", g))
    return first.select(run(1).alias("lig_tag"), run(2).alias("ext_tag"))


def read_refgene(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, name, cds_start, cds_end, starts, ends, symbol) of a refGene table."""
    f = F.col("f")
    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("int"))
    return _lines(spark, path).filter(F.length("value") > 0).withColumn("f", F.split("value", r"\s+")).select(f[2].alias("chrom"), f[1].alias("name"), f[6].cast("int").alias("cds_start"), f[7].cast("int").alias("cds_end"), numbers(f[9]).alias("starts"), numbers(f[10]).alias("ends"), f[12].alias("symbol"))


def coding_exons(genes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(chrom, start, stop, name): exons of the wanted genes, clipped to the coding part."""
    rows = genes.join(symbols.select("symbol").distinct(), "symbol", "left_semi").withColumn("e", F.explode(F.arrays_zip("starts", "ends")))
    kept = rows.filter((F.col("e.starts") > 0) & (F.col("cds_start") <= F.col("e.ends")) & (F.col("cds_end") >= F.col("e.starts")))
    return kept.select("chrom", F.greatest("e.starts", "cds_start").alias("start"), F.least("e.ends", "cds_end").alias("stop"), F.concat_ws("/", "symbol", "name").alias("name"))


def exons_with_utrs(genes: DataFrame, symbols: DataFrame, shift: int = -1) -> DataFrame:
    """(chrom, start, stop, name): whole exons of the wanted genes, starts moved by a shift."""
    rows = genes.join(symbols.select("symbol").distinct(), "symbol", "left_semi").withColumn("e", F.explode(F.arrays_zip("starts", "ends")))
    return rows.select("chrom", (F.col("e.starts") + shift).alias("start"), F.col("e.ends").alias("stop"), F.concat_ws("/", "symbol", "name").alias("name"))


def read_svm_model(spark: SparkSession, path: str) -> SvmModel:
    """A support-vector model in its text format. It is read to the driver: models are parameters."""
    lines = [r["value"] for r in spark.read.text(path, wholetext=True).collect()][0].splitlines()
    at = lines.index("SV")
    head = dict((x.split(" ", 1) + [""])[:2] for x in lines[:at])
    numbers = lambda key, kind=float: [kind(x) for x in head.get(key, "").split()]
    body = [x.split() for x in lines[at + 1 :] if x.strip()]
    width = max(1, int(head.get("nr_class", "2")) - 1)
    sparse = [{int(i): float(v) for i, v in (p.split(":") for p in row[width:])} for row in body]
    kind = {"linear": LINEAR, "polynomial": POLY, "rbf": RBF, "sigmoid": SIGMOID, "precomputed": PRECOMPUTED}[head["kernel_type"]]
    first = 0 if kind == PRECOMPUTED else 1
    sv = np.zeros((len(body), max((max(r, default=0) for r in sparse), default=0) + 1 - first))
    for i, row in enumerate(sparse):
        for j, v in row.items():
            sv[i, j - first] = v
    one = lambda key, default: float(head.get(key, default))
    return SvmModel(head["svm_type"], kind, one("gamma", 0), one("coef0", 0), int(one("degree", 3)), numbers("rho"), numbers("label", int), numbers("nr_sv", int), numbers("probA"), numbers("probB"), np.array([[float(x) for x in r[:width]] for r in body]).T.reshape(width, -1), sv)
