"""Writers of the text formats, through Spark's own sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import reverse_complement, wrapped
from ..operators.svm import POLY, PRECOMPUTED, RBF, SIGMOID, SvmModel
from .readers import DESIGN_COLUMNS


def write_table(df: DataFrame, path: str, header: bool = True, compression: str | None = None, by: list[str] | None = None) -> None:
    """Tab-separated files, one folder per value of the columns in ``by``."""
    writer = df.write.option("sep", "\t").option("header", header).option("compression", compression or "none")
    (writer.partitionBy(*by) if by else writer).csv(path)


def write_design(df: DataFrame, path: str, model: str = "logistic") -> None:
    """Design records under their header, the score's column named by its model."""
    names = [f"{model}_score" if c == "score" else c for c in DESIGN_COLUMNS]
    write_table(df.select(*[F.format_string("%.6g", F.col(c)) if c == "score" else F.col(c) for c in DESIGN_COLUMNS]).toDF(f">{names[0]}", *names[1:]), path)


def write_gaps(gaps: DataFrame, path: str) -> None:
    """Uncovered intervals as BED, one folder per kind of gap."""
    write_table(gaps.select("chr", (F.col("start") - 1).alias("start"), "stop", "kind"), path, header=False, by=["kind"])


def fastq_lines(records: DataFrame) -> DataFrame:
    return records.select("ord", F.concat_ws("\n", "header", "seq", F.lit("+"), "qual").alias("value"))


def write_fastq(records: DataFrame, path: str, compress: bool = False) -> None:
    """FASTQ records, sorted by ordinal."""
    fastq_lines(records).orderBy("ord").select("value").write.option("compression", "gzip" if compress else "none").text(path)


def fasta_lines(records: DataFrame, name: Column, seq: Column, width: int = 70) -> DataFrame:
    return records.select(F.concat_ws("\n", F.concat(F.lit(">"), name), F.array_join(wrapped(seq, width), "\n")).alias("value"))


def target_fasta(design: DataFrame) -> DataFrame:
    """Lines of a FASTA of probe targets: arms and scan as the plus strand reads them."""
    plain = F.concat("ext_probe_sequence", "scan_target_sequence", "lig_probe_sequence")
    return fasta_lines(design, F.col("mip_key"), F.when(F.col("probe_strand") == "-", reverse_complement(plain)).otherwise(plain))


def write_fasta(lines: DataFrame, path: str) -> None:
    lines.write.text(path)


def track_rows(design: DataFrame, colour: str = "0,0,0") -> DataFrame:
    """BED9 rows of probes: from the first arm's start to the last's end, thick between the arms."""
    ends = F.array_sort(F.array("ext_probe_start", "ext_probe_stop", "lig_probe_start", "lig_probe_stop"))
    rows = design.withColumn("__e", ends)
    return rows.select(F.concat(F.lit("chr"), F.col("chr")).alias("chrom"), (F.col("__e")[0] - 1).alias("start"), F.col("__e")[3].alias("end"), F.col("mip_key").alias("name"), F.lit(1).alias("score"), F.col("probe_strand").alias("strand"), F.col("__e")[1].alias("thick_start"), (F.col("__e")[2] - 1).alias("thick_end"), F.lit(colour).alias("rgb"))


def sam_lines(reads: DataFrame) -> DataFrame:
    """SAM lines of alignments with their optional fields."""
    columns = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
    line = F.concat_ws("\t", *[F.col(c).cast("string") for c in columns])
    return reads.select("ord", "disposition", F.when(F.col("tags") == "", line).otherwise(F.concat_ws("\t", line, "tags")).alias("value"))


def write_routed(reads: DataFrame, path: str, header: DataFrame | None = None) -> None:
    """SAM files by disposition, a folder each: header lines (line, value) first, then alignments in order.

    A range shuffle by disposition and order lets a large folder have several parts, which follow one another
    by name; the header stands in the first.
    """
    lines = sam_lines(reads)
    if header is not None:
        heads = lines.select("disposition").distinct().join(header.select("line", "value"), how="cross")  # a few of either
        lines = lines.withColumn("part", F.lit(1)).unionByName(heads.select("disposition", F.lit(0).alias("part"), F.col("line").alias("ord"), "value"))
    else:
        lines = lines.withColumn("part", F.lit(1))
    lines.orderBy("disposition", "part", "ord").select("disposition", "value").write.partitionBy("disposition").text(path)


def write_collapsed(reads: DataFrame, path: str, split_by_barcode: bool = False, header: DataFrame | None = None) -> None:
    """SAM files of collapsed reads (``operators.collapse``), a folder per route or, of the routes "unique" and
    "uncollapsed", per sample."""
    kept = F.col("route").isin("unique", "uncollapsed")
    folder = F.when(kept, F.concat_ws(".", "sample", "route")).otherwise(F.col("route")) if split_by_barcode else F.col("route")
    write_routed(reads.withColumn("disposition", folder), path, header)


def read_group_header(barcodes: DataFrame) -> DataFrame:
    """@RG lines, one per barcode."""
    return barcodes.select(F.concat(F.lit("@RG\tID:"), F.col("sequence"), F.lit("\tSM:"), F.col("label")).alias("value"))


def svm_model_lines(model: SvmModel) -> list[str]:
    """A support-vector model in its text format."""
    number = lambda x: f"{x:.16g}"
    head = [f"svm_type {model.svm_type}", f"kernel_type {model.kernel}"]
    if model.kernel == POLY:
        head.append(f"degree {model.degree}")
    if model.kernel in (POLY, RBF, SIGMOID):
        head.append(f"gamma {number(model.gamma)}")
    if model.kernel in (POLY, SIGMOID):
        head.append(f"coef0 {number(model.coef0)}")
    head += [f"nr_class {max(2, len(model.counts))}", f"total_sv {len(model.sv)}", "rho " + " ".join(map(number, model.rho))]
    for key, values in (("label", model.labels), ("probA", model.prob_a), ("probB", model.prob_b), ("nr_sv", model.counts)):
        if values:
            head.append(f"{key} " + " ".join(map(number, values)))
    first = 0 if model.kernel == PRECOMPUTED else 1
    body = [" ".join([*map(number, coef), *(f"{j + first}:{number(v)}" for j, v in enumerate(row) if v or model.kernel in (PRECOMPUTED,))]) for coef, row in zip(model.coef.T, model.sv, strict=True)]
    return [*head, "SV", *body]

