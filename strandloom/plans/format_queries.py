"""Round trips through the text formats: rows are written, read back and used, and SQL says what they must be."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import from_letters
from ..operators import genome as G
from ..operators import reads as R
from ..operators.svm import LINEAR, SvmModel, predict
from ..sources import chunks, readers, writers
from ..tables import shared_dir
from .inputs import GENOME, LETTERS, genome, table


def _folder(spark: SparkSession, name: str) -> str:
    """A place to write to, in a new folder that is removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return f"{path}/{name}"


def _text(lines: DataFrame, value: Column, name: str) -> str:
    path = _folder(lines.sparkSession, name)
    lines.select(value.alias("value")).write.text(path)
    return path


def _tabbed(*columns: Column) -> Column:
    return F.concat_ws("\t", *[c.cast("string") for c in columns])


def bed_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of customers, through a BED file, with and without labels."""
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("chr"), F.col("c_nationkey").cast("string")).alias("chr"), (F.col("c_custkey") * 10).alias("start"), (F.col("c_custkey") * 10 + 25).alias("stop"), F.when(F.col("c_custkey") % 3 > 0, F.translate("c_mktsegment", " ", "_")).alias("label"))
    path = _text(rows, _tabbed(F.col("chr"), F.col("start"), F.col("stop"), F.col("label")), "bed")
    return readers.read_bed(spark, path).drop("ord")


BED = "SELECT CAST(c_nationkey AS VARCHAR) AS chr, CAST(c_custkey * 10 AS INTEGER) AS start, CAST(c_custkey * 10 + 25 AS INTEGER) AS stop, CASE WHEN c_custkey % 3 > 0 THEN replace(c_mktsegment, ' ', '_') ELSE 'region' END AS label FROM customer"


def fasta_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences through a wrapped FASTA file."""
    rows = genome(spark, sf_dir)
    path = _folder(spark, "fasta")
    writers.write_fasta(writers.fasta_lines(rows, F.concat(F.lit("chr"), F.col("chr").cast("string"), F.lit(" of a document")), F.col("seq")), path)
    return readers.read_fasta(spark, path).select("chr", "seq")


FASTA = f"SELECT CAST(chr AS VARCHAR) AS chr, seq FROM ({GENOME})"


def vcf_near_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of a VCF file within 500 bases of a feature; longer references mark the bases behind their first."""
    orders = table(spark, sf_dir, "orders")
    ref = F.when(F.col("o_orderkey") % 5 == 0, "ACG").otherwise("C")
    lines = orders.select(_tabbed(F.concat(F.lit("chr"), (F.col("o_custkey") % 7).cast("string")), F.col("o_orderkey") * 4, F.lit("."), ref, F.when(F.col("o_orderstatus") == "F", "T").otherwise("G")).alias("line"))
    variants = readers.read_vcf(spark, _text(lines, F.col("line"), "vcf"))
    features = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 7).cast("string").alias("chr"), (F.col("c_custkey") * 97).cast("int").alias("start_f"), (F.col("c_custkey") * 97 + 40).cast("int").alias("stop_f"))
    return readers.variants_near(variants, features)


VCF = """
WITH o AS (SELECT CAST(o_custkey % 7 AS VARCHAR) AS chr, o_orderkey * 4 AS base, CASE WHEN o_orderkey % 5 = 0 THEN 'ACG' ELSE 'C' END AS ref, CASE WHEN o_orderstatus = 'F' THEN 'T' ELSE 'G' END AS alt FROM orders),
v AS (SELECT chr, CAST(unnest(CASE WHEN length(ref) > 1 THEN range(base + 1, base + length(ref)) ELSE [base] END) AS INTEGER) AS pos, ref || alt AS alleles FROM o)
SELECT chr, pos, alleles FROM v WHERE EXISTS (SELECT 1 FROM customer c WHERE CAST(c.c_custkey % 7 AS VARCHAR) = v.chr AND v.pos BETWEEN c.c_custkey * 97 - 500 AND c.c_custkey * 97 + 540)
"""


def sam_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments written by disposition with read groups and read back: each with its folder's header lines."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    tags = R.with_read_group(F.when(n % 4 == 0, F.lit("NM:i:1\tRG:Z:own")).when(n % 4 == 1, "NM:i:0").otherwise(""), F.col("event_type"))
    reads = e.select(n.alias("ord"), F.concat(F.lit("r"), n.cast("string")).alias("qname"), (n % 2 * 16).cast("int").alias("flag"), (F.col("user_id") % 5).cast("string").alias("rname"), (n % 1000 + 1).cast("int").alias("pos"), F.lit(60).alias("mapq"), F.lit("20M").alias("cigar"), F.lit("*").alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"), F.lit("ACGT").alias("seq"), F.lit("IIII").alias("qual"), tags.alias("tags"), F.col("event_type").alias("disposition"))
    barcodes = e.select(F.col("event_type").alias("label"), from_letters(F.col("event_type")).alias("sequence")).distinct()
    header = writers.read_group_header(barcodes).orderBy("value").withColumn("line", F.monotonically_increasing_id())
    path = _folder(spark, "sam")
    writers.write_routed(reads, path, header)
    back, heads = readers.read_sam(spark, path)
    return back.select("qname", "flag", "rname", "pos", "cigar", "tags").withColumn("n_headers", F.lit(heads.count()))


SAM = """
SELECT 'r' || event_id AS qname, CAST(event_id % 2 * 16 AS INTEGER) AS flag, CAST(user_id % 5 AS VARCHAR) AS rname, CAST(event_id % 1000 + 1 AS INTEGER) AS pos, '20M' AS cigar,
  CASE WHEN event_id % 4 = 0 THEN 'NM:i:1' || chr(9) || 'RG:Z:own' WHEN event_id % 4 = 1 THEN 'NM:i:0' || chr(9) || 'RG:Z:' || event_type ELSE 'RG:Z:' || event_type END AS tags, CAST((SELECT count(DISTINCT event_type) * count(DISTINCT event_type) FROM events) AS INTEGER) AS n_headers FROM events
"""


def oligo_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of oligos and places of captures that aren't unique, from the tags of a SAM file."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    tags = F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("X0:i:"), (F.col("p_size") % 4 + 1).cast("string"), F.lit("\tX1:i:"), (key % 2).cast("string")))
    line = lambda name: F.concat_ws("\t", name, F.lit("0\t1\t5\t60\t16M\t*\t0\t0\tA\tI"), F.when(tags != "", tags))
    oligos, _ = readers.read_sam(spark, _text(p, line(F.format_string("chr%d:%d-%d", F.col("p_size"), key, key + 16)), "oligos"))
    captures, _ = readers.read_sam(spark, _text(p, line(F.format_string("%d_%d_%d", key % 3 + 100, F.col("p_size"), key)), "captures"))
    copies = readers.copy_counts(oligos).select(F.lit("oligo").alias("kind"), "chr", F.col("start").alias("pos"), "n")
    return copies.unionByName(readers.unmappable_captures(captures).select(F.lit("capture").alias("kind"), "chr", "pos", F.col("size").alias("n")))


OLIGOS = """
WITH p AS (SELECT p_partkey AS k, p_size, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size % 4 + 1 END AS x0, p_partkey % 2 AS x1 FROM part)
SELECT 'oligo' AS kind, CAST(p_size AS VARCHAR) AS chr, CAST(k AS INTEGER) AS pos, CAST(coalesce(x0, 100) AS INTEGER) AS n FROM p
UNION ALL SELECT 'capture', CAST(p_size AS VARCHAR), CAST(k AS INTEGER), CAST(k % 3 + 100 AS INTEGER) FROM p WHERE NOT (coalesce(x0, 0) = 1 AND x0 IS NOT NULL AND x1 = 0)
"""


def fastq_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as reads, through a compressed FASTQ file, numbered by their order."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.format_string("@c%d:%d", "conv_id", "turn").alias("header"), F.concat(F.lit("A"), from_letters(F.col("text"))).alias("seq"))
    path = _folder(spark, "fastq")
    writers.write_fastq(rows.withColumn("qual", F.translate("seq", "ACGT", "I5?#")), path, compress=True)
    return readers.read_fastq(spark, path).select("ord", "header", "seq", "qual")


FASTQ = f"""
WITH r AS (SELECT conv_id, turn, 'A' || {LETTERS.format("text")} AS seq FROM conversations)
SELECT row_number() OVER (ORDER BY conv_id * 1000 + turn) - 1 AS ord, '@c' || conv_id || ':' || turn AS header, seq, translate(seq, 'ACGT', 'I5?#') AS qual FROM r
"""


def qseq_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of qseq files of two folders with files of one name, as FASTQ records."""
    e = table(spark, sf_dir, "events")
    digits = F.lower(F.hex(F.col("event_id") * 7919 + 65536))
    line = _tabbed(F.lit("m"), F.lit(1), F.col("event_id") % 8, F.col("user_id"), F.col("event_id"), F.lit(5), F.lit(0), F.lit(1), F.translate(digits, "0123456789abcdef", "ACGT.CGTACGTACGT"), F.translate(digits, "0123456789abcdef", "hgfedcbaBCDEFGHI"), F.col("event_id") % 2)
    folder = _folder(spark, "qseq")
    for name, own in (("a", e.filter("event_id % 2 = 0")), ("b", e.filter("event_id % 2 = 1"))):
        own.select(line.alias("value")).write.text(f"{folder}/{name}")
    return R.qseq_records(readers.read_qseq(spark, [f"{folder}/b", f"{folder}/a"]), "run").select(F.col("ord.file").alias("file"), "header", "seq", "qual")


QSEQ = """
WITH e AS (SELECT event_id, user_id, lower(printf('%X', event_id * 7919 + 65536)) AS d FROM events)
SELECT CAST((event_id + 1) % 2 AS INTEGER) AS file, '@run:' || event_id % 8 || ':' || user_id || ':' || event_id || ':5:' || event_id % 2 AS header, translate(d, '0123456789abcdef', 'ACGTNCGTACGTACGT') AS seq, translate(d, '0123456789abcdef', 'IHGFEDCB#$%&''()*') AS qual FROM e
"""


def barcode_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads whose barcode is listed in a file or one base off it, by the barcode they stand for."""
    nations = table(spark, sf_dir, "nation")
    sequence = F.substring(F.concat(from_letters(F.col("n_name")), F.lit("ACGTACGT")), 1, 8)
    listed = readers.read_barcodes(spark, _text(nations.coalesce(1).orderBy("n_nationkey"), _tabbed(F.col("n_name").substr(F.lit(1), F.lit(5)), sequence), "barcodes"))
    reads = table(spark, sf_dir, "customer").select("c_custkey", F.substring(F.concat(from_letters(F.col("c_mktsegment")), F.translate(F.col("c_nationkey").cast("string"), "0123456789", "ACGTACGTAC"), F.lit("TTTTTTTT")), 1, 8).alias("barcode"))
    own = reads.join(nations.select(F.col("n_nationkey"), sequence.alias("s")), F.col("c_custkey") % 30 == F.col("n_nationkey"), "left").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.col("barcode")).otherwise(F.overlay("s", F.lit("N"), (F.col("c_custkey") % 8 + 1).cast("int"))).alias("barcode")).filter("barcode IS NOT NULL")
    return R.select_barcodes(own, R.barcode_neighbours(listed)).select("c_custkey", "barcode")


BARCODES = f"""
WITH n AS (SELECT n_nationkey AS k, substring({LETTERS.format("n_name")} || 'ACGTACGT', 1, 8) AS s FROM nation),
v AS (SELECT substring(s, 1, i - 1) || x || substring(s, i + 1) AS variant, arg_max(s, k) AS s FROM n CROSS JOIN (SELECT unnest(range(1, 9)) AS i) CROSS JOIN (SELECT unnest(['A', 'T', 'C', 'G', 'N']) AS x) GROUP BY 1),
r AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN substring({LETTERS.format("c_mktsegment")} || translate(CAST(c_nationkey AS VARCHAR), '0123456789', 'ACGTACGTAC') || 'TTTTTTTT', 1, 8) ELSE substring(n.s, 1, CAST(c_custkey % 8 AS BIGINT)) || 'N' || substring(n.s, CAST(c_custkey % 8 + 2 AS BIGINT)) END AS barcode FROM customer LEFT JOIN n ON c_custkey % 30 = n.k)
SELECT c_custkey, v.s AS barcode FROM r JOIN v ON v.variant = r.barcode
"""


def design_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes written as a design file, read back, and drawn as a track with their targets' sequences."""
    c = table(spark, sf_dir, "customer")
    at, plus = (F.col("c_custkey") * 300).cast("int"), F.col("c_custkey") % 2 == 0
    side = lambda one, two: F.when(plus, one).otherwise(two)
    arm = lambda salt, n: F.left(F.translate(F.sha2(F.concat(F.col("c_custkey").cast("string"), F.lit(salt)), 256), "0123456789abcdef", "ACGTACGTACGTACGT"), F.lit(n))
    values = {
        "mip_key": F.format_string("%d:%d-%d/16,24/%s", "c_nationkey", at, at + 139, side(F.lit("+"), F.lit("-"))), "score": (F.col("c_custkey") % 100 / 100).cast("double"), "chr": F.col("c_nationkey").cast("string"),
        "ext_probe_start": side(at, at + 124), "ext_probe_stop": side(at + 15, at + 139), "ext_probe_copy": F.lit(1), "ext_probe_sequence": arm("e", 16),
        "lig_probe_start": side(at + 116, at), "lig_probe_stop": side(at + 139, at + 23), "lig_probe_copy": F.lit(2), "lig_probe_sequence": arm("l", 24),
        "mip_scan_start_position": at + 24, "mip_scan_stop_position": at + 115, "scan_target_sequence": arm("s", 60), "mip_sequence": arm("m", 60), "feature_start_position": at, "feature_stop_position": at + 139,
        "probe_strand": side(F.lit("+"), F.lit("-")), "failure_flags": F.lit("000"), "mip_name": F.format_string("c_%04d", "c_custkey"),
    }
    path = _folder(spark, "design")
    writers.write_design(c.select(*[v.alias(k) for k, v in values.items()]), path)
    back = readers.read_design(spark, path)
    tracks = writers.track_rows(back).select(F.col("name").alias("mip_key"), "chrom", "start", "thick_start", "thick_end", "end", "strand")
    targets = writers.target_fasta(back).select(F.regexp_extract("value", r"^>(\S+)", 1).alias("mip_key"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n", ""), "\n", "").alias("target"))
    return tracks.join(targets, "mip_key").join(back.select("mip_key", "score", "mip_name"), "mip_key").join(readers.probes_of(back).select("mip_key", "mip_start", "mip_stop"), "mip_key")


_ARM = "substring(translate(sha256(c_custkey || '{0}'), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, {1})"
DESIGN = f"""
WITH c AS (SELECT *, CAST(c_custkey * 300 AS INTEGER) AS base, c_custkey % 2 = 0 AS plus, {_ARM.format("e", 16)} || {_ARM.format("s", 60)} || {_ARM.format("l", 24)} AS whole FROM customer)
SELECT c_nationkey || ':' || base || '-' || (base + 139) || CASE WHEN plus THEN '/16,24/+' ELSE '/16,24/-' END AS mip_key, 'chr' || c_nationkey AS chrom, CAST(base - 1 AS INTEGER) AS start, CAST(CASE WHEN plus THEN base + 15 ELSE base + 23 END AS INTEGER) AS thick_start,
  CAST(CASE WHEN plus THEN base + 115 ELSE base + 123 END AS INTEGER) AS thick_end, CAST(base + 139 AS INTEGER) AS "end", CASE WHEN plus THEN '+' ELSE '-' END AS strand, CASE WHEN plus THEN whole ELSE reverse(translate(whole, 'ACGT', 'TGCA')) END AS target,
  CAST(printf('%.6g', c_custkey % 100 / 100.0::DOUBLE) AS DOUBLE) AS score, 'c_' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(4, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') AS mip_name, base AS mip_start, CAST(base + 139 AS INTEGER) AS mip_stop FROM c
"""


def refgene_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons of wanted genes from a refGene file: clipped to the coding part, and whole."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct((F.col("l_linenumber") * 100 + F.col("l_orderkey") % 50).alias("a"), (F.col("l_linenumber") * 100 + F.col("l_orderkey") % 50 + F.col("l_quantity").cast("int")).alias("b")))).alias("x"))
    listed = lambda f: F.concat(F.array_join(F.transform("x", lambda v: v[f].cast("string")), ","), F.lit(","))
    zero, name = F.lit(0), F.concat(F.lit("NM"), F.col("l_orderkey").cast("string"))
    line = _tabbed(zero, name, F.lit("chr1"), F.lit("+"), zero, zero, F.lit(150), F.lit(420), F.size("x"), listed("a"), listed("b"), zero, F.concat(F.lit("G"), (F.col("l_orderkey") % 500).cast("string")))
    genes = readers.read_refgene(spark, _text(items, line, "refgene"))
    symbols = table(spark, sf_dir, "nation").select(F.concat(F.lit("G"), (F.col("n_nationkey") * 17).cast("string")).alias("symbol"))
    coding = readers.coding_exons(genes, symbols).withColumn("kind", F.lit("coding"))
    return coding.unionByName(readers.exons_with_utrs(genes, symbols).withColumn("kind", F.lit("whole"))).drop("chrom")


REFGENE = """
WITH e AS (SELECT l_orderkey AS k, CAST(l_linenumber * 100 + l_orderkey % 50 AS INTEGER) AS a, CAST(l_linenumber * 100 + l_orderkey % 50 + CAST(l_quantity AS INTEGER) AS INTEGER) AS b, 'G' || l_orderkey % 500 || '/NM' || l_orderkey AS name FROM lineitem WHERE l_orderkey % 500 IN (SELECT n_nationkey * 17 FROM nation))
SELECT greatest(a, 150) AS start, least(b, 420) AS stop, name, 'coding' AS kind FROM e WHERE 150 <= b AND 420 >= a
UNION ALL SELECT a - 1, b, name, 'whole' FROM e
"""


def model_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors scored by a linear model that was written to its text format and read back."""
    model = SvmModel("epsilon_svr", LINEAR, rho=[0.25], coef=np.array([[1.0, -0.5]]), sv=np.array([[(j % 7) / 8 for j in range(64)], [(j % 5) / 4 for j in range(64)]]))
    lines = spark.createDataFrame([("\n".join(writers.svm_model_lines(model)),)], "line string")
    back = readers.read_svm_model(spark, _text(lines.coalesce(1), F.col("line"), "model"))
    return predict(table(spark, sf_dir, "embeddings"), back, "embedding", "score").select("vec_id", F.round("score", 5).alias("score"))


MODEL = "SELECT vec_id, round(list_sum(list_transform(embedding, lambda v, i: v::DOUBLE * ((i - 1) % 7 / 8.0::DOUBLE))) - 0.5 * list_sum(list_transform(embedding, lambda v, i: v::DOUBLE * ((i - 1) % 5 / 4.0::DOUBLE))) - 0.25, 5) AS score FROM embeddings"


def range_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of every sequence, read from a table of chunks of 256 bases."""
    path = _folder(spark, "chunks")
    chunks.write_chunks(genome(spark, sf_dir), path, chunk=256, folders=32)
    start = (F.col("doc_id") * 37 % 900 - 40).cast("int")
    ranges = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("chr"), start.alias("start"), (start + 300).alias("stop"))
    return chunks.read_ranges(spark, path, ranges, ["doc_id"]).select("doc_id", "seq", "seq_start", "seq_stop")


RANGES = f"""
WITH g AS ({GENOME}), r AS (SELECT chr AS doc_id, seq AS s, greatest(chr * 37 % 900 - 40, 1) AS a, chr * 37 % 900 + 260 AS b FROM g),
c AS (SELECT doc_id, a, nullif(substring(s, a, greatest(b - a + 1, 0)), '') AS seq FROM r)
SELECT doc_id, seq, CASE WHEN seq IS NOT NULL THEN a END AS seq_start, a + length(seq) - 1 AS seq_stop FROM c
"""


def slices_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surroundings of features: the joined sequence slices, clamped to what is known."""
    features = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chr"), (F.col("doc_id") % 700 + 1).cast("int").alias("start_f"), (F.col("doc_id") % 700 + 60).cast("int").alias("stop_f"))
    return G.sequence_slices(features, genome(spark, sf_dir), 50).select("chr", "seq", "seq_start", "seq_stop")


SLICES = f"SELECT chr, substring(seq, greatest(chr % 700 - 49, 1), greatest(least(length(seq), chr % 700 + 110) - greatest(chr % 700 - 49, 1) + 1, 0)) AS seq, CAST(greatest(chr % 700 - 49, 1) AS INTEGER) AS seq_start, CAST(least(length(seq), chr % 700 + 110) AS INTEGER) AS seq_stop FROM ({GENOME})"

QUERIES = {f.__name__: f for f in (bed_regions, fasta_records, vcf_near_features, sam_routed, oligo_copies, fastq_records, qseq_reads, barcode_selection, design_tracks, refgene_exons, model_predictions, range_reads, slices_around)}
ORACLES = {"bed_regions": BED, "fasta_records": FASTA, "vcf_near_features": VCF, "sam_routed": SAM, "oligo_copies": OLIGOS, "fastq_records": FASTQ, "qseq_reads": QSEQ, "barcode_selection": BARCODES, "design_tracks": DESIGN, "refgene_exons": REFGENE, "model_predictions": MODEL, "range_reads": RANGES, "slices_around": SLICES}
