"""Sequence queries over genomes derived from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alignments as A
from ..functions import sequences as S
from ..operators import genome as G
from ..operators import svm
from .inputs import GENOME, genome, table

RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"
SIZE = 12


def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reverse complement of every sequence, and whether it is its own."""
    rows = genome(spark, sf_dir)
    return rows.select("chr", S.reverse_complement(F.col("seq")).alias("rc"), S.is_palindrome(F.col("seq")).alias("palindrome"))


REVERSE_COMPLEMENT = f"SELECT chr, {RC.format('seq')} AS rc, seq = {RC.format('seq')} AS palindrome FROM ({GENOME})"


def kmer_count_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences that may overlap, of three k-mers in every sequence, and their shares."""
    rows = genome(spark, sf_dir)
    out = [x for m in ("AA", "TT", "ACA") for x in (S.count_overlapping(F.col("seq"), m).cast("long").alias(f"n_{m}"), F.round(S.share_of_mer(F.col("seq"), m), 6).alias(f"share_{m}"))]
    return rows.select("chr", *out, F.round(S.share_of_bases(F.col("seq"), "GC"), 6).alias("gc"))


def _count(mer: str) -> str:
    return f"CAST(len(list_filter(range(1, length(seq) - {len(mer) - 1} + 1), lambda i: substring(seq, i, {len(mer)}) = '{mer}')) AS BIGINT)"


KMER_COUNT = (
    "SELECT chr, "
    + ", ".join(f"{_count(m)} AS n_{m}, CASE WHEN length(seq) > {len(m) - 1} THEN round({_count(m)} / (length(seq) - {len(m) - 1}), 6) ELSE 0.0 END AS share_{m}" for m in ("AA", "TT", "ACA"))
    + f", CASE WHEN length(seq) > 0 THEN round((length(seq) - length(translate(seq, 'GC', ''))) / length(seq), 6) ELSE 0.0 END AS gc FROM ({GENOME})"
)


def kmer_copy_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many 12-mers occur how often, on either strand of the whole genome."""
    return G.copy_numbers(genome(spark, sf_dir), SIZE).groupBy("copies").agg(F.count(F.lit(1)).alias("n_kmers"), F.min("kmer").alias("first_kmer"))


WINDOWS = f"SELECT chr, i AS start, substring(seq, i, {{size}}) AS kmer FROM (SELECT chr, seq, unnest(range(1, length(seq) - {{size}} + 2)) AS i FROM ({GENOME}) WHERE length(seq) >= {{size}})"
KMER_COPY = f"WITH k AS ({WINDOWS.format(size=SIZE)}), c AS (SELECT least(kmer, {RC.format('kmer')}) AS kmer, count(*) AS copies FROM k GROUP BY 1) SELECT copies, count(*) AS n_kmers, min(kmer) AS first_kmer FROM c GROUP BY copies"


def unique_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 30 bases that occur once on either strand, counted by sequence."""
    return G.unique_windows(genome(spark, sf_dir), 30, spell=False).groupBy("chr").agg(F.count(F.lit(1)).alias("n_unique"), F.min("start").alias("first_start"))


UNIQUE_WINDOWS = f"WITH k AS ({WINDOWS.format(size=30)}), u AS (SELECT any_value(chr) AS chr, any_value(start) AS start FROM k GROUP BY least(kmer, {RC.format('kmer')}) HAVING count(*) = 1) SELECT chr, count(*) AS n_unique, min(start) AS first_start FROM u GROUP BY chr"


def wrap_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 70 bases of every sequence."""
    return genome(spark, sf_dir).select("chr", F.array_join(S.wrapped(F.col("seq")), "\n").alias("lines"))


WRAP_TEXT = f"SELECT chr, array_to_string(regexp_extract_all(seq, '(?s).{{1,70}}'), chr(10)) AS lines FROM ({GENOME})"


def base_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of G or C and of other bases in every sequence."""
    return genome(spark, sf_dir).select("chr", S.base_runs(F.col("seq")).cast("long").alias("runs"))


BASE_RUNS = f"SELECT chr, CAST(len(regexp_extract_all(seq, '[GC]+|[^GC]+')) AS BIGINT) AS runs FROM ({GENOME})"


def cigar_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference and read span of CIGAR strings made from lineitem's numbers."""
    op = F.element_at(F.array(*map(F.lit, "IDS=X")), (F.col("l_partkey") % 5 + 1).cast("int"))
    cigar = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("M"), (F.col("l_suppkey") % 9 + 1).cast("string"), op, F.col("l_linenumber").cast("string"), F.lit("M"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cigar.alias("cigar"))
    return rows.select("l_orderkey", "l_linenumber", "cigar", A.reference_span(F.col("cigar")).alias("ref_span"), A.read_span(F.col("cigar")).alias("read_span"))


CIGAR_SPAN = """
WITH c AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS q, CAST(l_suppkey % 9 + 1 AS INTEGER) AS n, substring('IDS=X', CAST(l_partkey % 5 + 1 AS INTEGER), 1) AS op FROM lineitem)
SELECT l_orderkey, l_linenumber, q || 'M' || n || op || l_linenumber || 'M' AS cigar, q + l_linenumber + CASE WHEN op = 'D' THEN n ELSE 0 END AS ref_span, q + l_linenumber + CASE WHEN op <> 'D' THEN n ELSE 0 END AS read_span FROM c
"""


def svr_rbf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of RBF kernels of every vector with the mean vector of each label, weighted by label."""
    rows = table(spark, sf_dir, "embeddings")
    places = rows.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    centres = places.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("c")).withColumnRenamed("label", "of")
    whole = centres.agg(F.collect_list(F.struct("of", "c")).alias("all"))  # one row: as many centres as labels
    value = F.aggregate("all", F.lit(0.0), lambda s, x: s + (x["of"] + 1) * svm.kernel(F.col("embedding"), x["c"], svm.RBF, 0.5))
    return rows.crossJoin(F.broadcast(whole)).select("vec_id", F.round(value, 4).alias("score"))


SVR_RBF = """
WITH p AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, embedding FROM embeddings),
m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM p GROUP BY label, i),
e AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, embedding FROM embeddings)),
d AS (SELECT vec_id, m.label, sum((v - m) * (v - m)) AS d FROM e JOIN m ON m.i = e.i GROUP BY vec_id, m.label)
SELECT vec_id, round(sum((label + 1) * exp(-0.5 * d)), 4) AS score FROM d GROUP BY vec_id
"""

QUERIES = {f.__name__: f for f in (reverse_complement, kmer_count_overlapping, kmer_copy_number, unique_windows, wrap_text, base_runs, cigar_span, svr_rbf)}
ORACLES = {"reverse_complement": REVERSE_COMPLEMENT, "kmer_count_overlapping": KMER_COUNT, "kmer_copy_number": KMER_COPY, "unique_windows": UNIQUE_WINDOWS, "wrap_text": WRAP_TEXT, "base_runs": BASE_RUNS, "cigar_span": CIGAR_SPAN, "svr_rbf": SVR_RBF}
