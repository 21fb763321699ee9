"""Read queries: reads derived from conversations, events and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alignments as A
from ..functions.sequences import from_letters
from ..operators import collapse as E
from ..operators import complexity as C
from ..operators import reads as R
from ..params import CollapseParams, CutParams
from .inputs import LETTERS, table

TAGS = CollapseParams().tags


def zip_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User and assistant turns as two files of reads, zipped by ordinal, tagged and trimmed."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.floor(F.col("turn") / 2)).alias("ord"), "role", F.concat(F.lit("@r"), F.col("conv_id").cast("string"), F.lit("/"), (F.col("turn") % 2 + 1).cast("string")).alias("header"), from_letters(F.col("text")).alias("seq"))
    rows = rows.withColumn("qual", F.translate("seq", "ACGT", "I5##"))
    both = R.zip_reads(rows.filter("role = 'user'"), rows.filter("role = 'assistant'"))
    tagged = R.tag_pair(both.filter(~R.all_hash(F.col("qual1")) & ~R.all_hash(F.col("qual2"))), 5, 3)
    seq1, qual1 = R.trim(F.col("seq1"), F.col("qual1"), 100, 2)
    return tagged.select("ord", R.unified_header(F.col("header1"), F.col("header2")).alias("header"), "tag", seq1.alias("seq1"), qual1.alias("qual1"), F.length("seq2").alias("n2"))


ZIP_READS = f"""
WITH r AS (SELECT conv_id * 1000 + turn // 2 AS ord, role, '@r' || conv_id AS header, {LETTERS.format("text")} AS seq FROM conversations),
z AS (SELECT a.ord, a.header, a.seq AS s1, b.seq AS s2 FROM r a JOIN r b ON a.ord = b.ord AND a.role = 'user' AND b.role = 'assistant'),
y AS (SELECT * FROM z WHERE NOT regexp_full_match(translate(s1, 'ACGT', 'I5##'), '#+') AND NOT regexp_full_match(translate(s2, 'ACGT', 'I5##'), '#+')),
k AS (SELECT *, rtrim(substring(translate(substring(s1, 6), 'ACGT', 'I5##'), 1, 100), '#') AS q FROM y)
SELECT ord, header, substring(s1, 1, 5) || substring(s2, 1, 3) AS tag, substring(substring(substring(s1, 6), 1, length(q)), 3) AS seq1, substring(q, 3) AS qual1, CAST(greatest(length(s2) - 3, 0) AS INTEGER) AS n2 FROM k
"""


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments made from events."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    flag = F.element_at(F.array(*map(F.lit, (0, 16, 83, 99, 147, 163, 4, 81))), (n % 8 + 1).cast("int"))
    cigar = F.element_at(F.array(*map(F.lit, ("50M", "10S40M", "45M5S", "*", "20M2D28M"))), (n % 5 + 1).cast("int"))
    pos = (F.col("user_id") * 100).cast("int")
    return e.select(
        n.alias("ord"), F.concat(F.lit("c"), n.cast("string"), F.lit("#"), F.when(n % 11 == 0, "").otherwise("ACGT"), F.lit("-"), F.translate(F.col("user_id").cast("string"), "0123456789", "ACGTNACGTA")).alias("qname"),
        flag.alias("flag"), F.when(n % 13 == 0, "*").otherwise("1").alias("rname"), pos.alias("pos"), cigar.alias("cigar"), F.when(n % 7 == 0, "2").otherwise("=").alias("rnext"), (pos + (n % 3000).cast("int")).alias("pnext"), (n % 200).cast("int").alias("tlen"),
        F.when(n % 3 == 0, F.format_string("1:%d-%d/g", pos, pos + 50)).otherwise(F.format_string("1:%d-%d/16,24/+", pos, pos + 100)).alias("mip_key"),
    )


def read_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads by what becomes of them."""
    reads = R.dispositions(R.parse_names(_reads(spark, sf_dir)), CollapseParams(picky_tags=True, flex=10))
    return R.disposition_counts(reads)


READ_DISPOSITION = """
WITH r AS (SELECT event_id AS n, [0, 16, 83, 99, 147, 163, 4, 81][event_id % 8 + 1] AS flag, ['50M', '10S40M', '45M5S', '*', '20M2D28M'][event_id % 5 + 1] AS cigar, [50, 40, 45, 0, 50][event_id % 5 + 1] AS span, CAST(user_id AS VARCHAR) AS u FROM events),
d AS (SELECT *, flag % 2 = 0 AS single FROM r)
SELECT CASE WHEN n % 11 = 0 THEN 'skipped' WHEN contains(u, '4') THEN 'bad_tag' WHEN NOT single AND (n % 7 = 0 OR (n % 3000) > 1000) THEN 'discordant'
  WHEN flag NOT IN (0, 16, 147, 99, 83, 163) THEN 'improper'
  WHEN (single AND contains(cigar, 'S')) OR (flag IN (163, 99) AND cigar = '10S40M') OR (flag IN (83, 147) AND cigar = '45M5S') THEN 'soft_clipped'
  WHEN n % 13 = 0 THEN 'unmapped' WHEN n % 3 = 0 OR (NOT single AND n % 200 <> span AND abs(n % 200 - 100) > 10) THEN 'off_target' ELSE 'on_target' END AS disposition, count(*) AS n_reads
FROM d GROUP BY 1
"""


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("sample"), F.col("user_id").cast("string").alias("mip_key"), F.col("props").alias("mtag"), F.col("event_id").alias("cluster"))


COMPLEXITY = "SELECT event_type AS sample, CAST(user_id AS VARCHAR) AS mip, count(DISTINCT event_id) AS total, count(DISTINCT props) AS \"unique\" FROM events GROUP BY event_type, user_id"


def tag_group_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and unique tags by sample and probe."""
    return C.complexity(_tagged(spark, sf_dir))


def complexity_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and unique tags by probe, by sample and over all."""
    return C.marginals(tag_group_complexity(spark, sf_dir))


MARGINALS = f"""SELECT CASE WHEN grouping(sample) = 1 THEN 'ALL_SAMPLES' ELSE sample END AS sample, CASE WHEN grouping(mip) = 1 THEN 'ALL_POSITIONS' ELSE mip END AS mip, CAST(sum(total) AS BIGINT) AS total, CAST(sum("unique") AS BIGINT) AS "unique"
FROM ({COMPLEXITY}) GROUP BY GROUPING SETS ((mip), (sample), ())"""


def saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the tag pool behind every total, and how much of it was seen."""
    return C.with_saturation(complexity_grouping_sets(spark, sf_dir)).select("sample", "mip", F.round("pool", 3).alias("pool"), "saturation")


SATURATION = f"""
WITH RECURSIVE m AS ({MARGINALS}),
b AS (SELECT *, CAST(total AS DOUBLE) AS n, CAST("unique" AS DOUBLE) AS u, sample = 'ALL_SAMPLES' AND mip = 'ALL_POSITIONS' AS overall FROM m),
h AS (SELECT sample, mip, n, u, overall, 0 AS turn, u AS low, greatest(CASE WHEN overall THEN floor(n * u / nullif(n - u, 0)) ELSE n * u / (n - u + 0.1) END, u) AS high FROM b WHERE u > 0 AND u < n
  UNION ALL SELECT sample, mip, n, u, overall, turn + 1, CASE WHEN below THEN mid ELSE low END, CASE WHEN below THEN high ELSE mid END FROM (SELECT *, (low + high) / 2 AS mid, ((low + high) / 2) * (1 - pow(1 - 1 / ((low + high) / 2), n)) - u < 0 AS below FROM h WHERE turn < 60)),
p AS (SELECT sample, mip, (low + high) / 2 AS pool FROM h WHERE turn = 60)
SELECT b.sample, b.mip, round(p.pool, 3) AS pool, CASE WHEN u = 0 OR n = 0 THEN 'NA' WHEN u = n THEN '~0%' WHEN p.pool IS NULL THEN 'NA' WHEN floor(100 * u / p.pool) < 8 THEN '<8%' WHEN overall AND floor(100 * u / p.pool) >= 99 THEN '>99%' ELSE CAST(CAST(floor(100 * u / p.pool) AS BIGINT) AS VARCHAR) || '%' END AS saturation
FROM b LEFT JOIN p ON p.sample = b.sample AND p.mip = b.mip
"""


def birthday_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that a probe's molecules in a sample all have different tags."""
    rows = tag_group_complexity(spark, sf_dir)
    return rows.select("sample", "mip", F.round(C.distinct_probability(F.col("unique"), TAGS), 6).alias("p"))


BIRTHDAY = f"""SELECT sample, mip, round(CASE WHEN "unique" <= 1 THEN 1.0 ELSE list_reduce(list_transform(range(0, "unique"), lambda k: 1 - CAST(k AS DOUBLE) / {TAGS}.0), lambda a, b: a * b) END, 6) AS p FROM ({COMPLEXITY})"""


def dominant_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent place and form of each group of reads; of equals the one of better quality."""
    e = table(spark, sf_dir, "events")
    reads = e.select((F.col("event_id") % 97).alias("mip_key"), F.lit("b").alias("barcode"), (F.col("event_id") % 5).alias("mtag"), F.lit(1).alias("read_number"), F.col("user_id").alias("pos"), F.col("event_type").alias("cigar"), F.col("props").alias("qual"))
    return R.dominant(reads).select("mip_key", "mtag", "pos", "cigar", "n", "quality")


DOMINANT = """
WITH r AS (SELECT event_id % 97 AS mip_key, event_id % 5 AS mtag, user_id AS pos, event_type AS cigar, count(*) AS n, CAST(sum(list_sum(list_transform(string_split(props, ''), lambda c: ascii(c) - 33))) AS BIGINT) AS quality FROM events GROUP BY ALL)
SELECT mip_key, mtag, pos, cigar, n, quality FROM (SELECT *, row_number() OVER (PARTITION BY mip_key, mtag ORDER BY n DESC, quality DESC, pos DESC, cigar DESC) AS k FROM r) WHERE k = 1
"""


def consensus_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus of the turns of every conversation and role, as reads in their order."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("mip_key"), "role", "turn", from_letters(F.col("text")).alias("seq"))
    return R.consensus(rows.withColumn("qual", F.translate("seq", "ACGT", "I5?+")), ("mip_key", "role"), "turn")


def barcode_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All barcodes one base off those of the nations, and what they stand for."""
    barcodes = table(spark, sf_dir, "nation").select(F.col("n_name").alias("label"), F.substring(F.concat(from_letters(F.col("n_name")), F.lit("ACGTACGT")), 1, 8).alias("sequence"), F.col("n_nationkey").alias("ord"))
    return R.barcode_neighbours(barcodes)


BARCODES = f"""
WITH b AS (SELECT n_name AS label, substring({LETTERS.format("n_name")} || 'ACGTACGT', 1, 8) AS sequence, n_nationkey AS ord FROM nation),
v AS (SELECT label, sequence, ord, substring(sequence, 1, i - 1) || x || substring(sequence, i + 1) AS variant FROM b CROSS JOIN (SELECT unnest(range(1, 9)) AS i) CROSS JOIN (SELECT unnest(['A', 'T', 'C', 'G', 'N']) AS x))
SELECT variant, arg_max(sequence, ord) AS sequence, arg_max(label, ord) AS label FROM v GROUP BY variant
"""


def trimmed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads without their probes' arms."""
    reads = _reads(spark, sf_dir).withColumns({"seq": F.repeat(F.lit("ACGTN"), 10), "qual": F.repeat(F.lit("I5?+#"), 10)})
    return R.trim_arms(reads.filter(A.cigar_fits(F.col("cigar"), F.col("seq")))).select("ord", "trim_status", "new_pos", "new_cigar", "new_seq")


def sequenced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reads, design, barcodes) made from events: a probe per user, a pair of reads per event, a sample per type.

    Bases repeat a user's own pattern with an event's changes; places stray by a base, some pairs lack a mate, some
    alignments hold insertions or clips or don't fit their bases, and some barcodes are one base off.
    """
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    dealt = events.repartition("event_id")  # few bytes of a file become many reads
    start = (F.col("user_id") * 200 + 1000).cast("int")
    strand, chrom = F.when(F.col("user_id") % 2 == 0, "+").otherwise("-"), (F.col("user_id") % 22 + 1).cast("string")
    bases = lambda c, n: F.translate(F.left(F.sha2(c, 512), F.lit(n)), "0123456789abcdef", "ACGTACGTACGTACGT")
    key = F.format_string("%s:%d-%d/20,22/%s", chrom, start, start + 149, strand)
    design = events.select("user_id").distinct().select(key.alias("mip_key"), chrom.alias("chr"), start.alias("mip_start"), (start + 149).alias("mip_stop"), strand.alias("strand"), F.col("user_id").alias("ord"))
    letters = bases(F.col("event_type"), 8)
    barcodes = events.select("event_type").distinct().select(F.col("event_type").alias("label"), letters.alias("sequence"), F.hash("event_type").alias("ord"))
    n, own = F.col("event_id"), F.col("user_id").cast("string")
    barcode = F.when(n % 10 == 3, F.concat(F.lit("N"), F.substr(letters, F.lit(2)))).otherwise(letters)
    named = F.concat(F.lit("e"), F.floor(n / 3).cast("string"), F.lit("#"), barcode, F.lit("-"), bases(F.floor(n / 3).cast("string"), 3))
    plus = F.col("user_id") % 2 == 0
    mates = dealt.withColumn("second", F.explode(F.array(F.lit(False), F.lit(True)))).filter((n % 17 != 0) | F.col("second"))
    second = F.col("second")
    flag = F.when(plus, F.when(second, 83).otherwise(163)).otherwise(F.when(second, 147).otherwise(99))
    chosen = lambda a, b, c, d, e: F.when(n % 29 == 0, a).when(n % 31 == 0, b).when(n % 37 == 0, c).when(n % 41 == 0, d).otherwise(e)
    cigar, span = chosen("30M2I28M", "25M3D35M", "4S56M", "30M1I30M", "60M"), chosen(58, 63, 56, 60, 60)
    pos = (F.when(second, start + 150 - span).otherwise(start) + (n % 3).cast("int") - 1).cast("int")
    seq = F.overlay(bases(F.concat(own, second.cast("string")), 60), bases(F.concat(n.cast("string"), second.cast("string")), 2), (n % 58 + 1).cast("int"))
    qual = F.translate(F.left(F.sha2(F.concat(n.cast("string"), second.cast("string")), 512), F.lit(60)), "0123456789abcdef", "I5?+#AB7CD9E3F:H")
    reads = mates.select(
        (2 * n + second.cast("int")).alias("ord"), named.alias("qname"), flag.alias("flag"), chrom.alias("rname"), pos.alias("pos"), F.lit(60).alias("mapq"), cigar.alias("cigar"), F.lit("=").alias("rnext"),
        F.when(second, start).otherwise(start + 90).cast("int").alias("pnext"), F.when(second, -150).otherwise(150).alias("tlen"), seq.alias("seq"), qual.alias("qual"), F.lit("").alias("tags"),
    )
    return reads, design, barcodes


def collapsed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pair of reads per tag of each probe and sample, with its route."""
    params = CollapseParams(flex=1, tag_size=3, tolerant=True, confidence=0.5)
    reads, design, barcodes = sequenced(spark, sf_dir)
    return E.collapse(E.annotate(reads, params, design, barcodes), params).reads.drop("tags", "mapq", "rnext")


def collapse_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, unique tags and saturation of the same reads by probe, by sample and over all."""
    params = CollapseParams(flex=1, tag_size=3, tolerant=True)
    reads, design, barcodes = sequenced(spark, sf_dir)
    on = E.annotate(reads, params, design, barcodes).filter("disposition = 'on_target'")
    return E.summary(C.complexity(on), design)


_CUT = CutParams(tags=(5, 3), index_length=6, longest=80, skip=2, drop_all_hash=True, trim_hash=True)


def cut_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User and assistant turns as pairs of reads with an index read, cut end to end."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.floor(F.col("turn") / 2)).alias("ord"), "role", F.concat(F.lit("@r "), F.col("conv_id").cast("string"), F.when(F.col("conv_id") % 3 == 0, "#AC-GT").otherwise(""), F.lit("/"), (F.col("turn") % 2 + 1).cast("string")).alias("header"), from_letters(F.col("text")).alias("seq"))
    rows = rows.withColumn("qual", F.translate("seq", "ACGT", "I5##"))
    user, other = rows.filter("role = 'user'"), rows.filter("role = 'assistant'")
    index = user.select("ord", F.concat(F.lit("TG"), F.col("seq")).alias("seq"))
    return R.cut_pairs(user, other, _CUT, index)


CUT_READS = f"""
WITH r AS (SELECT conv_id * 1000 + turn // 2 AS ord, role, '@r ' || conv_id || CASE WHEN conv_id % 3 = 0 THEN '#AC-GT' ELSE '' END AS header, {LETTERS.format("text")} AS seq FROM conversations),
z AS (SELECT a.ord, replace(a.header, ' ', '_') || '#' || substring('TG' || a.seq, 1, 6) AS header, substring('TG' || a.seq, 1, 6) AS barcode, a.seq AS s1, b.seq AS s2 FROM r a JOIN r b ON a.ord = b.ord AND a.role = 'user' AND b.role = 'assistant'),
y AS (SELECT * FROM z WHERE NOT regexp_full_match(translate(s1, 'ACGT', 'I5##'), '#+') AND NOT regexp_full_match(translate(s2, 'ACGT', 'I5##'), '#+')),
k AS (SELECT *, rtrim(substring(translate(substring(s1, 6), 'ACGT', 'I5##'), 1, 80), '#') AS q1, rtrim(substring(translate(substring(s2, 4), 'ACGT', 'I5##'), 1, 80), '#') AS q2 FROM y)
SELECT ord, header || '-' || substring(s1, 1, 5) || substring(s2, 1, 3) AS header, barcode, substring(substring(substring(s1, 6), 1, length(q1)), 3) AS seq1, substring(q1, 3) AS qual1, substring(substring(substring(s2, 4), 1, length(q2)), 3) AS seq2, substring(q2, 3) AS qual2 FROM k
"""

QUERIES = {f.__name__: f for f in (cut_reads, collapsed_reads, collapse_summary, zip_reads, read_disposition, tag_group_complexity, complexity_grouping_sets, saturation, birthday_probability, dominant_alignment, consensus_reads, barcode_neighbourhood, trimmed_reads)}
ORACLES = {"zip_reads": ZIP_READS, "cut_reads": CUT_READS, "read_disposition": READ_DISPOSITION, "tag_group_complexity": COMPLEXITY, "complexity_grouping_sets": MARGINALS, "saturation": SATURATION, "birthday_probability": BIRTHDAY, "dominant_alignment": DOMINANT, "barcode_neighbourhood": BARCODES}
