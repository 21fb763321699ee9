"""Probe-design queries over targets derived from the benchmark table."""

from __future__ import annotations

import dataclasses
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import INTERCEPT, JUNCTION, POWER_BASE, PROFILE_MERS, terms
from ..functions.sequences import mers
from ..operators import genome as G
from ..operators import probes as P
from ..operators import repeats, tiling
from ..operators.svm import RBF, SvmModel
from ..params import DesignParams
from ..tables import written
from .inputs import TARGETS, genome, targets

#: Targets are short, so captures are too; two arm sums keep the candidates of a start at 96.
PARAMS = DesignParams(min_capture_size=80, max_capture_size=100, capture_increment=10, arm_length_sums=(40, 42), max_arm_copy_product=400)
_ARMS = PARAMS.arms()
#: The candidates on their own: every arm sum of the default options.
ALL_SUMS = dataclasses.replace(PARAMS, arm_length_sums=DesignParams().arm_length_sums)


def arm_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arm pairs of the default options."""
    return P.arm_pairs(spark, DesignParams())


ARM_PAIRS = """
SELECT CAST(s AS INTEGER) AS arm_sum, CAST(s - l AS INTEGER) AS ext_len, CAST(l AS INTEGER) AS lig_len
FROM (SELECT unnest(range(40, 46)) AS s) a CROSS JOIN (SELECT unnest(range(18, 31)) AS l) b WHERE s - l BETWEEN 16 AND 30
"""


def _candidates(spark: SparkSession, sf_dir: str, params: DesignParams = PARAMS) -> DataFrame:
    return P.with_sequences(P.candidate_bounds(targets(spark, sf_dir), params), params)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = targets(spark, sf_dir)
    rows = P.scored_bounds(P.candidate_bounds(features, PARAMS), features, _copies(features))
    return rows.withColumns({"snp_count": F.lit(0), "mapping_failed": F.lit(False), "arm_fraction_masked": F.lit(0.0)})


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chr, pos, alleles): a variant at every seventeenth base of every target."""
    base = targets(spark, sf_dir)
    at = base.withColumn("pos", F.explode(F.sequence(F.lit(5), F.greatest(F.lit(5), F.length("seq")), F.lit(17)))).filter("pos <= length(seq)")
    ref = F.substr("seq", F.col("pos"), F.lit(1))
    return at.select("chr", "pos", F.concat(ref, F.translate(ref, "ACGT", "CATG")).alias("alleles"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored candidates with what variants, repeats and windows that aren't unique say of them."""
    features = targets(spark, sf_dir)
    rows = written(_scored(spark, sf_dir).drop("snp_count", "mapping_failed", "arm_fraction_masked"), "scored")
    variants = _variants(spark, sf_dir).filter("pos % 51 = 5")  # every third of them
    rows = P.with_variants(rows, variants, ["feature_id", "capture_size", "mip_key"])
    masked = repeats.with_mask(features, repeats.tandem_repeats(features.select("chr", "seq"), longest=60, least=40))
    windows = G.capture_windows(features, PARAMS.max_capture_size, PARAMS.min_capture_size, PARAMS.step)
    flagged = P.with_mapping_flag(P.with_masking(rows, PARAMS, masked), G.unmappable(windows, features.select("chr", "seq")), PARAMS)
    return written(flagged, "judged")  # condensing reads it twice


def probe_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every target: bounds, arms and key."""
    rows = _candidates(spark, sf_dir, ALL_SUMS)
    return rows.select("feature_id", "capture_size", "mip_key", "scan_start", "scan_stop", "ext_probe_start", "lig_probe_start", "ext_probe_sequence", "lig_probe_sequence")


_SIZES = ", ".join(f"({s})" for s in range(PARAMS.max_capture_size, PARAMS.min_capture_size - 1, -PARAMS.step))
_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"
def _key(start: str, size: str) -> str:
    """One number for a part of a feature's strand."""
    return f"((CAST(feature_id AS BIGINT) * 1000000 + {start}) * 1000 + {size}) * 2 + CAST(strand = '-' AS INTEGER)"


def _candidate_sql(params: DesignParams) -> str:
    arms = params.arms()
    pairs = ", ".join(f"({e}, {g})" for _, e, g in arms)
    return f"""
t AS ({TARGETS}), arms(ext_len, lig_len) AS (VALUES {pairs}), sizes(capture_size) AS (VALUES {_SIZES}), strands(strand) AS (VALUES ('+'), ('-')),
starts AS (SELECT t.*, unnest(range(greatest(start_f - {PARAMS.max_capture_size} + {max(a for a, _, _ in arms)}, 0) + 1, stop_f + 1)) AS scan_start FROM t),
c0 AS (SELECT *, scan_start + capture_size - ext_len - lig_len - 1 AS scan_stop, CASE WHEN strand = '+' THEN ext_len ELSE lig_len END AS left_len, CASE WHEN strand = '+' THEN lig_len ELSE ext_len END AS right_len
  FROM starts CROSS JOIN sizes CROSS JOIN arms CROSS JOIN strands
  WHERE NOT (capture_size > stop_f - start_f + {PARAMS.max_mip_overlap} AND capture_size - {PARAMS.step} >= {PARAMS.min_capture_size}) AND scan_start - greatest(ext_len, lig_len) >= 1 AND scan_start + capture_size - 1 - least(ext_len, lig_len) <= seq_stop),
c1 AS (SELECT *, scan_start - left_len AS mip_start, scan_stop + right_len AS mip_stop, CASE WHEN strand = '+' THEN scan_start - left_len ELSE scan_stop + 1 END AS ext_probe_start, CASE WHEN strand = '+' THEN scan_stop + 1 ELSE scan_start - left_len END AS lig_probe_start FROM c0 WHERE scan_stop + right_len <= seq_stop),
b AS MATERIALIZED (SELECT feature_id, chr, capture_size, ext_len, lig_len, strand, scan_start, scan_stop, ext_probe_start, lig_probe_start, mip_start, mip_stop,
  chr || ':' || mip_start || '-' || mip_stop || '/' || ext_len || ',' || lig_len || '/' || strand AS mip_key, {_key("ext_probe_start", "ext_len")} AS e_key, {_key("lig_probe_start", "lig_len")} AS l_key, {_key("scan_start", "scan_stop - scan_start")} AS s_key FROM c1),
parts AS (SELECT feature_id, strand, start, size, {_key("start", "size")} AS key, CASE WHEN strand = '+' THEN part ELSE {_RC.format('part')} END AS part FROM (SELECT p.*, substring(t.seq, p.start, p.size) AS part FROM (SELECT DISTINCT feature_id, strand, unnest([ext_probe_start, lig_probe_start]) AS start, unnest([ext_len, lig_len]) AS size FROM b) p JOIN t USING (feature_id))),
a AS MATERIALIZED (SELECT * FROM parts)
"""


CANDIDATES = _candidate_sql(PARAMS)
_WITH_ARMS = "b JOIN a e ON e.key = e_key JOIN a l ON l.key = l_key"
PROBE_CANDIDATES = f"WITH {_candidate_sql(ALL_SUMS)} SELECT b.feature_id, CAST(capture_size AS INTEGER) AS capture_size, mip_key, CAST(scan_start AS INTEGER) AS scan_start, CAST(scan_stop AS INTEGER) AS scan_stop, CAST(ext_probe_start AS INTEGER) AS ext_probe_start, CAST(lig_probe_start AS INTEGER) AS lig_probe_start, e.part AS ext_probe_sequence, l.part AS lig_probe_sequence FROM {_WITH_ARMS}"


def logistic_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic score of every candidate, with the copies of its arms."""
    return _scored(spark, sf_dir).select("feature_id", "capture_size", "mip_key", "ext_probe_copy", "lig_probe_copy", F.round("score", 6).alias("score"))


def _share(seq: str, bases: str) -> str:
    return f"(length({seq}) - length(translate({seq}, '{bases}', ''))) / length({seq})"


_PART_INPUTS = {
    "e": {**{n: _share("part", b) for n, b in (("eg", "G"), ("eGC", "GC"), ("ea", "A"))}, "el": "CAST(size AS DOUBLE)", "ce": "CASE WHEN copies > 100 THEN 2.0 ELSE log10(copies) END"},
    "l": {**{n: _share("part", b) for n, b in (("lg", "G"), ("lGC", "GC"), ("la", "A"))}, "ll": "CAST(size AS DOUBLE)", "j": "CASE substring(part, 1, 2) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in JUNCTION.items()) + " ELSE 0.0 END", "cl": "CASE WHEN copies > 100 THEN 2.0 ELSE log10(copies) END"},
    "s": {**{n: _share("part", b) for n, b in (("tg", "G"), ("tGC", "GC"), ("ta", "A"))}, "bps": "length(part) / len(regexp_extract_all(part, '[GC]+|[^GC]+'))", "tl": "CAST(least(length(part), 250) AS DOUBLE)"},
}
_INPUTS = [k for own in _PART_INPUTS.values() for k in own]
_QUOTED = {k: f'"in_{k if k.islower() else k[0] + "_both"}"' for k in _INPUTS}
_EXPONENT = " + ".join([str(INTERCEPT), *("(" + " * ".join([_QUOTED[n] for n in names] + [f"({value})"]) + ")" for names, value in terms())])
_KMERS = " UNION ALL ".join(f"SELECT substring(seq, i, {n}) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) - {n} + 2)) AS i FROM t WHERE length(seq) >= {n})" for n in sorted({n for _, e, g in _ARMS for n in (e, g)}))
_OF = {w: ", ".join(f"{v} AS {_QUOTED[k]}" for k, v in own.items()) for w, own in _PART_INPUTS.items()}
SCORED = f"""
{CANDIDATES},
k AS (SELECT least(kmer, {_RC.format('kmer')}) AS kmer, count(*) AS copies FROM ({_KMERS}) GROUP BY 1),
n AS (SELECT a.*, k.copies FROM a JOIN k ON k.kmer = least(part, {_RC.format('part')})),
e AS MATERIALIZED (SELECT key, copies, {_OF["e"]} FROM n),
l AS MATERIALIZED (SELECT key, copies, {_OF["l"]} FROM n),
scans AS (SELECT {_key("start", "stop - start")} AS key, CASE WHEN strand = '+' THEN part ELSE {_RC.format('part')} END AS part FROM (SELECT p.*, substring(t.seq, p.start, p.stop - p.start + 1) AS part FROM (SELECT DISTINCT feature_id, strand, scan_start AS start, scan_stop AS stop FROM b) p JOIN t USING (feature_id))),
sc AS MATERIALIZED (SELECT key, {_OF["s"]} FROM scans),
x AS (SELECT b.*, e.copies AS ext_probe_copy, l.copies AS lig_probe_copy, pow({POWER_BASE}, {_EXPONENT}) AS powered FROM {_WITH_ARMS.replace("a e", "e").replace("a l", "l")} JOIN sc ON sc.key = s_key),
s AS (SELECT *, powered / (1 + powered) AS score FROM x)
"""
LOGISTIC_SCORE = f"WITH {SCORED} SELECT feature_id, CAST(capture_size AS INTEGER) AS capture_size, mip_key, ext_probe_copy, lig_probe_copy, round(score, 6) AS score FROM s"


def best_per_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best candidate over each position and strand; scores to six places decide, then scan starts."""
    rows = _scored(spark, sf_dir).withColumn("score", F.round("score", 6))
    return P.collapse(rows, PARAMS).select("feature_id", "pos", "strand", "scan_start", "score")


_FIT = f"ext_probe_copy * lig_probe_copy <= {PARAMS.max_arm_copy_product} AND greatest(ext_probe_copy, lig_probe_copy) <= {PARAMS.target_arm_copy}"
BEST = f"""{SCORED},
p AS (SELECT feature_id, strand, scan_start, round(score, 6) AS score, unnest(range(scan_start, scan_stop + 1)) AS pos FROM s WHERE {_FIT}),
best AS (SELECT feature_id, CAST(pos AS INTEGER) AS pos, strand, CAST(scan_start AS INTEGER) AS scan_start, score FROM (SELECT *, row_number() OVER (PARTITION BY feature_id, pos, strand ORDER BY score DESC, scan_start) AS r FROM p) WHERE r = 1)
"""
BEST_PER_POSITION = f"WITH {BEST} SELECT * FROM best"


def worst_of_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position of each target whose best probe scores lowest."""
    return P.worst_of_best(best_per_position(spark, sf_dir))


WORST_OF_BEST = f"""WITH {BEST},
m AS (SELECT *, row_number() OVER (PARTITION BY feature_id, pos ORDER BY score DESC, strand DESC, scan_start DESC) AS r FROM best)
SELECT feature_id, pos, strand, scan_start, score FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY score, pos) AS q FROM m WHERE r = 1) WHERE q = 1
"""


def condensed_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probe that the fold keeps of each scan start and strand."""
    return P.condense(_judged(spark, sf_dir), PARAMS).select("feature_id", "scan_start", "strand", "mip_key", F.round("score", 6).alias("score"), "snp_count", F.round("arm_fraction_masked", 6).alias("arm_fraction_masked"), "masking_failed")


def greedy_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes picked to tile every target."""
    return tiling.pick(P.condense(_judged(spark, sf_dir), PARAMS), PARAMS)


def masked_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tandem repeats of every sequence made from documents, and how much of each they mask."""
    found = repeats.tandem_repeats(genome(spark, sf_dir), longest=100)
    return found.withColumn("n_masked", F.col("stop") - F.col("start") + 1)


def variant_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms with the other allele, for variants at every seventeenth base of every target."""
    snps = _variants(spark, sf_dir)
    rows = _candidates(spark, sf_dir).drop("seq", "rc", "mip_sequence", "scan_target_sequence")
    found = P.with_variants(rows, snps, ["feature_id", "capture_size", "mip_key"])
    return found.select("capture_size", "mip_key", F.col("snp_count").cast("long").alias("snp_count"), "snp_failed", F.concat("snp_ext_sequence", F.lit("/"), "snp_lig_sequence").alias("arms"))


VARIANT_ARMS = f"""WITH {CANDIDATES},
v AS (SELECT feature_id, seq, pos, substring(seq, pos, 1) AS r FROM (SELECT feature_id, seq, unnest(range(5, length(seq) + 1, 17)) AS pos FROM t)),
h AS (SELECT a.key, count(*) AS n,
  arg_max(substring(part, 1, place - 1) || base || substring(part, place + 1), pos) AS changed FROM (SELECT a.*, v.pos, CASE WHEN a.strand = '+' THEN v.pos - a.start ELSE a.start + a.size - 1 - v.pos END + 1 AS place, CASE WHEN a.strand = '+' THEN translate(v.r, 'ACGT', 'CATG') ELSE translate(translate(v.r, 'ACGT', 'CATG'), 'ACGT', 'TGCA') END AS base
  FROM a JOIN v ON v.feature_id = a.feature_id AND v.pos BETWEEN a.start AND a.start + a.size - 1) a GROUP BY a.key),
a2 AS MATERIALIZED (SELECT a.*, coalesce(h.n, 0) AS n, h.changed FROM a LEFT JOIN h ON h.key = a.key)
SELECT CAST(capture_size AS INTEGER) AS capture_size, mip_key, e.n + l.n AS snp_count, e.n + l.n > 1 AS snp_failed, CASE WHEN e.n + l.n > 0 THEN CASE WHEN l.n = 0 THEN e.changed ELSE e.part END || '/' || CASE WHEN l.n > 0 THEN l.changed ELSE l.part END END AS arms
FROM {_WITH_ARMS.replace("a e", "a2 e").replace("a l", "a2 l")}
"""

# -- support-vector scores by a model that is made here: a formula gives its vectors

SV, GAMMA, RHO = 8, 0.002, -1.5
MODEL = SvmModel(
    "epsilon_svr", RBF, gamma=GAMMA, rho=[RHO], coef=np.array([[((7 * k) % 5) / 2 - 1.0 for k in range(SV)]]),
    sv=np.array([[((37 * k + 11 * j) % 17) / 17 + (20.0 if j in (21, 173) else 45.0 if j == 151 else 0.0) for j in range(192)] for k in range(SV)]),
)
SVR_PARAMS = dataclasses.replace(PARAMS, score_method="svr", svr_priority_score=1.2, svr_optimal_score=1.6)
MIXED_PARAMS = dataclasses.replace(SVR_PARAMS, score_method="mixed")


def _copies(features: DataFrame) -> DataFrame:
    """Copies of the windows of all arm lengths, written since both arms of every candidate are joined to them."""
    return written(reduce(DataFrame.unionByName, [G.copy_numbers(features, n) for n in sorted({n for _, e, g in _ARMS for n in (e, g)})]), "copies")


def svr_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support-vector score of every candidate."""
    features = targets(spark, sf_dir)
    rows = P.scored_by(P.candidate_bounds(features, SVR_PARAMS), features, _copies(features), SVR_PARAMS, MODEL)
    return rows.select("feature_id", "capture_size", "mip_key", F.round("score", 6).alias("score"))


def mixed_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes picked by logistic scores to condense and support-vector scores of those that tiling looks at."""
    features = targets(spark, sf_dir)
    condensed = P.with_rescoring(P.condense(written(_scored(spark, sf_dir), "scored"), MIXED_PARAMS), features, _copies(features))
    return tiling.pick(condensed, MIXED_PARAMS, MODEL)


def _mer_count(mer: str) -> str:
    """Occurrences that may overlap, in DuckDB; only mers that begin as they end can."""
    if any(mer[:k] == mer[-k:] for k in range(1, len(mer))):
        return f"len(list_filter(range(1, length(part) - {len(mer) - 2}), lambda i: substring(part, i, {len(mer)}) = '{mer}'))"
    return f"(length(part) - length(replace(part, '{mer}', ''))) // {len(mer)}"


def _apart(values: list[str], first: int) -> str:
    """List of squared distances of some inputs from each support vector's."""
    return "[" + ", ".join(" + ".join(f"pow({v} - {float(MODEL.sv[k, first + j])!r}, 2)" for j, v in enumerate(values)) for k in range(SV)) + "]"


def _named(longest: int) -> tuple[str, list[str]]:
    """Columns of k-mer shares in DuckDB and their names in the model's order."""
    columns, names = [], []
    for mer in mers(longest):
        if mer == "T":
            columns.append(f"{_share('part', 'GC')} AS m_share")
            names.append("m_share")
        columns.append(f"CASE WHEN length(part) >= {len(mer)} THEN {_mer_count(mer)} / (length(part) - {len(mer) - 1}) ELSE 0.0 END AS m_{mer.lower()}")
        names.append(f"m_{mer.lower()}")
    return ", ".join([*columns, "CAST(length(part) AS DOUBLE) AS m_len"]), [*names, "m_len"]


_BOTH = {m: sorted({m, m[::-1].translate(str.maketrans("ACGT", "TGCA"))}) for m in PROFILE_MERS}
_AROUND = ", ".join(f"({' + '.join(_mer_count(x).replace('part', 'seq') for x in _BOTH[m])}) / (seq_stop - seq_start + 2001) AS p{i}" for i, m in enumerate(PROFILE_MERS))
_ARM, _SCAN = _named(2), _named(3)
_JUNCTION = [f"CAST(substring(part, 1, 2) = '{a}{b}' AS DOUBLE)" for a in "ACGT" for b in "ACGT"]
_LOG = "CASE WHEN copies > 100 THEN 2.0 ELSE log10(copies) END"
_SUM = "".join(f" + {float(MODEL.coef[0, k])!r} * exp(-{GAMMA} * (de[{k + 1}] + dl[{k + 1}] + ds[{k + 1}] + df[{k + 1}]))" for k in range(SV))
SVR_SCORE = f"""WITH {CANDIDATES},
k AS (SELECT least(kmer, {_RC.format('kmer')}) AS kmer, count(*) AS copies FROM ({_KMERS}) GROUP BY 1),
m AS MATERIALIZED (SELECT a.key, a.part, k.copies, {_ARM[0]} FROM a JOIN k ON k.kmer = least(part, {_RC.format('part')})),
e AS MATERIALIZED (SELECT key, {_apart([*_ARM[1]], 0)} AS d, {_apart([_LOG], 190)} AS c FROM m),
l AS MATERIALIZED (SELECT key, {_apart([*_ARM[1], *_JUNCTION], 152)} AS d, {_apart([_LOG], 191)} AS c FROM m),
scans AS (SELECT {_key("start", "stop - start")} AS key, CASE WHEN strand = '+' THEN part ELSE {_RC.format('part')} END AS part FROM (SELECT p.*, substring(t.seq, p.start, p.stop - p.start + 1) AS part FROM (SELECT DISTINCT feature_id, strand, scan_start AS start, scan_stop AS stop FROM b) p JOIN t USING (feature_id))),
s AS MATERIALIZED (SELECT key, {_apart(_SCAN[1], 66)} AS d FROM (SELECT key, {_SCAN[0]} FROM scans)),
f AS MATERIALIZED (SELECT feature_id, {_apart([f"p{i}" for i in range(len(PROFILE_MERS))], 22)} AS d FROM (SELECT feature_id, {_AROUND} FROM t)),
x AS (SELECT b.feature_id, capture_size, mip_key, list_transform(list_zip(e.d, e.c), lambda z: z[1] + z[2]) AS de, list_transform(list_zip(l.d, l.c), lambda z: z[1] + z[2]) AS dl, s.d AS ds, f.d AS df FROM b JOIN e ON e.key = e_key JOIN l ON l.key = l_key JOIN s ON s.key = s_key JOIN f ON f.feature_id = b.feature_id)
SELECT feature_id, CAST(capture_size AS INTEGER) AS capture_size, mip_key, round({-RHO}{_SUM}, 6) AS score FROM x
"""

QUERIES = {f.__name__: f for f in (arm_pairs, probe_candidates, logistic_score, best_per_position, worst_of_best, condensed_probes, greedy_tiling, variant_arms, masked_targets, svr_score, mixed_tiling)}
ORACLES = {"arm_pairs": ARM_PAIRS, "probe_candidates": PROBE_CANDIDATES, "logistic_score": LOGISTIC_SCORE, "best_per_position": BEST_PER_POSITION, "worst_of_best": WORST_OF_BEST, "variant_arms": VARIANT_ARMS, "svr_score": SVR_SCORE}
