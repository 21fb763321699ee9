"""Capture probes: candidates, scores, variants in arms, and the best probe per place.

A probe captures a scan region between two arms; on the plus strand the extension arm lies left of it
and the ligation arm right, on the minus strand the other way round and reverse-complemented.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import arm_features, ext_inputs, joined_features, junction_features, lig_inputs, logistic_inputs, logistic_of, logistic_score, profile, scan_features, scan_inputs
from ..functions.sequences import masked_share, reverse_complement, slice_at
from ..params import DesignParams
from .genome import with_copies
from .intervals import point_join
from .svm import SvmModel, predict


def arm_pairs(spark, params: DesignParams) -> DataFrame:
    """(arm_sum, ext_len, lig_len) of the arm pairs to try."""
    return spark.createDataFrame(params.arms(), "arm_sum int, ext_len int, lig_len int")


def candidate_bounds(features: DataFrame, params: DesignParams) -> DataFrame:
    """Every candidate of every feature by its bounds, without sequences.

    Scan starts run from where the feature's first base is as far as possible from the extension arm to
    the feature's end; sizes, arm pairs and strands are crossed with them. Sizes that exceed the feature
    by more than the allowed overlap are left out while a smaller one exists. No score prunes the set:
    it holds all candidates that a pruned search looks at, and more. ``generation`` orders a start's
    candidates as they would be tried.
    """
    arms = params.arms()
    largest_sum = max(a for a, _, _ in arms)
    low, high, step = params.min_capture_size, params.max_capture_size, params.step
    first = F.greatest(F.col("start_f") - high + largest_sum, F.lit(0)) + 1
    starts = features.withColumn("rc", reverse_complement(F.col("seq"))).withColumn("scan_start", F.explode(F.sequence(first, F.greatest(first, F.col("stop_f")))))
    sizes = [s for s in range(high, low - 1, -step)]
    pairs = sorted(arms, key=lambda a: (-a[0], a[1]))
    # sizes, arm pairs and strands are one small literal list: a single explode, no join
    shapes = F.array(*[F.struct(F.lit(i).alias("generation"), F.lit(s).alias("capture_size"), F.lit(e).alias("ext_len"), F.lit(g).alias("lig_len"), F.lit(strand).alias("strand")) for i, (s, (_, e, g), strand) in enumerate((s, a, strand) for s in sizes for a in pairs for strand in "+-")])
    columns = [*features.columns, "rc"]
    all_ = starts.withColumn("__shape", F.explode(shapes)).select(*columns, "scan_start", "__shape.*")
    stop = F.col("scan_start") + F.col("capture_size") - F.col("ext_len") - F.col("lig_len") - 1
    bounded = all_.withColumn("scan_stop", stop)
    oversize = (F.col("capture_size") > F.col("stop_f") - F.col("start_f") + params.max_mip_overlap) & (F.col("capture_size") - step >= low)
    longest, end = F.greatest("ext_len", "lig_len"), F.col("scan_start") + F.col("capture_size") - 1
    inside = (F.col("scan_start") - longest > 0) & (F.col("scan_start") - longest >= F.col("seq_start")) & (end - F.least("ext_len", "lig_len") <= F.col("seq_stop"))
    kept = bounded.filter(~oversize & inside & (F.col("scan_start") <= F.col("stop_f")))
    plus = F.col("strand") == "+"
    left_len = F.when(plus, F.col("ext_len")).otherwise(F.col("lig_len"))
    right_len = F.when(plus, F.col("lig_len")).otherwise(F.col("ext_len"))
    placed = kept.withColumn("__ls", F.col("scan_start") - left_len).withColumn("__le", F.col("scan_start") - 1).withColumn("__rs", F.col("scan_stop") + 1).withColumn("__re", F.col("scan_stop") + right_len)
    side = lambda ext, a, b: F.when(plus == ext, F.col(a)).otherwise(F.col(b))
    out = {"ext_probe_start": side(True, "__ls", "__rs"), "ext_probe_stop": side(True, "__le", "__re"), "lig_probe_start": side(True, "__rs", "__ls"), "lig_probe_stop": side(True, "__re", "__le"), "mip_start": F.col("__ls"), "mip_stop": F.col("__re")}
    return placed.filter(F.col("__re") <= F.col("seq_stop")).withColumns(out).drop("__ls", "__le", "__rs", "__re")


def with_sequences(bounds: DataFrame, params: DesignParams) -> DataFrame:
    """Candidates with both arms, the scan target and the assembled probe, as the strand reads them.

    Parts of minus probes are cut out of rc, the reverse complement of the whole sequence, which
    ``candidate_bounds`` makes once per feature.
    """

    def part(start: str, stop: str) -> Column:
        plain = slice_at(F.col("seq"), F.col("seq_start"), F.col(start), F.col(stop))
        back = slice_at(F.col("rc"), F.lit(1), F.col("seq_stop") - F.col(stop) + 1, F.col("seq_stop") - F.col(start) + 1)
        return F.when(F.col("strand") == "+", plain).otherwise(back)

    ext_tag, lig_tag = params.tag_sizes
    middle = "N" * lig_tag + params.backbone + "N" * ext_tag
    parts = bounds.withColumns({"ext_probe_sequence": part("ext_probe_start", "ext_probe_stop"), "lig_probe_sequence": part("lig_probe_start", "lig_probe_stop"), "scan_target_sequence": part("scan_start", "scan_stop")})
    return parts.withColumn("mip_sequence", F.concat("lig_probe_sequence", F.lit(middle), "ext_probe_sequence")).withColumn("mip_key", mip_key())


def mip_key() -> Column:
    return F.format_string("%s:%d-%d/%d,%d/%s", F.col("chr").cast("string"), F.col("mip_start"), F.col("mip_stop"), F.col("ext_len"), F.col("lig_len"), F.col("strand"))


def with_masking(candidates: DataFrame, params: DesignParams | None = None, masked: DataFrame | None = None) -> DataFrame:
    """arm_fraction_masked from masked_seq, a copy of the sequence with N for masked bases, and masking_failed:
    whether it exceeds the threshold.

    masked: (feature_id, seq_start, masked_seq), joined where candidates don't hold them.
    """
    rows = candidates if masked is None else candidates.drop("seq_start", "masked_seq").join(masked.select("feature_id", "seq_start", "masked_seq"), "feature_id")
    arm = lambda a, b: slice_at(F.col("masked_seq"), F.col("seq_start"), F.col(a), F.col(b))
    share = masked_share(arm("ext_probe_start", "ext_probe_stop"), arm("lig_probe_start", "lig_probe_stop"))
    limit = (params or DesignParams()).masked_arm_threshold
    made = rows.withColumn("arm_fraction_masked", share).withColumn("masking_failed", F.col("arm_fraction_masked") > limit)
    return made if masked is None else made.drop("masked_seq")


def with_arm_copies(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Copies of both arms by their sequence; 0 where they aren't known."""
    return with_copies(with_copies(candidates, counts, "ext_probe_sequence", "ext_probe_copy"), counts, "lig_probe_sequence", "lig_probe_copy")


def with_mapping_flag(candidates: DataFrame, unmappable: DataFrame, params: DesignParams | None = None) -> DataFrame:
    """mapping_failed: whether a capture window that starts at the probe isn't unique; never, if params.check_copy_number
    is off."""
    if params is not None and not params.check_copy_number:
        return candidates.withColumn("mapping_failed", F.lit(False))
    bad = unmappable.select(F.col("size").alias("capture_size"), "chr", F.col("pos").alias("mip_start"), F.lit(True).alias("__bad"))
    return candidates.join(bad, ["capture_size", "chr", "mip_start"], "left").withColumn("mapping_failed", F.coalesce("__bad", F.lit(False))).drop("__bad")


def scored(candidates: DataFrame) -> DataFrame:
    """Candidates with their logistic score; its inputs are projected once and dropped."""
    ext, lig, target = F.col("ext_probe_sequence"), F.col("lig_probe_sequence"), F.col("scan_target_sequence")
    inputs = logistic_inputs(ext, lig, target, F.col("ext_probe_copy"), F.col("lig_probe_copy"))
    prepared = candidates.withColumns({f"__{k}": v for k, v in inputs.items()})
    result = prepared.withColumn("score", logistic_score({k: F.col(f"__{k}") for k in inputs}, ext, lig, target))
    return result.drop(*[f"__{k}" for k in inputs])


def scored_bounds(bounds: DataFrame, features: DataFrame, counts: DataFrame) -> DataFrame:
    """Candidates by their bounds with both arms' sequences and copies, and the logistic score."""
    of_arm = lambda arm: {"ext": ext_inputs(arm, F.col("copies")), "lig": lig_inputs(arm, F.col("copies"))}
    joined, names = _with_parts(bounds, features, counts, of_arm, scan_inputs)
    score = logistic_of({k: F.col(f"__{k}") for k in names}, _unfit())
    return joined.withColumn("score", score).withColumn("mip_key", mip_key()).drop("__ext_unfit", "__lig_unfit", "__scan_unfit", *[f"__{k}" for k in names])


def with_svm_features(bounds: DataFrame, features: DataFrame, counts: DataFrame) -> DataFrame:
    """Candidates by their bounds with both arms' sequences and copies, and svm_features, the 192 inputs of the
    support-vector model. The surroundings are those that the feature's own sequence shows."""
    of_arm = lambda arm: {"ext": {"ext": arm_features(arm)}, "lig": {"lig": arm_features(arm), "junction": junction_features(arm)}}
    joined, names = _with_parts(bounds, features, counts, of_arm, lambda scan: {"scan": scan_features(scan)})
    around = features.select("feature_id", profile(F.col("seq"), F.col("seq_start"), F.col("seq_stop")).alias("__around"))
    column = {k: F.col(f"__{k}") for k in names}
    vector = joined_features(column["ext"], F.col("__around"), column["scan"], column["lig"], column["junction"], F.col("ext_probe_copy"), F.col("lig_probe_copy"), _unfit())
    made = joined.join(around, "feature_id").withColumn("svm_features", vector).withColumn("mip_key", mip_key())
    return made.drop("__around", "__ext_unfit", "__lig_unfit", "__scan_unfit", *[f"__{k}" for k in names])


def scored_by(bounds: DataFrame, features: DataFrame, counts: DataFrame, params: DesignParams, model: SvmModel | None = None) -> DataFrame:
    """Candidates with the score that params.score_method asks for.

    "logistic": the logistic score. "svr": the model's prediction for every candidate. "mixed": the logistic score, which
    condensing goes by; ``with_rescoring`` then gives the condensed probes what tiling scores them anew by.
    """
    if params.score_method != "svr":
        return scored_bounds(bounds, features, counts)
    if model is None:
        raise ValueError("score_method svr needs a model")
    return predict(with_svm_features(bounds, features, counts), model, "svm_features", "score").drop("svm_features")


def with_rescoring(condensed: DataFrame, features: DataFrame, counts: DataFrame) -> DataFrame:
    """Condensed probes with svm_features, for tiling by score_method "mixed"."""
    columns = ["feature_id", "scan_start", "strand", "generation"]
    bounds = condensed.drop("ext_probe_sequence", "lig_probe_sequence", "scan_target_sequence", "ext_probe_copy", "lig_probe_copy", "mip_key")
    return condensed.join(with_svm_features(bounds, features, counts).select(*columns, "svm_features"), columns)


def _unfit() -> Column:
    return F.col("__ext_unfit") | F.col("__lig_unfit") | F.col("__scan_unfit")


def _with_parts(bounds: DataFrame, features: DataFrame, counts: DataFrame, of_arm: Callable[[Column], dict[str, dict[str, Column]]], of_scan: Callable[[Column], dict[str, Column]]) -> tuple[DataFrame, list[str]]:
    """Candidates with their arms and scan regions and, as __name, what is known of each; and those names.

    Candidates share arms and scan regions. Each arm and each region of a feature is cut out and judged
    once, and candidates are joined to what is known of theirs by whole numbers.
    """
    key = ["feature_id", "strand"]
    narrow = bounds.drop("seq", "rc")
    whole = features.select("feature_id", "seq", "seq_start", "seq_stop")

    def cut(parts: DataFrame, name: str) -> DataFrame:
        plain = slice_at(F.col("seq"), F.col("seq_start"), F.col("start"), F.col("stop"))
        rows = parts.distinct().join(whole, "feature_id")
        return rows.select(*key, "start", "stop", F.when(F.col("strand") == "+", plain).otherwise(reverse_complement(plain)).alias(name))

    two = F.array(*[F.struct(F.col(f"{w}_probe_start").alias("start"), F.col(f"{w}_probe_stop").alias("stop")) for w in ("ext", "lig")])
    arms = with_copies(cut(narrow.select(*key, F.explode(two).alias("x")).select(*key, "x.*"), "arm"), counts, "arm", "copies")
    scans = cut(narrow.select(*key, F.col("scan_start").alias("start"), F.col("scan_stop").alias("stop")), "scan")
    arm, scan = F.col("arm"), F.col("scan")
    arm_inputs, scan_inputs_ = of_arm(arm), of_scan(scan)
    joined = narrow
    for w, inputs in arm_inputs.items():
        own = arms.select(*key, F.col("start").alias(f"{w}_probe_start"), F.col("stop").alias(f"{w}_probe_stop"), arm.alias(f"{w}_probe_sequence"), F.col("copies").alias(f"{w}_probe_copy"), F.contains(arm, F.lit("N")).alias(f"__{w}_unfit"), *[v.alias(f"__{k}") for k, v in inputs.items()])
        joined = joined.join(own, [*key, f"{w}_probe_start", f"{w}_probe_stop"])
    own = scans.select(*key, F.col("start").alias("scan_start"), F.col("stop").alias("scan_stop"), scan.alias("scan_target_sequence"), F.contains(scan, F.lit("-")).alias("__scan_unfit"), *[v.alias(f"__{k}") for k, v in scan_inputs_.items()])
    return joined.join(own, [*key, "scan_start", "scan_stop"]), [*arm_inputs["ext"], *arm_inputs["lig"], *scan_inputs_]


def pruned(scored: DataFrame, params: DesignParams) -> DataFrame:
    """The candidates that a search with early stops looks at, out of all scored ones.

    Shapes of a start are tried in the order of ``generation``, both strands at once. What counts is the better
    score of the shape tried last: above the upper limit, no smaller size is begun, and of the size at hand only
    the smallest arm sum. By the logistic heuristic an arm sum ends when both strands score below the whole part
    of what they scored before. A fold over a start's shapes, as many as sizes times arm pairs.
    """
    limit, smallest = params.upper_limit, min(total for total, _, _ in params.arms())
    heuristic = params.logistic_heuristic and params.score_method == "logistic"
    key = ["feature_id", "scan_start"]
    rows = scored.withColumn("__shape", F.floor(F.col("generation") / 2).cast("int")).withColumn("__score", F.nanvl("score", F.lit(float("-inf"))))
    of = lambda strand: F.max(F.when(F.col("strand") == strand, F.col("__score")))
    shapes = rows.groupBy(*key, "__shape").agg(F.first("capture_size").alias("size"), F.first(F.col("ext_len") + F.col("lig_len")).alias("total"), of("+").alias("plus"), of("-").alias("minus"))
    ordered = shapes.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("__shape", "size", "total", "plus", "minus"))).alias("__all"))
    kind = "struct<size:int,total:int,size_open:boolean,sum_open:boolean,ended:boolean,best:double,plus:double,minus:double,kept:array<int>>"
    begin = F.struct(F.lit(-1), F.lit(-1), F.lit(True), F.lit(True), F.lit(False), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.array().cast("array<int>")).cast(kind)
    whole = lambda x: F.when(F.abs(x) < 1e15, F.signum(x) * F.floor(F.abs(x))).otherwise(x)

    def step(s: Column, c: Column) -> Column:
        high = s["best"] > limit
        new_size = s["size"] != c["size"]
        size_open = F.when(new_size, ~high).otherwise(s["size_open"])
        new_sum = new_size | (s["total"] != c["total"])
        sum_open = F.when(new_sum, ~high | (c["total"] == smallest)).otherwise(s["sum_open"])
        ended = ~new_sum & s["ended"]
        seen = size_open & sum_open & ~ended
        before = lambda name: F.when(new_sum, F.lit(0.0)).otherwise(s[name])
        falls = (c["plus"] < before("plus")) & (c["minus"] < before("minus")) if heuristic else F.lit(False)
        keep = lambda new, old: F.when(seen, new).otherwise(old)
        state = (c["size"], c["total"], size_open, sum_open, keep(falls, ended), keep(F.greatest(c["plus"], c["minus"]), s["best"]), keep(whole(c["plus"]), before("plus")), keep(whole(c["minus"]), before("minus")), keep(F.array_append(s["kept"], c["__shape"]), s["kept"]))
        return F.struct(*state).cast(kind)

    kept = ordered.select(*key, F.explode(F.aggregate("__all", begin, step)["kept"]).alias("__shape"))
    return rows.join(kept, [*key, "__shape"]).drop("__shape", "__score")


def with_variants(candidates: DataFrame, snps: DataFrame, key: list[str]) -> DataFrame:
    """snp_count, snp_failed and the arms with the other allele, from variants (chr, pos, alleles).

    Variants are joined to the arms that contain them by bins. A variant of two plain bases replaces the
    base that matches its first allele, or that allele's complement; each starts from the plain arm and
    the last one counts. Other variants, or more than one in the arms, make the probe fail.
    """
    arm = lambda which, turn: candidates.select(*key, "chr", "strand", F.lit(turn).alias("turn"), F.col(f"{which}_probe_start").alias("start"), F.col(f"{which}_probe_stop").alias("stop"), F.col(f"{which}_probe_sequence").alias("arm"))
    hits = point_join(snps.select("chr", "pos", "alleles"), arm("ext", 0).unionByName(arm("lig", 1)), ["chr"], 64)
    at = (F.when(F.col("strand") == "+", F.col("pos") - F.col("start")).otherwise(F.col("stop") - F.col("pos")) + 1).cast("int")
    base = F.substr("arm", at, F.lit(1))
    one, two = F.substring("alleles", 1, 1), F.substring("alleles", 2, 1)
    other = lambda x: F.translate(x, "ACGT", "TGCA")
    plain = F.rlike("alleles", F.lit("^[^N-]{2}$"))
    new = F.when(plain & (base == one), two).when(plain & (base == other(one)) & F.rlike(one, F.lit("[ACGT]")), other(two))
    judged = hits.withColumn("changed", F.when(new.isNotNull(), F.overlay("arm", new, at, F.lit(1))))
    seen = judged.groupBy(*key).agg(
        F.count(F.lit(1)).alias("snp_count"),
        F.max(F.col("changed").isNull()).alias("__odd"),
        F.max_by(F.struct("turn", "changed"), F.struct("turn", "pos")).alias("__last"),
    )
    joined = candidates.join(seen, key, "left")
    count = F.coalesce("snp_count", F.lit(0))
    swap = lambda turn, name: F.when(F.col("__last.turn") == turn, F.col("__last.changed")).otherwise(F.col(name))
    return joined.withColumns({"snp_failed": F.coalesce("__odd", F.lit(False)) | (count > 1), "snp_ext_sequence": F.when(count > 0, swap(0, "ext_probe_sequence")), "snp_lig_sequence": F.when(count > 0, swap(1, "lig_probe_sequence")), "snp_count": count}).drop("__odd", "__last")


def condense(candidates: DataFrame, params: DesignParams, keys: tuple[str, ...] = ("feature_id", "scan_start", "strand")) -> DataFrame:
    """One probe per scan start and strand, chosen by a fold over its candidates, the last made first.

    The rules aren't an order (a candidate may win by mask, copies, variants or score, and a win by score
    alone leaves the remembered mask and copies as they were), so a sorted array is folded.
    """
    high = params.upper_limit
    low, limit, wanted = params.lower_limit, params.masked_arm_threshold, params.target_arm_copy
    usable = candidates.filter((F.col("ext_probe_copy") * F.col("lig_probe_copy") <= params.max_arm_copy_product) & ~F.col("mapping_failed"))
    small_ = F.struct((-F.col("generation")).alias("turn"), F.nanvl("score", F.lit(float("-inf"))).alias("score"), F.col("snp_count"), F.greatest("ext_probe_copy", "lig_probe_copy").alias("copies"), F.col("arm_fraction_masked").alias("masked"), F.col("generation"))
    kind = "struct<generation:int,score:double,snps:bigint,copies:bigint,masked:double,done:boolean>"

    def state(c: Column, copies: Column, masked: Column, done: Column) -> Column:
        return F.struct(c["generation"].alias("generation"), c["score"].alias("score"), c["snp_count"].cast("bigint").alias("snps"), copies.cast("bigint").alias("copies"), masked.cast("double").alias("masked"), done.alias("done")).cast(kind)

    def step(s: Column, c: Column) -> Column:
        fresh = state(c, c["copies"], c["masked"], F.lit(False))
        by_mask = (c["masked"] > limit) & (c["masked"] < s["masked"])
        by_copies = (c["copies"] > wanted) & (c["copies"] < s["copies"])
        fine = c["copies"] <= wanted
        by_low = fine & (c["score"] < low) & (c["score"] > s["score"])
        by_snps = fine & (c["score"] > low) & (c["snp_count"] < s["snps"])
        by_score = fine & (c["score"] > low) & (c["snp_count"] == s["snps"]) & (c["score"] > s["score"])
        return F.when(s["generation"].isNull(), fresh).when(s["done"], s).when(by_mask | by_copies | by_low | by_snps, fresh).when(by_score, state(c, s["copies"], s["masked"], c["score"] > high)).otherwise(s)

    fields = (("generation", "int"), ("score", "double"), ("snps", "bigint"), ("copies", "bigint"), ("masked", "double"), ("done", "boolean"))
    begin = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in fields]).cast(kind)
    folded = usable.groupBy(*keys).agg(F.sort_array(F.collect_list(small_)).alias("__all")).select(*keys, F.aggregate("__all", begin, step)["generation"].alias("generation"))
    return candidates.join(folded, [*keys, "generation"])


def collapse(condensed: DataFrame, params: DesignParams, keys: tuple[str, ...] = ("feature_id",)) -> DataFrame:
    """The best probe of each position and strand: fewest variants, highest score, earliest scan start.

    One row per position and strand with the probe's key columns; rows of probes are narrow here.
    """
    copies = (F.col("ext_probe_copy") * F.col("lig_probe_copy") <= params.max_arm_copy_product) & (F.greatest("ext_probe_copy", "lig_probe_copy") <= params.target_arm_copy)
    fit = condensed.filter(copies & (F.col("arm_fraction_masked") <= params.masked_arm_threshold))
    narrow = fit.select(*keys, "strand", "scan_start", "scan_stop", "snp_count", F.nanvl("score", F.lit(float("-inf"))).alias("score"))
    covered = narrow.withColumn("pos", F.explode(F.sequence("scan_start", "scan_stop")))
    best = F.min(F.struct("snp_count", (-F.col("score")).alias("worse"), "scan_start"))
    return covered.groupBy(*keys, "pos", "strand").agg(best.alias("b")).select(*keys, "pos", "strand", F.col("b.scan_start").alias("scan_start"), F.col("b.snp_count").alias("snp_count"), (-F.col("b.worse")).alias("score"))


def worst_of_best(collapsed: DataFrame, keys: tuple[str, ...] = ("feature_id",), strand: str | None = None) -> DataFrame:
    """For each feature the position whose better strand scores lowest, and that probe.

    Equal strands: minus; equal positions: the first. ``strand`` restricts the search to one strand.
    """
    rows = collapsed if strand is None else collapsed.filter(F.col("strand") == strand)
    per_position = rows.groupBy(*keys, "pos").agg(F.max(F.struct("score", (F.col("strand") == "-").alias("minus"), "scan_start")).alias("best"))
    worst = F.min(F.struct(F.col("best.score").alias("score"), "pos", F.col("best.minus").alias("minus"), F.col("best.scan_start").alias("scan_start")))
    found = per_position.groupBy(*keys).agg(worst.alias("w"))
    return found.select(*keys, "w.pos", F.when(F.col("w.minus"), "-").otherwise("+").alias("strand"), "w.scan_start", "w.score")


def design_record(probes: DataFrame, number: Column, minor: bool = False) -> DataFrame:
    """The 20 columns of a design file, from probes with their feature's start, stop and label."""
    flag = lambda c: F.when(F.col(c), "1").otherwise("0")
    suffix = F.when(F.col("snp_count") == 1, F.lit("_SNP_b" if minor else "_SNP_a")).otherwise("")
    return probes.select(
        "mip_key", "score", "chr", "ext_probe_start", "ext_probe_stop", "ext_probe_copy", "ext_probe_sequence",
        "lig_probe_start", "lig_probe_stop", "lig_probe_copy", "lig_probe_sequence",
        F.col("scan_start").alias("mip_scan_start_position"), F.col("scan_stop").alias("mip_scan_stop_position"),
        "scan_target_sequence", "mip_sequence", (F.col("start_f") - 1).alias("feature_start_position"), F.col("stop_f").alias("feature_stop_position"),
        F.col("strand").alias("probe_strand"), F.concat(flag("mapping_failed"), flag("masking_failed"), flag("snp_failed")).alias("failure_flags"),
        F.concat(F.format_string("%s_%04d", F.col("label"), number), suffix).alias("mip_name"),
    )
