"""Probe scores: the logistic model, its inputs, and the feature vector of the support-vector model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequences import base_runs, count_overlapping, mers, share_of_bases, share_of_mer

# Contribution of the first two bases of the ligation arm.
JUNCTION = {
    "AA": 0.0, "AC": 0.35, "AG": 0.046, "AT": 0.079, "CA": 0.34, "CC": 0.22, "CG": 0.55, "CT": -0.071,
    "GA": 0.35, "GC": 0.92, "GG": 0.24, "GT": 0.48, "TA": -0.46, "TC": -0.35, "TG": -0.25, "TT": -0.98,
}
# One k-mer of each pair of reverse complements, for the profile of a target's surroundings.
PROFILE_MERS = (
    "A AA AAA AAC AAG AAT AC ACA ACC ACG AG AGA AGC AGG AGT AT ATA ATC ATG CAG CG CGG G GAC GAG GC GCG GG GGC GGG GTG TA TAA TAC TAG TC TCC TCG TG TGA TGC TGG TTC TTG"
).split()
# Coefficients of the exponent, by the product of inputs they multiply.
INTERCEPT = -35.0464 - 4
COEFFICIENTS = {
    "bps": -1.974282, "bps*eGC": 2.63667, "bps*lGC": 2.540741, "bps*tl": -0.006488, "ea": -0.018137,
    "ea*ea": 7.795877, "ea*eg": -5.576753, "ea*el": -0.274062, "ea*lg": 8.695568, "ea*ce": -2.014126,
    "ea*cl": 3.163087, "eGC*eGC": -19.900678, "eGC": 35.747084, "eg": -2.082136, "eg*eg": 7.204324,
    "eg*lg": 11.73888, "eg*cl": -2.173235, "eg*tGC": -7.123214, "el": 1.068617, "el*el": -0.008666,
    "el*eGC": -0.555599, "el*lg": -0.289857, "el*ll": -0.009621, "el*ce": 0.119863, "j": 2.405833,
    "j*lGC": -1.764289, "j*lg": 2.112564, "j*ce": 0.656183, "j*ta": -3.099451, "j*tGC": -2.097335,
    "la*la": 6.542827, "la": -8.885956, "la*eg": 5.297562, "la*lGC": 13.042436, "la*lg": -12.333361,
    "lGC": 19.866468, "lGC*lGC": -13.698276, "lGC*ll": -0.517301, "lGC*cl": -2.846777, "lGC*ta": 13.64081,
    "lg": 13.614709, "lg*eGC": -4.759165, "lg*lGC": -7.48883, "lg*ce": -2.308594, "lg*ta": -12.640154,
    "ll": 1.164626, "ll*ll": -0.010326, "ll*eGC": -0.354197, "ll*ce": 0.111448, "ll*ta": 0.238095, "ce": -4.161632,
    "ce*eGC": -2.728864, "ce*cl": 0.641717, "ce*tGC": 3.738798, "cl": -1.98457, "cl*eGC": 2.362253,
    "cl*tGC": 3.467229, "ta": -18.443242, "ta*ta": 20.89245, "ta*tl": -0.048679, "tGC*tGC": -50.249451,
    "tGC": 27.132716, "tGC*tl": -0.050633, "tg": -20.772366, "tg*tg": -60.796481, "tg*ta": 26.630245,
    "tg*tGC": 87.162648, "tg*tl": 0.030256, "tl": 0.032811,
}
#: The model's base of powers, which isn't e, and the score of probes that can't be judged.
POWER_BASE, UNJUDGED = 2.71828, -1000.0


def terms() -> list[tuple[list[str], float]]:
    """(inputs, coefficient) of each product in the exponent."""
    return [(product.split("*"), value) for product, value in COEFFICIENTS.items()]


def junction_score(lig_arm: Column) -> Column:
    """Contribution of the first two bases of the ligation arm; 0 if unknown."""
    known = F.create_map(*[x for pair, value in JUNCTION.items() for x in (F.lit(pair), F.lit(value))])
    return F.coalesce(F.try_element_at(known, F.substring(lig_arm, 1, 2)), F.lit(0.0))


def log_copies(copies: Column) -> Column:
    """Decimal logarithm of a copy count, 2 above 100; minus infinity for an unknown count of 0."""
    return F.when(copies > 100, 2.0).when(copies > 0, F.log10(copies)).otherwise(F.lit(float("-inf")))


def ext_inputs(arm: Column, copies: Column) -> dict[str, Column]:
    """The exponent's inputs that the extension arm gives."""
    return {"eg": share_of_bases(arm, "G"), "eGC": share_of_bases(arm, "GC"), "ea": share_of_bases(arm, "A"), "el": F.length(arm).cast("double"), "ce": log_copies(copies)}


def lig_inputs(arm: Column, copies: Column) -> dict[str, Column]:
    """The exponent's inputs that the ligation arm gives."""
    shares = {"lg": share_of_bases(arm, "G"), "lGC": share_of_bases(arm, "GC"), "la": share_of_bases(arm, "A")}
    return shares | {"ll": F.length(arm).cast("double"), "j": junction_score(arm), "cl": log_copies(copies)}


def scan_inputs(target: Column) -> dict[str, Column]:
    """The exponent's inputs that the scan region gives."""
    shares = {"tg": share_of_bases(target, "G"), "tGC": share_of_bases(target, "GC"), "ta": share_of_bases(target, "A")}
    return shares | {"bps": F.length(target) / base_runs(target), "tl": F.least(F.length(target), F.lit(250)).cast("double")}


def logistic_inputs(ext: Column, lig: Column, target: Column, ext_copies: Column, lig_copies: Column) -> dict[str, Column]:
    """The exponent's inputs by name."""
    return ext_inputs(ext, ext_copies) | lig_inputs(lig, lig_copies) | scan_inputs(target)


def logistic_of(inputs: dict[str, Column], unfit: Column) -> Column:
    """Score in 0 to 1 from the inputs, or that of probes that can't be judged. Pass columns that hold
    the inputs, so that each is computed once. Unknown copy counts make the exponent infinite or not a
    number, which ends in 0, 1 or NaN as the arithmetic has it.
    """
    total = reduce(lambda s, t: s + reduce(lambda a, b: a * b, [inputs[n] for n in t[0]]) * t[1], terms(), F.lit(INTERCEPT))
    powered = F.pow(F.lit(POWER_BASE), total)
    return F.when(unfit, UNJUDGED).otherwise(powered / (1 + powered))


def logistic_score(inputs: dict[str, Column], ext: Column, lig: Column, target: Column) -> Column:
    """Score from inputs and sequences: arms with N and targets with "-" aren't judged and score -1000."""
    return logistic_of(inputs, F.contains(ext, F.lit("N")) | F.contains(lig, F.lit("N")) | F.contains(target, F.lit("-")))


def profile(seq: Column, seq_start: Column, seq_stop: Column) -> Column:
    """Shares of 44 k-mers, either strand, in a target's surroundings (a thousand bases each side)."""
    room = seq_stop - seq_start + 2001
    shares = []
    for mer in PROFILE_MERS:
        back = mer[::-1].translate(str.maketrans("ACGT", "TGCA"))
        found = count_overlapping(seq, mer)
        shares.append((found if back == mer else found + count_overlapping(seq, back)) / room)
    return F.array(*shares)


def _mer_shares(seq: Column, longest: int) -> list[Column]:
    """Shares of k-mers in lexicographic order, with the share of G and C before T."""
    return [x for mer in mers(longest) for x in (([share_of_bases(seq, "GC")] if mer == "T" else []) + [share_of_mer(seq, mer)])]


def arm_features(arm: Column) -> Column:
    """The 22 inputs of the support-vector model that an arm gives."""
    return F.array(*_mer_shares(arm, 2), F.length(arm).cast("double"))


def scan_features(target: Column) -> Column:
    """The 86 inputs that the scan region gives."""
    return F.array(*_mer_shares(target, 3), F.length(target).cast("double"))


def junction_features(lig: Column) -> Column:
    """16 inputs, one of them 1: the first two bases of the ligation arm."""
    return F.array(*[F.when(F.substring(lig, 1, 2) == a + b, 1.0).otherwise(0.0) for a in "ACGT" for b in "ACGT"])


def joined_features(ext: Column, surroundings: Column, scan: Column, lig: Column, junction: Column, ext_copies: Column, lig_copies: Column, unfit: Column) -> Column:
    """The 192 inputs from their parts, in the model's order; all 0 if the probe can't be judged."""
    whole = F.concat(ext, surroundings, scan, lig, junction, F.array(log_copies(ext_copies), log_copies(lig_copies)))
    return F.when(unfit, F.array_repeat(F.lit(0.0), 192)).otherwise(whole)


def feature_vector(ext: Column, lig: Column, target: Column, ext_copies: Column, lig_copies: Column, surroundings: Column) -> Column:
    """The 192 inputs of the support-vector model; all 0 if the probe can't be judged.

    Shares of k-mers come in lexicographic order with the share of G and C before T.
    """
    unfit = F.contains(ext, F.lit("N")) | F.contains(lig, F.lit("N")) | F.contains(target, F.lit("-"))
    return joined_features(arm_features(ext), surroundings, scan_features(target), arm_features(lig), junction_features(lig), ext_copies, lig_copies, unfit)
