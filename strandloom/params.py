"""Options of probe design and of read collapsing."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass


@dataclass(frozen=True)
class DesignParams:
    """Options of probe design, with the usual defaults."""

    project_name: str = "project"
    min_capture_size: int = 120
    max_capture_size: int = 250
    capture_increment: int = 5
    arm_length_sums: tuple[int, ...] = (40, 41, 42, 43, 44, 45)
    arm_lengths: tuple[tuple[int, int], ...] = ()
    ext_min_length: int = 16
    lig_min_length: int = 18
    longest_arm: int = 30
    tag_sizes: tuple[int, int] = (5, 0)  # at the extension and at the ligation arm
    backbone: str = "CTTCAGCTTCCCGATATCCGACGGTAGTGT"
    masked_arm_threshold: float = 0.5
    target_arm_copy: int = 20
    max_arm_copy_product: int = 75
    feature_flank: int = 0
    max_mip_overlap: int = 30
    starting_mip_overlap: int = 0
    check_copy_number: bool = True
    seal_both_strands: bool = False
    half_seal_both_strands: bool = False
    double_tile_strand_unaware: bool = False
    double_tile_strands_separately: bool = False
    score_method: str = "logistic"
    logistic_heuristic: bool = True  # stop trying longer extension arms when both strands' scores fall
    logistic_optimal_score: float = 0.98
    logistic_priority_score: float = 0.9
    svr_optimal_score: float = 2.2
    svr_priority_score: float = 1.5
    silent_mode: bool = False

    @property
    def step(self) -> int:
        return max(1, self.capture_increment)

    @property
    def upper_limit(self) -> float:
        """Score above which no better probe is looked for."""
        return self.svr_optimal_score if self.score_method == "svr" else self.logistic_optimal_score

    @property
    def lower_limit(self) -> float:
        """Score below which a probe's position is tiled first."""
        return self.svr_priority_score if self.score_method == "svr" else self.logistic_priority_score

    def arms(self) -> list[tuple[int, int, int]]:
        """(sum, extension, ligation) lengths of the arm pairs to try, by sum and extension length."""
        pairs = {(e + g, e, g) for e, g in self.arm_lengths}
        for total in self.arm_length_sums:
            for lig in range(self.lig_min_length, min(self.longest_arm, total - self.ext_min_length) + 1):
                if total - lig <= self.longest_arm:
                    pairs.add((total, total - lig, lig))
        return sorted(pairs)

    def check(self) -> DesignParams:
        if not 0 < self.min_capture_size <= self.max_capture_size:
            raise ValueError("capture sizes are to be positive and in order")
        if self.score_method not in ("logistic", "svr", "mixed"):
            raise ValueError("score_method is one of logistic, svr, mixed")
        if not self.arms():
            raise ValueError("no pair of arm lengths fits the options")
        return self


@dataclass(frozen=True)
class CollapseParams:
    """Options of read collapsing."""

    tag_size: int = 5
    flex: int = 0
    confidence: float = 0.9
    picky_tags: bool = False
    single_end: bool = False
    collapse_free: bool = False
    key_by_reference: bool = False
    exact_arms: bool = False
    trim: bool = True
    tolerant: bool = False  # barcodes may differ by one base
    drop_soft_clipped: bool = True
    split_by_barcode: bool = False
    seed: int = 0

    @property
    def tags(self) -> int:
        """Number of different tags."""
        return 4**self.tag_size


@dataclass(frozen=True)
class CutParams:
    """Options of cutting FASTQ reads."""

    tags: tuple[int, int] | None = None  # bases of the molecular tag: of both reads, or of a read's two ends
    index_length: int | None = None
    longest: int | None = None
    skip: int = 0
    drop_all_hash: bool = False
    trim_hash: bool = False


def parse_options(words: list[str], file_lines: list[str] | None = None) -> DesignParams:
    """Options from "-name value" words; lines of a parameter file, read later, win.

    Unknown names are an error; "on" and "off" are switches and lists are separated by commas, arm
    pairs written as ext:lig.
    """
    known = {f.name: f for f in dataclasses.fields(DesignParams)}
    given: dict[str, object] = {}

    def take(name: str, value: str) -> None:
        field = known.get(name.lstrip("-"))
        if field is None:
            raise ValueError(f"unknown option {name}")
        default = field.default
        if field.name == "arm_lengths":
            given[field.name] = tuple(tuple(int(x) for x in pair.split(":")) for pair in value.split(","))
        elif isinstance(default, bool):
            given[field.name] = value.lower() in ("on", "true", "1")
        elif isinstance(default, tuple):
            given[field.name] = tuple(int(x) for x in value.split(","))
        else:
            given[field.name] = type(default)(value)

    if len(words) % 2:
        raise ValueError("options come as names and values")
    for name, value in zip(words[::2], words[1::2], strict=True):
        take(name, value)
    for line in file_lines or []:
        parts = line.split()
        if len(parts) == 2 and parts[0].startswith("-"):
            take(*parts)
    if given.get("arm_lengths") and "arm_length_sums" not in given:
        given["arm_length_sums"] = ()
    return DesignParams(**given).check()
