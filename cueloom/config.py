"""Limits that quality rules and operators read, with their defaults. Times are milliseconds."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class QCConfig:
    # The limits of the rules.
    # How long a cue stays, and what lies between two.
    min_duration: int = 800
    max_duration: int = 7000
    long_duration: int = 9000
    min_gap: int = 100
    # Lines and characters of a cue, in Chinese and otherwise.
    max_lines: int = 2
    max_lines_zh: int = 1
    max_chars_per_line_zh: int = 30
    max_chars_per_line_en: int = 42
    # Characters a second, in Chinese and in English.
    cps_limit: int = 9
    cps_limit_en: int = 25
    # Words that a cue covers.
    alignment_tolerance: int = 120
    word_coverage_min: float = 0.95
