"""The registry of cue rules and their evaluation.

Issues are rows (rule, severity, media_id, lang, cue_no, sub_no); sub_no numbers the lines (or pairs
of lines) of a cue from 0 and is 0 for rules on whole cues.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.config import QCConfig
from cueloom.functions import text as T

ERROR, WARNING, SUGGESTION = "error", "warning", "suggestion"


@dataclass(frozen=True)
class Rule:
    """hits(config): an array of sub_no, or a boolean; severity(config): a name or a column."""

    name: str
    hits: Callable[[QCConfig], Column]
    severity: Callable[[QCConfig], Column]
    per_line: bool = False
    at_previous: bool = False


RULES: dict[str, Rule] = {}


def rule(name: str, severity: str | Callable[[QCConfig], Column], per_line: bool = False):
    def add(hits: Callable[[QCConfig], Column]) -> Callable[[QCConfig], Column]:
        of = severity if callable(severity) else lambda _: F.lit(severity)
        RULES[name] = Rule(name, hits, of, per_line)
        return hits

    return add


def with_neighbours(cues: DataFrame) -> DataFrame:
    """Cues with the columns that rules read, of the cue itself and of the one before and after."""
    over = Window.partitionBy("media_id", "lang").orderBy("cue_no")
    columns = {f"prev_{c}": F.lag(c).over(over) for c in ("start_ms", "end_ms", "text", "speaker")}
    columns |= {f"next_{c}": F.lead(c).over(over) for c in ("start_ms", "text")}
    x = cues.withColumns(columns).withColumn("lines", T.lines(F.col("text")))
    return x.withColumns({"dur": F.col("end_ms") - F.col("start_ms"), "flat": T.strip(F.regexp_replace("text", "\n", "")), "last": T.last_line(F.col("text"))})


def check(cues: DataFrame, config: QCConfig = QCConfig(), names: list[str] | None = None) -> DataFrame:
    """Issues of the rules of these names (all by default) on ``cues``."""
    rules = [RULES[n] for n in (names or RULES)]

    def issues(r: Rule) -> Column:
        hits = r.hits(config) if r.per_line else F.when(r.hits(config), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
        severity = r.severity(config)
        return F.transform(F.coalesce(hits, F.array().cast("array<int>")), lambda sub: F.struct(F.lit(r.name).alias("rule"), severity.alias("severity"), sub.cast("int").alias("sub_no")))

    found = with_neighbours(cues).select("media_id", "lang", "cue_no", F.explode(F.concat(*map(issues, rules))).alias("x"))
    return found.select("x.rule", "x.severity", "media_id", "lang", "cue_no", "x.sub_no")


def line_numbers(test: Callable[[Column], Column], array: str = "lines") -> Column:
    """Numbers of the lines that pass the test."""
    marked = F.transform(array, lambda line, k: F.when(test(line), k))
    return F.filter(marked, lambda k: k.isNotNull())


def pair_numbers(test: Callable[[Column, Column], Column]) -> Column:
    """Numbers of the lines that pass the test together with the next line."""
    marked = F.transform("lines", lambda line, k: F.when((k < F.size("lines") - 1) & test(line, F.try_element_at("lines", k + 2)), k))
    return F.filter(marked, lambda k: k.isNotNull())
