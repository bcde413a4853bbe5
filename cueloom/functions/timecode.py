"""Time codes of subtitle formats from and to whole milliseconds.

Writing carries an overflow of milliseconds through to hours.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fields(ms: Column) -> tuple[Column, Column, Column, Column]:
    whole = F.greatest(ms, F.lit(0)).cast("long")
    div = lambda n: F.floor(whole / n)
    return div(3_600_000), div(60_000) % 60, div(1000) % 60, whole % 1000


def _two(n: Column) -> Column:
    return F.when(n < 100, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))


def to_srt(ms: Column) -> Column:
    h, m, s, rest = _fields(ms)
    return F.concat(_two(h), F.lit(":"), _two(m), F.lit(":"), _two(s), F.lit(","), F.lpad(rest.cast("string"), 3, "0"))


def to_vtt(ms: Column) -> Column:
    return F.replace(to_srt(ms), F.lit(","), F.lit("."))


def to_ass(ms: Column) -> Column:
    h, m, s, rest = _fields(F.floor(ms / 10) * 10)
    return F.concat(h.cast("string"), F.lit(":"), _two(m), F.lit(":"), _two(s), F.lit("."), F.lpad(F.floor(rest / 10).cast("string"), 2, "0"))


def parse(text: Column) -> Column:
    """Milliseconds of H:MM:SS,mmm, H:MM:SS.cc or MM:SS.mmm; null for anything else."""
    pattern = r"^\s*(?:(\d+):)?(\d{1,2}):(\d{1,2})[.,](\d{1,3})\s*$"
    part = lambda k: F.regexp_extract(text, pattern, k)
    number = lambda x: F.coalesce(F.try_to_number(F.nullif(x, F.lit("")), F.lit("99999999")), F.lit(0)).cast("long")
    ms = number(part(1)) * 3_600_000 + number(part(2)) * 60_000 + number(part(3)) * 1000 + number(F.rpad(part(4), 3, "0"))
    return F.when(text.rlike(pattern), ms)
