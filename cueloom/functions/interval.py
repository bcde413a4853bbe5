"""Arithmetic of time intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """How long two intervals overlap, 0 if they don't."""
    return F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0).cast("long"))


def byte_range(header: Column, size: Column) -> tuple[Column, Column]:
    """First and last byte of a closed, open or suffix range header; null where it can't be met."""
    pattern = r"^bytes=(\d*)-(\d*)$"
    field = lambda k: F.nullif(F.regexp_extract(header, pattern, k), F.lit("")).cast("long")
    start, end = field(1), field(2)
    suffix = start.isNull() & end.isNotNull()
    first = F.when(suffix, F.greatest(size - end, F.lit(0))).otherwise(start)
    last = F.when(suffix, size - 1).otherwise(F.least(F.coalesce(end, size - 1), size - 1))
    ok = header.rlike(pattern) & (start.isNotNull() | end.isNotNull()) & (first < size) & (first <= last)
    return F.when(ok, first), F.when(ok, last)
