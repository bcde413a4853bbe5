"""Streaming forms: latest progress, pause sessions and windowed roll-ups of event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_progress(events: DataFrame, key: str = "video_id", at: str = "ts") -> DataFrame:
    """The last event of each key, kept up to date (update or complete mode)."""
    others = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*others), at).alias("x")).select(key, "x.*")


def pause_sessions(events: DataFrame, keys: list[str], gap: str, late: str, at: str = "ts") -> DataFrame:
    """Sessions that a pause of ``gap`` ends. Times are points here, so a session closes a gap after
    its last event; words with ends need the batch form."""
    return events.withWatermark(at, late).groupBy(*keys, F.session_window(at, gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select(*keys, "s.start", "s.end", "n")


def windowed_counts(events: DataFrame, keys: list[str], width: str, late: str, slide: str | None = None, at: str = "ts") -> DataFrame:
    """Counts in tumbling or sliding windows; what comes later than ``late`` is dropped."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return events.withWatermark(at, late).groupBy(*keys, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, "w.start", "w.end", "n")


def without_repeats(events: DataFrame, keys: list[str], late: str, at: str = "ts") -> DataFrame:
    """Each key once, for repeats that come within ``late`` of each other."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
