"""Interval joins that shuffle by time bucket instead of comparing everything with everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions.interval import overlap

BUCKET_MS = 10_000


def _buckets(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor(F.greatest(start, end) / width))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int = BUCKET_MS, more_than: int = 0) -> DataFrame:
    """Pairs with equal keys whose [start_ms, end_ms] overlap by more than ``more_than`` ms.

    Columns other than the keys come back as l_name and r_name, with overlap_ms. Each interval goes
    to the buckets that it touches, and a pair is kept in the first bucket that both touch, so it
    comes once. A long interval costs one row for each bucket of its length.
    """
    def side(df: DataFrame, p: str) -> DataFrame:
        named = df.select(*keys, *(F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in keys))
        return named.withColumn("bucket", F.explode(_buckets(F.col(f"{p}_start_ms"), F.col(f"{p}_end_ms"), width)))

    joined = side(left, "l").join(side(right, "r"), [*keys, "bucket"])
    first = F.greatest(F.floor(F.col("l_start_ms") / width), F.floor(F.col("r_start_ms") / width))
    joined = joined.where(F.col("bucket") == first).withColumn("overlap_ms", overlap(*(F.col(c) for c in ("l_start_ms", "l_end_ms", "r_start_ms", "r_end_ms"))))
    return joined.where(F.col("overlap_ms") > more_than).drop("bucket")


def point_join(points: DataFrame, at: str, intervals: DataFrame, keys: list[str], start: str = "start_ms", end: str = "end_ms", width: int = BUCKET_MS) -> DataFrame:
    """Points with the intervals [start, end] that hold them, by equal keys."""
    pointed = points.withColumn("bucket", F.floor(F.col(at) / width))
    spread = intervals.withColumn("bucket", F.explode(_buckets(F.col(start), F.col(end), width)))
    return pointed.join(spread, [*keys, "bucket"]).where(F.col(at).between(F.col(start), F.col(end))).drop("bucket")


def align_words(words: DataFrame, cues: DataFrame, tolerance: int) -> DataFrame:
    """Each word's best cue: (media_id, word_no, lang, cue_no, overlap_ms, w_start, w_end, confidence, speaker, text).

    Candidates start within the cue, give or take the tolerance; the cue with the longest overlap
    wins, then the first by language and number. Words without a candidate are left out.
    """
    w = words.select("media_id", "word_no", "text", "speaker", "confidence", F.col("start_ms").alias("w_start"), F.greatest("end_ms", F.col("start_ms") + 1).alias("w_end"))
    c = cues.select("media_id", "lang", "cue_no", F.col("start_ms").alias("c_start"), F.col("end_ms").alias("c_end"), (F.col("start_ms") - tolerance).alias("from_ms"), (F.col("end_ms") + tolerance).alias("to_ms"))
    met = point_join(w, "w_start", c, ["media_id"], "from_ms", "to_ms").withColumn("overlap_ms", overlap(F.col("w_start"), F.col("w_end"), F.col("c_start"), F.col("c_end")))
    best = Window.partitionBy("media_id", "word_no").orderBy(F.desc("overlap_ms"), "lang", "cue_no")
    return met.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n", "from_ms", "to_ms")


def asof_floor(points: DataFrame, at: str, marks: DataFrame, mark: str, keys: list[str]) -> DataFrame:
    """Points with the last mark at or before them (null if none): one pass over both, ordered by time."""
    both = points.select(*points.columns, F.lit(None).cast(marks.schema[mark].dataType).alias("found"), F.lit(1).alias("kind")).unionByName(
        marks.select(*keys, F.col(mark).alias(at), F.col(mark).alias("found"), F.lit(0).alias("kind")), allowMissingColumns=True
    )
    upto = Window.partitionBy(*keys).orderBy(at, "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("found", F.last("found", ignorenulls=True).over(upto)).where("kind = 1").drop("kind").withColumnRenamed("found", f"floor_{mark}")
