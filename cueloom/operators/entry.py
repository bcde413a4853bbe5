"""Where a cue should start, by the confidence and the gaps of its words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueloom.operators.intervals import point_join

# Limits of confidence, and times in milliseconds.
UNSURE, SURE, CLIFF, GOOD, ANCHOR = 0.40, 0.70, 0.30, 0.50, 0.45
MARGIN_MS, LEAD_IN_MS, LEAST_SHIFT_MS, MOST_SHIFT_MS, GAP_MS = 50, 100, 80, 1500, 1500


def entry_points(words: DataFrame, cues: DataFrame) -> DataFrame:
    """Cues that should start later: (media_id, lang, cue_no, start_ms, reason).

    A cue whose first word is unsure and one of the next five sure starts shortly before its first good
    word (``cliff``), if that is neither too near nor too far; else before the first sure word after a long
    gap that no long gap follows (``gap``). Cues of fewer than two words stay. Words count for a cue if they
    start within it, give or take 50 ms; of equal starts the smaller number is first.
    """
    key = ["media_id", "lang", "cue_no"]
    near = cues.select(*key, F.col("start_ms").alias("c_start"), (F.col("start_ms") - MARGIN_MS).alias("from_ms"), (F.col("end_ms") + MARGIN_MS).alias("to_ms"))
    x = point_join(words.select("media_id", "word_no", "start_ms", "end_ms", "confidence"), "start_ms", near, ["media_id"], "from_ms", "to_ms")
    over = Window.partitionBy(*key).orderBy("start_ms", "word_no")
    x = x.withColumns({"k": F.row_number().over(over), "before": F.lag("end_ms").over(over), "after": F.lead("start_ms").over(over)})
    shift = F.col("start_ms") - LEAD_IN_MS - F.col("c_start")
    steady = F.coalesce(F.col("after") - F.col("end_ms") <= GAP_MS, F.lit(True))
    anchor = (F.col("start_ms") - F.col("before") > GAP_MS) & steady & (shift >= LEAST_SHIFT_MS) & (F.col("confidence") >= ANCHOR)
    least = lambda holds: F.min(F.when(holds, F.struct("k", "start_ms")))["start_ms"] - LEAD_IN_MS
    x = x.groupBy(*key, "c_start").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("k") == 1, F.col("confidence"))).alias("first"),
        F.max(F.when(F.col("k").between(2, 6), F.col("confidence"))).alias("peak"),
        least(F.col("confidence") > GOOD).alias("good"),
        least(anchor).alias("anchor"),
    ).where("n > 1")
    cliff = (F.col("first") < UNSURE) & (F.col("peak") >= SURE) & (F.col("peak") - F.col("first") >= CLIFF)
    x = x.withColumn("cliff", F.coalesce(cliff, F.lit(False)))
    moved = F.when(~F.col("cliff"), F.col("anchor")).when((F.col("good") - F.col("c_start")).between(LEAST_SHIFT_MS, MOST_SHIFT_MS), F.col("good"))
    return x.select(*key, moved.alias("start_ms"), F.when(F.col("cliff"), "cliff").otherwise("gap").alias("reason")).where("start_ms IS NOT NULL")
