"""Asking again: what a model's replies left out, doubled or put elsewhere, and what scored low, round by round.

A round asks for all units of all media at once, in one job, and is kept before the next starts; rounds
are few and bounded, whatever the replies are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions import text as T
from cueloom.operators.checkpoints import cut
from cueloom.plans import review, units

UNIT = ["media_id", "unit_id"]
CUE = ["media_id", "unit_id", "merged_from", "start_ms", "end_ms", "text"]


def suspects(segments: DataFrame, cues: DataFrame) -> DataFrame:
    """Units to ask for again: (media_id, unit_id, reason).

    missing: no cue covers it, as its own unit or as one merged into it; duplicate: its cue has the text of an earlier
    one of the same group (units named alike up to their first number); moved: its cue starts more than three seconds from
    its segment. A unit that is several of these has the first of them.
    """
    covered = cues.select("media_id", F.explode(F.concat(F.array("unit_id"), F.coalesce("merged_from", F.array().cast("array<string>")))).alias("unit_id"))
    missing = segments.select(*UNIT).join(covered, UNIT, "left_anti").withColumn("reason", F.lit("missing"))
    group = F.regexp_extract("unit_id", r"^(mu?\d+)", 1)
    again = F.row_number().over(Window.partitionBy("media_id", group, T.strip(F.col("text"))).orderBy("start_ms", "unit_id"))
    double = cues.where((group != "") & (T.strip(F.col("text")) != "")).withColumn("n", again).where("n > 1").select(*UNIT, F.lit("duplicate").alias("reason"))
    moved = units.timestamp_mismatches(cues, segments).select(*UNIT, F.lit("moved").alias("reason"))
    rank = F.array_position(F.array(*map(F.lit, ("missing", "duplicate", "moved"))), F.col("reason"))
    return missing.unionByName(double).unionByName(moved).groupBy(*UNIT).agg(F.min_by("reason", rank).alias("reason"))


def retry(segments: DataFrame, cues: DataFrame, responder: review.Responder, rounds: int = 2) -> tuple[DataFrame, list[int]]:
    """Cues after asking again for suspect units, and how many were asked for in each round.

    ``segments``: (media_id, unit_id, start_ms, end_ms, text), ``cues``: the columns CUE. The responder gets (media_id, unit_id,
    round, source, before, after), the last two being the texts of the units around, and replies with a
    text; a null or blank one is no answer. The cue of an answer takes its segment's times. Cues of a unit that was
    asked for, or that had one merged into it, go with the first answer of the round; without any answer, rounds end.
    """
    now, asked = cut(cues.select(*CUE)), []
    over = Window.partitionBy("media_id").orderBy("start_ms", "unit_id")
    placed = segments.select(*UNIT, "start_ms", "end_ms", F.col("text").alias("source"), F.lag("text").over(over).alias("before"), F.lead("text").over(over).alias("after"))
    for number in range(1, rounds + 1):
        wanted = cut(suspects(segments, now).join(placed, UNIT))
        count = wanted.count()
        if not count:
            break
        asked.append(count)
        replies = responder.reply(wanted.select(*UNIT, F.lit(number).alias("round"), "source", "before", "after"))
        answered = cut(replies.where(T.strip(F.col("reply")) != "").select(*UNIT, F.col("reply").alias("text")).join(wanted.select(*UNIT, "start_ms", "end_ms"), UNIT))
        if not answered.limit(1).count():
            break
        ids = wanted.groupBy("media_id").agg(F.collect_set("unit_id").alias("ids"))
        touched = F.coalesce(F.arrays_overlap(F.concat(F.array("unit_id"), F.coalesce("merged_from", F.array().cast("array<string>"))), F.col("ids")), F.lit(False))
        kept = now.join(ids, "media_id", "left").where(~touched).select(*CUE)
        now = cut(kept.unionByName(answered.select("media_id", "unit_id", F.array().cast("array<string>").alias("merged_from"), "start_ms", "end_ms", "text")))
    return now, asked


def refine(cues: DataFrame, sources: DataFrame, evaluator: review.Responder, refiner: review.Responder, threshold: float = 0.6, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """Cues (media_id, unit_id, text) rewritten while they score low, and the last scores: (media_id, unit_id, overall, round).

    ``sources``: (media_id, unit_id, source). In each round the evaluator scores what is new to it (null where it
    does not say: such a cue is left alone), and the refiner gets those below the threshold; a blank or null reply leaves
    the text. After the last round the rewritten cues are scored no more. Scores as of ``review.overall``.
    """
    now = cut(cues.select(*UNIT, "text"))
    scores, fresh = None, now
    for number in range(1, rounds + 1):
        told = evaluator.reply(fresh.join(sources, UNIT).withColumn("round", F.lit(number)))
        found = cut(review.overall(told.where(F.col("accuracy").isNotNull())).select(*UNIT, "overall", F.lit(number).alias("round")))
        scores = found if scores is None else cut(scores.join(found.select(*UNIT), UNIT, "left_anti").unionByName(found))
        low = scores.where(F.col("overall") < threshold).join(now, UNIT).join(sources, UNIT)
        if not low.limit(1).count():
            break
        better = cut(refiner.reply(low.withColumn("round", F.lit(number))).where(T.strip(F.col("reply")) != "").select(*UNIT, F.col("reply").alias("text")))
        now, fresh = cut(now.join(better.select(*UNIT), UNIT, "left_anti").unionByName(better)), better
    return now, scores
