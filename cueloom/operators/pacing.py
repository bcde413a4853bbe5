"""When cues come and go, so that each can be read: windows over neighbours, and one short fold.

Every step but one is decided by a row and its neighbours as they were before the step, or by a running
sum and maximum. Only borrowing reading time passes a decision on: a cue that cannot take what it lacks
after itself takes it before itself, of what the cue before has left. Such cues and the one that they
lean on are folded together, and nothing else is; runs of them are a few cues long.

Times are whole milliseconds; halves and shares are rounded down, needs up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from cueloom.functions import text as T
from cueloom.operators.entry import entry_points

KEY = ["media_id", "lang", "cue_no"]
# Gaps up to the first are set to the second, and the second lies between cues at least.
SMALL_GAP, LEAST_GAP = 150, 105
# How far a cue may be off its words, and how long it may outstay them beyond the padding.
OFF_WORDS, OUTSTAY = 100, 500


def _frame() -> tuple[Column, Column, WindowSpec]:
    """Start and end of a cue, and the window of its medium and language."""
    return F.col("start_ms"), F.col("end_ms"), Window.partitionBy("media_id", "lang").orderBy("cue_no")


def _least(value: Column) -> Column:
    """At least zero, as where there is no neighbour."""
    return F.greatest(F.lit(0), value)


def _halved(value: Column) -> Column:
    return F.floor(value / 2).cast("long")


def _durations(cues: DataFrame, shortest: int, longest: int) -> DataFrame:
    """Short cues last longer, and long ones end sooner unless they were merged."""
    start, end, _ = _frame()
    span = F.when(end - start < shortest, shortest).when((end - start > longest) & ~F.col("merged"), longest).otherwise(end - start)
    return cues.withColumn("end_ms", start + span)


def _overlaps_and_small_gaps(cues: DataFrame) -> DataFrame:
    """Overlaps are shared out by length of text; small gaps become the least gap around their middle."""
    start, end, over = _frame()
    x = cues.withColumns({"next": F.lead("start_ms").over(over), "next_chars": F.lead("chars").over(over), "before": F.lag("end_ms").over(over)})
    gap, both = F.col("next") - end, F.col("chars") + F.col("next_chars")
    share = F.when(both > 0, F.floor(-gap * F.col("chars") / both).cast("long")).otherwise(0)
    small = lambda g: (g > 0) & (g < SMALL_GAP)
    centred = lambda a, b: _halved(a + b - LEAST_GAP)
    until = F.when(gap < 0, F.col("next") + share).when(small(gap), centred(end, F.col("next"))).otherwise(end)
    since = F.when(small(start - F.col("before")), centred(F.col("before"), start) + LEAST_GAP).otherwise(start)
    return x.withColumns({"start_ms": since, "end_ms": until}).drop("next", "next_chars", "before")


def _reading_time(cues: DataFrame, longest: int, limit: Column) -> DataFrame:
    """A cue that is read too fast takes what it lacks after itself; else before itself, of what the cue
    before left; else all there is before and the rest after. If that is not enough, it takes nothing."""
    start, end, over = _frame()
    span = end - start
    lack = F.floor((F.col("chars") * 1000 + limit - 1) / limit).cast("long") - span
    lack = F.when(F.col("merged"), lack).otherwise(F.least(lack, _least(longest - span)))
    x = cues.withColumn("lack", F.when(span > 0, _least(lack)).otherwise(0))
    x = x.withColumns({"after": _least(F.lead("start_ms").over(over) - end - LEAST_GAP), "room": _least(start - F.lag("end_ms").over(over) - LEAST_GAP)})
    leans = (F.col("lack") > F.col("after")) & (F.col("room") > 0) & (F.col("lack") <= F.col("after") + F.col("room"))
    x = x.withColumn("leans", leans).withColumn("run", F.sum((~F.col("leans")).cast("int")).over(over))
    columns = [c for c in x.columns if c not in ("media_id", "lang", "run")]
    runs = x.groupBy("media_id", "lang", "run").agg(F.array_sort(F.collect_list(F.struct("cue_no", *(c for c in columns if c != "cue_no")))).alias("rows"))
    # What each of a run takes before and after itself.
    took = "array<struct<before:bigint,after:bigint>>"

    def step(done: Column, row: Column) -> Column:
        room = _least(row["room"] - F.coalesce(F.try_element_at(done, F.lit(-1))["after"], F.lit(0)))
        before = F.when(~row["leans"] | (row["lack"] > row["after"] + room), 0).otherwise(F.least(row["lack"], room))
        after = F.when(row["leans"], F.when(row["lack"] > row["after"] + room, 0).otherwise(row["lack"] - before)).when(row["lack"] <= row["after"], row["lack"]).otherwise(0)
        return F.concat(done, F.array(F.struct(before.cast("long").alias("before"), after.cast("long").alias("after"))).cast(took))

    moved = runs.withColumn("took", F.aggregate("rows", F.array().cast(took), step))
    each = moved.select("media_id", "lang", F.explode(F.arrays_zip("rows", "took")).alias("x")).select("media_id", "lang", "x.rows.*", "x.took")
    return each.withColumns({"start_ms": start - F.col("took.before"), "end_ms": end + F.col("took.after")}).drop("lack", "after", "room", "leans", "took")


def _least_gaps(cues: DataFrame) -> DataFrame:
    """Cues too near to the one before move on, and so do those after them as far as need be."""
    start, end, over = _frame()
    upto = over.rowsBetween(Window.unboundedPreceding, 0)
    packed = F.sum(end - start + LEAST_GAP).over(upto) - (end - start + LEAST_GAP)
    x = cues.withColumn("packed", packed)
    return x.withColumn("moved", F.col("packed") + F.max(start - F.col("packed")).over(upto)).withColumns({"end_ms": F.col("moved") + end - start, "start_ms": F.col("moved")}).drop("packed", "moved")


def _padding(cues: DataFrame, padding: int) -> DataFrame:
    """A cue stays a little longer where there is room."""
    _, end, over = _frame()
    following = F.lead("start_ms").over(over)
    free = F.when(following.isNotNull(), _least(following - end - LEAST_GAP)).otherwise(padding)
    return cues.withColumn("end_ms", end + F.least(F.lit(padding), free))


def _shortest(cues: DataFrame, shortest: int) -> DataFrame:
    """A cue still too short takes what it lacks of the gap after it, then of that before it."""
    start, end, over = _frame()
    lack = _least(shortest - (end - start))
    after = F.least(lack, _least(F.lead("start_ms").over(over) - end - LEAST_GAP))
    x = cues.withColumns({"lack": lack - after, "end_ms": end + after})
    before = F.least("lack", _least(start - F.lag("end_ms").over(over) - LEAST_GAP))
    return x.withColumn("start_ms", start - before).drop("lack")


def _words(cues: DataFrame, words: DataFrame, padding: int) -> DataFrame:
    """A cue covers its words where its neighbours leave room, and does not outstay them for long."""
    start, end, over = _frame()
    spans = words.where("cue_no IS NOT NULL").groupBy("media_id", "cue_no").agg(F.min("start_ms").alias("said"), F.max("end_ms").alias("silent"))
    x = cues.join(spans, ["media_id", "cue_no"], "left").withColumn("next", F.lead("start_ms").over(over))
    short = (F.col("silent") - end > OFF_WORDS) & (F.col("next").isNull() | (F.col("next") - F.col("silent") >= LEAST_GAP))
    x = x.withColumn("end_ms", F.when(short, F.col("silent")).otherwise(end))
    latest = F.col("silent") + padding + OUTSTAY
    x = x.withColumn("end_ms", F.when(end > latest, F.least(latest, F.col("next") - LEAST_GAP)).otherwise(end))
    before = F.lag("end_ms").over(over)
    x = x.withColumn("before", before)
    late = (start - F.col("said") > OFF_WORDS) & (F.col("before").isNull() | (F.col("said") - F.col("before") >= LEAST_GAP))
    return x.withColumn("start_ms", F.when(late, F.col("said")).otherwise(start)).drop("said", "silent", "next", "before")


def pace(cues: DataFrame, words: DataFrame | None = None, shortest: int = 800, longest: int = 7000, padding: int = 300, cps: int = 9, cps_en: int = 25) -> DataFrame:
    """Display times of cues: (media_id, lang, cue_no, start_ms, end_ms).

    In this order: durations, overlaps and small gaps, reading time borrowed of gaps, least gaps,
    padding, the shortest duration again; with ``words`` also the bounds of a cue's words, entry points,
    and the shortest duration once more. ``cues`` may have a boolean ``merged``: such cues may last longer.
    ``words``: (media_id, word_no, start_ms, end_ms, confidence, cue_no); cue_no names the cue that a word
    belongs to and may be null; entry points go by time. A null text counts as empty; a cue without
    words keeps its bounds. Cues are ordered by number, which repeats in no medium and language.
    """
    start, end, _ = _frame()
    merged = F.coalesce(F.col("merged"), F.lit(False)) if "merged" in cues.columns else F.lit(False)
    x = cues.select(*KEY, start.cast("long").alias("start_ms"), end.cast("long").alias("end_ms"), merged.alias("merged"), F.coalesce(T.chars(F.col("text")), F.lit(0)).alias("chars"))
    x = _overlaps_and_small_gaps(_durations(x, shortest, longest))
    x = _reading_time(x, longest, F.when(F.col("lang") == "zh", cps).otherwise(cps_en))
    x = _shortest(_padding(_least_gaps(x), padding), shortest)
    if words is not None:
        x = _words(x, words, padding)
        later = entry_points(words.drop("cue_no"), x.select(*KEY, "start_ms", "end_ms")).select(*KEY, F.col("start_ms").alias("entry"))
        x = x.join(later, KEY, "left").withColumn("start_ms", F.coalesce("entry", "start_ms")).drop("entry")
        x = _shortest(x, shortest)
    return x.select(*KEY, "start_ms", "end_ms")
