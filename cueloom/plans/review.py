"""What surrounds a language model's replies: payloads in, replies checked and applied.

The model itself is a ``Responder``: anything that maps prompts to replies. ``ReplayResponder``
answers from a table, which makes every stage here deterministic.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions import text as T
from cueloom.sources.subtitles import lenient_json

# English words that negate, weights of an evaluation, endings that leave a sentence open.
NEGATION_WORDS = ["not", "don't", "doesn't", "didn't", "isn't", "aren't", "wasn't", "weren't", "won't", "wouldn't", "can't", "cannot", "couldn't", "shouldn't", "never", "no", "nothing", "nobody", "nowhere", "neither", "nor", "hardly", "barely", "scarcely"]
NEGATION_ZH = "[不没无未别非莫]"
WEIGHTS = {"accuracy": 0.40, "fluency": 0.30, "consistency": 0.15, "compression": 0.15}

SCHEMAS = {
    "translate": "ARRAY<STRUCT<batch_index INT, unit_id STRING, text STRING>>",
    "merge_review": "ARRAY<STRUCT<batch_index INT, merge_with_next BOOLEAN>>",
    "evaluate": "ARRAY<STRUCT<unit_id STRING, accuracy DOUBLE, fluency DOUBLE, consistency DOUBLE, compression DOUBLE, issues ARRAY<STRING>, suggestion STRING>>",
    "refine": "ARRAY<STRUCT<unit_id STRING, text STRING>>",
    "annotate": "ARRAY<STRUCT<unit_id STRING, annotation STRING>>",
    "correct": "ARRAY<STRUCT<index INT, words ARRAY<STRING>>>",
    "punctuate": "ARRAY<STRUCT<index INT, text STRING>>",
    "split": "STRUCT<results ARRAY<STRUCT<id STRING, parts ARRAY<STRING>>>>",
    "qc": "STRUCT<issues ARRAY<STRUCT<severity STRING, category STRING, rule STRING, cue_id INT, time STRING, detail STRING, fix STRING>>>",
}


class Responder(Protocol):
    def reply(self, prompts: DataFrame) -> DataFrame:
        """``prompts`` with a column ``reply``."""


class ReplayResponder:
    """Answers from a table of (key columns, reply); a prompt without an answer gets null."""

    def __init__(self, replies: DataFrame, keys: list[str]) -> None:
        self.replies, self.keys = replies, keys

    def reply(self, prompts: DataFrame) -> DataFrame:
        return prompts.join(self.replies.select(*self.keys, "reply"), self.keys, "left")


def payload(rows: DataFrame, keys: list[str], order: str, item: Column) -> DataFrame:
    """(keys, payload): each batch's items as a JSON list, in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("i")))), lambda x: x["i"])
    return rows.groupBy(*keys).agg(F.to_json(listed).alias("payload"))


def items(replies: DataFrame, stage: str, keys: list[str]) -> DataFrame:
    """One row for each item of the stage's replies; replies that don't parse give none."""
    parsed = lenient_json(F.col("reply"), SCHEMAS[stage])
    if stage in ("split", "qc"):
        parsed = parsed["results" if stage == "split" else "issues"]
    return replies.select(*keys, F.explode(parsed).alias("x")).select(*keys, "x.*")


def resolve(wanted: DataFrame, answered: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted rows with their text and state: ok, missing (no or blank text) or duplicate."""
    once = answered.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("text"))
    x = wanted.join(once, keys, "left")
    state = F.when(F.col("n") > 1, "duplicate").when(F.coalesce(T.strip(F.col("text")), F.lit("")) == "", "missing").otherwise("ok")
    return x.select(*wanted.columns, F.when(state == "ok", F.col("text")).alias("text"), state.alias("state"))


def merge_flags(segments: DataFrame, flags: DataFrame, far_ms: int = 800) -> DataFrame:
    """Flags that survive: the text must not close a sentence, nor end 800 ms or more before the next
    unless it is left hanging (a comma or a conjunction at its end)."""
    following = F.lead("start_ms").over(Window.partitionBy("media_id").orderBy("seq"))
    x = segments.withColumn("gap", following - F.col("end_ms")).join(flags, ["media_id", "seq"], "left")
    closes = T.ends_sentence(F.col("text"))
    hanging = T.strip(F.lower("text")).rlike(r"(,|，|、|\b(and|but|or|because|that|which|of|to|the))$")
    keep = F.coalesce("flag", F.lit(False)) & ~closes & (F.col("gap").isNull() | (F.col("gap") < far_ms) | hanging)
    return x.select("media_id", "seq", keep.alias("merge"))


def merge_budget(units: DataFrame, share: int = 24) -> DataFrame:
    """How many merges a media's review may ask for: one in 24, at least one."""
    return units.groupBy("media_id").agg(F.greatest(F.lit(1).cast("long"), F.ceil(F.count(F.lit(1)) / share)).alias("budget"))


def overall(scores: DataFrame) -> DataFrame:
    """Scores between 0 and 1 (absent: 0.5) with their weighted mean."""
    part = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.5))))
    x = scores.withColumns({c: part(F.col(c)) for c in WEIGHTS})
    return x.withColumn("overall", sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0)))


def new_issues(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Issues that no existing one has by rule and cue, once each, marked as the model's."""
    own = found.withColumn("n", F.row_number().over(Window.partitionBy("rule", "cue_id").orderBy("detail"))).where("n = 1").drop("n")
    e = existing.select(F.col("rule").alias("e_rule"), F.col("cue_id").alias("e_cue")).distinct()
    left = own.join(e, (F.col("rule") == F.col("e_rule")) & F.col("cue_id").eqNullSafe(F.col("e_cue")), "left_anti")
    return left.withColumn("detail", F.concat(F.lit("[LLM] "), "detail"))


def negation_loss(pairs: DataFrame) -> DataFrame:
    """Pairs whose source negates while the target has no word that does."""
    words = F.regexp_extract_all(F.lower("l_text"), F.lit("[a-z']+"), 0)
    negated = F.size(F.array_intersect(words, F.array(*map(F.lit, NEGATION_WORDS)))) > 0
    return pairs.where(negated & ~F.col("r_text").rlike(NEGATION_ZH)).select("media_id", "l_cue_no", "r_cue_no")


def covered_windows(targets: DataFrame, units: DataFrame, slack_ms: int = 50) -> DataFrame:
    """Targets that start before or end after the units that they cover (their own and those merged
    into them): (media_id, cue_no, early, late)."""
    x = targets.withColumn("unit_id", F.explode(F.array_distinct(F.concat(F.array("unit_id"), F.coalesce("merged_from", F.array().cast("array<string>"))))))
    x = x.join(units.select("media_id", "unit_id", F.col("start_ms").alias("u_start"), F.col("end_ms").alias("u_end")), ["media_id", "unit_id"])
    x = x.groupBy("media_id", "cue_no", "start_ms", "end_ms").agg(F.min("u_start").alias("s"), F.max("u_end").alias("e"))
    x = x.select("media_id", "cue_no", (F.col("start_ms") < F.col("s") - slack_ms).alias("early"), (F.col("end_ms") > F.col("e") + slack_ms).alias("late"))
    return x.where("early OR late")


def shot_boundaries(cues: DataFrame, cuts: DataFrame) -> DataFrame:
    """Cues across a cut that a neighbour leaves free: (media_id, lang, cue_no, cut_ms), the first such cut."""
    from cueloom.operators.intervals import point_join

    over = Window.partitionBy("media_id", "lang").orderBy("cue_no")
    x = cues.withColumns({"p": F.lag("end_ms").over(over), "n": F.lead("start_ms").over(over)})
    x = point_join(cuts, "cut_ms", x, ["media_id"]).where((F.col("cut_ms") > F.col("start_ms")) & (F.col("cut_ms") < F.col("end_ms")) & ((F.col("p") <= F.col("cut_ms")) | (F.col("n") >= F.col("cut_ms"))))
    return x.groupBy("media_id", "lang", "cue_no").agg(F.min("cut_ms").alias("cut_ms"))


def split_long(segments: DataFrame, most_ms: int = 5000) -> DataFrame:
    """Segments longer than the limit in equal parts of time and characters; blank parts go."""
    dur = F.col("end_ms") - F.col("start_ms")
    n = F.when(dur <= most_ms, F.lit(1).cast("long")).otherwise(F.greatest(F.lit(2).cast("long"), F.floor(dur / most_ms) + 1))
    x = segments.withColumn("dur", dur).withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    each = F.greatest(F.lit(1).cast("long"), F.floor(F.length("text") / F.col("n")))
    from_char = (F.col("i") * each + 1).cast("int")
    size = F.when(F.col("i") == F.col("n") - 1, F.length("text")).otherwise(each).cast("int")
    part = F.when(F.col("n") == 1, F.col("text")).otherwise(T.strip(F.substring(F.col("text"), from_char, size)))
    at = lambda k: F.col("start_ms") + F.floor(F.col("dur") * k / F.col("n"))
    return x.select("media_id", "seq", "i", at(F.col("i")).alias("start_ms"), at(F.col("i") + 1).alias("end_ms"), part.alias("text")).where((F.col("text") != "") | (F.col("dur") <= most_ms))


def transcript_text(segments: DataFrame) -> DataFrame:
    """(media_id, text): a line for each segment, with its speaker."""
    line = F.struct("seq", F.concat(F.lit("["), F.upper("speaker"), F.lit("] "), "text").alias("t"))
    return segments.groupBy("media_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n").alias("text"))


def punctuated_enough(segments: DataFrame, least: float = 0.3) -> DataFrame:
    return segments.groupBy("media_id").agg((F.avg(T.ends_sentence(F.col("text")).cast("int")) >= least).alias("enough"))


def update_rows(rows: DataFrame, key: str, changes: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with the non-null values of ``changes`` by key, for tables that cannot be updated in place."""
    fresh = changes.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in columns))
    return rows.join(fresh, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*(f"_{c}" for c in columns))


def delete_rows(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")
