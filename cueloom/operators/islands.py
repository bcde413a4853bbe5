"""Runs of consecutive rows: sessions by pauses, composed units and merge chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions import text as T


def number_runs(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str) -> DataFrame:
    """``df`` with the number of its run, from 1; a run starts at each row where ``starts`` is true."""
    over = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_new", F.when(F.row_number().over(over) == 1, 1).when(starts, 1).otherwise(0)).withColumn(name, F.sum("_new").over(over.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def gap_sessions(words: DataFrame, gap_ms: int = 500, keys: tuple[str, ...] = ("media_id",)) -> DataFrame:
    """Words with their session: a pause longer than ``gap_ms`` starts one."""
    over = Window.partitionBy(*keys).orderBy("word_no")
    pause = F.col("start_ms") - F.lag("end_ms").over(over)
    return number_runs(words.withColumn("pause", pause), list(keys), ["word_no"], F.col("pause") > gap_ms, "session").drop("pause")


def compose_units(segments: DataFrame, gap_ms: int = 3000, short: int = 3) -> DataFrame:
    """Segments joined into units: one continues the previous of the same speaker, after a gap of at most
    ``gap_ms``, if that is a fragment or if this has ``short`` words or fewer and ends no sentence."""
    over = Window.partitionBy("media_id").orderBy("seq")
    prev = lambda c: F.lag(c).over(over)
    x = segments.withColumn("whole", T.ends_sentence(F.col("text"))).withColumn("n_words", F.size(F.split(T.strip(F.col("text")), r"\s+")))
    x = x.withColumn("joins", (prev("speaker") == F.col("speaker")) & (F.col("start_ms") - prev("end_ms") <= gap_ms) & (~prev("whole") | ((F.col("n_words") <= short) & ~F.col("whole"))))
    x = number_runs(x, ["media_id"], ["seq"], ~F.col("joins"), "unit_no")
    return x.groupBy("media_id", "unit_no").agg(
        F.when(F.count(F.lit(1)) == 1, F.min_by("unit_id", "seq")).otherwise(F.concat(F.lit("m"), F.min_by("unit_id", "seq"), F.lit("_"), F.max_by("unit_id", "seq"))).alias("unit_id"),
        F.min("start_ms").alias("start_ms"), F.max_by("end_ms", "seq").alias("end_ms"), F.count(F.lit(1)).alias("n_segments"),
    )


def merge_chains(cues: DataFrame, merges: Column, max_duration: int) -> DataFrame:
    """Cues joined along ``merges`` (this cue with the next): each chain as one row unless it lasts
    longer than twice ``max_duration``, in which case its cues stay as they were."""
    over = Window.partitionBy("media_id", "lang").orderBy("cue_no")
    x = number_runs(cues.withColumn("_m", merges), ["media_id", "lang"], ["cue_no"], ~F.coalesce(F.lag("_m").over(over), F.lit(False)), "chain")
    whole = Window.partitionBy("media_id", "lang", "chain")
    span = F.max("end_ms").over(whole) - F.min("start_ms").over(whole)
    x = x.withColumn("apart", span > 2 * max_duration)
    return x.groupBy("media_id", "lang", "chain", F.when(F.col("apart"), F.col("cue_no")).otherwise(-1).alias("own")).agg(
        F.min("cue_no").alias("cue_no"), F.count(F.lit(1)).alias("n_cues"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
    ).drop("own", "chain")


def keep_later(cues: DataFrame, keys: tuple[str, ...] = ("media_id", "lang"), slack_ms: int = 1) -> DataFrame:
    """Cues without those that run into the next one by more than the slack: the later is kept."""
    following = F.lead("start_ms").over(Window.partitionBy(*keys).orderBy("start_ms", "cue_no"))
    return cues.withColumn("_n", following).where(F.col("_n").isNull() | (F.col("end_ms") <= F.col("_n") + slack_ms)).drop("_n")


def first_of_term(rows: DataFrame, term: Column, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The first row of each term."""
    over = Window.partitionBy(*keys, "_t").orderBy(*order)
    return rows.withColumn("_t", F.lower(term)).withColumn("_n", F.row_number().over(over)).where("_n = 1").drop("_t", "_n")
