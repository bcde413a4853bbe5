"""Quality control as one plan: rules over cues, and the summary."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from cueloom.config import QCConfig
from cueloom.functions import text as T
from cueloom.functions.similarity import seq_ratio
from cueloom.operators import lookup
from cueloom.operators.intervals import align_words, overlap_join
from cueloom.operators.islands import number_runs
from cueloom.rules import cue_rules  # noqa: F401  (fills the registry)
from cueloom.rules.registry import check

#: Rules of a report on single-language cues, in the order in which ties are reported.
REPORT_RULES = ["MaxLines", "ReadingSpeed", "MinDuration", "MaxDuration", "EmptyText", "Overlap", "GapFlash"]


def report(cues: DataFrame, config: QCConfig = QCConfig(), names: list[str] | None = None) -> DataFrame:
    """Issues by rule and severity, errors first."""
    counts = check(cues, config, names or REPORT_RULES).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.array_position(F.array(F.lit("error"), F.lit("warning"), F.lit("suggestion")), F.col("severity")), "rule")


def summary(cues: DataFrame, config: QCConfig = QCConfig(), names: list[str] | None = None) -> DataFrame:
    """One row: issues of each severity, and whether there is no error."""
    issues = check(cues, config, names or REPORT_RULES)
    of = lambda s: F.count_if(F.col("severity") == s)
    return issues.agg(of("error").alias("errors"), of("warning").alias("warnings"), of("suggestion").alias("suggestions"), (of("error") == 0).alias("passed"))


def fragment_runs(cues: DataFrame, least: int = 5) -> DataFrame:
    """Runs of English cues that end no sentence: (media_id, cue_no of the first, n)."""
    x = cues.where("lang = 'en'").withColumn("ends", T.strip(F.col("text")).rlike("[.!?。？！…]$"))
    x = number_runs(x, ["media_id"], ["cue_no"], F.col("ends") | F.lag("ends").over(Window.partitionBy("media_id").orderBy("cue_no")), "run").where("NOT ends")
    return x.groupBy("media_id", "run").agg(F.min("cue_no").alias("cue_no"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("run")


def similar_neighbours(cues: DataFrame) -> DataFrame:
    """Neighbouring cues with the similarity of their texts: over .85 they are duplicates, in Chinese
    over .4 they overlap."""
    over = Window.partitionBy("media_id", "lang").orderBy("cue_no")
    x = cues.withColumn("a", T.strip(F.lag("text").over(over))).withColumn("b", T.strip(F.col("text")))
    x = x.where((F.length("a") >= 4) & (F.length("b") >= 4)).withColumn("ratio", seq_ratio("a", "b"))
    kind = F.when(F.col("ratio") > 0.85, "DuplicateTranslation").when((F.col("lang") == "zh") & (F.col("ratio") > 0.4) & (F.length("a") >= 6) & (F.length("b") >= 6), "OverlappingContent")
    return x.select("media_id", "lang", "cue_no", "ratio", kind.alias("rule")).where("rule IS NOT NULL")


# Rules on the words of a cue.


def _aligned(words: DataFrame, cues: DataFrame, config: QCConfig) -> DataFrame:
    return align_words(words, cues, config.alignment_tolerance)


def coverage(words: DataFrame, cues: DataFrame, config: QCConfig = QCConfig()) -> DataFrame:
    """Words, words without a cue, and whether enough of them are covered, for each media."""
    aligned = _aligned(words, cues, config).select("media_id", "word_no", F.lit(1).alias("hit"))
    found = words.select("media_id", "word_no").join(aligned, ["media_id", "word_no"], "left")
    out = found.groupBy("media_id").agg(F.count(F.lit(1)).alias("words"), F.count_if(F.col("hit").isNull()).alias("uncovered"))
    return out.withColumn("covered", 1 - F.col("uncovered") / F.greatest(F.col("words"), F.lit(1)) >= config.word_coverage_min)


def uncovered_words(words: DataFrame, cues: DataFrame, config: QCConfig = QCConfig()) -> DataFrame:
    return words.join(_aligned(words, cues, config).select("media_id", "word_no"), ["media_id", "word_no"], "left_anti").select("media_id", "word_no", "text")


def uncovered_report(words: DataFrame, cues: DataFrame, most: int = 30, config: QCConfig = QCConfig()) -> DataFrame:
    """The first uncovered words of a media, and a row that counts the others."""
    x = uncovered_words(words, cues, config).withColumn("n", F.row_number().over(Window.partitionBy("media_id").orderBy("word_no")))
    shown = x.where(F.col("n") <= most).select("media_id", F.col("n").cast("long").alias("n"), "text")
    more = x.where(F.col("n") > most).groupBy("media_id").agg(F.count(F.lit(1)).alias("more"))
    return shown.unionByName(more.select("media_id", F.lit(most + 1).cast("long").alias("n"), F.concat(F.lit("… "), F.col("more"), F.lit(" more")).alias("text")))


def word_measures(words: DataFrame, cues: DataFrame, config: QCConfig = QCConfig()) -> DataFrame:
    """A row for each cue with words: how entry, exit, speakers, gaps and confidence stand."""
    a = _aligned(words, cues, config)
    order = Window.partitionBy("media_id", "lang", "cue_no").orderBy("word_no")
    a = a.withColumn("k", F.row_number().over(order)).withColumn("gap", F.lead("w_start").over(order) - F.col("w_end"))
    inside = F.when(F.col("w_end") <= F.col("c_end"), F.col("w_end"))
    at = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    return a.groupBy("media_id", "lang", "cue_no", "c_start", "c_end").agg(
        F.count(F.lit(1)).alias("n_words"), at("w_start", 1).alias("first_start"), F.max("w_end").alias("last_end"), F.max(inside).alias("last_inside"),
        F.count_distinct("speaker").alias("speakers"), at("confidence", 1).alias("first_confidence"), F.max(F.when(F.col("k").between(2, 6), F.col("confidence"))).alias("next_confidence"),
        F.median(F.when(F.col("gap") > 0, F.col("gap"))).alias("median_gap"), F.count_if(F.col("gap") > 0).alias("gaps"), F.max("gap").alias("largest_gap"),
        at("gap", 1).alias("first_gap"), F.max(F.when(F.col("k") == 1, F.length("text"))).alias("first_length"), F.max(F.when(F.col("k") == 1, F.col("w_end") - F.col("w_start"))).alias("first_ms"),
    )


def entry_accuracy(m: DataFrame) -> DataFrame:
    off, zh = F.abs(F.col("c_start") - F.col("first_start")), F.col("lang") == "zh"
    severity = F.when(off > F.when(zh, 500).otherwise(300), "warning").when(off > F.when(zh, 300).otherwise(150), "suggestion")
    return m.select("media_id", "lang", "cue_no", off.alias("off_ms"), severity.alias("severity")).where("severity IS NOT NULL")


def entry_confidence(m: DataFrame) -> DataFrame:
    diff = F.round((F.col("next_confidence") - F.col("first_confidence")) * 100)
    hit = (F.col("first_confidence") < 0.4) & (F.col("next_confidence") >= 0.7) & (diff >= 30)
    stretched = (F.col("first_length") <= 5) & (F.col("first_ms") > 800)
    return m.where(hit).select("media_id", "lang", "cue_no", F.when((diff >= 50) | stretched | (F.col("first_gap") > 500), "warning").otherwise("suggestion").alias("severity"))


def exit_precision(m: DataFrame) -> DataFrame:
    padding = F.col("c_end") - F.col("last_inside")
    severity = F.when(padding > 1000, "error").when(padding < F.when(F.col("lang") == "zh", 80).otherwise(120), "suggestion")
    return m.select("media_id", "lang", "cue_no", padding.alias("padding_ms"), severity.alias("severity")).where("severity IS NOT NULL")


def reading_padding(m: DataFrame) -> DataFrame:
    padding = F.col("c_end") - F.col("last_inside")
    return m.where((padding < 150) | (padding > 1000)).select("media_id", "lang", "cue_no", padding.alias("padding_ms"))


def speaker_consistency(m: DataFrame) -> DataFrame:
    return m.where("speakers > 1").select("media_id", "lang", "cue_no", "speakers")


def padding_conflict(m: DataFrame) -> DataFrame:
    following = F.lead("first_start").over(Window.partitionBy("media_id", "lang").orderBy("cue_no"))
    x = m.withColumn("next_no", F.lead("cue_no").over(Window.partitionBy("media_id", "lang").orderBy("cue_no"))).withColumn("gap", following - F.col("last_end"))
    x = x.where((F.col("next_no") == F.col("cue_no") + 1) & (F.col("gap") > 0) & (F.col("gap") < 300) & (F.col("c_end") - F.col("last_end") > F.col("gap")))
    return x.select("media_id", "lang", "cue_no", F.col("gap").alias("gap_ms"))


def word_gap_anomaly(words: DataFrame, cues: DataFrame, config: QCConfig = QCConfig()) -> DataFrame:
    """Gaps of at least 200 ms that are over five times the median of the cue's positive gaps."""
    a = _aligned(words, cues, config)
    whole = Window.partitionBy("media_id", "lang", "cue_no")
    a = a.withColumn("gap", F.lead("w_start").over(whole.orderBy("word_no")) - F.col("w_end"))
    positive = F.when(F.col("gap") > 0, F.col("gap"))
    a = a.withColumns({"median": F.median(positive).over(whole), "n_words": F.count(F.lit(1)).over(whole), "positive": F.count(positive).over(whole)})
    return a.where((F.col("n_words") >= 3) & (F.col("positive") >= 2) & (F.col("median") >= 10) & (F.col("gap") >= 200) & (F.col("gap") > 5 * F.col("median"))).select("media_id", "lang", "cue_no", "word_no", F.col("gap").alias("gap_ms"))


# Rules on pairs of cues in two languages.


def pairs(cues: DataFrame, source: str = "en", more_than: int = 50) -> DataFrame:
    """Source cues with cues of other languages that overlap them by more than 50 ms."""
    return overlap_join(cues.where(F.col("lang") == source), cues.where(F.col("lang") != source), ["media_id"], more_than=more_than)


def orphans(cues: DataFrame, source: str = "en", more_than: int = 50) -> DataFrame:
    """Cues of either side without a partner."""
    met = pairs(cues, source, more_than)
    both = met.select("media_id", F.col("l_lang").alias("lang"), F.col("l_cue_no").alias("cue_no")).unionByName(met.select("media_id", F.col("r_lang").alias("lang"), F.col("r_cue_no").alias("cue_no")))
    return cues.join(both, ["media_id", "lang", "cue_no"], "left_anti").select("media_id", "lang", "cue_no")


def completeness(cues: DataFrame, source: str = "en") -> DataFrame:
    """Units of one side that the other lacks, by number."""
    own = lambda is_source: cues.where((F.col("lang") == source) if is_source else (F.col("lang") != source)).select("media_id", "cue_no")
    lacking = own(True).join(own(False), ["media_id", "cue_no"], "left_anti").withColumn("kind", F.lit("untranslated"))
    return lacking.unionByName(own(False).join(own(True), ["media_id", "cue_no"], "left_anti").withColumn("kind", F.lit("orphan")))


def visual_density(cues: DataFrame, source: str = "en", most: int = 18) -> DataFrame:
    """Pairs with more characters a second of overlap than can be read."""
    x = pairs(cues, source).withColumn("chars", T.chars(F.col("l_text")) + T.chars(F.col("r_text")))
    return x.where(F.col("chars") * 1000 > most * F.col("overlap_ms")).select("media_id", "l_cue_no", "r_cue_no", "chars", "overlap_ms")


def combined_speed(cues: DataFrame, config: QCConfig = QCConfig(), source: str = "en") -> DataFrame:
    """Pairs of which one side is too fast to read."""
    x = pairs(cues, source).withColumn("l_dur", F.col("l_end_ms") - F.col("l_start_ms")).withColumn("r_dur", F.col("r_end_ms") - F.col("r_start_ms"))
    slow = (T.chars(F.col("l_text")) * 1000 > config.cps_limit_en * F.col("l_dur")) | (T.cjk_count(F.col("r_text")) * 1000 > config.cps_limit * F.col("r_dur"))
    return x.where((F.col("l_dur") > 0) & (F.col("r_dur") > 0) & slow).select("media_id", "l_cue_no", "r_cue_no")


def line_balance(cues: DataFrame, source: str = "en") -> DataFrame:
    """Pairs whose numbers of lines differ by two (a suggestion) or more (an error)."""
    diff = F.abs(F.size(T.lines(F.col("l_text"))) - F.size(T.lines(F.col("r_text"))))
    x = pairs(cues, source).withColumn("diff", diff)
    return x.where("diff >= 2").select("media_id", "l_cue_no", "r_cue_no", F.when(F.col("diff") > 2, "error").otherwise("suggestion").alias("severity"))


def number_loss(cues: DataFrame, source: str = "en") -> DataFrame:
    """Pairs whose source has numbers that the target lacks."""
    numbers = F.array_distinct(F.regexp_extract_all("l_text", F.lit(r"\d+"), 0))
    x = pairs(cues, source).withColumn("lost", F.filter(numbers, lambda n: ~F.col("r_text").contains(n)))
    return x.where(F.size("lost") > 0).select("media_id", "l_cue_no", "r_cue_no", F.array_join(F.array_sort("lost"), ",").alias("lost"))


def terminology(cues: DataFrame, glossary: DataFrame, source: str = "en") -> DataFrame:
    """Glossary terms left in their own language, as substrings in any case with line breaks as spaces:
    the source term in other cues, the target term in source cues. Terms go to the cues, in parts of bounded
    size (``lookup``); empty terms are left out."""
    key = ["media_id", "lang", "cue_no"]
    # Texts of a repeated cue are put together by a mark that no text has, and no term may have.
    x = cues.withColumn("flat", F.lower(F.regexp_replace(F.col("text"), "\n", " "))).groupBy(*key).agg(F.array_join(F.collect_list("flat"), "\n").alias("flat"))
    of_source = F.coalesce(F.col("lang") != source, F.lit(False))

    def terms(name: str) -> list[Broadcast]:
        t = glossary.select(F.col(name).alias("term"), F.lower(name).alias("word")).where(~F.contains("word", F.lit("\n")) & (F.col("word") != ""))
        return lookup.parts_of(t.groupBy("word").agg(F.collect_set("term").alias("terms")), "terms")

    def found(parts: list[Broadcast], text: Column) -> Column:
        @F.arrow_udf(ArrayType(StringType()))
        def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in lookup.search((b.to_pylist() for b in batches), parts):
                yield pa.array([list({t for _, _, own in matches for t in own}) for _, matches in batch], pa.list_(pa.string()))

        return find(text)

    x = x.select(*key, found(terms("source"), F.when(of_source, F.col("flat"))).alias("a"), found(terms("target"), F.when(F.col("lang") == source, F.col("flat"))).alias("b"))
    return x.select(*key, F.explode(F.concat("a", "b")).alias("term"))


def shots(cues: DataFrame, cuts: DataFrame) -> DataFrame:
    """Cues that a cut (media_id, cut_ms) falls strictly inside of, with the first such cut."""
    from cueloom.operators.intervals import point_join

    x = point_join(cuts, "cut_ms", cues, ["media_id"]).where((F.col("cut_ms") > F.col("start_ms")) & (F.col("cut_ms") < F.col("end_ms")))
    return x.groupBy("media_id", "lang", "cue_no").agg(F.min("cut_ms").alias("cut_ms"))
