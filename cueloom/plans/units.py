"""Units, their words and their cues: attaching, matching and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.operators.intervals import point_join


def source_cues(segments: DataFrame, lang: str) -> DataFrame:
    """Segments as cues in the source language, numbered src_0000 and up within their media."""
    n = F.row_number().over(Window.partitionBy("media_id").orderBy("seq")) - 1
    return segments.select("media_id", F.concat(F.lit("src_"), F.lpad(n.cast("string"), 4, "0")).alias("cue_id"), "unit_id", "start_ms", "end_ms", "text", F.lit(lang).alias("lang"), "speaker")


def slice_words(words: DataFrame, units: DataFrame, tolerance: int = 50) -> DataFrame:
    """Each unit's words, as (media_id, unit_id, n_words, from_word, to_word, whole): those that lie within
    it, give or take the tolerance, or all of its media's, if none does (whole). A media without words
    gives none. All words are told by their bounds, not listed for each unit."""
    own = units.select("media_id", "unit_id", (F.col("start_ms") - tolerance).alias("from_ms"), (F.col("end_ms") + tolerance).alias("to_ms"))
    w = words.select("media_id", "word_no", F.col("start_ms").alias("w_start"), F.col("end_ms").alias("w_end"))
    inside = point_join(w, "w_start", own, ["media_id"], "from_ms", "to_ms").where("w_end <= to_ms")
    bounds = [F.count(F.lit(1)).alias("n_words"), F.min("word_no").alias("from_word"), F.max("word_no").alias("to_word")]
    found = inside.groupBy("media_id", "unit_id").agg(*bounds)
    every = w.groupBy("media_id").agg(*(b for b in bounds)).withColumnsRenamed({c: f"all_{c}" for c in ("n_words", "from_word", "to_word")})
    x = own.select("media_id", "unit_id").join(found, ["media_id", "unit_id"], "left").join(every, "media_id", "left")
    pick = lambda c, default: F.coalesce(c, f"all_{c}", F.lit(default)).alias(c)
    return x.select("media_id", "unit_id", pick("n_words", 0), pick("from_word", None), pick("to_word", None), F.col("n_words").isNull().alias("whole"))


def chain(cues: DataFrame) -> DataFrame:
    """A cue's units in order: its own, then those merged into it (merged_from, may be null)."""
    units = F.concat(F.array("unit_id"), F.coalesce("merged_from", F.array().cast("array<string>")))
    return cues.select("media_id", "cue_no", F.posexplode(units).alias("place", "unit_id"))


def attach_words(cues: DataFrame, words: DataFrame) -> DataFrame:
    """(media_id, cue_no, texts) of cues whose units have words (media_id, unit_id, word_no, text): the
    words of the whole chain, unit after unit."""
    x = chain(cues).join(words.select("media_id", "unit_id", "word_no", "text"), ["media_id", "unit_id"])
    ordered = F.array_sort(F.collect_list(F.struct("place", "word_no", "text")))
    return x.groupBy("media_id", "cue_no").agg(ordered.alias("w")).select("media_id", "cue_no", F.col("w.text").alias("texts"))


def matched_by_units(targets: DataFrame, words: DataFrame) -> DataFrame:
    """(media_id, cue_no, source_text) of every target cue: the source's words of its chain, each unit's
    joined and the units' with a space between; null where no unit of it has any."""
    x = chain(targets).join(words.groupBy("media_id", "unit_id").agg(F.array_sort(F.collect_list(F.struct("word_no", "text"))).alias("w")), ["media_id", "unit_id"])
    x = x.withColumn("own", F.trim(F.array_join("w.text", "")))
    met = x.where("own <> ''").groupBy("media_id", "cue_no").agg(F.array_sort(F.collect_list(F.struct("place", "own"))).alias("u"))
    return targets.select("media_id", "cue_no").join(met, ["media_id", "cue_no"], "left").select("media_id", "cue_no", F.array_join("u.own", " ").alias("source_text"))


def unresolved(targets: DataFrame, words: DataFrame) -> DataFrame:
    """Target cues that their units give no source text; what is left for matching by overlap."""
    return targets.join(matched_by_units(targets, words).where("source_text IS NULL"), ["media_id", "cue_no"], "left_semi")


def timestamp_mismatches(cues: DataFrame, segments: DataFrame, tolerance: int = 3000) -> DataFrame:
    """Units whose cue starts further from their segment than the tolerance."""
    s = segments.select("media_id", "unit_id", F.col("start_ms").alias("segment_ms"))
    off = F.abs(F.col("start_ms") - F.col("segment_ms"))
    return cues.join(s, ["media_id", "unit_id"]).where(off > tolerance).select("media_id", "unit_id", off.alias("off_ms")).distinct()


def within_part(start: Column, local: Column, epsilon: int = 500, margin: int = 12_000) -> Column:
    """Whether a cue of a part counts: between the part's split points, or, where those are not known,
    not in the margin that parts share. Columns part, parts, split_from, split_to and part_ms say which."""
    first, last = F.col("part") == 0, F.col("part") == F.col("parts") - 1
    known = F.col("split_from").isNotNull() & F.col("split_to").isNotNull()
    split = (first | (start >= F.col("split_from") - epsilon)) & (last | (start <= F.col("split_to") + epsilon))
    return F.when(known, split).otherwise((first | (local >= margin)) & (last | (local <= F.col("part_ms") - margin)))


def merge_parts(cues: DataFrame, parts: DataFrame) -> DataFrame:
    """Cues (media_id, part, start_ms, end_ms, text) of overlapping parts on one time line, each once.

    parts: (media_id, part, parts, offset_ms, part_ms, split_from, split_to), few rows for a media. Cues past
    their part's bounds go, as do those that end before they start.
    """
    x = cues.join(parts, ["media_id", "part"])
    start, end = F.col("start_ms") + F.col("offset_ms"), F.col("end_ms") + F.col("offset_ms")
    x = x.where(within_part(start, F.col("start_ms")) & (end >= start))
    return x.select("media_id", start.alias("start_ms"), end.alias("end_ms"), "text").distinct()


def split_bilingual(text: Column, marker: str = "<<EN>>") -> tuple[Column, Column]:
    """The target and the source text of a bilingual cue: by the marker line, else by an empty line, else the
    last line if it is mostly Latin. A source part that is not mostly Latin belongs to the target."""
    def latin(t: Column) -> Column:
        bare = F.regexp_replace(t, r"\s", "")
        return (F.length(bare) > 0) & (2 * F.regexp_count(bare, F.lit("[A-Za-z]")) >= F.length(bare))

    trim = lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")
    by = lambda sep: (trim(F.substring_index(text, sep, 1)), trim(F.substring(text, F.locate(sep, text) + len(sep), F.length(text))))
    marked, blank = f"\n{marker}\n", "\n\n"
    last = trim(F.substring_index(text, "\n", -1))
    tail = F.contains(text, F.lit("\n")) & latin(last)
    rest = trim(F.substring(text, F.lit(1), F.greatest(F.length(text) - F.length(F.substring_index(text, "\n", -1)) - 1, F.lit(0))))
    one = F.when(F.contains(text, F.lit(marked)), by(marked)[0]).when(F.contains(text, F.lit(blank)), by(blank)[0]).when(tail, rest).otherwise(trim(text))
    two = F.when(F.contains(text, F.lit(marked)), by(marked)[1]).when(F.contains(text, F.lit(blank)), by(blank)[1]).when(tail, last).otherwise(F.lit(""))
    back = (two != "") & ~latin(two)
    return F.when(back, F.concat_ws("\n", F.nullif(one, F.lit("")), two)).otherwise(one), F.when(back, F.lit("")).otherwise(two)


def mean_confidence(words: DataFrame, changed: DataFrame) -> DataFrame:
    """Of each turn, the mean confidence of its words and how many of them a correction (media_id, word_no,
    text) changed."""
    c = changed.select("media_id", "word_no", F.col("text").alias("new"))
    x = words.join(c, ["media_id", "word_no"], "left")
    return x.groupBy("media_id", "turn").agg(F.avg("confidence").alias("confidence"), F.count_if(F.col("new") != F.col("text")).alias("changed"))


def correction_log(words: DataFrame, changed: DataFrame) -> DataFrame:
    """Every word with the text before and after a correction and whether they differ."""
    c = changed.select("media_id", "word_no", F.col("text").alias("after"))
    x = words.select("media_id", "word_no", F.col("text").alias("before")).join(c, ["media_id", "word_no"], "left")
    return x.select("media_id", "word_no", "before", F.coalesce("after", "before").alias("after"), F.coalesce(F.col("after") != F.col("before"), F.lit(False)).alias("changed"))


def compose_json(units: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON object for each media: its units in order of their start."""
    item = F.struct("start_ms", "unit_id", "end_ms", "text", "speaker")
    return units.groupBy(*keys).agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("units"))).alias("content"))


def read_compose_json(files: DataFrame, content: str, keys: list[str]) -> DataFrame:
    schema = "units array<struct<unit_id string, start_ms long, end_ms long, text string, speaker string>>"
    return files.select(*keys, F.inline(F.from_json(content, schema)["units"]))


def raw_cues_json(cues: DataFrame) -> DataFrame:
    """A JSON object for each cue; null fields, and an empty merged_from, are left out."""
    merged = F.when(F.size("merged_from") > 0, F.col("merged_from"))
    return cues.select("media_id", "cue_no", F.to_json(F.struct("unit_id", "start_ms", "end_ms", "text", "speaker", merged.alias("merged_from"))).alias("json"))
