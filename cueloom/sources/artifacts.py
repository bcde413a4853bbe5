"""JSON artifacts of a pipeline run: recogniser output, key frames, checkpoints, cue and segment files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.functions import timecode as C

_TOKEN = "STRUCT<text STRING, word STRING, p DOUBLE, probability DOUBLE, t0 DOUBLE, start DOUBLE, end DOUBLE, offsets STRUCT<`from` LONG, `to` LONG>, timestamps STRUCT<`from` STRING, `to` STRING>>"
_SEGMENT = f"STRUCT<text STRING, tokens ARRAY<{_TOKEN}>, words ARRAY<{_TOKEN}>>"


def parse_recogniser_json(df: DataFrame, content: str, keys: list[str]) -> DataFrame:
    """(keys, word_no, text, start_ms, end_ms, confidence) of recogniser output, whichever of its lists
    it uses. Times come from offsets in ms, else from time codes, else from seconds; blank and
    ``[_…`` tokens are dropped."""
    j = F.from_json(content, f"STRUCT<transcription ARRAY<{_SEGMENT}>, segments ARRAY<{_SEGMENT}>, result ARRAY<{_SEGMENT}>>")
    x = df.select(*keys, j.alias("j"))
    x = x.select(*keys, F.posexplode(F.coalesce("j.transcription", "j.segments", "j.result")).alias("a", "s"))
    x = x.select(*keys, "a", F.posexplode(F.coalesce("s.tokens", "s.words")).alias("b", "t"))
    text = F.coalesce("t.text", "t.word")
    x = x.where((F.trim(text) != "") & ~F.trim(text).startswith("[_"))
    ms = lambda seconds: F.round(seconds * 1000).cast("long")
    start = F.coalesce(F.col("t.offsets.from"), C.parse(F.col("t.timestamps.from")), ms(F.coalesce("t.t0", "t.start")))
    end = F.coalesce(F.col("t.offsets.to"), C.parse(F.col("t.timestamps.to")), ms(F.col("t.end")))
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(*keys).orderBy("a", "b")).cast("long")
    return x.select(*keys, n.alias("word_no"), text.alias("text"), start.alias("start_ms"), end.alias("end_ms"), F.coalesce("t.p", "t.probability", F.lit(0.0)).alias("confidence"))


def parse_keyframes(lines: DataFrame, line: str, keys: list[str]) -> DataFrame:
    """(keys, key_ms) of packet lists, one ``time,flags`` a line; a flag with K marks a key frame."""
    time = F.regexp_extract(line, r"^([\d.]+),.*K", 1)
    return lines.select(*keys, time.alias("t")).where("t <> ''").select(*keys, F.round(F.col("t").cast("double") * 1000).cast("long").alias("key_ms")).distinct()


def load_partial(df: DataFrame, content: str, keys: list[str], fingerprint: Column) -> DataFrame:
    """(keys, unit_id, text) of checkpoints that were made for the same segments; others give nothing.
    A bare list, the older form, has no fingerprint and is taken as it is."""
    item = "STRUCT<unit_id STRING, text STRING>"
    listed = F.ltrim(F.col(content)).startswith("[")
    whole = F.from_json(content, f"STRUCT<segments_fingerprint STRING, cues ARRAY<{item}>>")
    cues = F.when(listed, F.from_json(content, f"ARRAY<{item}>")).when(whole["segments_fingerprint"] == fingerprint, whole["cues"])
    return df.select(*keys, F.explode(cues).alias("c")).select(*keys, "c.*")


def pending(segments: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Segments that no finished cue covers."""
    return segments.join(done.select(*keys).distinct(), keys, "left_anti")


def cue_json(cues: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, content): cues of a key as a JSON document, numbered from 1, with its speakers."""
    item = F.struct("cue_no", F.struct("start_ms", "end_ms", "text", "lang", "speaker").alias("c"))
    rows = F.transform(F.array_sort(F.collect_list(item)), lambda r, k: F.struct((k + 1).alias("id"), r["c"]["start_ms"].alias("start_ms"), r["c"]["end_ms"].alias("end_ms"), r["c"]["text"].alias("text"), r["c"]["lang"].alias("lang"), r["c"]["speaker"].alias("speaker")))
    x = cues.groupBy(*keys).agg(rows.alias("cues"), F.array_sort(F.collect_set("speaker")).alias("speakers"))
    return x.select(*keys, F.to_json(F.struct("speakers", "cues")).alias("content"))


def segment_summary(words: DataFrame, keys: list[str]) -> DataFrame:
    """Words of each segment counted, with its duration, first and last word and range of word numbers."""
    return words.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("word_count"), (F.max("end_ms") - F.min("start_ms")).alias("duration_ms"), F.min_by("text", "word_no").alias("first_word"), F.max_by("text", "word_no").alias("last_word"),
        F.min("word_no").alias("from_word"), F.max("word_no").alias("to_word"),
    )


def bilingual_ass(groups: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, content): dialogue lines of (target, source) texts on screen together; empty groups are skipped."""
    text = F.concat_ws("\\N", F.nullif(F.replace(F.coalesce("target", F.lit("")), F.lit("\n"), F.lit("\\N")), F.lit("")), F.concat(F.lit("{\\fs14}"), F.nullif(F.regexp_replace("source", "\\s+", " "), F.lit(""))))
    line = F.concat(F.lit("Dialogue: 0,"), C.to_ass(F.col("start_ms")), F.lit(","), C.to_ass(F.col("end_ms")), F.lit(",Default,,0,0,0,,"), text)
    rows = F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", line.alias("l"))))
    return groups.where(text != "").groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["l"]), "\n").alias("content"))


def bilingual_vtt(groups: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, content): numbered WebVTT cues of (target, source) texts on screen together, a line ``<<EN>>`` between
    the two; groups without either are skipped, and numbers go on without them. A source is one line."""
    from pyspark.sql import Window

    target = F.nullif(F.coalesce("target", F.lit("")), F.lit(""))
    source = F.nullif(F.trim(F.regexp_replace(F.coalesce("source", F.lit("")), r"\s+", " ")), F.lit(""))
    text = F.when(target.isNotNull() & source.isNotNull(), F.concat(target, F.lit("\n<<EN>>\n"), source)).otherwise(F.coalesce(target, source))
    x = groups.select(*keys, "start_ms", "end_ms", text.alias("text")).where("text IS NOT NULL")
    x = x.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("start_ms", "end_ms", "text")))
    entry = F.concat(F.col("k").cast("string"), F.lit("\n"), C.to_vtt(F.col("start_ms")), F.lit(" --> "), C.to_vtt(F.col("end_ms")), F.lit("\n"), F.col("text"), F.lit("\n\n"))
    rows = F.array_sort(F.collect_list(F.struct("k", entry.alias("e"))))
    return x.groupBy(*keys).agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(rows, lambda r: r["e"]), "")).alias("content"))
