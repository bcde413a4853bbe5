"""Subtitle and transcript formats as DataFrame transformations.

Readers take files as rows (``spark.read.text(wholetext=True)`` or any column of contents) and
explode them; writers gather a key's cues into one text. Everything runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.functions import text as T
from cueloom.functions import timecode as C

TIMING = r"(?:\d+:)?\d{1,2}:\d{1,2}[.,]\d{1,3}"


def _plain(content: Column) -> Column:
    """Without byte order mark, with line feeds only."""
    return F.regexp_replace(F.regexp_replace(content, "^﻿", ""), "\r\n?", "\n")


def _blocks(df: DataFrame, content: str, keys: list[str]) -> DataFrame:
    parts = F.split(T.strip(_plain(F.col(content))), r"\n[ \t]*\n\s*")
    return df.select(*keys, F.posexplode(parts).alias("pos", "block"))


def _timed(blocks: DataFrame, keys: list[str], settings: bool) -> DataFrame:
    pattern = rf"(?m)^\s*({TIMING})\s*-->\s*({TIMING})[ \t]*(.*)$"
    body = F.regexp_extract("block", rf"(?s)-->[^\n]*\n(.*)$", 1)
    x = blocks.where(F.col("block").rlike(pattern)).withColumns({"start_ms": C.parse(F.regexp_extract("block", pattern, 1)), "end_ms": C.parse(F.regexp_extract("block", pattern, 2)), "text": T.strip(body)})
    if settings:
        x = x.withColumn("settings", T.strip(F.regexp_extract("block", pattern, 3)))
    return x.where("start_ms IS NOT NULL AND end_ms IS NOT NULL AND text <> ''").select(*keys, "pos", "start_ms", "end_ms", "text", *(["settings"] if settings else []))


def _numbered(x: DataFrame, keys: list[str]) -> DataFrame:
    """The number of a cue in its file, from 1."""
    from pyspark.sql import Window

    return x.withColumn("index", F.row_number().over(Window.partitionBy(*keys).orderBy("pos")).cast("long")).drop("pos")


def parse_srt(df: DataFrame, content: str, keys: list[str]) -> DataFrame:
    """(keys, index, start_ms, end_ms, text) of SRT files; blocks without a valid timing or text are skipped."""
    return _numbered(_timed(_blocks(df, content, keys), keys, False), keys)


def parse_vtt(df: DataFrame, content: str, keys: list[str]) -> DataFrame:
    """As ``parse_srt``, of WebVTT files, with the cues' settings."""
    return _numbered(_timed(_blocks(df, content, keys), keys, True), keys)


def parse_ass(df: DataFrame, content: str, keys: list[str]) -> DataFrame:
    """(keys, index, start_ms, end_ms, style, text) of the dialogue lines of ASS files."""
    rows = df.select(*keys, F.posexplode(F.split(_plain(F.col(content)), "\n")).alias("pos", "line")).where("line LIKE 'Dialogue:%'")
    fields = F.split(F.substring("line", 10, 1 << 30), ",", 10)
    text = T.strip(T.unescape_newlines(F.regexp_replace(F.get(fields, 9), r"\{[^}]*\}", "")))
    x = rows.select(*keys, "pos", C.parse(F.get(fields, 1)).alias("start_ms"), C.parse(F.get(fields, 2)).alias("end_ms"), T.strip(F.get(fields, 3)).alias("style"), text.alias("text"))
    return _numbered(x.where("start_ms IS NOT NULL AND end_ms IS NOT NULL"), keys)


def _gather(df: DataFrame, keys: list[str], entry: Column, order: list[str], separator: str) -> DataFrame:
    """One content for each key; entries in order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, entry.alias("entry"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["entry"]), separator).alias("content"))


def write_srt(cues: DataFrame, keys: list[str], order: tuple[str, ...] = ("cue_no",)) -> DataFrame:
    """(keys, content): SRT files with cues renumbered from 1."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    entry = F.concat(F.col("_n").cast("string"), F.lit("\n"), C.to_srt(F.col("start_ms")), F.lit(" --> "), C.to_srt(F.col("end_ms")), F.lit("\n"), T.unescape_newlines(F.col("text")), F.lit("\n"))
    return _gather(cues.withColumn("_n", n), keys, entry, ["_n"], "\n")


def write_vtt(cues: DataFrame, keys: list[str], order: tuple[str, ...] = ("cue_no",)) -> DataFrame:
    entry = F.concat(C.to_vtt(F.col("start_ms")), F.lit(" --> "), C.to_vtt(F.col("end_ms")), F.lit("\n"), T.unescape_newlines(F.col("text")), F.lit("\n"))
    return _gather(cues, keys, entry, list(order), "\n").withColumn("content", F.concat(F.lit("WEBVTT\n\n"), "content"))


def write_ass(cues: DataFrame, keys: list[str], style: str = "Default", order: tuple[str, ...] = ("cue_no",)) -> DataFrame:
    entry = F.concat(F.lit("Dialogue: 0,"), C.to_ass(F.col("start_ms")), F.lit(","), C.to_ass(F.col("end_ms")), F.lit(f",{style},,0,0,0,,"), F.replace("text", F.lit("\n"), F.lit("\\N")))
    head = "[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"
    return _gather(cues, keys, entry, list(order), "\n").withColumn("content", F.concat(F.lit(head), "content", F.lit("\n")))


def parse_transcript(df: DataFrame, content: str, keys: list[str], prefix: str) -> DataFrame:
    """(keys, word_no, text, start, end, confidence, speaker) of transcript JSON; a document of another
    format than ``prefix`` ends the query, a missing confidence is 0."""
    schema = "format STRING, words ARRAY<STRUCT<text STRING, start DOUBLE, end DOUBLE, confidence DOUBLE, speaker STRING>>"
    x = df.select(*keys, F.from_json(content, schema).alias("j"))
    words = F.when(F.col("j.format").startswith(prefix), F.col("j.words")).otherwise(F.raise_error(F.concat(F.lit("unknown transcript format: "), F.coalesce("j.format", F.lit("none")))))
    return x.select(*keys, F.posexplode(words).alias("p", "w")).select(*keys, (F.col("p") + 1).cast("long").alias("word_no"), "w.text", "w.start", "w.end", F.coalesce("w.confidence", F.lit(0.0)).alias("confidence"), "w.speaker")


def parse_cue_json(df: DataFrame, content: str, keys: list[str]) -> DataFrame:
    """(keys, index, cue_id, start, end, text, lang) of cue JSON, a list or an object with ``cues``."""
    item = "STRUCT<cue_id STRING, id STRING, start DOUBLE, end DOUBLE, text STRING, zh_text STRING, en_text STRING, lang STRING, language STRING>"
    listed = F.coalesce(F.from_json(content, f"ARRAY<{item}>"), F.from_json(content, f"STRUCT<cues ARRAY<{item}>>")["cues"])
    nested = F.from_json(content, f"STRUCT<cues ARRAY<{item}>>")["cues"]
    rows = df.select(*keys, F.posexplode(F.when(F.ltrim(F.col(content)).startswith("["), listed).otherwise(nested)).alias("p", "c"))
    return rows.select(*keys, (F.col("p") + 1).cast("long").alias("index"), F.coalesce("c.cue_id", "c.id").alias("cue_id"), "c.start", "c.end", F.coalesce("c.text", "c.zh_text", "c.en_text").alias("text"), F.coalesce("c.lang", "c.language").alias("lang"))


def parse_silences(lines: DataFrame, line: str, keys: list[str], order: str) -> DataFrame:
    """(keys, start, end, duration) of a silence-detection log, given line by line: each end with the start before it."""
    from pyspark.sql import Window

    number = lambda name: F.nullif(F.regexp_extract(line, rf"{name}:\s*(-?[\d.]+)", 1), F.lit("")).cast("double")
    x = lines.withColumns({"_s": number("silence_start"), "_e": number("silence_end")})
    start = F.last("_s", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("start", start).where("_e IS NOT NULL AND start IS NOT NULL").select(*keys, "start", F.col("_e").alias("end"), (F.col("_e") - F.col("start")).alias("duration"))


def lenient_json(text: Column, schema: str) -> Column:
    """The first object or list in a reply that may be fenced or commented; null if there is none."""
    opening, closing = ("[", "]") if schema.upper().startswith("ARRAY") else ("{", "}")
    found = F.regexp_extract(text, rf"(?s)\{opening}.*\{closing}", 0)
    return F.from_json(F.nullif(found, F.lit("")), schema)
