"""Subtitle files of several formats read together, each by its extension."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.functions import text as T
from cueloom.sources import subtitles

SUFFIXES = ("srt", "vtt", "ass", "ssa", "json")


def load_mixed(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, lang, index, cue_id, start_ms, end_ms, text, cue_lang) of files given as rows.

    ``spark.read.text(folder, wholetext=True)`` with ``_metadata.file_path`` gives such rows. A file of
    another extension ends the query. A cue is Chinese if it has a Chinese character, unless its file says what it
    is; a file is of the language that most of its cues are, English if there are as many. Files without
    cues have no rows; extensions are read in either case.
    """
    suffix = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    x = files.select(F.col(path).alias("path"), F.col(content).alias("content"), F.coalesce(suffix, F.lit("")).alias("suffix"))
    detected = F.when(F.col("text").rlike(T.HAN_BASIC), "zh").otherwise("en")
    none = F.lit(None).cast("string")

    def timed(parse, *of: str) -> DataFrame:
        return parse(x.where(F.col("suffix").isin(*of)), "content", ["path"]).select("path", "index", none.alias("cue_id"), "start_ms", "end_ms", "text", detected.alias("cue_lang"))

    listed = subtitles.parse_cue_json(x.where("suffix = 'json'"), "content", ["path"])
    ms = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)) * 1000).cast("long").alias(f"{c}_ms")
    listed = listed.select("path", "index", "cue_id", ms("start"), ms("end"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", detected).alias("cue_lang"))
    # Rows of no known format, which end the query when they are read.
    refused = F.raise_error(F.concat(F.lit("no subtitle format: "), F.coalesce("path", F.lit("null"))))
    unknown = x.where(~F.col("suffix").isin(*SUFFIXES)).select(refused.cast("string").alias("path"), F.lit(0).cast("long").alias("index"), none.alias("cue_id"), F.lit(0).cast("long").alias("start_ms"), F.lit(0).cast("long").alias("end_ms"), none.alias("text"), none.alias("cue_lang"))
    cues = reduce(DataFrame.unionByName, [unknown, timed(subtitles.parse_srt, "srt"), timed(subtitles.parse_vtt, "vtt"), timed(subtitles.parse_ass, "ass", "ssa"), listed])
    of = lambda lang: F.count_if(F.col("cue_lang") == lang)
    langs = cues.groupBy("path").agg(F.when(of("zh") > of("en"), "zh").otherwise("en").alias("lang"))
    # A file of many cues is one group of the join: its rows stay as they are where the languages are broadcast.
    return cues.join(langs, "path").select("path", "lang", "index", "cue_id", "start_ms", "end_ms", "text", "cue_lang")
