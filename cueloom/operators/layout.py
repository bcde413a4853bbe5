"""Cues laid out for display: short ones join the cue before, and texts are broken into lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.functions import text as T
from cueloom.operators import hanlines, segmentation
from cueloom.operators.folds import break_line, fold

KEY = ["media_id", "lang", "cue_no"]


def _join_lines(lines: list[str], more: list[str], whole: str, sizes: list[int], most: int) -> list[str]:
    """Chinese lines with another cue's after them, broken again if one gets too long."""
    joined = [*lines[:-1], lines[-1] + more[0], *more[1:]] if lines and more else lines + more
    return hanlines.lay_out(whole, sizes, most) if max(map(len, joined), default=0) > most else joined


def layout(cues: DataFrame, dictionary: DataFrame, longest: int = 7000, most: int = 84, most_zh: int = 40, near_ms: int = 300) -> DataFrame:
    """(media_id, lang, cue_no, n_cues, start_ms, end_ms, text): cues with their lines.

    A cue that cannot stand alone joins the one before it, if it is near and both together last no
    longer than ``longest``. In Chinese that is a text of one character, of marks or of a short particle,
    or one that starts as what goes on; the joined text is broken again if a line gets too long. In other languages it is one of
    three words or fewer that ends no sentence, if both have less than ``most`` characters. Chinese cues without
    text are left out; a null text counts as empty. Lines of Chinese words follow the dictionary.
    """
    x = cues.select(*KEY, F.coalesce("text", F.lit("")).alias("text"), "start_ms", "end_ms")
    whole = F.when(F.col("lang") == "zh", hanlines.normalise(T.strip(F.col("text"))))
    bare = T.strip(F.regexp_replace("text", r"(?U)\s+", " "))
    few = F.size(F.split(bare, " ")) <= 3
    alone = F.when(F.col("lang") == "zh", hanlines.stands_alone(F.col("text"))).otherwise(~few | T.ends_sentence(bare))
    x = x.select(*KEY, "start_ms", "end_ms", alone.alias("alone"), whole.alias("whole_zh"), bare.alias("bare"))
    x = x.withColumn("steps", segmentation.steps_of(F.col("whole_zh"), dictionary))
    x = x.select(*KEY, "start_ms", "end_ms", "alone", F.coalesce("whole_zh", "bare").alias("whole"), "steps", (F.col("lang") == "zh").alias("zh"))

    def step(rows: pd.DataFrame) -> Iterator[tuple]:
        held: dict | None = None

        def done(h: dict) -> tuple:
            return h["no"], h["n"], h["start"], h["end"], "\n".join(h["lines"]) if h["zh"] else break_line(h["whole"])

        for no, start, end, alone, whole, steps, zh in rows[["cue_no", "start_ms", "end_ms", "alone", "whole", "steps", "zh"]].itertuples(index=False):
            sizes = [] if steps is None else list(steps)
            lines = hanlines.lay_out(whole, sizes, most_zh) if zh else []
            if zh and not lines:
                continue
            if held and not alone and 0 <= start - held["end"] <= near_ms and end - held["start"] <= longest and (zh or len(held["whole"]) + len(whole) < most):
                if zh:
                    held["lines"] = _join_lines(held["lines"], lines, held["whole"] + whole, held["sizes"] + sizes, most_zh)
                held |= {"n": held["n"] + 1, "end": end, "whole": held["whole"] + whole if zh else f"{held['whole']} {whole}".strip(), "sizes": held["sizes"] + sizes}
                continue
            if held:
                yield done(held)
            held = {"no": no, "n": 1, "start": start, "end": end, "whole": whole, "sizes": sizes, "lines": lines, "zh": zh}
        if held:
            yield done(held)

    return fold(x, ["media_id", "lang"], ["cue_no"], "cue_no long, n_cues long, start_ms long, end_ms long, text string", step)
