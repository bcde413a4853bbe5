"""Corrected words and restored punctuation, carried over to timed words by their differences."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from cueloom.operators.folds import bound, bounds, word_of

# How far numbers of words may differ, from how many words on, and what counts as punctuation.
MOST_MORE, LEAST_WORDS = 2, 4
PUNCTUATION = ",.?!:;，。？！、；："
MARKS = re.compile(f"[{PUNCTUATION}]")


def _spaced(old: str, new: str) -> str:
    """The new word with the old one's leading space."""
    return " " + new if old.startswith(" ") and new and not new.startswith(" ") else new


@F.pandas_udf(ArrayType(StringType()))
def aligned_words(old: pd.Series, new: pd.Series) -> pd.Series:
    """Words after correction, or null where the reply cannot be used."""
    def follow(was: list[str], now: list[str]) -> Iterator[str]:
        bare = lambda words: [w.strip().lower() for w in words]
        first = True
        for kind, a, b, c, d in SequenceMatcher(None, bare(was), bare(now)).get_opcodes():
            partners = [] if kind == "insert" else was[a:b]
            for k in range(b - a if kind == "equal" else d - c):
                if kind == "equal":
                    yield partners[k]
                elif k < len(partners):
                    yield _spaced(partners[k], now[c + k])
                else:
                    yield now[c + k] if first or now[c + k].startswith(" ") else " " + now[c + k]
                first = False

    def one(was, now) -> list[str] | None:
        if was is None or now is None:
            return None
        was, now = list(was), list(now)
        if len(was) == len(now):
            return list(map(_spaced, was, now))
        if abs(len(was) - len(now)) <= MOST_MORE and len(was) >= LEAST_WORDS:
            return list(follow(was, now))
        return None

    return pd.Series([one(*x) for x in zip(old, new, strict=True)])


def correct_words(words: DataFrame, replies: DataFrame) -> DataFrame:
    """Words after the replies (media_id, turn, tokens): (media_id, turn, k, text, start_ms, end_ms, confidence, speaker),
    k counting from 0.

    As many tokens as words replace them one by one, with their times. Up to two more or fewer, for turns of four words
    or more, are aligned by their differences and the times dealt out anew. Other replies, and turns
    without one, leave the words as they are.
    """
    key = ["media_id", "turn"]
    own = F.array_sort(F.collect_list(F.struct("word_no", "text", "start_ms", "end_ms", "confidence", "speaker")))
    x = words.groupBy(*key).agg(own.alias("w"), F.avg("confidence").alias("mean")).join(replies.select(*key, "tokens"), key, "left")
    # A turn's words stay in one row until they are done.
    x = x.select(*key, "w", "mean", aligned_words("w.text", "tokens").alias("texts")).withColumn("m", F.size(F.coalesce("texts", "w.text")).cast("long"))
    x = x.withColumns({"n": F.size("w").cast("long"), "b": bounds(F.col("w"))})

    def row(k: Column, text: Column, start: Column, end: Column, confidence: Column, speaker: Column) -> Column:
        return F.struct(k.cast("long").alias("k"), text.alias("text"), start.cast("double").alias("start_ms"), end.cast("double").alias("end_ms"), confidence.alias("confidence"), speaker.alias("speaker"))

    same = F.transform("w", lambda w, k: row(k, F.coalesce(F.get("texts", k), w["text"]), w["start_ms"], w["end_ms"], w["confidence"], w["speaker"]))
    b, n, m = F.col("b"), F.col("n"), F.col("m")
    other = F.transform("texts", lambda t, k: row(k, t, bound(b, k.cast("long"), n, m), bound(b, k.cast("long") + 1, n, m), F.col("mean"), F.get("w", word_of(k.cast("long"), n, m))["speaker"]))
    return x.select(*key, F.inline(F.when(n == m, same).otherwise(other)))


def _added_marks(plain: str, text: str) -> list[tuple[int, str]] | None:
    """Where the text has marks more (before which character of ``plain``), if it differs in nothing else; else null. One pass."""
    at = since = 0
    out: list[tuple[int, str]] = []
    for m in MARKS.finditer(text):
        size = m.start() - since
        if plain[at : at + size] != text[since : m.start()]:
            return None
        at, since = at + size, m.end()
        if plain[at : at + 1] == m.group():
            at += 1
        else:
            out.append((at, m.group()))
    return out if plain[at:] == text[since:] else None


def _marks_by_differences(plain: str, text: str) -> list[tuple[int, str]]:
    """Marks that the text has where it differs, which takes the square of its length."""
    opcodes = SequenceMatcher(lambda ch: ch in " \t", plain, text, autojunk=False).get_opcodes()
    return [(a, ch) for kind, a, _, c, d in opcodes if kind in ("insert", "replace") for ch in text[c:d] if ch in PUNCTUATION]


@F.pandas_udf(ArrayType(StringType()))
def punctuated_words(old: pd.Series, text: pd.Series) -> pd.Series:
    """Words, which carry the spaces before them, with the marks that the text has after them and they lack;
    nothing else of the text is taken. A text that has marks more and is otherwise the same is read along the words, so that none
    is lost; another one is compared by differences."""
    lower = lambda text: "".join(c.lower() if len(c.lower()) == 1 else c for c in text)

    def one(was, now) -> list[str] | None:
        if was is None or now is None:
            return None if was is None else list(was)
        was = list(was)
        plain = "".join(was)
        owner = [k for k, w in enumerate(was) for _ in w]
        marks: dict[int, str] = {}
        mine, other = lower(plain), lower(now)
        added = _added_marks(mine, other)
        for a, ch in _marks_by_differences(mine, other) if added is None else added:
            at = next((k for k in range(a - 1, -1, -1) if not plain[k].isspace()), None)
            if at is not None and ch not in marks.get(owner[at], ""):
                marks[owner[at]] = marks.get(owner[at], "") + ch
        for k, found in marks.items():
            bare = was[k].rstrip()
            space = was[k][len(bare) :]
            for ch in found:
                bare += "" if bare.endswith(ch) else ch
            was[k] = bare + space
        return was

    return pd.Series([one(*x) for x in zip(old, text, strict=True)])


def restore_punctuation(words: DataFrame, replies: DataFrame) -> DataFrame:
    """Words with the punctuation of the replies (media_id, turn, reply): (media_id, turn, word_no, text).
    Turns without a reply keep theirs."""
    key = ["media_id", "turn"]
    x = words.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("word_no", "text"))).alias("w")).join(replies.select(*key, "reply"), key, "left")
    x = x.withColumn("texts", punctuated_words("w.text", "reply"))
    return x.select(*key, F.inline(F.arrays_zip(F.col("w.word_no").alias("word_no"), F.col("texts").alias("text"))))
