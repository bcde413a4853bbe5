"""Texts found again in the words they were made of: by their letters and digits, or token by token in order.

A unit's words are put together once, as lower-case letters and digits only; prefix sums say which of
them belong to which word. A text is then one substring search, whatever its spaces, marks and line ends.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

# How long a chunk is shown at least.
SHORTEST_MS = 800


def letters_and_digits(text: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]", "")


def _last_at(text: Column, part: Column) -> Column:
    """Where the last occurrence of a part starts, from 1; 0 if there is none."""
    back = F.instr(F.reverse(text), F.reverse(part))
    return F.when(back > 0, F.length(text) - back - F.length(part) + 2).otherwise(0)


def find_words(words: DataFrame, chunks: DataFrame, keys: list[str], cps: int) -> DataFrame:
    """The words that each chunk of a unit covers: (keys, chunk_no, first_word, last_word, n_words, start_ms, end_ms).

    ``words``: (keys, word_no, text, start_ms, end_ms), ``chunks``: (keys, chunk_no, lines, start_ms). The first
    occurrence of the whole chunk counts; without one, what lies between the first occurrence of its first
    line and the last one of its last line, if that starts later. Words of marks alone count where they
    stand between. A chunk lasts as long as its words and as its characters take to read, 800 ms at least;
    one that is not found, or has neither letter nor digit, has no words and starts where it says.
    Repeated chunk numbers each keep a row; null lines count as empty, null texts likewise.
    """
    w = words.select(*keys, "word_no", letters_and_digits(F.coalesce("text", F.lit(""))).alias("norm"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    upto = Window.partitionBy(*keys).orderBy("word_no", "s", "e", "norm").rowsBetween(Window.unboundedPreceding, 0)
    w = w.withColumn("end", F.sum(F.length("norm")).over(upto))
    units = w.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("word_no", "s", "e", "norm", "end"))).alias("w")).withColumns({"whole": F.array_join("w.norm", ""), "ends": F.col("w.end")})
    x = chunks.select(*keys, "chunk_no", F.transform(F.coalesce("lines", F.array().cast("array<string>")), lambda line: F.coalesce(line, F.lit(""))).alias("lines"), F.col("start_ms").alias("own_ms")).join(units, keys, "left")
    norm = lambda column: letters_and_digits(F.coalesce(column, F.lit("")))
    x = x.withColumns({"text": norm(F.array_join("lines", "")), "head": norm(F.get("lines", F.lit(0))), "tail": norm(F.try_element_at("lines", F.lit(-1))), "whole": F.coalesce("whole", F.lit(""))})
    x = x.withColumn("at", F.instr("whole", F.col("text")))
    first = F.when(F.col("head") == "", 1).otherwise(F.instr("whole", F.col("head")))
    last = F.when(F.col("tail") == "", F.length("whole") + 1).otherwise(_last_at(F.col("whole"), F.col("tail")))
    x = x.withColumns({"first": first, "last": last})
    between = (F.col("first") > 0) & (F.col("last") > F.col("first"))
    # Characters of the unit, from 1 and inclusive.
    x = x.withColumn("hit", F.when((F.col("text") != "") & (F.col("at") > 0), F.struct(F.col("at").alias("from"), (F.col("at") + F.length("text") - 1).alias("to"))).when((F.col("text") != "") & between, F.struct(F.col("first").alias("from"), (F.col("last") + F.length("tail") - 1).alias("to"))))
    # The first word that ends at or after a character holds it.
    holds = lambda at: F.size(F.filter("ends", lambda end: end < at))
    x = x.withColumns({"i": holds(F.col("hit.from")), "j": holds(F.col("hit.to"))})
    a, b = F.get("w", F.col("i")), F.get("w", F.col("j"))
    reading = F.greatest(F.floor(F.aggregate("lines", F.lit(0), lambda n, line: n + F.length(line)) * 1000 / cps).cast("long"), F.lit(SHORTEST_MS))
    found = F.col("hit").isNotNull()
    start = F.when(found, a["s"]).otherwise(F.col("own_ms"))
    end = F.when(found, F.greatest(b["e"], a["s"] + reading)).otherwise(F.col("own_ms") + reading)
    count = F.when(found, F.col("j") - F.col("i") + 1).otherwise(0)
    return x.select(*keys, "chunk_no", F.when(found, a["word_no"]).alias("first_word"), F.when(found, b["word_no"]).alias("last_word"), count.cast("int").alias("n_words"), start.alias("start_ms"), end.alias("end_ms"))


def contains_in_order(tokens: Column, wanted: Column) -> Column:
    """All of a sequence stands in another in this order, with anything between; never if it is empty or null."""
    cursor = F.aggregate(tokens, F.lit(0), lambda at, token: at + F.coalesce((F.get(wanted, at) == token).cast("int"), F.lit(0)))
    return F.coalesce((F.size(wanted) > 0) & (cursor == F.size(wanted)), F.lit(False))


@F.pandas_udf(ArrayType(IntegerType()))
def match_in_order(tokens: pd.Series, wanted: pd.Series) -> pd.Series:
    """Where each of a sequence stands in another (from 0), every one at its first place after the one before
    it; null if one has no such place, or either is null. One pass over both."""
    def match(line, words) -> list[int] | None:
        if line is None or words is None:
            return None
        out: list[int] = []
        places = iter(range(len(line)))
        for word in words:
            at = next((k for k in places if line[k] == word), None)
            if at is None:
                return None
            out.append(at)
        return out

    return pd.Series([match(*pair) for pair in zip(tokens, wanted, strict=True)], dtype=object)
