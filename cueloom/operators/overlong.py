"""Units that last too long, parted between whole words where it reads best.

What a boundary is worth by its words, and whether it may be one at all, are columns. Only the choice
among them, which depends on the parts so far, is a search over one unit's times: the best boundary by words,
lengths and durations parts a unit, and the parts likewise while they last longer than they may. A last part that
ends on a preposition goes back to the part before it, which is parted anew if it got too long, until nothing changes.
Scores are whole thousandths of a point, times whole milliseconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from cueloom.functions import text as T
from cueloom.operators import wordindex
from cueloom.operators.folds import SENTENCE_ENDS

# Words by how well a part starts before them, and what parts may not start or end on.
STRONG = "because but so where when while although though if unless until since whereas".split()
MEDIUM = "and or yet then which who that".split()
WEAK = "like now well okay ok".split()
PREPOSITIONS = "of in to for with on at from by about into through over under after before between during without within upon across along around behind beyond down off out up toward towards against among beside above below near inside outside".split()
ARTICLES = "a an the".split()
STRANDED = "be am is are was were been being isn't aren't wasn't weren't won't can't couldn't wouldn't shouldn't don't doesn't didn't haven't hasn't hadn't".split()
IDIOMS = (("so", "on"), ("thinking", "about"), ("afraid", "of"))
CLAUSE = ",;:，；：—–"
# Points of a boundary after a sentence, before a strong word, and so on.
AFTER_SENTENCE, BEFORE_STRONG, AFTER_CLAUSE, BEFORE_MEDIUM, BEFORE_WEAK, AFTER_STRONG, ELSE = 1000, 900, 760, 620, 420, 320, 100
# Hundredths of the longest duration that are tolerated; rounds of mending; the smallest good part.
SOFT, TAIL, ROUNDS, FEWEST, SHORTEST_MS = 115, 250, 8, 3, 1000


def _boundaries(words: DataFrame, keys: list[str]) -> DataFrame:
    """Words that are not blank, with the worth of the boundary before each (null where none may be), whether
    a part that ends on it has to go back, and, if so, whether only with the word before it."""
    over = Window.partitionBy(*keys).orderBy("word_no")
    x = words.select(*keys, "word_no", T.strip(F.col("text")).alias("text"), "start_ms", "end_ms").where("text <> ''").withColumn("norm", T.normalise_token(F.col("text")))
    x = x.withColumns({"prev_text": F.lag("text").over(over), "prev": F.lag("norm").over(over)})
    never = (F.col("prev") == "") | (F.col("norm") == "") | F.col("prev").isin(*PREPOSITIONS, *ARTICLES, *STRANDED) | F.col("norm").isin(*PREPOSITIONS)
    worth = (
        F.when(F.col("prev_text").rlike(f"[{SENTENCE_ENDS}]$"), AFTER_SENTENCE).when(F.col("prev_text").rlike(f"[{CLAUSE}]$"), AFTER_CLAUSE).when(F.col("norm").isin(*STRONG), BEFORE_STRONG)
        .when(F.col("norm").isin(*MEDIUM), BEFORE_MEDIUM).when(F.col("norm").isin(*WEAK), BEFORE_WEAK).when(F.col("prev").isin(*STRONG), AFTER_STRONG).otherwise(ELSE)
    )
    idiom = F.lit(False)
    for a, b in IDIOMS:
        idiom |= (F.col("prev") == a) & (F.col("norm") == b)
    return x.select(*keys, "word_no", "text", "norm", "start_ms", "end_ms", F.when(~never, worth).alias("worth"), F.col("norm").isin(*PREPOSITIONS).alias("dangles"), F.coalesce(idiom, F.lit(False)).alias("idiom"))


def _parts(start: list[int], end: list[int], worth: list[int | None], dangles: bool, idiom: bool, longest: int) -> list[int]:
    """The words that parts start with."""
    n, soft = len(start), longest * SOFT // 100
    span = lambda a, b: end[b - 1] - start[a]

    def best(a: int, b: int) -> int | None:
        whole = span(a, b)
        target = whole if 10 * whole <= 22 * longest else 2 * longest  # twice the duration wanted on the left

        def score(k: int) -> tuple[int, int]:
            sides = ((k - a, span(a, k)), (b - k, span(k, b)))
            most = max(d for _, d in sides)
            points = 180_000 if most <= longest else 80_000 if most <= soft else -120 * (most - soft)
            points -= 9 * abs(2 * sides[0][1] - target)
            points -= sum(180_000 * (count < FEWEST) + 120_000 * (d < SHORTEST_MS) for count, d in sides)
            return 1000 * worth[k] + points, -k

        return max((k for k in range(a + 1, b) if worth[k] is not None), key=score, default=None)

    def split(a: int, b: int, force: bool) -> list[int]:
        todo, out = [(a, b, force)], []
        while todo:
            x, y, must = todo.pop()
            k = best(x, y) if y - x > 1 and (must or span(x, y) > soft) else None
            if k is None:
                out.append(x)
            else:
                todo += [(k, y, False), (x, k, False)]
        return out

    goes_back = lambda cuts: len(cuts) > 1 and dangles and not (idiom and n - cuts[-1] > 1)
    cuts = split(0, n, True)
    for _ in range(ROUNDS):
        now = cuts[:-1] if goes_back(cuts) else cuts
        if n - now[-1] > 1 and span(now[-1], n) > soft:
            now = now[:-1] + split(now[-1], n, False)
        if now == cuts:
            break
        cuts = now
    if goes_back(cuts) and 100 * span(cuts[-2], n) <= TAIL * longest:
        cuts = cuts[:-1]
    return cuts


def split_overlong(words: DataFrame, keys: list[str], longest: int = 7000) -> DataFrame:
    """(keys, part, first_word, last_word, start_ms, end_ms) of the parts of each unit, counted from 1.

    A unit that lasts no longer than ``longest`` is one part. Blank words belong to no part; a unit of blank
    words has none. Numbers of words repeat in no unit.
    """
    def parts_of(number: list[int], start: list[int], end: list[int], worth: list[int | None], dangles: bool, idiom: bool) -> Iterator[tuple]:
        cuts = [0] if end[-1] - start[0] <= longest else _parts(start, end, worth, dangles, idiom, longest)
        for part, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(number)], strict=True), 1):
            yield part, number[a], number[b - 1], start[a], end[b - 1]

    kinds = ArrayType(StructType([StructField(c, LongType()) for c in ("part", "first_word", "last_word", "start_ms", "end_ms")]))

    # Units are many and short, so they come as rows, a batch at a time.
    @F.arrow_udf(kinds)
    def parted(number: pa.Array, start: pa.Array, end: pa.Array, worth: pa.Array, dangles: pa.Array, idiom: pa.Array) -> pa.Array:
        ends, rows = [0], []
        for unit in zip(*(c.to_pylist() for c in (number, start, end, worth, dangles, idiom)), strict=True):
            rows += parts_of(*unit)
            ends.append(len(rows))
        columns = zip(*rows, strict=True) if rows else [()] * 5
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], kinds.elementType.names))

    own = F.array_sort(F.collect_list(F.struct("word_no", "start_ms", "end_ms", "worth", "dangles", "idiom")))
    x = _boundaries(words, keys).groupBy(*keys).agg(own.alias("w"))
    last = F.element_at("w", -1)
    long = lambda c: F.col(f"w.{c}").cast("array<long>")
    return x.select(*keys, F.inline(parted(long("word_no"), long("start_ms"), long("end_ms"), long("worth"), last["dangles"], last["idiom"])))


def part_texts(parts: DataFrame, words: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """``parts`` with the text of each, cut out of the unit's own text (units: keys, text).

    A part starts at the token that its first word with a letter or digit matches, and words match tokens
    in order; so what the text has beyond the words is kept. Where the words are not all found so, or a
    part would lack one of its own, all parts of the unit are their words put together. A unit of one part
    keeps its text. A unit without text counts as one that is not found.
    """
    spoken = _boundaries(words, keys)
    mine = spoken.join(parts.select(*keys, "part", "first_word", "last_word"), keys).where(F.col("word_no").between(F.col("first_word"), F.col("last_word")))
    own = mine.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct("word_no", "text", "norm"))).alias("w"))
    own = own.select(*keys, "part", F.array_join("w.text", " ").alias("spoken"), F.filter("w.norm", lambda t: t != "").alias("tokens"))
    # The unit's tokens, with where they start, from 1.
    pieces = units.select(*keys, F.posexplode(F.regexp_extract_all("text", F.lit(r"(?U)\S+|\s+"), 0)).alias("place", "piece"))
    upto = Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumn("since", F.sum(F.length("piece")).over(upto) - F.length("piece") + 1).withColumn("norm", T.normalise_token(F.col("piece")))
    pieces = pieces.where(F.col("piece").rlike(r"(?U)^\S") & (F.col("norm") != ""))
    source = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "norm", "since"))).alias("t"))
    over = Window.partitionBy(*keys).orderBy("part")
    all_of = own.groupBy(*keys).agg(F.flatten(F.array_sort(F.collect_list(F.struct("part", "tokens")))["tokens"]).alias("wanted"), F.count(F.lit(1)).alias("n"))
    placed = all_of.join(source, keys, "left").join(units.select(*keys, F.col("text").alias("whole")), keys, "left")
    placed = placed.withColumn("places", wordindex.match_in_order("t.norm", "wanted"))
    x = own.join(placed.select(*keys, "n", "whole", "places", F.col("t.since").alias("since")), keys)
    x = x.withColumn("before", F.coalesce(F.sum(F.size("tokens")).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    begin = F.when(F.col("before") == 0, 1).otherwise(F.get("since", F.get("places", F.col("before"))))
    x = x.withColumn("begin", begin).withColumn("until", F.lead("begin").over(over))
    size: Column = F.coalesce("until", F.length("whole") + 1) - F.col("begin")
    x = x.withColumn("slice", T.strip(F.substring("whole", F.col("begin"), size)))
    held = F.transform(F.regexp_extract_all("slice", F.lit(r"(?U)\S+"), 0), T.normalise_token)
    good = F.col("places").isNotNull() & F.col("begin").isNotNull() & wordindex.contains_in_order(F.filter(held, lambda t: t != ""), F.col("tokens"))
    x = x.withColumn("good", F.min(F.coalesce(good, F.lit(False))).over(Window.partitionBy(*keys)))
    text = F.when(F.col("n") == 1, T.strip(F.coalesce("whole", "spoken"))).when(F.col("good"), F.col("slice")).otherwise(F.col("spoken"))
    return parts.join(x.select(*keys, "part", text.alias("text")), [*keys, "part"])
