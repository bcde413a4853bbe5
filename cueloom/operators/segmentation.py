"""Words of text without spaces, by a dictionary, and the rules and repairs that need them.

The dictionary is a table (word, freq), which is sent to the texts (``lookup``). Runs of Han characters are cut into the words whose product of
frequencies is largest; of equal ones the longer first word wins. A character that no word holds counts
as seen once. Runs of Latin letters and digits are one word, every other character is its own.

Words that the dictionary lacks are guessed where a table of states is given: two or more characters in a row that
the dictionary leaves alone are cut by the likeliest states of a word's characters (B begins, M goes on, E ends,
S stands alone). The table (state, next, char, weight) holds what a first state weighs (next and char null), what a
state after another does (next), and what a character in a state does (char); ``word_states`` makes one out of a dictionary.
Weights are whole millionths, so that sums do not depend on their order.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from cueloom.functions import text as T
from cueloom.operators import lookup
from cueloom.operators.folds import CLAUSE_PUNCT, SENTENCE_ENDS, fold
from cueloom.rules.cue_rules import LETTERS, SAFE_ENGLISH

# Particles that start no line.
PARTICLES = "了着过吗呢吧啊么嘛呗"
HAN_FIRST, HAN_LAST = "一", "鿿"
MILLION = 1_000_000
# Which states stand before which, and the weight of what was never seen.
BEFORE = {"B": "ES", "M": "BM", "E": "BM", "S": "ES"}
NEVER = -(10**12)


def _best_sizes(text: str, found: Iterable[tuple[int, int, int]], alone: int) -> list[int]:
    """How long the first word of the likeliest cut of each suffix is, out of dictionary words (first, size, weight).
    Latin letters and digits in a row are one word. What follows a run weighs the same for all cuts of it."""
    own = [alone] * len(text)
    longer: list[list[tuple[int, int]] | None] = [None] * len(text)
    for first, size, weight in found:
        if size == 1:
            own[first] = weight
        elif longer[first] is None:
            longer[first] = [(size, weight)]
        else:
            longer[first].append((size, weight))
    best, sizes = [0] * (len(text) + 1), [1] * len(text)
    for at in range(len(text) - 1, -1, -1):
        most, length = own[at] + best[at + 1], 1
        for size, weight in longer[at] or ():
            whole = weight + best[at + size]
            if whole > most or (whole == most and size > length):
                most, length = whole, size
        best[at], sizes[at] = most, length
    for m in re.finditer("[A-Za-z0-9]+", text):
        sizes[m.start() : m.end()] = range(m.end() - m.start(), 0, -1)
    return sizes


def _words(text: str, sizes: list[int]) -> list[tuple[str, int]]:
    """The words of a text (word, first), by the length of the first word of each rest."""
    out, at = [], 0
    while at < len(text):
        out.append((text[at : at + sizes[at]], at))
        at += sizes[at]
    return out


def _likeliest_states(weights: list[dict[str, int]], first: dict[str, int], after: dict[tuple[str, str], int]) -> str:
    """The states of the likeliest path; of equal ones the later letter wins, from the end on."""
    best = {s: (first.get(s, NEVER) + weights[0].get(s, NEVER), s) for s in BEFORE}
    for own in weights[1:]:
        step = {}
        for s, froms in BEFORE.items():
            came = max(froms, key=lambda f: (best[f][0] + after.get((f, s), NEVER), f))
            step[s] = best[came][0] + after.get((came, s), NEVER) + own.get(s, NEVER), best[came][1] + s
        best = step
    return max(best["E"], best["S"], key=lambda b: (b[0], b[1][-1]))[1]


def _guess(text: str, words: list[tuple[str, int]], whole: set[tuple[int, int]], weights: dict[str, dict[str, int]], first: dict, after: dict) -> list[tuple[str, int]]:
    """Chinese characters in a row that stand alone and are no word together, as the words that their states tell."""
    out: list[tuple[str, int]] = []
    at = 0
    while at < len(words):
        until = at
        while until < len(words) and len(words[until][0]) == 1 and HAN_FIRST <= words[until][0] <= HAN_LAST:
            until += 1
        start, size = words[at][1], until - at
        if size < 2 or (start, size) in whole:
            until = max(until, at + 1)
            out += words[at:until]
        else:
            states, since = _likeliest_states([weights.get(c, {}) for c in text[start : start + size]], first, after), 0
            for k, state in enumerate(states):
                if state in "ES":
                    out.append((text[start + since : start + k + 1], start + since))
                    since = k + 1
        at = until
    return out


def _known(dictionary: DataFrame) -> tuple[list[Broadcast], int]:
    """The dictionary's Chinese words with their weights, in parts, and the weight of a character that no word holds.
    Other words, though they count, are in no run."""
    known = dictionary.where("word <> '' AND freq > 0").groupBy("word").agg(F.sum("freq").alias("freq"))
    total, alone = known.agg(F.coalesce(F.sum("freq"), F.lit(1)).alias("total")).select("total", _weight(F.lit(1.0), F.col("total")).alias("alone")).first()
    known = known.where(F.col("word").rlike(f"^{T.HAN_BASIC}+$"))
    return lookup.parts_of(known.select("word", _weight(F.col("freq"), F.lit(float(total))).alias("weight")), "weight"), alone


def _weight(seen: Column, total: Column) -> Column:
    return F.round(F.log(seen / total.cast("double")) * MILLION).cast("long")


def word_states(dictionary: DataFrame) -> DataFrame:
    """States out of the words of a dictionary (word, freq), each as often as it was seen: (state, next, char, weight).

    A word follows another as often as words are seen, so a state that starts one weighs the same at the start and
    after a word. Words that are empty, or hold anything but Han characters, are left out.
    """
    words = dictionary.where(F.col("word").rlike(f"^{T.HAN_BASIC}+$") & (F.col("freq") > 0)).select("freq", F.regexp_extract_all("word", F.lit("(?s)."), 0).alias("c"))
    n = F.size("c")
    state = F.when(n == 1, "S").when(F.col("p") == 0, "B").when(F.col("p") == n - 1, "E").otherwise("M")
    each = words.select("freq", "c", F.posexplode("c").alias("p", "char")).withColumn("state", state)
    following = F.when(F.col("state").isin("B", "M"), F.when(F.col("p") == n - 2, "E").otherwise("M"))
    each = each.select("freq", "char", "state", following.alias("next"))
    weight = lambda seen, of: F.round(F.log(seen.cast("double") / of) * MILLION).cast("long").alias("weight")
    of_state = each.groupBy("state").agg(F.sum("freq").alias("of"))
    chars = each.groupBy("state", "char").agg(F.sum("freq").alias("seen")).join(F.broadcast(of_state), "state").select("state", F.lit(None).cast("string").alias("next"), "char", weight(F.col("seen"), F.col("of")))
    inner = each.where("next IS NOT NULL").groupBy("state", "next").agg(F.sum("freq").alias("seen")).join(F.broadcast(of_state), "state").select("state", "next", F.lit(None).cast("string").alias("char"), weight(F.col("seen"), F.col("of")))
    starts = of_state.where("state IN ('B', 'S')").withColumn("all", F.sum("of").over(Window.partitionBy()))
    starts = starts.select(F.explode(F.array(F.lit(None).cast("string"), F.lit("E"), F.lit("S"))).alias("before"), "state", weight(F.col("of"), F.col("all")))
    starts = starts.select(F.coalesce("before", "state").alias("state"), F.when(F.col("before").isNotNull(), F.col("state")).alias("next"), F.lit(None).cast("string").alias("char"), "weight")
    return chars.unionByName(inner).unionByName(starts)


def _guessing(states: DataFrame) -> tuple[dict, dict, Broadcast]:
    """First states, pairs of states, and the states of Chinese characters with their weights: four, eight, and four
    for each of some 21,000 characters, whatever the table holds besides."""
    known = states.where(F.col("state").isin(*BEFORE) & F.coalesce(F.col("char").rlike(f"^{T.HAN_BASIC}$"), F.col("next").isNull() | F.col("next").isin(*BEFORE)))
    rows = known.groupBy(F.when(F.col("char").isNull(), F.col("next")).alias("next"), "state", "char").agg(F.max("weight").alias("weight")).collect()
    first, after, chars = {}, {}, {}
    for r in rows:
        if r.char is not None:
            chars.setdefault(r.char, {})[r.state] = r.weight
        elif r.next is None:
            first[r.state] = r.weight
        else:
            after[r.state, r.next] = r.weight
    return first, after, states.sparkSession.sparkContext.broadcast(chars)


def words_of(text: Column, dictionary: DataFrame, states: DataFrame | None = None) -> Column:
    """The words of each text, as an array of (word, first); null for a null text."""
    parts, alone = _known(dictionary)
    guess = None if states is None else _guessing(states)

    @F.arrow_udf(ArrayType(StructType().add("word", StringType()).add("first", IntegerType())))
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in lookup.search((b.to_pylist() for b in batches), parts):
            ends, words, firsts = [0], [], []
            none = []
            for whole, matches in batch:
                if whole and guess:
                    found = list(matches)
                    own = _guess(whole, _words(whole, _best_sizes(whole, found, alone)), {m[:2] for m in found}, guess[2].value, *guess[:2])
                else:
                    own = _words(whole, _best_sizes(whole, matches, alone)) if whole else []
                words += [w for w, _ in own]
                firsts += [at for _, at in own]
                ends.append(len(words))
                none.append(whole is None)
            items = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(firsts, pa.int32())], ["word", "first"])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items, mask=pa.array(none, pa.bool_()))

    return cut(text)


def segment(texts: DataFrame, keys: list[str], dictionary: DataFrame, text: str = "text", states: DataFrame | None = None) -> DataFrame:
    """Words of each text with their place: (keys, word, first), first counting characters from 0.

    Texts are dealt out once, and the dictionary goes to them in parts of bounded size (``lookup``). A null or empty text has no
    words; keys are expected to be distinct. Words of
    the dictionary that are empty or never seen are left out, and of repeated words the frequencies add up. With
    ``states`` unseen words are guessed; of repeated rows of that table the heaviest counts, and what it lacks
    is next to impossible.
    """
    return texts.select(*keys, text).repartition(*keys).select(*keys, F.explode(words_of(F.col(text), dictionary, states)).alias("w")).select(*keys, "w.word", "w.first")


def steps_of(text: Column, dictionary: DataFrame) -> Column:
    """For each character of a text, how long the word is that starts there if what stands before it is left
    out, as by a line's end; null for a null text."""
    parts, alone = _known(dictionary)

    @F.arrow_udf(ArrayType(IntegerType()))
    def steps(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in lookup.search((b.to_pylist() for b in batches), parts):
            yield pa.array([None if whole is None else _best_sizes(whole, matches, alone) for whole, matches in batch], pa.list_(pa.int32()))

    return steps(text)


def word_steps(texts: DataFrame, keys: list[str], dictionary: DataFrame, text: str = "text") -> DataFrame:
    """(keys, steps) of each text (``steps_of``). Texts without characters have no row."""
    return texts.select(*keys, text).repartition(*keys).select(*keys, steps_of(F.col(text), dictionary).alias("steps")).where(F.size("steps") > 0)


def _neighbours(cues: DataFrame) -> DataFrame:
    """Chinese cues with the stripped first line, and the number, text and stripped last line of the cue before."""
    return _with_neighbours(cues.where("lang = 'zh'"))


def _with_neighbours(cues: DataFrame) -> DataFrame:
    over = Window.partitionBy("media_id", "lang").orderBy("cue_no")
    x = cues.withColumns({"prev_no": F.lag("cue_no").over(over), "prev_text": F.lag("text").over(over)})
    return x.withColumns({"head": T.strip(F.get(T.lines(F.col("text")), 0)), "tail": T.strip(F.element_at(T.lines(F.col("prev_text")), -1))})


def split_words(cues: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Chinese words that a line or cue parts: (rule, media_id, lang, cue_no, sub_no, word), all errors.

    CompoundWords: a word of several Han characters over a line end (sub_no: its first character).
    ParticleLine: a line from the second on (sub_no, from 0) that starts with a particle of its own.
    ParticleCue and TokenAcrossCues: the same between a cue and the next, under the former's number; of the words over
    that border there is one. Nulls break nothing.
    """
    x = _neighbours(cues)
    lines = T.lines(F.col("text"))
    ints = lambda c: c.cast("array<int>")
    starts = lambda c: F.substring(c, 1, 1).isin(*PARTICLES)
    # Where lines end, in characters without line ends.
    ends = F.transform(F.sequence(F.lit(1), F.size(lines) - 1), lambda k: F.length(F.array_join(F.slice(lines, F.lit(1), k), "")))
    of = lambda rule, no, sub, breaks, text: F.struct(F.lit(rule).alias("rule"), no.cast("long").alias("cue_no"), sub.cast("int").alias("sub_no"), ints(breaks).alias("breaks"), text.alias("text"))
    none, zero, own = F.array(), F.lit(0), F.col("cue_no")
    whole = F.when(F.size(lines) > 1, F.array(of("CompoundWords", own, zero, ends, F.array_join(lines, ""))))
    later = F.transform(lines, lambda line, k: of("ParticleLine", own, k, none, F.when((k > 0) & starts(T.strip(line)), T.strip(line))))
    head = F.when(F.col("prev_no").isNotNull() & starts(F.col("head")), F.array(of("ParticleCue", F.col("prev_no"), zero, none, F.col("head"))))
    pair = F.when((F.col("tail") != "") & (F.col("head") != ""), F.array(of("TokenAcrossCues", F.col("prev_no"), zero, F.array(F.length("tail")), F.concat("tail", "head"))))
    all_of = F.concat(*(F.coalesce(c, F.array().cast("array<struct<rule:string,cue_no:bigint,sub_no:int,breaks:array<int>,text:string>>")) for c in (whole, later, head, pair)))
    texts = x.select("media_id", "lang", F.explode(all_of).alias("x")).select("media_id", "lang", "x.*").where("text IS NOT NULL")
    words = segment(texts, ["media_id", "lang", "rule", "cue_no", "sub_no", "breaks"], dictionary)
    last = F.col("first") + F.length("word")
    parted = (F.length("word") > 1) & F.exists("breaks", lambda b: (b > F.col("first")) & (b < last))
    compound = (F.col("rule") == "CompoundWords") & parted & F.col("word").rlike(f"^{T.HAN_BASIC}+$")
    alone = F.col("rule").startswith("Particle") & (F.col("first") == 0) & (F.length("word") == 1)
    found = words.where(compound | alone | ((F.col("rule") == "TokenAcrossCues") & parted))
    sub = F.when(F.col("rule") == "CompoundWords", F.col("first")).otherwise(F.col("sub_no"))
    return found.select("rule", "media_id", "lang", "cue_no", sub.alias("sub_no"), "word")


def english_across_cues(cues: DataFrame) -> DataFrame:
    """English words in Chinese cues that the border to the next cue parts: (media_id, lang, cue_no, word)."""
    x = _neighbours(cues)
    trail = F.regexp_extract(F.element_at(T.lines(F.col("prev_text")), -1), f"(?U)([{LETTERS}]{{3,}})\\s*$", 1)
    lead = F.regexp_extract(F.get(T.lines(F.col("text")), 0), f"(?U)^\\s*([{LETTERS}]+)", 1)
    x = x.withColumns({"trail": trail, "lead": lead}).where((F.col("trail") != "") & (F.col("lead") != "") & ~F.lower("trail").isin(*SAFE_ENGLISH))
    return x.select("media_id", "lang", F.col("prev_no").alias("cue_no"), F.concat("trail", "lead").alias("word"))


def mend_names(cues: DataFrame) -> DataFrame:
    """Cues where a short capitalised last line went to the next cue, if that starts with a capital:
    (media_id, lang, cue_no, text). A cue left without text holds a space."""
    def step(rows: pd.DataFrame) -> list[tuple]:
        out: list[tuple] = []
        for no, text in rows[["cue_no", "text"]].itertuples(index=False):
            text = text or ""
            if out:
                before = out[-1][1].split("\n")
                name, head = before[-1].strip(), text.split("\n")[0].strip()
                if 0 < len(name) <= 6 and name.isascii() and name[0].isupper() and name[-1] not in SENTENCE_ENDS + CLAUSE_PUNCT and head[:1].isupper():
                    out[-1] = (out[-1][0], "\n".join(line for line in before[:-1] if line.strip()) or " ")
                    text = "\n".join([f"{name} {head}", *text.split("\n")[1:]])
            out.append((no, text))
        return out

    return fold(cues.select("media_id", "lang", "cue_no", "text"), ["media_id", "lang"], ["cue_no"], "cue_no long, text string", step)


def mend_words(cues: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Chinese cues where the first part, of two characters or more, of a word parted by the border went to the
    next cue: (media_id, lang, cue_no, text). A part that would empty its line stays, and so do other
    languages' cues. Borders are read as they are in the input, not as a move before them left them."""
    over = Window.partitionBy("media_id", "lang").orderBy("cue_no")
    x = _with_neighbours(cues.select("media_id", "lang", "cue_no", "text"))
    whole = F.when((F.col("lang") == "zh") & (F.col("tail") != "") & (F.col("head") != ""), F.concat("tail", "head"))
    x = x.withColumns({"border": F.length("tail"), "words": words_of(whole, dictionary)}).drop("prev_no", "prev_text", "head", "tail")
    size = F.col("border") - F.col("w.first")
    # The one word over the border, if its first part may move.
    x = x.withColumn("w", F.get(F.filter("words", lambda w: (w["first"] < F.col("border")) & (w["first"] + F.length(w["word"]) > F.col("border"))), F.lit(0))).drop("words")
    x = x.withColumn("moved", F.when((size >= 2) & (F.col("w.first") > 0), F.substring("w.word", F.lit(1), size))).drop("w", "border")
    x = x.withColumn("gone", F.lead("moved").over(over))
    bare = F.regexp_replace("text", r"(?U)\s+$", "")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.regexp_replace(F.left(bare, F.length(bare) - F.length("gone")), r"(?U)\s+$", ""))
    return x.select("media_id", "lang", "cue_no", F.concat(F.coalesce("moved", F.lit("")), kept).alias("text"))
