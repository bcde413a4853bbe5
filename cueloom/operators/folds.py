"""Operators whose steps depend on what earlier steps decided, one media at a time.

What a row alone can decide is a column; only the fold itself runs in Python, on Arrow groups. The
groups are media (or a language of one), which are as long as a recording. All times are
milliseconds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cueloom.functions import text as T
from cueloom.operators.intervals import overlap_join
from cueloom.operators.islands import gap_sessions

# Word classes and punctuation of English.
ARTICLES = frozenset("a an the".split())
SUBJECT_PRONOUNS = frozenset("i you he she it we they who what".split())
OBJECT_PRONOUNS = frozenset("me him her us them it".split())
NEGATION = frozenset("not never no don't doesn't didn't won't can't couldn't shouldn't wouldn't isn't aren't wasn't weren't hasn't haven't hadn't".split())
AUXILIARIES = frozenset("be am is are was were been being have has had having do does did doing will would shall should can could may might must".split())
CONJUNCTIONS = frozenset("and but or nor yet so because while that which who whom whose when where whether if although though unless until since as than whereas except however then also still".split())
PREPOSITIONS = frozenset("of in to for with on at from by about into through over under after before between during without within upon across along around behind beyond down off out up toward towards against among amongst beside besides above below near inside outside beneath underneath notwithstanding".split())
ADJECTIVE_SUFFIXES = tuple("y ful less ive ous al able ible ent ant ic ish ary".split())
DISCOURSE_MARKERS = frozenset("so now well anyway ok okay anyways anyhow look listen right alright".split())
PHRASAL_ROOTS = frozenset("give look take put get come go bring turn set run work find break pick carry hold keep let make show call check cut drop fall fill grow hang pull push shut sit stand think throw wake walk write build start move pass hand point send pay lay step back".split())
PHRASAL_PARTICLES = frozenset("up down in out on off away at for over through into around about back forward aside along ahead apart together".split())
SENTENCE_ENDS, CLAUSE_PUNCT, TRAILING = ".!?。！？…", ",;:—，、；：", ",.;!?\"'"


def fold(df: DataFrame, keys: list[str], order: list[str], schema: str, step: Callable[[pd.DataFrame], Iterator[tuple]]) -> DataFrame:
    """step, given a group in order, yields rows of the schema without the keys, which are put before."""
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    names = [part.split()[0] for part in schema.split(", ")]

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(list(step(group.sort_values(order, kind="stable"))), columns=names)
        for at, (name, value) in enumerate(zip(keys, key, strict=True)):
            out.insert(at, name, value)
        return out

    return df.groupBy(*keys).applyInPandas(run, f"{kinds}, {schema}")


def merge_short_sessions(words: DataFrame, gap_ms: int = 500, near_ms: int = 800, most_ms: int = 15_000, short: int = 3) -> DataFrame:
    """Sessions of words where short ones that end no sentence have joined the one before:
    (media_id, session, n_words, start_ms, end_ms)."""
    s = gap_sessions(words, gap_ms).groupBy("media_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min_by("start_ms", "word_no").alias("s"), F.max_by("end_ms", "word_no").alias("e"), T.ends_sentence(F.max_by("text", "word_no")).alias("ends"))

    def step(rows: pd.DataFrame) -> Iterator[tuple]:
        held = None
        number = 0
        for n, s, e, ends in rows[["n", "s", "e", "ends"]].itertuples(index=False):
            if held and ((held[0] <= short and not held[3]) or (n <= short and not ends)) and s - held[2] <= near_ms and e - held[1] <= most_ms:
                held = (held[0] + n, held[1], e, ends)
                continue
            if held:
                number += 1
                yield number, *held[:3]
            held = (n, s, e, ends)
        if held:
            yield number + 1, *held[:3]

    return fold(s, ["media_id"], ["session"], "session long, n_words long, start_ms long, end_ms long", step)


def _bare(word: str) -> str:
    return word.strip().lower().strip(TRAILING + CLAUSE_PUNCT + SENTENCE_ENDS)


def must_stay_together(last: str, following: str) -> bool:
    """Splitting between the words would orphan an article, an adjective, an auxiliary, a pronoun or a
    particle, or part two words of a name."""
    a, b = _bare(last), _bare(following)
    if not a or not b or any(c in CLAUSE_PUNCT or c in SENTENCE_ENDS for c in last.strip()):
        return False
    weak = a in ARTICLES or a in AUXILIARIES or a in SUBJECT_PRONOUNS or a in NEGATION
    weak = weak or any(a.endswith(x) and len(a) > len(x) + 1 for x in ADJECTIVE_SUFFIXES)
    weak = weak or (last.strip()[0].isupper() and following.strip()[0].isupper() and a.isalpha() and b.isalpha())
    return weak or (a in PHRASAL_ROOTS and b in PHRASAL_PARTICLES) or b in OBJECT_PRONOUNS or a.replace(",", "").replace(".", "").isdigit()


def segment_words(words: DataFrame, max_duration: int = 7000, max_chars: int = 42, threshold: int = 40) -> DataFrame:
    """Semantic segmentation: (media_id, segment, first_word, last_word, start_ms, end_ms, text).

    A boundary scores what the first signal in the list below gives, less what speaks for going on;
    it splits from ``threshold`` on, and always where the speaker changes.
    """
    def positive(last: str, ends: bool, following: str, gap: int, span: int, chars: int, n: int, marked: bool) -> int:
        bare = following.lower().rstrip(TRAILING)
        signals = (
            (ends, 100),
            (span + gap > max_duration, 100),
            (chars + len(following) > 3 * max_chars and gap > 150, 70),
            (following[:1].isupper() and gap > 300, 80),
            (bare in DISCOURSE_MARKERS and gap > 300, 75),
            (n >= 5 and not marked and gap > 500, 70),
            (any(c in CLAUSE_PUNCT for c in last), 50),
            (gap > 800, 60), (gap > 500, 45), (gap > 300, 25), (gap > 150, 10),
            (bare in CONJUNCTIONS, 30),
        )
        return next((score for holds, score in signals if holds), 0)

    def step(rows: pd.DataFrame) -> Iterator[tuple]:
        held: list = []
        number = chars = 0
        marked = False
        for w in rows.itertuples(index=False):
            text = w.text.strip()
            if held:
                last, bare = held[-1], text.lower().rstrip(TRAILING)
                gap = w.start_ms - last.end_ms
                less = 30 * text[:1].islower() + 25 * (bare in PREPOSITIONS or bare in ARTICLES) + 40 * (len(held) <= 3 and not marked)
                score = positive(last.text.strip(), last.ends, text, gap, last.end_ms - held[0].start_ms, chars, len(held), marked) - less
                if w.speaker != last.speaker or (score >= threshold and not must_stay_together(last.text, text)):
                    number += 1
                    yield number, held[0].word_no, last.word_no, held[0].start_ms, last.end_ms, " ".join(t for t in (x.text.strip() for x in held) if t)
                    held, chars, marked = [], 0, False
            held.append(w)
            chars += len(text)
            marked = marked or any(c in CLAUSE_PUNCT or c in SENTENCE_ENDS for c in text)
        if held:
            yield number + 1, held[0].word_no, held[-1].word_no, held[0].start_ms, held[-1].end_ms, " ".join(t for t in (x.text.strip() for x in held) if t)

    return fold(words.select("media_id", "word_no", "speaker", "text", T.ends_sentence(F.col("text")).alias("ends"), "start_ms", "end_ms"), ["media_id"], ["word_no"], "segment long, first_word long, last_word long, start_ms long, end_ms long, text string", step)


def break_line(text: str, most: int = 42) -> str:
    """A text in two lines, at the space where they are most even, after punctuation or before a
    conjunction if that is nearly as even; never after what must stay together if it can be helped."""
    words = text.split()
    if len(" ".join(words)) <= most or len(words) < 2:
        return " ".join(words)

    def cost(k: int) -> tuple:
        first, second = " ".join(words[:k]), " ".join(words[k:])
        good = 12 * words[k - 1].endswith(tuple(SENTENCE_ENDS + CLAUSE_PUNCT)) + 8 * (_bare(words[k]) in CONJUNCTIONS or _bare(words[k]) in PREPOSITIONS)
        return max(len(first), len(second)) > most, must_stay_together(words[k - 1], words[k]), abs(len(first) - len(second)) - good, k

    k = min(range(1, len(words)), key=cost)
    return " ".join(words[:k]) + "\n" + " ".join(words[k:])


@F.pandas_udf(StringType())
def break_lines(text: pd.Series) -> pd.Series:
    """``break_line`` of a column."""
    return text.map(break_line, na_action="ignore")


# Steps that need no fold: a row and its neighbours decide.


def annotation_timing(cues: DataFrame) -> DataFrame:
    """Annotations last as long as they take to read, and end 300 ms before the next."""
    reading = F.greatest(F.length("text"), F.lit(40)) * 200
    following = F.lead("start_ms").over(Window.partitionBy("media_id", "lang").orderBy("cue_no"))
    end = F.when(following.isNull(), F.col("start_ms") + reading).otherwise(F.least(following - 300, F.col("start_ms") + F.floor(reading * 13 / 10)))
    return cues.select("media_id", "lang", "cue_no", "start_ms", end.alias("end_ms"))


def assign_speakers(words: DataFrame, turns: DataFrame) -> DataFrame:
    """Each word's turn: the first that holds its middle, else the one that overlaps it most."""
    touching = words.select("media_id", "word_no", F.col("start_ms"), (F.col("end_ms") + 1).alias("end_ms"))
    x = overlap_join(touching, turns.withColumn("end_ms", F.col("end_ms") + 1), ["media_id"])
    end, turn_end = F.col("l_end_ms") - 1, F.col("r_end_ms") - 1
    x = x.withColumn("holds", F.floor((F.col("l_start_ms") + end) / 2).between(F.col("r_start_ms"), turn_end)).withColumn("o", F.least(end, turn_end) - F.greatest("l_start_ms", "r_start_ms"))
    best = Window.partitionBy("media_id", "l_word_no").orderBy(F.desc("holds"), F.desc(F.when(F.col("holds"), 0).otherwise(F.col("o"))), "r_turn")
    return x.withColumn("n", F.row_number().over(best)).where("n = 1").select("media_id", F.col("l_word_no").alias("word_no"), F.col("r_turn_speaker").alias("turn_speaker"))


def best_silence(silences: DataFrame, targets: DataFrame, wide: int = 60_000, narrow: int = 30_000, long_ms: int = 1500) -> DataFrame:
    """Where to split near each target: a silence of 1.5 s or more within a minute, else any within half."""
    from cueloom.operators.intervals import point_join

    middle = silences.withColumn("mid", F.col("s") + F.floor(F.col("len") / 2))
    spread = targets.withColumn("from_ms", F.col("target") - wide).withColumn("to_ms", F.col("target") + wide)
    x = point_join(middle, "mid", spread, ["media_id"], "from_ms", "to_ms", width=wide).withColumn("away", F.abs(F.col("mid") - F.col("target")))
    x = x.withColumn("pass", F.when(F.col("len") >= long_ms, 0).when(F.col("away") <= narrow, 1)).where("pass IS NOT NULL")
    score = 4 * (wide - F.col("away")) * 5000 + 6 * F.least("len", F.lit(5000)) * wide
    best = F.min_by(F.col("s") + F.col("len"), F.struct("pass", -score, "event_id"))
    return x.groupBy("media_id", "target").agg(best.alias("split_ms"))


def shift_parts(cues: DataFrame, part: str) -> DataFrame:
    """Cues of parts that follow each other, put on one time line. Parts are few: a window over one row each."""
    length = cues.groupBy(part).agg(F.max("end_ms").alias("len"))
    offset = F.coalesce(F.sum("len").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = cues.join(length.select(part, offset.alias("o")), part)
    return x.withColumns({"start_ms": F.col("start_ms") + F.col("o"), "end_ms": F.col("end_ms") + F.col("o")}).drop("o")


def bounds(words: Column) -> Column:
    """The times that part the words of a turn, with its start and end."""
    return F.concat(F.slice(words["start_ms"], 1, 1), words["end_ms"])


def word_of(k: Column, n: Column, m: Column) -> Column:
    """Which of n words the k-th of m tokens starts in."""
    return ((k * n - k * n % m) / m).cast("int")


def bound(b: Column, k: Column, n: Column, m: Column) -> Column:
    """When the k-th of m tokens starts on the bounds of n words."""
    f, i = k * n % m, word_of(k, n, m)
    return F.when(k == m, F.get(b, n.cast("int")).cast("double")).otherwise((F.get(b, i) * (m - f) + F.get(b, i + 1) * f).cast("double") / m)


def redistribute_timing(words: DataFrame, counts: DataFrame) -> DataFrame:
    """Times of m new tokens (counts: media_id, turn, m) on the bounds of a turn's n words, by linear
    interpolation: (media_id, turn, k, start_ms, end_ms, confidence, speaker), the confidence being the
    words' mean and the speaker that of the word a token starts in. Turns without tokens have no row."""
    own = F.array_sort(F.collect_list(F.struct("word_no", "start_ms", "end_ms", "speaker")))
    x = words.groupBy("media_id", "turn").agg(own.alias("w"), F.avg("confidence").alias("confidence")).join(counts.where("m > 0"), ["media_id", "turn"])
    x = x.withColumn("n", F.size("w").cast("long")).withColumn("b", bounds(F.col("w")))
    x = x.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    b, k, n, m = (F.col(c) for c in "bknm")
    return x.select("media_id", "turn", "k", bound(b, k, n, m).alias("start_ms"), bound(b, k + 1, n, m).alias("end_ms"), "confidence", F.get("w", word_of(k, n, m))["speaker"].alias("speaker"))
