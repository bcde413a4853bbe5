"""Words by a dictionary, entry points and corrections: brute force and cases that the driver's tables do not hold."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from cueloom.operators import entry, segmentation
from cueloom.plans import corrections

CUE = "media_id long, lang string, cue_no long, text string"


def cues_of(spark, *texts, lang="zh"):
    return spark.createDataFrame([(1, lang, k, t) for k, t in enumerate(texts)], CUE)


def words_of(spark, *words):
    return spark.createDataFrame([(w, 10) for w in words], "word string, freq long")


def best_cut(text, freq):
    """All cuts of a text, the likeliest one; of equal ones that of the longer first words."""
    total = sum(freq.values())
    cuts = []
    for ends in itertools.product([False, True], repeat=len(text) - 1):
        marks = [0, *[k + 1 for k, e in enumerate(ends) if e], len(text)]
        cut = [text[a:b] for a, b in itertools.pairwise(marks)]
        if all(len(w) == 1 or w in freq for w in cut):
            cuts.append((sum(round(math.log(freq.get(w, 1) / total) * 1e6) for w in cut), [len(w) for w in cut], cut))
    return max(cuts)[2]


def test_segment_against_all_cuts(spark):
    rng = random.Random(3)
    freq = {"".join(rng.choice("过去方法") for _ in range(rng.randint(1, 3))): rng.randint(1, 9) for _ in range(14)}
    texts = ["".join(rng.choice("过去方法程") for _ in range(rng.randint(1, 9))) for _ in range(30)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {}
    for r in segmentation.segment(rows, ["k"], spark.createDataFrame(list(freq.items()), "word string, freq long")).collect():
        got.setdefault(r.k, []).append((r.first, r.word))
    for k, text in enumerate(texts):
        assert [w for _, w in sorted(got[k])] == best_cut(text, freq)


def test_segment_edges(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "用GPT4 过去\n好!"), (4, "过" * 3000)], "k long, text string")
    got = segmentation.segment(rows, ["k"], words_of(spark, "过去", "过去", "")).collect()
    assert {r.k for r in got} == {3, 4} and sum(r.k == 4 for r in got) == 3000
    assert sorted((r.first, r.word) for r in got if r.k == 3) == [(0, "用"), (1, "GPT4"), (5, " "), (6, "过去"), (8, "\n"), (9, "好"), (10, "!")]
    empty = spark.createDataFrame([], "word string, freq long")
    assert segmentation.segment(rows.where("k = 3"), ["k"], empty).count() == 8
    assert segmentation.segment(rows.limit(0), ["k"], empty).count() == 0


def test_words_that_borders_part(spark):
    cues = cues_of(spark, "看过\n程序", "过去方", "法吧\n了好", "过程\n过程好", None, "Trans", "former", "Bach from", "Ulm")
    got = {(r.rule, r.cue_no, r.sub_no, r.word) for r in segmentation.split_words(cues, words_of(spark, "过程", "方法", "过去", "看")).collect()}
    assert got == {("CompoundWords", 0, 1, "过程"), ("TokenAcrossCues", 1, 0, "方法"), ("ParticleLine", 2, 1, "了"), ("TokenAcrossCues", 5, 0, "Transformer"), ("TokenAcrossCues", 6, 0, "formerBach"), ("TokenAcrossCues", 7, 0, "fromUlm")}
    assert [(r.cue_no, r.word) for r in segmentation.english_across_cues(cues).collect()] == [(5, "Transformer"), (6, "formerBach")]
    assert segmentation.split_words(cues.withColumn("lang", F.lit("en")), words_of(spark, "过程")).count() == 0


def texts(df):
    return [r.text for r in df.orderBy("cue_no").collect()]


def test_mending_names_and_words(spark):
    assert texts(segmentation.mend_names(cues_of(spark, "he met\nYann", "LeCun again\nthere", "Bob", "Dylan", "no.", None, lang="en"))) == ["he met", "Yann LeCun again\nthere", " ", "Bob Dylan", "no.", ""]
    assert texts(segmentation.mend_names(cues_of(spark, "A", "B", "C", lang="en"))) == [" ", " ", "A B C"]
    words = words_of(spark, "人工智能", "方法")
    assert texts(segmentation.mend_words(cues_of(spark, "好方\n说人工", "智能好", "方", "法"), words)) == ["好方\n说", "人工智能好", "方", "法"]
    assert texts(segmentation.mend_words(cues_of(spark, "人工", "智能"), words)) == ["人工", "智能"]
    assert texts(segmentation.mend_words(cues_of(spark, "说人工 ", "智能", lang="en"), words)) == ["说人工 ", "智能"]


def test_entry_points(spark):
    word = "media_id long, word_no long, start_ms long, end_ms long, confidence double"
    words = [(1, 0, 1000, 1100, 0.2), (1, 1, 1500, 1600, 0.45), (1, 2, 1700, 1800, 0.9)]  # unsure, then sure: a cliff
    words += [(1, 3, 10_000, 10_100, 0.9), (1, 4, 12_000, 12_100, 0.3), (1, 5, 14_000, 14_100, 0.8), (1, 6, 14_200, 14_300, 0.8)]  # the word at 12 s stands alone
    words += [(1, 7, 20_000, 20_100, 0.2), (1, 8, 22_000, 22_100, 0.9)]  # too far to move
    words += [(1, 9, 30_000, 30_100, 0.9)]
    cues = spark.createDataFrame([(1, "en", k, s, e) for k, (s, e) in enumerate([(1000, 2000), (10_000, 15_000), (20_000, 23_000), (30_000, 31_000), (40_000, 41_000)])], "media_id long, lang string, cue_no long, start_ms long, end_ms long")
    got = {r.cue_no: (r.start_ms, r.reason) for r in entry.entry_points(spark.createDataFrame(words, word), cues).collect()}
    assert got == {0: (1600, "cliff"), 1: (13_900, "gap")}


@pytest.mark.parametrize(
    ("new", "texts"),
    [
        (["A", "b", "c", "d"], ["A", " b", " c", " d"]),
        (["a", "b", "d"], ["a", " b", " d"]),
        (["a", "b", "x", "c", "d"], ["a", " b", " x", " c", " d"]),
        (["a", "B", "y", "z", "D", "e"], ["a", " b", " y", " z", " d", " e"]),
        (["a"], ["a", " b", " c", " d"]),
        (None, ["a", " b", " c", " d"]),
        ([], ["a", " b", " c", " d"]),
    ],
)
def test_corrected_words(spark, new, texts):
    words = [(1, 0, k, t, 100 * k, 100 * k + 100, 0.5, "s") for k, t in enumerate(["a", " b", " c", " d"])]
    words = spark.createDataFrame(words, "media_id long, turn long, word_no long, text string, start_ms long, end_ms long, confidence double, speaker string")
    replies = spark.createDataFrame([(1, 0, new)], "media_id long, turn long, tokens array<string>")
    got = corrections.correct_words(words, replies).orderBy("k").collect()
    assert [r.text for r in got] == texts
    assert [got[0].start_ms, got[-1].end_ms] == [0, 400] and all(a.end_ms == b.start_ms for a, b in itertools.pairwise(got))


def test_restored_punctuation(spark):
    words = [(1, t, k, w) for t in (0, 1, 2) for k, w in enumerate(["well", " so", " it", " is "])]
    words = spark.createDataFrame(words, "media_id long, turn long, word_no long, text string")
    replies = spark.createDataFrame([(1, 0, "Well, so it was!"), (1, 1, "Well, so. it is?")], "media_id long, turn long, reply string")
    got = {}
    for r in corrections.restore_punctuation(words, replies).orderBy("turn", "word_no").collect():
        got.setdefault(r.turn, []).append(r.text)
    assert got == {0: ["well,", " so", " it", " is! "], 1: ["well,", " so.", " it", " is? "], 2: ["well", " so", " it", " is "]}


def plain_states(chars, weight, first, after):
    """The likeliest of all paths of states; of equal ones that whose letters are later, from the end on."""
    allowed = {"B": "ME", "M": "ME", "E": "BS", "S": "BS"}
    paths = [p for p in itertools.product("BMES", repeat=len(chars)) if p[-1] in "ES" and all(b in allowed[a] for a, b in itertools.pairwise(p))]
    cost = lambda p: first.get(p[0], segmentation.NEVER) + sum(weight.get((s, c), segmentation.NEVER) for s, c in zip(p, chars)) + sum(after.get(x, segmentation.NEVER) for x in itertools.pairwise(p))
    return max(paths, key=lambda p: (cost(p), p[::-1]))


def test_unseen_words_against_all_paths(spark):
    """Real words in the dictionary tell how characters stand in words that it lacks."""
    words = {"我们": 50, "你们": 40, "老师": 30, "学生": 30, "学习": 25, "图书馆": 20, "飞机场": 15, "在": 60, "的": 80, "去": 30, "人": 30, "火车": 20, "车站": 20}
    dictionary = spark.createDataFrame(list(words.items()), "word string, freq long")
    table = segmentation.word_states(dictionary)
    rows = table.collect()
    weight = {(r.state, r.char): r.weight for r in rows if r.char}
    first, after = {r.state: r.weight for r in rows if not r.char and not r.next}, {(r.state, r.next): r.weight for r in rows if r.next}
    assert set(after) == {("B", "E"), ("B", "M"), ("M", "E"), ("E", "B"), ("E", "S"), ("S", "B"), ("S", "S")}
    draw = random.Random(8)
    texts = ["我们在火场学馆", "老生去飞站", "他们", "的在", "们", "在去人"] + ["".join(draw.choice("我你们老师学生习图书馆飞机场在的去人火车站猫") for _ in range(draw.randint(1, 9))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "no long, text string")
    known = {}
    for r in segmentation.segment(df, ["no"], dictionary).collect():
        known.setdefault(r.no, []).append((r["first"], r.word))
    got = {}
    for r in segmentation.segment(df, ["no"], dictionary, states=table).collect():
        got.setdefault(r.no, []).append((r["first"], r.word))
    more = 0
    for no, text in enumerate(texts):
        want, alone = [], []
        for at, w in [*sorted(known[no]), (len(text), None)]:
            if w and len(w) == 1:
                alone.append((at, w))
                continue
            chars = "".join(c for _, c in alone)
            if len(alone) < 2 or chars in words:
                want += alone
            else:
                begin, since = alone[0][0], 0
                for k, s in enumerate(plain_states(chars, weight, first, after)):
                    if s in "ES":
                        want.append((begin + since, chars[since : k + 1]))
                        since = k + 1
            alone = []
            want += [(at, w)] if w else []
        assert sorted(got[no]) == want, text
        more += len(want) < len(known[no])
    assert more > 50 and all("".join(w for _, w in sorted(got[k])) == t for k, t in enumerate(texts))


def test_states_that_say_nothing_leave_characters_alone(spark):
    df = spark.createDataFrame([(1, "猫狗鸟"), (2, ""), (3, None)], "no long, text string")
    none = spark.createDataFrame([], "word string, freq long")
    empty = segmentation.word_states(none)
    assert empty.collect() == []
    assert "".join(r.word for r in segmentation.segment(df, ["no"], none, states=empty).orderBy("first").collect()) == "猫狗鸟"


def test_marks_are_found_in_one_pass_and_none_is_lost(spark):
    # The longest equal piece of these two is not where they belong together.
    words = spark.createDataFrame([(1, 0, k, w) for k, w in enumerate(["xy", " xy", " x"])], "media_id long, turn long, word_no long, text string")
    replies = spark.createDataFrame([(1, 0, "xy? xy x!")], "media_id long, turn long, reply string")
    assert [r.text for r in corrections.restore_punctuation(words, replies).orderBy("word_no").collect()] == ["xy?", " xy", " x!"]
    for plain, text, added in [("a.b", "a..b", [(2, ".")]), ("ab", "a,b!?", [(1, ","), (2, "!"), (2, "?")]), ("a, b", "a, b", []), ("ab", "ac", None), ("a,b", "ab", None), ("", "!", [(0, "!")])]:
        assert corrections._added_marks(plain, text) == added
    # By differences these 30,000 characters take minutes.
    long = "ab ba " * 5000
    assert corrections._added_marks(long, long.replace("ba", "ba,"))[:2] == [(5, ","), (11, ",")]


def test_corrected_words_stay_with_their_turn(spark):
    words = spark.createDataFrame([(1, 0, k, "a", 0, 1, 0.5, "s") for k in range(4)], "media_id long, turn long, word_no long, text string, start_ms long, end_ms long, confidence double, speaker string")
    df = corrections.correct_words(words, spark.createDataFrame([(1, 0, ["a"] * 5)], "media_id long, turn long, tokens array<string>"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Union" not in plan
