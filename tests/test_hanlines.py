"""Lines of Chinese text: known cases, and a plain search over all cuts of short texts."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from cueloom.operators import hanlines, layout, segmentation

WORDS = {"我们": 90, "今天": 60, "学习": 50, "深度": 30, "深度学习": 20, "神经": 20, "神经网络": 15, "网络": 40, "但是": 70, "所以": 70, "模型": 60, "语言": 50, "语言模型": 25, "很": 80, "大": 90, "训练": 40, "数据": 60}
TEXT = "no long, text string"


@pytest.fixture(scope="module")
def dictionary(spark):
    return spark.createDataFrame(list(WORDS.items()), "word string, freq long")


def lines_of(spark, dictionary, texts, most):
    df = spark.createDataFrame(list(enumerate(texts)), TEXT)
    got = {r.no: r.lines for r in hanlines.han_lines(df, ["no"], dictionary, most).collect()}
    return [got[k] for k in range(len(texts))]


def test_known_lines(spark, dictionary):
    texts = [None, "", "  ", "今天", "我们今天学习深度学习，但是模型很大。", "我们学习《语言模型》的训练", "我们 学习 GPT model 今天", "我们今天\n学习", "abcdefghijkl"]
    got = lines_of(spark, dictionary, texts, 8)
    assert got[:4] == [None, [], [], ["今天"]]
    assert "".join(got[4]) == texts[4] and not any(line.startswith("学习") for line in got[4])
    assert any("《语言模型》" in line for line in got[5])
    assert any("GPT model" in line for line in got[6])
    assert got[7] == ["我们今天学习"] and got[8] == ["abcdefgh", "ijkl"]


def cuts(run):
    """All ways to part a run."""
    for k in range(len(run)):
        for at in itertools.combinations(range(1, len(run)), k):
            yield [run[a:b] for a, b in itertools.pairwise((0, *at, len(run)))]


def likeliest(run):
    """The best of all cuts; of equal ones that with the longer word first."""
    total = sum(WORDS.values())
    weight = lambda w: round(math.log(WORDS.get(w, 1) / total) * 1_000_000)
    known = [c for c in cuts(run) if all(len(w) == 1 or w in WORDS for w in c)]
    return max(known, key=lambda c: (sum(map(weight, c)), [len(w) for w in c]))


def han(c):
    return "一" <= c <= "鿿"


def forbidden(text, at):
    """A break before a character is not allowed: inside a word, a Latin or digit run, or a pair of marks."""
    pos = 0
    for same, run in itertools.groupby(text, han):
        run = "".join(run)
        if same:
            spot = pos
            for w in likeliest(run):
                if spot < at < spot + len(w):
                    return True
                spot += len(w)
        pos += len(run)
    a, b = text[at - 1], text[at] if at < len(text) else ""
    if a.isascii() and a.isalnum() and b.isascii() and b.isalnum():
        return True
    left, right = text[:at].rstrip(" "), text[at:].lstrip()
    if left and right and left[-1].isascii() and left[-1].isalpha() and right[0].isascii() and right[0].isalpha():
        return True
    return "《" in text[:at] and "》" not in text[text[:at].rindex("《") : at]


def worth(text, at):
    scores = [{"。": 100, "？": 100, "，": 80, "、": 70, "；": 80}.get(text[at - 1], 0)]
    for c in ("但是", "所以"):
        scores += [60] * (text[at:].startswith(c) or text[: at + 1].endswith(c))
    return max(scores + [30] * (text[at] in "的地得"))


def plain(text, most):
    out = []
    while len(text) > most:
        n = len(text)
        good = [(worth(text, at) + 100 * min(at, n - at) / max(at, n - at), at) for at in range(1, min(most, n - 1) + 1) if not forbidden(text, at) and worth(text, at)]
        if good:
            at = max(good)[1]
        else:
            order = [most] + [most + d for d in range(1, min(n - most, 15))] + [most - d for d in range(1, min(most, 15))]
            at = next((x for x in order if not forbidden(text, x)), most)
        out.append(text[:at].rstrip())
        text = text[at:].lstrip()
    out.append(text)
    if len(out) > 1 and len(out[-1]) == 1 and len(out[-2]) + 1 <= most + 2:
        out[-2:] = [out[-2] + out[-1]]
    done = out[:1]
    for line in out[1:]:
        while line and line[0] in hanlines.NO_LINE_START:
            done[-1] += line[0]
            line = line[1:]
        done += [line] if line else []
    return done


def test_lines_against_all_cuts(spark, dictionary):
    draw = random.Random(11)
    parts = [*WORDS, "，", "。", "、", "的", "了", "《", "》", "GPT", " ok ", "42", "好", "是"]
    texts = []
    while len(texts) < 300:
        text = "".join(draw.choice(parts) for _ in range(draw.randint(3, 8))).strip()
        if 5 <= len(text) <= 17 and text.count("《") == text.count("》") <= 1 and text.find("《") <= text.find("》"):
            texts.append(text)
    df = spark.createDataFrame(list(enumerate(texts)), TEXT)
    clean = {r.no: r.t for r in df.select("no", hanlines.normalise(F.col("text")).alias("t")).collect()}
    got = lines_of(spark, dictionary, texts, 6)
    for k in range(len(texts)):
        want = plain(clean[k], 6)
        if not (len(want) == 2 and len(want[0]) > len(want[1]) + 4):
            assert got[k] == want, texts[k]
    assert sum(len(x) > 1 for x in got) > 250


def test_uneven_pairs_are_balanced():
    text = "我们今天学习深度学习和神经网络，很大"
    assert hanlines.balance([text[:16], text[16:]], [1] * len(text))[0] != text[:16]
    for lines in (["一二三"], ["一二三四", "五六"], ["一二三四五六七八", "，二"]):
        assert "".join(hanlines.balance(lines, [1] * len("".join(lines)))) == "".join(lines)
    assert hanlines.balance(["一二三四", "五六"], [1] * 6) == ["一二三四", "五六"]


def test_steps_are_those_of_each_rest(spark, dictionary):
    text = "我们深度学习GPT4好"
    df = spark.createDataFrame([(1, text)], TEXT)
    steps = segmentation.word_steps(df, ["no"], dictionary).first().steps
    assert len(steps) == len(text)
    for at in range(len(text)):
        first = segmentation.segment(spark.createDataFrame([(1, text[at:])], TEXT), ["no"], dictionary).where("first = 0").first().word if at in (0, 1, 2, 4, 6, 8) else None
        assert first is None or len(first) == steps[at]


def test_short_cues_join_in_both_languages(spark, dictionary):
    rows = [(1, "zh", 1, "我们今天学习", 0, 1000), (1, "zh", 2, "的", 1100, 1500), (1, "zh", 3, "模型很大。", 1600, 2600), (1, "zh", 4, "了吗", 5000, 5600), (1, "zh", 5, None, 5700, 6000),
            (2, "en", 1, "We learn", 0, 1000), (2, "en", 2, "a lot.", 1100, 1500), (2, "en", 3, "today", 1600, 2000)]
    cues = spark.createDataFrame(rows, "media_id long, lang string, cue_no long, text string, start_ms long, end_ms long")
    got = {(r.lang, r.cue_no): (r.n_cues, r.end_ms, r.text) for r in layout.layout(cues, dictionary, most_zh=8).collect()}
    assert got == {("zh", 1): (2, 1500, "我们今天学习的"), ("zh", 3): (1, 2600, "模型很大。"), ("zh", 4): (1, 5600, "了吗"), ("en", 1): (1, 1000, "We learn"), ("en", 2): (2, 2000, "a lot. today")}


def test_a_joined_text_too_long_is_broken_again(spark, dictionary):
    rows = [(1, "zh", 1, "我们今天学习语言", 0, 1000), (1, "zh", 2, "的模型数据训练", 1100, 1500)]
    cues = spark.createDataFrame(rows, "media_id long, lang string, cue_no long, text string, start_ms long, end_ms long")
    (r,) = layout.layout(cues, dictionary, most_zh=8).collect()
    assert r.n_cues == 2 and r.text.replace("\n", "") == "我们今天学习语言的模型数据训练" and max(map(len, r.text.split("\n"))) <= 9


def test_marks_and_short_texts(spark):
    rows = [("好", False), ("的确", False), ("，好的", False), ("了吗", False), ("。。", False), ("好的呀", True), (None, False), ("好\n的", True)]
    df = spark.createDataFrame(rows, "text string, alone boolean")
    assert all(r.a == r.alone for r in df.select("alone", hanlines.stands_alone(F.col("text")).alias("a")).collect())
    marked = [("", ""), ("好，", "好。"), ("好", "好。"), ("好！", "好！"), (" 好 ", "好。"), (None, None)]
    assert [r.m for r in spark.createDataFrame(marked, "t string, w string").select(hanlines.end_mark(F.col("t")).alias("m")).collect()] == [w for _, w in marked]
    spaced = [("我  们好， 是", "我们好，是"), ("a  b", "a b"), ("中 国 人", "中国 人"), ("好 。", "好。")]
    assert [r.m for r in spark.createDataFrame(spaced, "t string, w string").select(hanlines.normalise(F.col("t")).alias("m")).collect()] == [w for _, w in spaced]
