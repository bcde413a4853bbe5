"""The rules themselves. Importing this module fills the registry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cueloom.functions import text as T
from cueloom.rules.registry import ERROR, SUGGESTION, WARNING, line_numbers, pair_numbers, rule

col, lit = F.col, F.lit


def zh() -> Column:
    return col("lang") == "zh"


def en() -> Column:
    return col("lang") == "en"


# Utterances that stand alone, openings of sentences, hints and patterns.
TINY_STANDALONE = ["对", "嗯", "好", "是啊", "没错", "确实", "也许吧", "结果呢", "有争议", "哦对", "嗯 对", "数亿年", "另一个", "对吧？", "是吧？", "我觉得", "好吧", "是的"]
TRAILING_STANDALONE = ["什么意思？", "预测什么？", "正是如此", "这也很棒", "公司很喜欢", "就在它指尖", "它们不重建", "反向传播", "孪生网络", "对", "嗯", "好", "是啊", "没错", "确实", "也许吧", "哦对", "嗯 对", "对吧？", "另一个", "数亿年", "结果呢", "有争议", "会做什么？", "纯监督模型", "确实如此", "好吧", "甚至更极端", "甚至数亿年"]
SENTENCE_STARTS = ["然", "而", "不", "过", "但", "是", "所", "以", "因", "此", "且", "并", "可", "那", "么", "据我所知", "你可能会说", "换个说法吧", "我想说的是", "也可以说"]
QUESTION_HINTS = ["吗", "呢", "吧", "啊", "么", "嘛", "呗"]
EXCLAMATION_HINTS = ["太好了", "真", "多么", "太", "竟然", "居然", "简直"]
MT_PATTERNS_EN = [r"\bmoreover\b", r"\bnevertheless\b", r"\bfurthermore\b", r"\bconsequently\b", r"\btherefore\b", "not only.*but also"]
TRANSLATIONESE_ZH = [r"\b此外\b", r"\b另外\b", r"\b然而\b", r"\b尽管如此\b", r"\b值得注意的是\b", r"\b在这个意义上\b", r"\b进行(讨论|分析|研究|处理|优化|测试)\b", r"\b该(技术|方法|系统|问题|模型|数据)\b", r"\b就[一-鿿]{1,6}而言\b"]
FILLERS = ["well", "you know", "i mean", "就是说", "那个", "嗯", "呃"]
SAFE_ENGLISH = ["the", "and", "for", "not", "are", "was", "had", "has", "but", "all", "can", "any", "its", "than", "that", "this", "with", "from", "have", "they", "been", "were", "some", "what", "when", "will", "would", "could", "about", "into", "over", "after", "before", "because", "which", "while", "where", "there", "their", "these"]
OVERLAP_STOP_WORDS = ["this", "that", "these", "those", "with", "from", "they", "them", "their", "have", "been", "were", "some", "what", "when", "will", "would", "could", "about", "into", "over", "after", "before"]
LETTERS = "a-zA-ZÀ-ɏ"


def any_in(text: Column, parts: list[str]) -> Column:
    return text.rlike("|".join(parts))


@rule("MaxLines", ERROR)
def _(c):
    return F.size("lines") > F.when(zh(), c.max_lines_zh).otherwise(c.max_lines)


@rule("ChineseLineLength", SUGGESTION, per_line=True)
def _(c):
    return F.when(zh(), line_numbers(lambda x: T.cjk_count(x) > c.max_chars_per_line_zh))


@rule("EnglishLineLength", ERROR, per_line=True)
def _(c):
    return F.when(en(), line_numbers(lambda x: F.length(x) > c.max_chars_per_line_en))


@rule("ReadingSpeed", ERROR)
def _(c):
    fast = F.when(zh(), T.cjk_count(col("text")) * 1000 > c.cps_limit * col("dur")).otherwise(T.chars(col("text")) * 1000 > c.cps_limit_en * col("dur"))
    return (col("dur") > 0) & fast


@rule("MinDuration", ERROR)
def _(c):
    return col("dur") < c.min_duration - 10


@rule("MaxDuration", lambda c: F.when(col("dur") > c.long_duration, WARNING).otherwise(SUGGESTION))
def _(c):
    return col("dur") > c.max_duration


@rule("EmptyText", ERROR)
def _(c):
    return T.strip(col("text")) == ""


@rule("LeadingPunctuation", SUGGESTION, per_line=True)
def _(c):
    return F.when(zh(), line_numbers(lambda x: T.strip(x).rlike(f"^[{T.SENTENCE_ENDS_ZH}]")))


@rule("TinyCue", ERROR)
def _(c):
    word = F.regexp_replace("flat", "[.!?]", "").rlike(r"^\p{L}+$")
    return F.length("flat").between(1, 3) & ~(zh() & col("flat").isin(TINY_STANDALONE)) & ~(en() & word)


@rule("UntranslatedText", ERROR)
def _(c):
    return zh() & (F.size(F.filter(F.regexp_extract_all("text", lit("[a-zA-Z]+"), 0), lambda w: F.length(w) > 2)) >= 4)


@rule("SemanticBreaks", SUGGESTION)
def _(c):
    first, second = F.length(F.get("lines", 0)), F.length(F.get("lines", 1))
    return (F.size("lines") == 2) & ((zh() & (first <= 3) & (second >= 10)) | (en() & (first <= 5) & (second >= 20)))


@rule("LineImbalance", SUGGESTION)
def _(c):
    first, second = F.length(T.strip(F.get("lines", 0))), F.length(T.strip(F.get("lines", 1)))
    return zh() & (F.size("lines") == 2) & (first > 0) & (second > 0) & (10 * F.abs(first - second) > 6 * F.greatest(first, second))


@rule("CJKSpaceAnomaly", ERROR)
def _(c):
    return zh() & col("text").rlike(f"{T.CJK} {{2,}}{T.CJK}")


@rule("PunctuationMidLine", ERROR, per_line=True)
def _(c):
    return F.when(zh(), line_numbers(lambda x: x.rlike(f"^[^。]*。\\s*{T.CJK}")))


@rule("AcronymSplit", ERROR, per_line=True)
def _(c):
    return F.when(zh(), pair_numbers(lambda a, b: a.rlike(r"[A-Z]\s*$") & b.rlike(r"^\s*[A-Z]")))


@rule("NumberSplit", ERROR, per_line=True)
def _(c):
    return F.when(zh(), pair_numbers(lambda a, b: a.rlike(r"\d{2,}\s*$") & b.rlike(r"^\s*\d")))


@rule("WordSplitEnglish", ERROR, per_line=True)
def _(c):
    def split(a: Column, b: Column) -> Column:
        tail, head = F.regexp_extract(a, f"([{LETTERS}]+)$", 1), F.regexp_extract(b, f"^([{LETTERS}]+)", 1)
        return (F.length(tail) >= 3) & (F.length(head) >= 1) & ~F.lower(tail).isin(SAFE_ENGLISH)

    return F.when(zh(), pair_numbers(split))


@rule("OrphanWordsIntra", ERROR)
def _(c):
    second = T.strip(F.get("lines", 1))
    return (F.size("lines") == 2) & ((en() & (second != "") & ~second.rlike(r"(?U)\s")) | (zh() & (F.length(second) <= 2)))


@rule("OrphanWordsCross", WARNING)
def _(c):
    gap = col("start_ms") - col("prev_end_ms")
    return (F.length("flat") <= 5) & gap.between(0, 500) & ~col("flat").isin(TRAILING_STANDALONE) & ~col("flat").rlike(f"^({'|'.join(SENTENCE_STARTS)})") & ~T.last_line(col("prev_text")).rlike("[？！…]$")


@rule("TranslationesePatterns", SUGGESTION)
def _(c):
    return (en() & F.lower("text").rlike("|".join(MT_PATTERNS_EN))) | (zh() & col("text").rlike("(?U)" + "|".join(TRANSLATIONESE_ZH)))


@rule("FillerWords", SUGGESTION)
def _(c):
    return any_in(F.lower("text"), FILLERS)


@rule("SingleCharacter", WARNING)
def _(c):
    return zh() & col("flat").rlike(f"^{T.CJK}$")


@rule("Overlap", ERROR)
def _(c):
    return col("start_ms") < col("prev_end_ms")


@rule("GapFlash", ERROR)
def _(c):
    gap = col("start_ms") - col("prev_end_ms")
    return (gap >= 0) & (gap < c.min_gap)


@rule("TimelineGap", ERROR)
def _(c):
    gap = col("start_ms") - col("prev_end_ms")
    return (gap > 0) & (gap < c.min_gap) & F.coalesce(col("speaker") == col("prev_speaker"), lit(True))


@rule("MissingPunctuation", SUGGESTION)
def _(c):
    alone = F.coalesce(col("next_start_ms") > col("end_ms") + 800, lit(True))
    return zh() & (col("last") != "") & ~col("last").rlike(f"[{T.SENTENCE_ENDS_ZH}]$") & alone & any_in(col("last"), QUESTION_HINTS + EXCLAMATION_HINTS)


def significant(text: Column) -> Column:
    """Distinct words of four letters or more that are no stop words."""
    found = F.transform(F.regexp_extract_all(text, lit("[a-zA-Z]+"), 0), F.lower)
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) >= 4) & ~w.isin(OVERLAP_STOP_WORDS)))


@rule("OverlappingContent", WARNING)
def _(c):
    a, b = significant(col("prev_text")), significant(col("text"))
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return en() & (F.length(T.strip(col("text"))) >= 6) & (F.length(T.strip(col("prev_text"))) >= 6) & (either > 0) & (10 * both >= 3 * either)


@rule("BoundaryRepetition", WARNING)
def _(c):
    before = T.strip(F.regexp_replace("prev_text", "\n", ""))
    same = lambda n: (F.length(before) >= n) & (F.length("flat") >= n) & (F.right(before, lit(n)) == F.substring("flat", 1, n)) & F.substring("flat", 1, n).rlike(T.HAN_BASIC)
    return same(2) | same(3)
