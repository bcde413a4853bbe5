"""Operators that SQL does not cover, and edges of those that it does, against plain loops."""

from difflib import SequenceMatcher

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cueloom.functions import text as T
from cueloom.functions import timecode as C
from cueloom.functions.interval import byte_range
from cueloom.functions.similarity import seq_ratio
from cueloom.operators import folds, intervals, islands, layout, matching, sets
from cueloom.rules.registry import RULES, check
from cueloom.sources import subtitles

CUE = "media_id long, lang string, cue_no long, speaker string, text string, start_ms long, end_ms long"
WORD = "media_id long, turn long, speaker string, word_no long, text string, start_ms long, end_ms long, confidence double"


def cues(spark, rows):
    return spark.createDataFrame([(1, lang, n, "a", text, s, e) for n, (lang, text, s, e) in enumerate(rows, 1)], CUE)


def names(df):
    return {(r["rule"], r["cue_no"], r["severity"]) for r in df.collect()}


def test_rules_at_their_limits(spark):
    found = names(check(cues(spark, [("en", "a\nb\nc", 0, 1000), ("en", "fine words here.", 1099, 1889), ("en", "x", 1988, 9000), ("en", "", 9200, 18300)])))
    assert ("MaxLines", 1, "error") in found
    assert ("GapFlash", 2, "error") in found and ("TimelineGap", 2, "error") in found
    assert not any(rule == "MinDuration" for rule, _, _ in found)  # 790 ms are enough
    assert ("MaxDuration", 3, "suggestion") in found and ("MaxDuration", 4, "warning") in found
    assert ("EmptyText", 4, "error") in found and not any(rule == "TinyCue" and n in (3, 4) for rule, n, _ in found)


def test_rules_on_chinese(spark):
    rows = [("zh", "。你好AB\nCD世界", 0, 9000), ("zh", "这是  什么吗", 9050, 12000), ("zh", "什么", 12100, 13000), ("zh", "对", 13100, 14000)]
    found = names(check(cues(spark, rows)))
    assert {("LeadingPunctuation", 1, "suggestion"), ("AcronymSplit", 1, "error"), ("CJKSpaceAnomaly", 2, "error"), ("TinyCue", 3, "error")} <= found
    assert ("TinyCue", 4, "error") not in found and ("OrphanWordsCross", 4, "warning") not in found
    assert check(cues(spark, []), names=list(RULES)).count() == 0


def test_overlap_join_against_loops(spark):
    left = [(k % 2, k, 700 * k, 700 * k + 100 + 37 * k * k % 30_000) for k in range(40)]
    right = [(k % 2, k, 500 * k, 500 * k + 61 * k % 9000) for k in range(40)]
    frame = lambda rows: spark.createDataFrame(rows, "media_id long, n long, start_ms long, end_ms long")
    got = sorted((r["l_n"], r["r_n"], r["overlap_ms"]) for r in intervals.overlap_join(frame(left), frame(right), ["media_id"], width=1000).collect())
    want = sorted((a[1], b[1], min(a[3], b[3]) - max(a[2], b[2])) for a in left for b in right if a[0] == b[0] and min(a[3], b[3]) > max(a[2], b[2]))
    assert got == want and got


def test_asof_floor(spark):
    points = spark.createDataFrame([(1, 5), (1, 10), (2, 1)], "k long, t long")
    marks = spark.createDataFrame([(1, 5), (1, 7), (2, 3)], "k long, m long")
    got = {(r.k, r.t): r.floor_m for r in intervals.asof_floor(points, "t", marks, "m", ["k"]).collect()}
    assert got == {(1, 5): 5, (1, 10): 7, (2, 1): None}


def words(spark, spec):
    return spark.createDataFrame([(1, 0, sp, n, t, s, e, 0.9) for n, (t, s, e, sp) in enumerate(spec, 1)], WORD)


def test_sessions_and_short_ones(spark):
    w = words(spark, [("one", 0, 100, "a"), ("two", 200, 300, "a"), ("Hm", 900, 1000, "a"), ("far", 9000, 9100, "a"), ("end.", 9700, 9800, "a"), ("more", 10400, 10500, "a")])
    got = islands.gap_sessions(w).groupBy("session").count().orderBy("session").collect()
    assert [r["count"] for r in got] == [2, 1, 1, 1, 1]
    merged = folds.merge_short_sessions(w).orderBy("session").collect()
    assert [(r.n_words, r.start_ms, r.end_ms) for r in merged] == [(3, 0, 1000), (3, 9000, 10500)]


def test_segments_split_where_they_should(spark):
    w = words(spark, [("Hello", 0, 400, "a"), ("world.", 500, 900, "a"), ("The", 1000, 1200, "a"), ("dog", 3000, 3300, "a"), ("ran", 3400, 3800, "a"), ("Now", 3900, 4200, "b")])
    got = [r.text for r in folds.segment_words(w).orderBy("segment").collect()]
    assert got == ["Hello world.", "The dog ran", "Now"]  # no split after an article, one at a new speaker
    w = words(spark, [("Ask", 0, 400, "a"), ("my", 500, 700, "a"), ("old", 800, 900, "a"), ("friend", 1000, 1200, "a"), ("Mr.", 1300, 1500, "a"), ("Smith", 1600, 1900, "a"), ("there.", 2000, 2300, "a"), ("Yes.", 2400, 2700, "a")])
    assert [r.text for r in folds.segment_words(w).orderBy("segment").collect()] == ["Ask my old friend Mr. Smith there.", "Yes."]


def test_bilingual_groups_use_each_source_once(spark):
    rows = [(1, "en", 1, "a", "one", 0, 2000), (1, "en", 2, "a", "two", 2000, 4000), (1, "en", 3, "a", "three", 8000, 9000), (1, "zh", 1, "a", "一", 300, 2300), (1, "zh", 2, "a", "二", 1800, 3900)]
    got = [(r.target_no, r.source_no, r.start_ms, r.end_ms) for r in matching.bilingual_groups(spark.createDataFrame(rows, CUE)).orderBy("group_no").collect()]
    assert got == [(1, 1, 300, 2300), (2, 2, 1800, 3900), (None, 3, 8000, 9000)]


def test_batches_against_loops(spark):
    rows = spark.createDataFrame([(1, n) for n in range(11)], "k long, n long")
    got = {(r.batch, r.n, r.context) for r in sets.batches(rows, ["k"], "n", 4, 2).collect()}
    assert got == {(b, n, n // 4 != b) for b in range(3) for n in range(11) if 4 * b - 2 <= n <= 4 * b + 5}


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 400_000_000))
def test_time_codes_round_trip(spark, ms):
    r = spark.range(1).select(C.parse(C.to_srt(F.lit(ms))).alias("a"), C.parse(C.to_vtt(F.lit(ms))).alias("b"), C.parse(C.to_ass(F.lit(ms))).alias("c"), C.parse(F.lit("nonsense")).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == (ms, ms, ms // 10 * 10, None)


def test_formats_round_trip(spark):
    c = cues(spark, [("en", "One\nline", 0, 1500), ("en", "Two, with comma", 3_661_001, 3_662_000)])
    for write, parse in ((subtitles.write_srt, subtitles.parse_srt), (subtitles.write_vtt, subtitles.parse_vtt)):
        got = parse(write(c, ["media_id"]), "content", ["media_id"]).orderBy("index").collect()
        assert [(r["index"], r.start_ms, r.end_ms, r.text) for r in got] == [(1, 0, 1500, "One\nline"), (2, 3_661_001, 3_662_000, "Two, with comma")]
    got = subtitles.parse_ass(subtitles.write_ass(c, ["media_id"]), "content", ["media_id"]).orderBy("index").collect()
    assert [(r.start_ms, r.text) for r in got] == [(0, "One\nline"), (3_661_000, "Two, with comma")]


def test_readers_are_lenient(spark):
    bad = "﻿1\r\n00:00:01,000 --> 00:00:02,000\r\nOk\r\n\r\n00:00:03,000 --> 00:00:04,000\r\nNo number\r\n\r\n3\r\nbad --> worse\r\nx\r\n\r\n4\r\n00:00:05,000 --> 00:00:06,000\r\n\r\n"
    got = subtitles.parse_srt(spark.createDataFrame([(1, bad), (2, ""), (3, None)], "f long, content string"), "content", ["f"]).orderBy("index").collect()
    assert [(r.f, r["index"], r.text) for r in got] == [(1, 1, "Ok"), (1, 2, "No number")]
    vtt = "WEBVTT\n\n00:01.500 --> 00:02.000 align:start line:0%\nHi\n"
    r = subtitles.parse_vtt(spark.createDataFrame([(1, vtt)], "f long, content string"), "content", ["f"]).first()
    assert (r.start_ms, r.settings, r.text) == (1500, "align:start line:0%", "Hi")


def test_json_readers(spark):
    t = spark.createDataFrame([(1, '{"format":"x-transcript-v1","words":[{"text":" a","start":0.5,"end":0.9}]}')], "f long, content string")
    r = subtitles.parse_transcript(t, "content", ["f"], "x-transcript").first()
    assert (r.word_no, r.text, r.confidence) == (1, " a", 0.0)
    j = spark.createDataFrame([(1, '[{"id":"c1","start":1,"end":2,"zh_text":"你"}]'), (2, '{"cues":[{"cue_id":"k","text":"t","language":"en"}]}')], "f long, content string")
    assert [(r.cue_id, r.text, r.lang) for r in subtitles.parse_cue_json(j, "content", ["f"]).orderBy("f").collect()] == [("c1", "你", None), ("k", "t", "en")]
    reply = spark.createDataFrame([('Sure:\n```json\n{"a": 1}\n```',), ("none",)], "r string").select(subtitles.lenient_json(F.col("r"), "STRUCT<a INT>").alias("x")).collect()
    assert [r.x and r.x.a for r in reply] == [1, None]


def test_silence_log(spark):
    log = spark.createDataFrame([(1, 1, "silence_start: 3.5"), (1, 2, "noise"), (1, 3, "silence_end: 5.0 | silence_duration: 1.5"), (1, 4, "silence_start: 9")], "f long, n long, line string")
    assert [(r.start, r.end) for r in subtitles.parse_silences(log, "line", ["f"], "n").collect()] == [(3.5, 5.0)]


def test_similarity_and_ranges(spark):
    r = spark.createDataFrame([("abcd", "bcde"), (None, "x")], "a string, b string").select(seq_ratio("a", "b").alias("x")).collect()
    assert r[0].x == SequenceMatcher(None, "abcd", "bcde").ratio() and r[1].x is None
    header = spark.createDataFrame([("bytes=0-9",), ("bytes=5-",), ("bytes=-3",), ("bytes=200-",), ("x",)], "h string")
    first, last = byte_range(F.col("h"), F.lit(100))
    assert [(r.a, r.b) for r in header.select(first.alias("a"), last.alias("b")).collect()] == [(0, 9), (5, 99), (97, 99), (None, None), (None, None)]


def test_text_functions(spark):
    r = spark.range(1).select(T.slugify(F.lit("  Héllo, wörld!  ")).alias("a"), T.strip_punctuation_zh(F.lit("你好，世界。")).alias("b"), T.smart_join(F.array(F.lit("你"), F.lit("好"))).alias("c"), T.annotation_term(F.lit("※ term：text")).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == ("Héllo_wörld", "你好 世界", "你好", "term")


def test_lines_and_layout(spark):
    assert folds.break_line("short one") == "short one"
    first, second = folds.break_line("This is a longer line of text, and it should be in two parts").split("\n")
    assert first == "This is a longer line of text," and len(second) <= 42
    c = cues(spark, [("en", "A full sentence.", 0, 1000), ("en", "and so", 1100, 1500), ("en", "Far off", 5000, 6000)])
    got = [(r.cue_no, r.n_cues, r.end_ms, r.text) for r in layout.layout(c, spark.createDataFrame([], "word string, freq long")).orderBy("cue_no").collect()]
    assert got == [(1, 2, 1500, "A full sentence. and so"), (3, 1, 6000, "Far off")]
    one = spark.createDataFrame([("a b",), (None,)], "t string").select(folds.break_lines("t").alias("x")).collect()
    assert [r.x for r in one] == ["a b", None]


def test_replies_are_checked(spark):
    from cueloom.plans import review

    replies = spark.createDataFrame([(1, 'Sure: [{"batch_index": 0, "text": "x"}, {"batch_index": 2, "text": "a"}, {"batch_index": 2, "text": "b"}]'), (2, "no idea"), (3, None)], "k long, reply string")
    got = review.items(replies, "translate", ["k"]).select("k", review.F.col("batch_index").alias("i"), "text")
    want = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0)], "k long, i int")
    assert {(r.k, r.i): r.state for r in review.resolve(want, got, ["k", "i"]).collect()} == {(1, 0): "ok", (1, 1): "missing", (1, 2): "duplicate", (2, 0): "missing"}
    s = review.overall(spark.createDataFrame([(2.0, -1.0, None, 0.5)], "accuracy double, fluency double, consistency double, compression double")).first()
    assert s.overall == 0.4 * 1 + 0.3 * 0 + 0.15 * 0.5 + 0.15 * 0.5


def test_artifacts(spark):
    from cueloom.sources import artifacts

    text = '{"transcription":[{"tokens":[{"text":"[_BEG_]","offsets":{"from":0,"to":0}},{"text":" Hi","offsets":{"from":10,"to":20},"p":0.5},{"text":" "}]}]}'
    other = '{"segments":[{"words":[{"word":"yo","start":1.5,"end":2.0}]}]}'
    got = artifacts.parse_recogniser_json(spark.createDataFrame([(1, text), (2, other)], "f long, c string"), "c", ["f"]).orderBy("f").collect()
    assert [(r.f, r.word_no, r.text, r.start_ms, r.end_ms, r.confidence) for r in got] == [(1, 1, " Hi", 10, 20, 0.5), (2, 1, "yo", 1500, 2000, 0.0)]
    frames = spark.createDataFrame([(1, "0.000,K__"), (1, "0.040,___"), (1, "2.000,K__")], "f long, l string")
    assert sorted(r.key_ms for r in artifacts.parse_keyframes(frames, "l", ["f"]).collect()) == [0, 2000]
    saved = spark.createDataFrame([(1, '{"segments_fingerprint":"a","cues":[{"unit_id":"u1","text":"x"}]}'), (2, '{"segments_fingerprint":"old","cues":[{"unit_id":"u2"}]}'), (3, '[{"unit_id":"u3","text":"y"}]')], "f long, c string")
    assert {r.unit_id for r in artifacts.load_partial(saved, "c", ["f"], F.lit("a")).collect()} == {"u1", "u3"}
    groups = spark.createDataFrame([(1, 0, 1000, "你好", "hi  there"), (1, 1000, 2000, None, "only"), (1, 2000, 3000, "", None)], "f long, start_ms long, end_ms long, target string, source string")
    assert artifacts.bilingual_ass(groups, ["f"]).first().content.split("\n") == ["Dialogue: 0,0:00:00.00,0:00:01.00,Default,,0,0,0,,你好\\N{\\fs14}hi there", "Dialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,{\\fs14}only"]


def test_terminology_is_substring_containment(spark):
    from cueloom.plans import qc

    texts = [("zh", "使用transformer模型"), ("zh", "用 .NET 写"), ("zh", "large\nLanguage model"), ("zh", "没有"), ("en", "the 模型 is pretransformers"), ("en", "a\n"), ("zh", "")]
    terms = [("Transformer", "模型"), (".net", "的"), ("large language", ""), ("transformers", "form"), ("用", "ab"), ("a", "a ")]
    got = sorted((r.cue_no, r.term) for r in qc.terminology(cues(spark, [(lang, t, 0, 1) for lang, t in texts]), spark.createDataFrame(terms, "source string, target string")).collect())
    want = sorted({(n, term) for n, (lang, text) in enumerate(texts, 1) for pair in terms for term, of_source in zip(pair, (True, False)) if term and (lang != "en") == of_source and term.lower() in text.replace("\n", " ").lower()})
    assert got == want and {(1, "Transformer"), (2, ".net"), (3, "large language"), (6, "a ")} <= set(got)


def test_redistributed_times_follow_the_words(spark):
    spec = [("a", 100, 120, "x"), ("b", 900, 1000, "x"), ("c", 1700, 1940, "y")]
    for m in (1, 2, 3, 4, 7):
        counts = spark.createDataFrame([(1, 0, m)], "media_id long, turn long, m long")
        got = folds.redistribute_timing(words(spark, spec), counts).orderBy("k").collect()
        bounds = [100] + [e for _, _, e, _ in spec]
        at = [100.0] + [bounds[k * 3 // m] * (1 - k * 3 / m % 1) + bounds[k * 3 // m + 1] * (k * 3 / m % 1) for k in range(1, m)] + [1940.0]
        assert [round(r.start_ms, 6) for r in got] == [round(t, 6) for t in at[:-1]] and [round(r.end_ms, 6) for r in got] == [round(t, 6) for t in at[1:]]
        assert [r.speaker for r in got] == [spec[k * 3 // m][3] for k in range(m)] and {round(r.confidence, 9) for r in got} == {0.9}
