"""The registered queries on the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueloom import adapters as A
from cueloom.config import QCConfig
from cueloom.functions import text as T
from cueloom.functions import timecode
from cueloom.functions.interval import byte_range
from cueloom.operators import entry, folds, hanlines, intervals, islands, layout, matching, overlong, pacing, segmentation, sets, wordindex
from cueloom.plans import corrections, qc, review, rollups, runs, units
from cueloom.rules import cue_rules as R
from cueloom.rules.registry import check
from cueloom.sources import artifacts, mixed, subtitles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
CONFIG = QCConfig()


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; sql follows ``WITH RECURSIVE <adapter views>``."""
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = f"WITH RECURSIVE {A.SQL}{sql}"
        return f

    return add


# Rules on cues: one query for each, all through the shared cue context.

CJK_N = f"length(regexp_replace({{}}, '[^{T.CJK[1:-1]}]', '', 'g'))"
STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_quoted = lambda items: ", ".join(f"'{x}'" for x in items)
_CTX = """, ctx AS (
  SELECT *, end_ms - start_ms AS dur, string_split(text, chr(10)) AS lines, lag(start_ms) OVER w AS prev_start_ms,
    lag(end_ms) OVER w AS prev_end_ms, lag(text) OVER w AS prev_text, lag(speaker) OVER w AS prev_speaker,
    lead(start_ms) OVER w AS next_start_ms, regexp_replace(replace(text, chr(10), ''), '^\\s+|\\s+$', '', 'g') AS flat,
    regexp_replace(string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10))[-1], '^\\s+|\\s+$', '', 'g') AS last
  FROM rule_cues WINDOW w AS (PARTITION BY media_id, lang ORDER BY cue_no)
), by_line AS (
  SELECT *, unnest(lines) AS line, unnest(range(len(lines))) AS k FROM ctx
), by_pair AS (SELECT *, lines[k + 2] AS next_line FROM by_line WHERE k + 1 < len(lines))
"""
_WORDS = "list_distinct(list_filter(list_transform(regexp_extract_all({}, '[a-zA-Z]+'), lambda w: lower(w)), lambda w: length(w) >= 4 AND NOT list_contains([" + _quoted(R.OVERLAP_STOP_WORDS) + "], w)))"
_L = R.LETTERS
_WHOLE = {
    "MaxLines": ("'error'", f"len(lines) > CASE WHEN lang = 'zh' THEN {CONFIG.max_lines_zh} ELSE {CONFIG.max_lines} END"),
    "ReadingSpeed": ("'error'", f"dur > 0 AND CASE WHEN lang = 'zh' THEN {CJK_N.format('text')} * 1000 > {CONFIG.cps_limit} * dur ELSE length(replace(text, chr(10), '')) * 1000 > {CONFIG.cps_limit_en} * dur END"),
    "MinDuration": ("'error'", "dur < 790"),
    "MaxDuration": ("CASE WHEN dur > 9000 THEN 'warning' ELSE 'suggestion' END", "dur > 7000"),
    "EmptyText": ("'error'", f"{STRIP.format('text')} = ''"),
    "TinyCue": ("'error'", f"length(flat) BETWEEN 1 AND 3 AND NOT (lang = 'zh' AND flat IN ({_quoted(R.TINY_STANDALONE)})) AND NOT (lang = 'en' AND regexp_full_match(regexp_replace(flat, '[.!?]', '', 'g'), '\\p{{L}}+'))".replace("{{L}}", "{L}")),
    "UntranslatedText": ("'error'", "lang = 'zh' AND len(list_filter(regexp_extract_all(text, '[a-zA-Z]+'), lambda w: length(w) > 2)) >= 4"),
    "SemanticBreaks": ("'suggestion'", "len(lines) = 2 AND ((lang = 'zh' AND length(lines[1]) <= 3 AND length(lines[2]) >= 10) OR (lang = 'en' AND length(lines[1]) <= 5 AND length(lines[2]) >= 20))"),
    "LineImbalance": ("'suggestion'", f"lang = 'zh' AND len(lines) = 2 AND least(length({STRIP.format('lines[1]')}), length({STRIP.format('lines[2]')})) > 0 AND 10 * abs(length({STRIP.format('lines[1]')}) - length({STRIP.format('lines[2]')})) > 6 * greatest(length({STRIP.format('lines[1]')}), length({STRIP.format('lines[2]')}))"),
    "CJKSpaceAnomaly": ("'error'", f"lang = 'zh' AND regexp_matches(text, '{T.CJK} {{2,}}{T.CJK}')"),
    "OrphanWordsIntra": ("'error'", f"len(lines) = 2 AND ((lang = 'en' AND {STRIP.format('lines[2]')} <> '' AND NOT regexp_matches({STRIP.format('lines[2]')}, '\\s')) OR (lang = 'zh' AND length({STRIP.format('lines[2]')}) <= 2))"),
    "OrphanWordsCross": ("'warning'", f"length(flat) <= 5 AND start_ms - prev_end_ms BETWEEN 0 AND 500 AND flat NOT IN ({_quoted(R.TRAILING_STANDALONE)}) AND NOT regexp_matches(flat, '^({'|'.join(R.SENTENCE_STARTS)})') AND NOT regexp_matches(regexp_replace(string_split(regexp_replace(prev_text, '^\\s+|\\s+$', '', 'g'), chr(10))[-1], '^\\s+|\\s+$', '', 'g'), '[？！…]$')"),
    "TranslationesePatterns": ("'suggestion'", "(lang = 'en' AND regexp_matches(lower(text), '" + "|".join(R.MT_PATTERNS_EN) + "')) OR (lang = 'zh' AND regexp_matches(text, '(^|[^\\p{L}\\p{N}_])(" + "|".join(p[2:-2] for p in R.TRANSLATIONESE_ZH) + ")($|[^\\p{L}\\p{N}_])'))"),
    "FillerWords": ("'suggestion'", f"regexp_matches(lower(text), '{'|'.join(R.FILLERS)}')"),
    "SingleCharacter": ("'warning'", f"lang = 'zh' AND regexp_full_match(flat, '{T.CJK}')"),
    "Overlap": ("'error'", "start_ms < prev_end_ms"),
    "GapFlash": ("'error'", "start_ms - prev_end_ms >= 0 AND start_ms - prev_end_ms < 100"),
    "TimelineGap": ("'error'", "start_ms - prev_end_ms > 0 AND start_ms - prev_end_ms < 100 AND coalesce(speaker = prev_speaker, true)"),
    "MissingPunctuation": ("'suggestion'", f"lang = 'zh' AND last <> '' AND NOT regexp_matches(last, '[{T.SENTENCE_ENDS_ZH}]$') AND coalesce(next_start_ms > end_ms + 800, true) AND regexp_matches(last, '{'|'.join(R.QUESTION_HINTS + R.EXCLAMATION_HINTS)}')"),
    "OverlappingContent": ("'warning'", f"lang = 'en' AND length({STRIP.format('text')}) >= 6 AND length({STRIP.format('prev_text')}) >= 6 AND len(list_distinct(list_concat({_WORDS.format('text')}, {_WORDS.format('prev_text')}))) > 0 AND 10 * len(list_intersect({_WORDS.format('text')}, {_WORDS.format('prev_text')})) >= 3 * len(list_distinct(list_concat({_WORDS.format('text')}, {_WORDS.format('prev_text')})))"),
    "BoundaryRepetition": ("'warning'", " OR ".join(f"(length(flat) >= {n} AND length({STRIP.format('replace(prev_text, chr(10), chr(0))').replace('chr(0)', repr(''))}) >= {n} AND right({STRIP.format('replace(prev_text, chr(10), chr(0))').replace('chr(0)', repr(''))}, {n}) = left(flat, {n}) AND regexp_matches(left(flat, {n}), '{T.HAN_BASIC}'))" for n in (2, 3))),
}
_LINES = {
    "ChineseLineLength": ("suggestion", "by_line", f"lang = 'zh' AND {CJK_N.format('line')} > {CONFIG.max_chars_per_line_zh}"),
    "EnglishLineLength": ("error", "by_line", f"lang = 'en' AND length(line) > {CONFIG.max_chars_per_line_en}"),
    "LeadingPunctuation": ("suggestion", "by_line", f"lang = 'zh' AND regexp_matches({STRIP.format('line')}, '^[{T.SENTENCE_ENDS_ZH}]')"),
    "PunctuationMidLine": ("error", "by_line", f"lang = 'zh' AND regexp_matches(line, '^[^。]*。\\s*{T.CJK}')"),
    "AcronymSplit": ("error", "by_pair", "lang = 'zh' AND regexp_matches(line, '[A-Z]\\s*$') AND regexp_matches(next_line, '^\\s*[A-Z]')"),
    "NumberSplit": ("error", "by_pair", "lang = 'zh' AND regexp_matches(line, '\\d{2,}\\s*$') AND regexp_matches(next_line, '^\\s*\\d')"),
    "WordSplitEnglish": ("error", "by_pair", f"lang = 'zh' AND length(regexp_extract(line, '([{_L}]+)$', 1)) >= 3 AND length(regexp_extract(next_line, '^([{_L}]+)', 1)) >= 1 AND lower(regexp_extract(line, '([{_L}]+)$', 1)) NOT IN ({_quoted(R.SAFE_ENGLISH)})"),
}


def _rule_sql(name: str) -> str:
    if name in _WHOLE:
        severity, condition = _WHOLE[name]
        return f"SELECT '{name}' AS rule, {severity} AS severity, media_id, lang, cue_no, 0::INTEGER AS sub_no FROM ctx WHERE {condition}"
    severity, source, condition = _LINES[name]
    return f"SELECT '{name}' AS rule, '{severity}' AS severity, media_id, lang, cue_no, k::INTEGER AS sub_no FROM {source} WHERE {condition}"


def _snake(name: str) -> str:
    return "qc_" + re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


for _name in [*_WHOLE, *_LINES]:
    query(_snake(_name), _CTX + _rule_sql(_name))(lambda s, d, n=_name: check(A.rule_cues(s, d), CONFIG, [n]))

_REPORT = " UNION ALL ".join(_rule_sql(n) for n in qc.REPORT_RULES)


@query("qc_report", f"{_CTX}SELECT rule, severity, count(*) AS n FROM ({_REPORT}) GROUP BY ALL")
def _(s, d):
    return qc.report(A.rule_cues(s, d))


@query("qc_summary", f"{_CTX}SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'suggestion') AS suggestions, count(*) FILTER (severity = 'error') = 0 AS passed FROM ({_REPORT})")
def _(s, d):
    return qc.summary(A.rule_cues(s, d))


@query("qc_consecutive_fragments", """, x AS (
  SELECT *, regexp_matches(regexp_replace(text, '\\s+$', ''), '[.!?。？！…]$') AS ends FROM rule_cues WHERE lang = 'en'
), r AS (SELECT *, sum(ends::INTEGER) OVER (PARTITION BY media_id ORDER BY cue_no) AS run FROM x)
SELECT media_id, min(cue_no) AS cue_no, count(*) AS n FROM r WHERE NOT ends GROUP BY media_id, run HAVING count(*) >= 2""")
def _(s, d):
    return qc.fragment_runs(A.rule_cues(s, d), least=2)


@query("qc_consecutive_fragments_5", """, x AS (
  SELECT *, regexp_matches(regexp_replace(text, '\\s+$', ''), '[.!?。？！…]$') AS ends FROM rule_cues WHERE lang = 'en'
), r AS (SELECT *, sum(ends::INTEGER) OVER (PARTITION BY media_id ORDER BY cue_no) AS run FROM x)
SELECT media_id, min(cue_no) AS cue_no, count(*) AS n FROM r WHERE NOT ends GROUP BY media_id, run HAVING count(*) >= 5""")
def _(s, d):
    return qc.fragment_runs(A.rule_cues(s, d))


@query("qc_similar_neighbours")
def _(s, d):
    return qc.similar_neighbours(A.rule_cues(s, d))


# Words and cues.

_ALIGN = """, met AS (
  SELECT w.*, c.lang, c.cue_no, c.start_ms AS c_start, c.end_ms AS c_end,
    greatest(least(greatest(w.end_ms, w.start_ms + 1), c.end_ms) - greatest(w.start_ms, c.start_ms), 0) AS overlap_ms
  FROM words w JOIN word_cues c ON w.media_id = c.media_id AND w.start_ms BETWEEN c.start_ms - 120 AND c.end_ms + 120
), aligned AS (
  SELECT *, greatest(end_ms, start_ms + 1) AS w_end FROM met
  QUALIFY row_number() OVER (PARTITION BY media_id, word_no ORDER BY overlap_ms DESC, lang, cue_no) = 1
), ord AS (
  SELECT *, row_number() OVER w AS k, lead(start_ms) OVER w - w_end AS gap FROM aligned
  WINDOW w AS (PARTITION BY media_id, lang, cue_no ORDER BY word_no)
), m AS (
  SELECT media_id, lang, cue_no, c_start, c_end, count(*) AS n_words, max(start_ms) FILTER (k = 1) AS first_start, max(w_end) AS last_end,
    max(w_end) FILTER (w_end <= c_end) AS last_inside, count(DISTINCT speaker) AS speakers, max(confidence) FILTER (k = 1) AS first_confidence,
    max(confidence) FILTER (k BETWEEN 2 AND 6) AS next_confidence, max(gap) FILTER (k = 1) AS first_gap,
    max(length(text)) FILTER (k = 1) AS first_length, max(w_end - start_ms) FILTER (k = 1) AS first_ms
  FROM ord GROUP BY ALL
)
"""


def _both(s, d):
    return A.words(s, d), A.word_cues(s, d)


@query("align_words", _ALIGN + "SELECT media_id, word_no, lang, cue_no, overlap_ms FROM aligned")
def _(s, d):
    return intervals.align_words(*_both(s, d), CONFIG.alignment_tolerance).select("media_id", "word_no", "lang", "cue_no", "overlap_ms")


@query("uncovered_words", _ALIGN + "SELECT media_id, word_no, text FROM words ANTI JOIN aligned USING (media_id, word_no)")
def _(s, d):
    return qc.uncovered_words(*_both(s, d))


@query("uncovered_report", _ALIGN + """, u AS (
  SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY word_no) AS n FROM words ANTI JOIN aligned USING (media_id, word_no)
) SELECT media_id, n, text FROM u WHERE n <= 30
UNION ALL SELECT media_id, 31, '… ' || count(*) || ' more' FROM u WHERE n > 30 GROUP BY media_id""")
def _(s, d):
    return qc.uncovered_report(*_both(s, d))


@query("coverage", _ALIGN + """SELECT media_id, count(*) AS words, count(*) FILTER (a.word_no IS NULL) AS uncovered,
  1 - count(*) FILTER (a.word_no IS NULL) / greatest(count(*), 1) >= 0.95 AS covered
FROM words LEFT JOIN (SELECT media_id, word_no FROM aligned) a USING (media_id, word_no) GROUP BY media_id""")
def _(s, d):
    return qc.coverage(*_both(s, d))


@query("qc_entry_accuracy", _ALIGN + """SELECT media_id, lang, cue_no, off_ms, CASE WHEN off_ms > w THEN 'warning' ELSE 'suggestion' END AS severity
FROM (SELECT *, abs(c_start - first_start) AS off_ms, CASE WHEN lang = 'zh' THEN 500 ELSE 300 END AS w, CASE WHEN lang = 'zh' THEN 300 ELSE 150 END AS s FROM m)
WHERE off_ms > s""")
def _(s, d):
    return qc.entry_accuracy(qc.word_measures(*_both(s, d)))


@query("qc_entry_confidence", _ALIGN + """SELECT media_id, lang, cue_no, CASE WHEN diff >= 50 OR (first_length <= 5 AND first_ms > 800) OR first_gap > 500
  THEN 'warning' ELSE 'suggestion' END AS severity FROM (SELECT *, round((next_confidence - first_confidence) * 100) AS diff FROM m)
WHERE first_confidence < 0.4 AND next_confidence >= 0.7 AND diff >= 30""")
def _(s, d):
    return qc.entry_confidence(qc.word_measures(*_both(s, d)))


@query("qc_exit_precision", _ALIGN + """SELECT media_id, lang, cue_no, c_end - last_inside AS padding_ms,
  CASE WHEN c_end - last_inside > 1000 THEN 'error' ELSE 'suggestion' END AS severity FROM m
WHERE c_end - last_inside > 1000 OR c_end - last_inside < CASE WHEN lang = 'zh' THEN 80 ELSE 120 END""")
def _(s, d):
    return qc.exit_precision(qc.word_measures(*_both(s, d)))


@query("qc_reading_padding", _ALIGN + "SELECT media_id, lang, cue_no, c_end - last_inside AS padding_ms FROM m WHERE c_end - last_inside < 150 OR c_end - last_inside > 1000")
def _(s, d):
    return qc.reading_padding(qc.word_measures(*_both(s, d)))


@query("qc_speaker_consistency", _ALIGN + "SELECT media_id, lang, cue_no, speakers FROM m WHERE speakers > 1")
def _(s, d):
    return qc.speaker_consistency(qc.word_measures(*_both(s, d)))


@query("qc_padding_conflict", _ALIGN + """SELECT media_id, lang, cue_no, gap_ms FROM (
  SELECT *, lead(first_start) OVER w - last_end AS gap_ms, lead(cue_no) OVER w AS nn FROM m WINDOW w AS (PARTITION BY media_id, lang ORDER BY cue_no)
) WHERE nn = cue_no + 1 AND gap_ms > 0 AND gap_ms < 300 AND c_end - last_end > gap_ms""")
def _(s, d):
    return qc.padding_conflict(qc.word_measures(*_both(s, d)))


@query("qc_word_gap_anomaly", _ALIGN + """, g AS (
  SELECT media_id, lang, cue_no, median(gap) FILTER (gap > 0) AS md, count(*) AS n, count(*) FILTER (gap > 0) AS positive FROM ord GROUP BY ALL
) SELECT media_id, lang, cue_no, word_no, gap AS gap_ms FROM ord JOIN g USING (media_id, lang, cue_no)
WHERE n >= 3 AND positive >= 2 AND md >= 10 AND gap >= 200 AND gap > 5 * md""")
def _(s, d):
    return qc.word_gap_anomaly(*_both(s, d))


@query("speaker_assign", """, turns AS (
  SELECT media_id, turn, role AS turn_speaker, s, e FROM (SELECT media_id, turn, min(start_ms) + 100 AS s, max(end_ms) - 50 AS e FROM words GROUP BY ALL)
  JOIN (SELECT conv_id AS media_id, turn, role FROM conversations) USING (media_id, turn)
), x AS (
  SELECT w.media_id, w.word_no, t.turn_speaker, (w.start_ms + w.end_ms) // 2 BETWEEN s AND e AS holds, least(w.end_ms, e) - greatest(w.start_ms, s) AS o, t.turn
  FROM words w JOIN turns t ON w.media_id = t.media_id AND w.start_ms <= e AND w.end_ms >= s
) SELECT media_id, word_no, turn_speaker FROM x
QUALIFY row_number() OVER (PARTITION BY media_id, word_no ORDER BY holds DESC, CASE WHEN holds THEN 0 ELSE o END DESC, turn) = 1""")
def _(s, d):
    words = A.words(s, d)
    turns = words.groupBy("media_id", "turn", "speaker").agg((F.min("start_ms") + 100).alias("start_ms"), (F.max("end_ms") - 50).alias("end_ms")).withColumnRenamed("speaker", "turn_speaker")
    return folds.assign_speakers(words, turns)


@query("gap_sessions", """, s AS (
  SELECT media_id, word_no, start_ms, end_ms, sum(n) OVER (PARTITION BY media_id ORDER BY word_no) AS session FROM (
    SELECT *, coalesce(start_ms - lag(end_ms) OVER (PARTITION BY media_id ORDER BY word_no) > 500, true)::INTEGER AS n FROM words)
) SELECT media_id, session::BIGINT AS session, count(*) AS n_words, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM s GROUP BY ALL""")
def _(s, d):
    return islands.gap_sessions(A.words(s, d)).groupBy("media_id", "session").agg(F.count(F.lit(1)).alias("n_words"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


@query("event_sessions", """, e AS (
  SELECT user_id, ts, event_id, coalesce((epoch_us(ts) // 1000) - lag(epoch_us(ts) // 1000) OVER w > 28800000, true)::INTEGER AS n FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM e)
SELECT user_id, session::BIGINT AS session, count(*) AS n FROM r GROUP BY ALL""")
def _(s, d):
    x = A.table(s, d, "events").select("user_id", A.millis("ts").alias("start_ms"), A.millis("ts").alias("end_ms"), F.struct("ts", "event_id").alias("word_no"))
    return islands.gap_sessions(x, 28_800_000, ("user_id",)).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"))


# Bilingual pairs.

_PAIRS = """, pairs AS (
  SELECT l.media_id, l.cue_no AS l_cue_no, r.cue_no AS r_cue_no, l.text AS l_text, r.text AS r_text, l.end_ms - l.start_ms AS l_dur, r.end_ms - r.start_ms AS r_dur,
    least(l.end_ms, r.end_ms) - greatest(l.start_ms, r.start_ms) AS overlap_ms
  FROM bilingual l JOIN bilingual r ON l.media_id = r.media_id AND l.lang = 'en' AND r.lang <> 'en' AND least(l.end_ms, r.end_ms) - greatest(l.start_ms, r.start_ms) > 50
) """


@query("bilingual_pairs", _PAIRS + "SELECT media_id, l_cue_no, r_cue_no, overlap_ms FROM pairs")
def _(s, d):
    return qc.pairs(A.bilingual_cues(s, d)).select("media_id", "l_cue_no", "r_cue_no", "overlap_ms")


@query("bilingual_orphans", _PAIRS + """SELECT media_id, lang, cue_no FROM bilingual b WHERE NOT EXISTS (
  SELECT 1 FROM pairs p WHERE overlap_ms > 2000 AND p.media_id = b.media_id AND CASE WHEN b.lang = 'en' THEN l_cue_no ELSE r_cue_no END = b.cue_no)""")
def _(s, d):
    return qc.orphans(A.bilingual_cues(s, d), more_than=2000)


@query("bilingual_orphans_50ms", _PAIRS + """SELECT media_id, lang, cue_no FROM bilingual b WHERE NOT EXISTS (
  SELECT 1 FROM pairs p WHERE p.media_id = b.media_id AND CASE WHEN b.lang = 'en' THEN l_cue_no ELSE r_cue_no END = b.cue_no)""")
def _(s, d):
    return qc.orphans(A.bilingual_cues(s, d))


@query("completeness_units", """SELECT media_id, cue_no, 'untranslated' AS kind FROM bilingual a WHERE lang = 'en' AND NOT EXISTS (SELECT 1 FROM bilingual b WHERE b.lang = 'zh' AND b.media_id = a.media_id AND b.cue_no = a.cue_no)
UNION ALL SELECT media_id, cue_no, 'orphan' FROM bilingual a WHERE lang = 'zh' AND NOT EXISTS (SELECT 1 FROM bilingual b WHERE b.lang = 'en' AND b.media_id = a.media_id AND b.cue_no = a.cue_no)""")
def _(s, d):
    return qc.completeness(A.bilingual_cues(s, d))


@query("visual_density", _PAIRS + """SELECT media_id, l_cue_no, r_cue_no, chars, overlap_ms FROM (
  SELECT *, length(replace(l_text, chr(10), '')) + length(replace(r_text, chr(10), '')) AS chars FROM pairs) WHERE chars * 1000 > 18 * overlap_ms""")
def _(s, d):
    return qc.visual_density(A.bilingual_cues(s, d))


@query("combined_speed", _PAIRS + f"SELECT media_id, l_cue_no, r_cue_no FROM pairs WHERE l_dur > 0 AND r_dur > 0 AND (length(replace(l_text, chr(10), '')) * 1000 > 25 * l_dur OR {CJK_N.format('r_text')} * 1000 > 9 * r_dur)")
def _(s, d):
    return qc.combined_speed(A.bilingual_cues(s, d))


@query("line_balance", _PAIRS + """SELECT media_id, l_cue_no, r_cue_no, CASE WHEN diff > 2 THEN 'error' ELSE 'suggestion' END AS severity FROM (
  SELECT *, abs(len(string_split(l_text, chr(10))) - len(string_split(r_text, chr(10)))) AS diff FROM pairs) WHERE diff >= 2""")
def _(s, d):
    return qc.line_balance(A.bilingual_cues(s, d))


@query("number_loss", _PAIRS + """SELECT media_id, l_cue_no, r_cue_no, array_to_string(list_sort(lost), ',') AS lost FROM (
  SELECT *, list_filter(list_distinct(regexp_extract_all(l_text || ' 42 of ' || l_cue_no, '\\d+')), lambda n: NOT contains(r_text || ' ' || r_cue_no, n)) AS lost FROM pairs) WHERE len(lost) > 0""")
def _(s, d):
    x = A.bilingual_cues(s, d)
    return qc.number_loss(x.withColumn("text", F.concat("text", F.when(F.col("lang") == "en", " 42 of ").otherwise(" "), "cue_no")))


@query("bilingual_groups", """, met AS MATERIALIZED (SELECT t.media_id, t.cue_no AS t, s.cue_no AS s, row_number() OVER (PARTITION BY t.media_id ORDER BY least(t.end_ms, s.end_ms) - greatest(t.start_ms, s.start_ms) DESC, t.cue_no, s.cue_no) AS k
    FROM bilingual t JOIN bilingual s ON t.media_id = s.media_id AND t.lang = 'zh' AND s.lang = 'en' AND least(t.end_ms, s.end_ms) > greatest(t.start_ms, s.start_ms)),
  greedy AS (SELECT DISTINCT media_id, 0::BIGINT AS k, []::BIGINT[] AS ts, []::BIGINT[] AS ss, false AS is_, NULL::BIGINT AS t, NULL::BIGINT AS s FROM met
    UNION ALL SELECT media_id, k, CASE WHEN f THEN list_append(ts, t) ELSE ts END, CASE WHEN f THEN list_append(ss, s) ELSE ss END, f, t, s
      FROM (SELECT m.media_id, m.k, ts, ss, m.t, m.s, NOT list_contains(ts, m.t) AND NOT list_contains(ss, m.s) AS f FROM greedy g JOIN met m ON m.media_id = g.media_id AND m.k = g.k + 1)),
  mates AS MATERIALIZED (SELECT media_id, t, s FROM greedy WHERE is_),
  groups AS (SELECT b.media_id, b.cue_no AS target_no, m.s AS source_no, start_ms, end_ms FROM bilingual b LEFT JOIN mates m ON m.media_id = b.media_id AND m.t = b.cue_no WHERE lang = 'zh'
    UNION ALL SELECT media_id, NULL, cue_no, start_ms, end_ms FROM bilingual b WHERE lang = 'en' AND NOT EXISTS (SELECT 1 FROM mates m WHERE m.media_id = b.media_id AND m.s = b.cue_no)),
  g AS MATERIALIZED (SELECT *, row_number() OVER v AS k, lead(start_ms) OVER v AS ns FROM groups WINDOW v AS (PARTITION BY media_id ORDER BY start_ms, target_no IS NULL, coalesce(target_no, source_no))),
  fit AS (SELECT DISTINCT media_id, 0::BIGINT AS k, NULL::BIGINT AS target_no, NULL::BIGINT AS source_no, 0::BIGINT AS b, 0::BIGINT AS e, false AS kept, -1::BIGINT AS until_ FROM g
    UNION ALL SELECT media_id, k, target_no, source_no, b, e2, kept2, CASE WHEN kept2 THEN e2 ELSE until_ END FROM (SELECT *, target_no IS NOT NULL OR b < e2 AS kept2 FROM (SELECT *, CASE WHEN target_no IS NULL AND end_ms > ns - 10 THEN greatest(b + 10, ns - 10) ELSE end_ms END AS e2
      FROM (SELECT g.*, f.until_, CASE WHEN g.target_no IS NULL AND f.until_ > 0 THEN greatest(g.start_ms, f.until_ + 10) ELSE g.start_ms END AS b FROM fit f JOIN g ON g.media_id = f.media_id AND g.k = f.k + 1))))
  SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY k) AS group_no, target_no, source_no, b AS start_ms, e AS end_ms FROM fit WHERE kept""")
def _(s, d):
    return matching.bilingual_groups(A.bilingual_cues(s, d))


def _whole_glossary(s: SparkSession, d: str) -> DataFrame:
    """All parts' names, and all distinct words on the target side."""
    parts = A.table(s, d, "part").select(F.col("p_name").alias("source"), F.lit("").alias("target"))
    return parts.unionByName(A.words(s, d).select(F.lit("").alias("source"), F.col("text").alias("target")).distinct())


@query("terminology_leaks", """, g AS (SELECT p_name AS term, true AS of_source FROM part UNION SELECT text, false FROM words)
SELECT DISTINCT media_id, lang, cue_no, term FROM bilingual c JOIN g ON (c.lang <> 'en') = of_source AND term <> '' AND contains(lower(replace(c.text, chr(10), ' ')), lower(term))""")
def _(s, d):
    return qc.terminology(A.bilingual_cues(s, d), _whole_glossary(s, d))


@query("shot_changes", """, cuts AS (SELECT DISTINCT user_id AS media_id, (epoch_us(ts) // 1000) % 60000 AS cut_ms FROM events)
SELECT c.media_id, lang, cue_no, min(cut_ms) AS cut_ms FROM cues c JOIN cuts k ON c.media_id = k.media_id AND cut_ms > start_ms AND cut_ms < end_ms GROUP BY ALL""")
def _(s, d):
    cuts = A.table(s, d, "events").select(F.col("user_id").alias("media_id"), (A.millis("ts") % 60_000).alias("cut_ms")).distinct()
    return qc.shots(A.cues(s, d), cuts)


# Units, chains and clean-up.

_BARE = STRIP.format("text")
_ABBREVIATED = "regexp_extract(" + _BARE + ", '(\\p{L}+(?:\\.\\p{L}+)*)\\.$', 1)"
_ENDS = f"""({_BARE} = '' OR (regexp_matches({_BARE}, '[.!?。？！…]$') AND NOT ({_ABBREVIATED} <> '' AND lower({_ABBREVIATED}) NOT IN ({_quoted(T.SPOKEN_FILLERS)})
  AND (lower({_ABBREVIATED}) IN ({_quoted(T.ABBREVIATIONS)}) OR (contains({_ABBREVIATED}, '.') AND upper({_ABBREVIATED}) = {_ABBREVIATED} AND lower({_ABBREVIATED}) <> {_ABBREVIATED})
    OR (length({_ABBREVIATED}) <= 3 AND regexp_matches({_ABBREVIATED}, '^\\p{{Lu}}'))))))"""


@query("compose_units", f""", x AS (
  SELECT *, {_ENDS} AS whole, len(regexp_split_to_array({STRIP.format('text')}, '\\s+')) AS n_words FROM segments
), j AS (
  SELECT *, coalesce(lag(speaker) OVER w = speaker AND start_ms - lag(end_ms) OVER w <= 3000 AND (NOT lag(whole) OVER w OR (n_words <= 3 AND NOT whole)), false) AS joins
  FROM x WINDOW w AS (PARTITION BY media_id ORDER BY seq)
), u AS (SELECT *, sum((NOT joins)::INTEGER) OVER (PARTITION BY media_id ORDER BY seq) AS unit_no FROM j)
SELECT media_id, unit_no::BIGINT AS unit_no, CASE WHEN count(*) = 1 THEN min_by(unit_id, seq) ELSE 'm' || min_by(unit_id, seq) || '_' || max_by(unit_id, seq) END AS unit_id,
  min(start_ms) AS start_ms, max_by(end_ms, seq) AS end_ms, count(*) AS n_segments FROM u GROUP BY media_id, unit_no""")
def _(s, d):
    return islands.compose_units(A.segments(s, d))


@query("merge_chains", """, x AS (
  SELECT *, coalesce(NOT lag(cue_no % 3 <> 0) OVER w, true)::INTEGER AS n FROM cues WINDOW w AS (PARTITION BY media_id, lang ORDER BY cue_no)
), c AS (SELECT *, sum(n) OVER (PARTITION BY media_id, lang ORDER BY cue_no) AS chain FROM x),
y AS (SELECT *, max(end_ms) OVER w - min(start_ms) OVER w > 14000 AS apart FROM c WINDOW w AS (PARTITION BY media_id, lang, chain))
SELECT media_id, lang, min(cue_no) AS cue_no, count(*) AS n_cues, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM y GROUP BY media_id, lang, chain, CASE WHEN apart THEN cue_no ELSE -1 END""")
def _(s, d):
    return islands.merge_chains(A.cues(s, d), F.col("cue_no") % 3 != 0, CONFIG.max_duration)


@query("overlap_dedup", """SELECT media_id, lang, cue_no, start_ms, end_ms FROM cues
QUALIFY coalesce(end_ms <= lead(start_ms) OVER (PARTITION BY media_id, lang ORDER BY start_ms, cue_no) + 1, true)""")
def _(s, d):
    return islands.keep_later(A.cues(s, d)).select("media_id", "lang", "cue_no", "start_ms", "end_ms")


@query("term_dedup", """SELECT media_id, cue_no, term FROM (SELECT media_id, cue_no, lower(string_split(text, ' ')[1]) AS term FROM cues)
QUALIFY row_number() OVER (PARTITION BY media_id, term ORDER BY cue_no) = 1""")
def _(s, d):
    x = A.cues(s, d).withColumn("term", F.lower(F.split("text", " ")[0]))
    return islands.first_of_term(x, F.col("term"), ("media_id",), ("cue_no",)).select("media_id", "cue_no", "term")


@query("annotation_timing", """SELECT media_id, lang, cue_no, start_ms, CASE WHEN n IS NULL THEN start_ms + reading
  ELSE least(n - 300, start_ms + reading * 13 // 10) END AS end_ms FROM (
  SELECT *, greatest(length(text), 40) * 200 AS reading, lead(start_ms) OVER (PARTITION BY media_id, lang ORDER BY cue_no) AS n FROM cues)""")
def _(s, d):
    return folds.annotation_timing(A.cues(s, d))


@query("merge_segments", """, p AS (SELECT media_id, k AS part, max(end_ms) // 2 * k AS pos, max(end_ms) // 2 AS half FROM cues, range(2) AS t(k) GROUP BY media_id, k), local AS (
  SELECT c.media_id, p.part, start_ms - greatest(pos - 10000, 0) AS s, CASE WHEN cue_no % 9 = 8 THEN start_ms - 1 ELSE end_ms END - greatest(pos - 10000, 0) AS e, text, pos, half
  FROM cues c JOIN p ON c.media_id = p.media_id AND c.start_ms >= pos - 10000 AND c.start_ms <= pos + half + 10000 AND lang = 'en')
SELECT DISTINCT media_id, s + greatest(pos - 10000, 0) AS start_ms, e + greatest(pos - 10000, 0) AS end_ms, text FROM local
WHERE e >= s AND (part = 0 OR s + greatest(pos - 10000, 0) >= pos - 500) AND (part = 1 OR s + greatest(pos - 10000, 0) <= pos + half + 500)""")
def _(s, d):
    return units.merge_parts(*_parts_of(s, d, True))


@query("merge_segments_margins", """, p AS (SELECT media_id, k AS part, max(end_ms) // 2 * k AS pos, max(end_ms) // 2 AS half FROM cues, range(2) AS t(k) GROUP BY media_id, k), local AS (
  SELECT c.media_id, p.part, start_ms - greatest(pos - 10000, 0) AS s, CASE WHEN cue_no % 9 = 8 THEN start_ms - 1 ELSE end_ms END - greatest(pos - 10000, 0) AS e, text, pos, half
  FROM cues c JOIN p ON c.media_id = p.media_id AND c.start_ms >= pos - 10000 AND c.start_ms <= pos + half + 10000 AND lang = 'en')
SELECT DISTINCT media_id, s + greatest(pos - 10000, 0) AS start_ms, e + greatest(pos - 10000, 0) AS end_ms, text FROM local
WHERE e >= s AND (part = 0 OR s >= 12000) AND (part = 1 OR s <= half + 20000 - 12000)""")
def _(s, d):
    return units.merge_parts(*_parts_of(s, d, False))


def _parts_of(s: SparkSession, d: str, known: bool) -> tuple[DataFrame, DataFrame]:
    """Each media cut in two parts that overlap by ten seconds on either side; every ninth cue ends before it starts."""
    c = A.cues(s, d)
    p = c.groupBy("media_id").agg(F.floor(F.max("end_ms") / 2).alias("half")).withColumn("part", F.explode(F.array(F.lit(0), F.lit(1))))
    p = p.withColumn("at", F.col("half") * F.col("part")).withColumn("offset_ms", F.greatest(F.col("at") - 10_000, F.lit(0)))
    when = lambda x: x if known else F.lit(None).cast("long")
    dim = p.select("media_id", "part", F.lit(2).alias("parts"), "offset_ms", (F.col("half") + 20_000).alias("part_ms"), when(F.col("at")).alias("split_from"), when(F.col("at") + F.col("half")).alias("split_to"))
    x = c.where("lang = 'en'").join(p, "media_id").where((F.col("start_ms") >= F.col("at") - 10_000) & (F.col("start_ms") <= F.col("at") + F.col("half") + 10_000))
    end = F.when(F.col("cue_no") % 9 == 8, F.col("start_ms") - 1).otherwise(F.col("end_ms"))
    return x.select("media_id", "part", (F.col("start_ms") - F.col("offset_ms")).alias("start_ms"), (end - F.col("offset_ms")).alias("end_ms"), "text"), dim


@query("low_score_groups", """, low AS (SELECT user_id AS media_id, event_id AS i FROM events WHERE value < 20), g AS (
  SELECT *, i - row_number() OVER (PARTITION BY media_id ORDER BY i) AS grp FROM low)
SELECT media_id, min(i) AS first_i, max(i) AS last_i, count(*) AS n FROM g GROUP BY media_id, grp""")
def _(s, d):
    return sets.consecutive_groups(A.table(s, d, "events").where("value < 20").select(F.col("user_id").alias("media_id"), F.col("event_id").alias("i")), ["media_id"], "i")


@query("batches_with_context", """, n AS (SELECT media_id, cue_no, row_number() OVER (PARTITION BY media_id ORDER BY cue_no) - 1 AS r FROM cues),
b AS (SELECT DISTINCT media_id, r // 4 AS batch FROM n)
SELECT b.media_id, b.batch, n.cue_no, n.r // 4 <> b.batch AS context FROM b JOIN n ON n.media_id = b.media_id AND n.r BETWEEN b.batch * 4 - 2 AND b.batch * 4 + 5""")
def _(s, d):
    return sets.batches(A.cues(s, d).select("media_id", "cue_no"), ["media_id"], "cue_no", size=4, context=2)


@query("index_completeness", """, seen AS (SELECT conv_id AS media_id, turn AS i FROM conversations WHERE (conv_id + turn) % 5 <> 0
  UNION ALL SELECT conv_id, turn FROM conversations WHERE (conv_id + turn) % 7 = 0), want AS (SELECT conv_id AS media_id, turn AS i FROM conversations)
SELECT media_id, i, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' ELSE 'duplicate' END AS kind
FROM want LEFT JOIN (SELECT media_id, i, count(*) AS n FROM seen GROUP BY ALL) USING (media_id, i) WHERE n IS NULL OR n > 1""")
def _(s, d):
    want = A.table(s, d, "conversations").select(F.col("conv_id").alias("media_id"), F.col("turn").alias("i"))
    key = F.col("media_id") + F.col("i")
    return sets.completeness(want, want.where(key % 5 != 0).unionByName(want.where(key % 7 == 0)), ["media_id", "i"])


@query("duplicate_translations", """SELECT media_id, cue_no FROM (SELECT *, cue_no // 3 AS grp FROM cues)
QUALIFY row_number() OVER (PARTITION BY media_id, grp, speaker ORDER BY start_ms, cue_no) > 1""")
def _(s, d):
    return sets.repeats(A.cues(s, d).withColumn("grp", F.floor(F.col("cue_no") / 3)), ["media_id", "grp", "speaker"], ["start_ms", "cue_no"]).select("media_id", "cue_no")


@query("replace_by_key", """, fresh AS (SELECT media_id, cue_no, text || '!' AS text FROM cues WHERE cue_no % 4 = 0)
SELECT media_id, cue_no, text FROM cues c WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.media_id = c.media_id AND f.cue_no = c.cue_no) UNION ALL SELECT * FROM fresh""")
def _(s, d):
    x = A.cues(s, d).select("media_id", "cue_no", "text")
    return sets.replace_by_key(x, x.where("cue_no % 4 = 0").withColumn("text", F.concat("text", F.lit("!"))), ["media_id", "cue_no"])


# Lookups in time.


@query("keyframe_asof", """, p AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t FROM events WHERE event_type <> 'click'), k AS (SELECT DISTINCT user_id, epoch_us(ts) // 1000 AS key_ms FROM events WHERE event_type = 'click')
SELECT user_id, event_id, t, (SELECT max(key_ms) FROM k WHERE k.user_id = p.user_id AND key_ms <= t) AS floor_key_ms FROM p""")
def _(s, d):
    e = A.table(s, d, "events").withColumn("t", A.millis("ts"))
    marks = e.where("event_type = 'click'").select("user_id", F.col("t").alias("key_ms")).distinct()
    return intervals.asof_floor(e.where("event_type <> 'click'").select("user_id", "event_id", "t"), "t", marks, "key_ms", ["user_id"])


@query("cue_at_time", """, t AS (SELECT media_id, unnest(range(0, max(end_ms) + 1, 2500)) AS t FROM cues GROUP BY media_id)
SELECT t.media_id, t, min_by(cue_no, cue_no) AS cue_no FROM t JOIN cues c ON c.media_id = t.media_id AND start_ms <= t AND t < end_ms GROUP BY ALL""")
def _(s, d):
    c = A.cues(s, d)
    t = c.groupBy("media_id").agg(F.max("end_ms").alias("last")).select("media_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"), F.lit(2500).cast("long"))).alias("t"))
    return intervals.point_join(t, "t", c, ["media_id"]).where("t < end_ms").groupBy("media_id", "t").agg(F.min("cue_no").alias("cue_no"))


@query("best_silence", """, sil AS (SELECT user_id AS media_id, event_id, (epoch_us(ts) // 1000) % 600000 AS s, floor(value * 50)::BIGINT AS len FROM events),
goal AS (SELECT DISTINCT media_id, unnest([150000, 300000, 450000]) AS target FROM sil), c AS (
  SELECT g.media_id, target, event_id, s + len AS e, len, abs(s + len // 2 - target) AS away FROM goal g JOIN sil ON sil.media_id = g.media_id AND abs(s + len // 2 - target) <= 60000),
w AS (SELECT *, CASE WHEN len >= 1500 THEN 0 WHEN away <= 30000 THEN 1 END AS pass, 4 * (60000 - away) * 5000 + 6 * least(len, 5000) * 60000 AS score FROM c)
SELECT media_id, target, e AS split_ms FROM w WHERE pass IS NOT NULL QUALIFY row_number() OVER (PARTITION BY media_id, target ORDER BY pass, score DESC, event_id) = 1""")
def _(s, d):
    sil = A.table(s, d, "events").select(F.col("user_id").alias("media_id"), F.col("event_id"), (A.millis("ts") % 600_000).alias("s"), F.floor(F.col("value") * 50).alias("len"))
    goal = sil.select("media_id").distinct().withColumn("target", F.explode(F.array(*map(F.lit, (150_000, 300_000, 450_000)))))
    return folds.best_silence(sil, goal)


# Roll-ups.

_COST = """, r(model, h, m, o) AS (VALUES ('deepseek-v4-flash', 0.0028, 0.14, 0.28), ('deepseek-v4-pro', 0.003625, 0.435, 0.87)), k AS (
  SELECT u.*, (cache_hit_tokens * h::DOUBLE + cache_miss_tokens * m::DOUBLE + completion_tokens * o::DOUBLE) / 1e6 AS b,
    (prompt_tokens * m::DOUBLE + completion_tokens * o::DOUBLE) / 1e6 AS f FROM usage u LEFT JOIN r USING (model)
), costs AS (
  SELECT *, coalesce(cost_usd, b, f) AS cost, CASE WHEN cost_usd IS NOT NULL THEN 0 WHEN b IS NOT NULL THEN 1 WHEN f IS NOT NULL THEN 2 ELSE 3 END AS rk FROM k) """


@query("usage_rollup", _COST + """SELECT step, count(*) AS calls, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(cache_hit_tokens)::BIGINT AS cache_hit_tokens,
  sum(cache_miss_tokens)::BIGINT AS cache_miss_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, round(sum(cost), 6) AS cost,
  ['api', 'api_buckets', 'fallback', 'unknown'][coalesce(min(CASE WHEN cost IS NOT NULL THEN rk END), 3) + 1] AS cost_source FROM costs GROUP BY ROLLUP (step)""")
def _(s, d):
    return rollups.usage_report(A.usage(s, d)).withColumn("cost", F.round("cost", 6))


@query("usage_cost", _COST + "SELECT model, rk AS source_rank, count(*) AS n, round(sum(cost), 6) AS cost FROM costs GROUP BY ALL")
def _(s, d):
    return rollups.cost(A.usage(s, d)).groupBy("model", "source_rank").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("cost"), 6).alias("cost"))


@query("usage_delta", """, b AS (SELECT step, sum(prompt_tokens) AS p, sum(completion_tokens) AS c FROM usage WHERE model <> 'unlisted' GROUP BY ALL), a AS (SELECT step, sum(prompt_tokens) AS p, sum(completion_tokens) AS c FROM usage GROUP BY ALL)
SELECT * FROM (SELECT step, 'prompt_tokens' AS metric, (a.p - coalesce(b.p, 0))::BIGINT AS delta FROM a LEFT JOIN b USING (step)
UNION ALL SELECT step, 'completion_tokens', (a.c - coalesce(b.c, 0))::BIGINT FROM a LEFT JOIN b USING (step)) WHERE delta <> 0""")
def _(s, d):
    u = A.usage(s, d)
    return rollups.usage_delta(u.where("model <> 'unlisted'"), u, ["step"], ["prompt_tokens", "completion_tokens"])


@query("rule_severity_pivot", "SELECT run, rule, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'suggestion') AS suggestion, count(*) AS total FROM issues GROUP BY run, rule")
def _(s, d):
    return rollups.rule_pivot(A.issues(s, d))


@query("rule_severity_cube", "SELECT run, severity, count(*) AS n FROM issues GROUP BY CUBE (run, severity)")
def _(s, d):
    return rollups.rule_cube(A.issues(s, d))


@query("rule_share", "SELECT run, rule, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY run) AS pct FROM issues GROUP BY run, rule")
def _(s, d):
    return rollups.rule_share(A.issues(s, d))


@query("regression_diff", """, c AS (SELECT rule, count(*) FILTER (run = 'baseline') AS baseline, count(*) FILTER (run = 'baseline' AND severity = 'error') AS baseline_errors,
  count(*) FILTER (run = 'current') AS current, count(*) FILTER (run = 'current' AND severity = 'error') AS current_errors FROM issues GROUP BY rule)
SELECT *, current - baseline AS delta, current_errors - baseline_errors > 0 AS degraded FROM c""")
def _(s, d):
    return rollups.regression(A.issues(s, d))


@query("new_fixed_issues", """, c AS (SELECT rule, count(*) FILTER (run = 'current') AS c, count(*) FILTER (run = 'baseline') AS b FROM issues GROUP BY rule),
x AS (SELECT *, row_number() OVER (PARTITION BY run, rule ORDER BY issue_no) AS k FROM issues JOIN c USING (rule))
SELECT rule, issue_no, CASE WHEN run = 'current' THEN 'new' ELSE 'fixed' END AS kind FROM x WHERE (run = 'current' AND k <= c - b) OR (run = 'baseline' AND k <= b - c)""")
def _(s, d):
    return rollups.new_and_fixed(A.issues(s, d))


@query("previous_run", "SELECT o_custkey AS case_name, o_orderkey AS run_seq, o_orderstatus AS run_id, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous_run_id FROM orders")
def _(s, d):
    return rollups.previous_run(A.table(s, d, "orders").select(F.col("o_custkey").alias("case_name"), F.col("o_orderkey").alias("run_seq"), F.col("o_orderstatus").alias("run_id")))


@query("video_catalog", """, last AS (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
n AS (SELECT o_custkey, count(*) AS n_chunks FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT c_custkey AS video_id, c_name AS title, coalesce(n_chunks, 0) AS n_chunks, o_orderkey AS run_id, o_orderstatus AS status FROM customer LEFT JOIN n ON c_custkey = n.o_custkey LEFT JOIN last ON c_custkey = last.o_custkey""")
def _(s, d):
    orders = A.table(s, d, "orders").select(F.col("o_custkey").alias("video_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("started_at"))
    chunks = A.table(s, d, "lineitem").select(F.col("l_orderkey").alias("run_id")).join(orders, "run_id")
    videos = A.table(s, d, "customer").select(F.col("c_custkey").alias("video_id"), F.col("c_name").alias("title"))
    return rollups.catalog(videos, chunks, orders)


@query("last_runs", "SELECT o_custkey AS video_id, o_orderkey AS run_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 10")
def _(s, d):
    return sets.top_per_key(A.table(s, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 10).select(F.col("o_custkey").alias("video_id"), F.col("o_orderkey").alias("run_id"))


# Texts and formats.


@query("lang_detect", f"""SELECT media_id, CASE WHEN sum({CJK_N.format('text')}) >= 0.4 * sum(length(regexp_replace(text, '[^\\p{{L}}]', '', 'g'))) THEN 'zh' ELSE 'en' END AS detected FROM cues GROUP BY media_id""")
def _(s, d):
    c = A.cues(s, d).groupBy("media_id").agg(F.sum(T.cjk_count(F.col("text"))).alias("z"), F.sum(F.regexp_count("text", F.lit(r"\p{L}"))).alias("n"))
    return c.select("media_id", F.when(F.col("z") >= 0.4 * F.col("n"), "zh").otherwise("en").alias("detected"))


@query("timecode_srt", """SELECT media_id, cue_no, lpad((start_ms // 3600000)::VARCHAR, 2, '0') || ':' || lpad((start_ms // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((start_ms // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad((start_ms % 1000)::VARCHAR, 3, '0') AS srt, start_ms AS parsed FROM cues""")
def _(s, d):
    c = A.cues(s, d).select("media_id", "cue_no", timecode.to_srt(F.col("start_ms")).alias("srt"))
    return c.withColumn("parsed", timecode.parse(F.col("srt")))


@query("srt_round_trip", f"SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY cue_no) AS index, start_ms, end_ms, {STRIP.format('text')} AS text FROM cues WHERE {STRIP.format('text')} <> ''")
def _(s, d):
    c = A.cues(s, d).where(T.strip(F.col("text")) != "").withColumn("text", F.regexp_replace("text", "\n{2,}", "\n"))
    return subtitles.parse_srt(subtitles.write_srt(c, ["media_id"]), "content", ["media_id"])


@query("bilingual_webvtt", f""", g AS (SELECT media_id, cue_no, s.start_ms, s.end_ms, t.text AS target, nullif(trim(regexp_replace(s.text, '\\s+', ' ', 'g')), '') AS source
    FROM (SELECT * FROM bilingual WHERE lang = 'en') s LEFT JOIN (SELECT * FROM bilingual WHERE lang = 'zh') t USING (media_id, cue_no)),
  x AS (SELECT media_id, row_number() OVER v AS k, start_ms, end_ms, body FROM (SELECT *, CASE WHEN coalesce(target, '') <> '' AND source IS NOT NULL THEN target || chr(10) || '<<EN>>' || chr(10) || source ELSE coalesce(nullif(target, ''), source) END AS body FROM g) WHERE body IS NOT NULL
    WINDOW v AS (PARTITION BY media_id ORDER BY start_ms, end_ms, body)),
  c AS (SELECT *, list_transform([start_ms, end_ms], lambda t: format('{{:02d}}:{{:02d}}:{{:02d}}.{{:03d}}', t // 3600000, t // 60000 % 60, t // 1000 % 60, t % 1000)) AS z FROM x)
  SELECT media_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(k || chr(10) || z[1] || ' --> ' || z[2] || chr(10) || body || chr(10) || chr(10), '' ORDER BY k) AS content FROM c GROUP BY media_id""")
def _(s, d):
    """Each source cue with the target of its number, in the source's time."""
    x = A.bilingual_cues(s, d)
    target = x.where("lang = 'zh'").select("media_id", "cue_no", F.col("text").alias("target"))
    groups = x.where("lang = 'en'").select("media_id", "cue_no", "start_ms", "end_ms", F.col("text").alias("source")).join(target, ["media_id", "cue_no"], "left")
    return artifacts.bilingual_vtt(groups, ["media_id"])


@query("mixed_formats", f""", c AS (SELECT *, {STRIP.format("text")} AS t, CASE media_id % 3 WHEN 0 THEN '.srt' WHEN 1 THEN '.vtt' ELSE '.SSA' END AS suffix FROM cues WHERE {STRIP.format("text")} <> ''),
  x AS (SELECT media_id::VARCHAR || suffix AS path, row_number() OVER (PARTITION BY media_id ORDER BY cue_no) AS index, CASE WHEN suffix = '.SSA' THEN start_ms // 10 * 10 ELSE start_ms END AS start_ms, CASE WHEN suffix = '.SSA' THEN end_ms // 10 * 10 ELSE end_ms END AS end_ms, t AS text,
    CASE WHEN regexp_matches(t, '{T.HAN_BASIC}') THEN 'zh' ELSE 'en' END AS cue_lang FROM c)
  SELECT path, CASE WHEN count(*) FILTER (cue_lang = 'zh') OVER (PARTITION BY path) > count(*) FILTER (cue_lang = 'en') OVER (PARTITION BY path) THEN 'zh' ELSE 'en' END AS lang, index, NULL::VARCHAR AS cue_id, start_ms, end_ms, text, cue_lang FROM x""")
def _(s, d):
    """All cues, a file for each medium, in three formats by turns."""
    c = A.cues(s, d).where(T.strip(F.col("text")) != "").withColumn("text", F.regexp_replace("text", "\n{2,}", "\n"))
    of = lambda k: c.where(F.col("media_id") % 3 == k)
    files = [(subtitles.write_srt(of(0), ["media_id"]), ".srt"), (subtitles.write_vtt(of(1), ["media_id"]), ".vtt"), (subtitles.write_ass(of(2), ["media_id"]), ".SSA")]
    named = [f.select(F.concat(F.col("media_id").cast("string"), F.lit(suffix)).alias("path"), "content") for f, suffix in files]
    return mixed.load_mixed(named[0].unionByName(named[1]).unionByName(named[2]))


@query("byte_ranges", """SELECT doc_id, greatest(n_chars - 500, 0) AS first, n_chars - 1 AS last FROM documents WHERE n_chars > 0""")
def _(s, d):
    x = A.table(s, d, "documents").where("n_chars > 0")
    first, last = byte_range(F.lit("bytes=-500"), F.col("n_chars"))
    return x.select("doc_id", first.alias("first"), last.alias("last"))


@query("graph_fingerprint", "SELECT media_id, substr(sha256(string_agg(unit_id || '|' || start_ms || '|' || end_ms, ';' ORDER BY seq)), 1, 16) AS fingerprint FROM segments GROUP BY media_id")
def _(s, d):
    part = F.struct("seq", F.concat_ws("|", "unit_id", "start_ms", "end_ms").alias("t"))
    return A.segments(s, d).groupBy("media_id").agg(F.substring(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), ";"), 256), 1, 16).alias("fingerprint"))


@query("props_json", "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events")
def _(s, d):
    return A.table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("clean_slugs", f"SELECT p_partkey, left(regexp_replace({STRIP.format(chr(39).join(['regexp_replace(p_name, ', '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_' + chr(92) + 's]', ', ', '', ', ', 'g', ')']))}, '\\s+', '_', 'g'), 80) AS slug FROM part")
def _(s, d):
    return A.table(s, d, "part").select("p_partkey", T.slugify(F.col("p_name")).alias("slug"))


# Ordered folds, which SQL cannot express: tested against plain loops.


_ENDS_LAST = _ENDS.replace("(text)", "(last_text)").replace("regexp_replace(text,", "regexp_replace(last_text,")


@query("merge_short_sessions", f""", g AS (SELECT *, sum(n) OVER (PARTITION BY media_id ORDER BY word_no) AS session FROM (SELECT *, coalesce(start_ms - lag(end_ms) OVER (PARTITION BY media_id ORDER BY word_no) > 500, true)::INTEGER AS n FROM words)),
  x AS (SELECT media_id, session, count(*) AS n, min_by(start_ms, word_no) AS s, max_by(end_ms, word_no) AS e, max_by(text, word_no) AS last_text FROM g GROUP BY ALL),
  y AS MATERIALIZED (SELECT media_id, n, s, e, {_ENDS_LAST} AS ends, row_number() OVER (PARTITION BY media_id ORDER BY session) AS i FROM x),
  r AS (SELECT media_id, i, 1::BIGINT AS session, n, s, e, ends FROM y WHERE i = 1
    UNION ALL SELECT media_id, i, session + CASE WHEN m THEN 0 ELSE 1 END, CASE WHEN m THEN hn + n ELSE n END, CASE WHEN m THEN hs ELSE s END, e, ends FROM (SELECT y.*, r.session, r.n AS hn, r.s AS hs,
      ((r.n <= 3 AND NOT r.ends) OR (y.n <= 3 AND NOT y.ends)) AND y.s - r.e <= 800 AND y.e - r.s <= 15000 AS m FROM r JOIN y ON y.media_id = r.media_id AND y.i = r.i + 1))
  SELECT media_id, session, max_by(n, i)::BIGINT AS n_words, max_by(s, i) AS start_ms, max_by(e, i) AS end_ms FROM r GROUP BY media_id, session""")
def _(s, d):
    return folds.merge_short_sessions(A.words(s, d))


@query("segment_words")
def _(s, d):
    return folds.segment_words(A.words(s, d))


_SHORTEST = """{0}a AS (SELECT *, greatest(800 - (e - s), 0) AS lack, greatest(coalesce(lead(s) OVER w - e - 105, 0), 0) AS room FROM {1} WINDOW w AS (PARTITION BY media_id, lang ORDER BY cue_no)),
  {0}b AS (SELECT * EXCLUDE (e, lack, room), lack - least(lack, room) AS rest, e + least(lack, room) AS e FROM {0}a),
  {0} AS (SELECT * EXCLUDE (s, rest), s - least(rest, greatest(coalesce(s - lag(e) OVER w - 105, 0), 0)) AS s FROM {0}b WINDOW w AS (PARTITION BY media_id, lang ORDER BY cue_no))"""
_PACE = f""", w AS (SELECT media_id, turn + 1 AS cue_no, word_no, 3 * start_ms AS ws, 3 * end_ms AS we, confidence FROM words),
  p0 AS (SELECT media_id, lang, cue_no, cue_no % 5 = 0 AS merged, length(replace(text, chr(10), '')) AS chars, 3 * start_ms AS s, 3 * end_ms AS e, row_number() OVER (PARTITION BY media_id, lang ORDER BY cue_no) AS k FROM word_cues),
  p1 AS (SELECT * EXCLUDE (e), s + CASE WHEN e - s < 800 THEN 800 WHEN e - s > 7000 AND NOT merged THEN 7000 ELSE e - s END AS e FROM p0),
  p2a AS (SELECT *, lead(s) OVER w AS ns, lead(chars) OVER w AS nc, lag(e) OVER w AS pe FROM p1 WINDOW w AS (PARTITION BY media_id, lang ORDER BY cue_no)),
  p2 AS (SELECT media_id, lang, cue_no, merged, chars, k, CASE WHEN s - pe > 0 AND s - pe < 150 THEN floor((pe + s - 105) / 2)::BIGINT + 105 ELSE s END AS s,
    CASE WHEN ns - e < 0 THEN ns + CASE WHEN chars + nc > 0 THEN (e - ns) * chars // (chars + nc) ELSE 0 END WHEN ns - e > 0 AND ns - e < 150 THEN floor((e + ns - 105) / 2)::BIGINT ELSE e END AS e FROM p2a),
  p3a AS MATERIALIZED (SELECT *, greatest(coalesce(lead(s) OVER w - e - 105, 0), 0) AS ahead, greatest(coalesce(s - lag(e) OVER w - 105, 0), 0) AS back, CASE WHEN e <= s THEN 0 ELSE greatest(CASE WHEN merged THEN need - (e - s) ELSE least(need - (e - s), greatest(7000 - (e - s), 0)) END, 0) END AS lack
    FROM (SELECT *, (chars * 1000 + CASE WHEN lang = 'zh' THEN 8 ELSE 24 END) // CASE WHEN lang = 'zh' THEN 9 ELSE 25 END AS need FROM p2) WINDOW w AS (PARTITION BY media_id, lang ORDER BY cue_no)),
  took AS (SELECT media_id, lang, k, 0::BIGINT AS b, CASE WHEN lack <= ahead THEN lack ELSE 0 END::BIGINT AS f FROM p3a WHERE k = 1
    UNION ALL SELECT media_id, lang, k, CASE WHEN lack <= ahead OR lack > ahead + left_ THEN 0 ELSE least(lack, left_) END, CASE WHEN lack <= ahead THEN lack WHEN lack > ahead + left_ THEN 0 ELSE lack - least(lack, left_) END
      FROM (SELECT p.*, greatest(p.back - t.f, 0) AS left_ FROM took t JOIN p3a p ON p.media_id = t.media_id AND p.lang = t.lang AND p.k = t.k + 1)),
  p3 AS (SELECT p.media_id, p.lang, cue_no, s - b AS s, e + f AS e FROM p3a p JOIN took USING (media_id, lang, k)),
  p4a AS (SELECT *, sum(e - s + 105) OVER w - (e - s + 105) AS packed FROM p3 WINDOW w AS (PARTITION BY media_id, lang ORDER BY cue_no)),
  p4b AS (SELECT *, packed + max(s - packed) OVER w AS m FROM p4a WINDOW w AS (PARTITION BY media_id, lang ORDER BY cue_no)),
  p4 AS (SELECT media_id, lang, cue_no, m AS s, m + e - s AS e FROM p4b),
  p5 AS (SELECT media_id, lang, cue_no, s, e + CASE WHEN lead(s) OVER w IS NULL THEN 300 ELSE least(300, greatest(lead(s) OVER w - e - 105, 0)) END AS e FROM p4 WINDOW w AS (PARTITION BY media_id, lang ORDER BY cue_no)),
  {_SHORTEST.format("p6", "p5")},
  p7a AS (SELECT p.*, said, silent, lead(s) OVER w AS ns FROM p6 p LEFT JOIN (SELECT media_id, cue_no, min(ws) AS said, max(we) AS silent FROM w GROUP BY ALL) USING (media_id, cue_no) WINDOW w AS (PARTITION BY p.media_id, p.lang ORDER BY p.cue_no)),
  p7b AS (SELECT * EXCLUDE (e), CASE WHEN silent - e > 100 AND (ns IS NULL OR ns - silent >= 105) THEN silent ELSE e END AS e FROM p7a),
  p7c AS (SELECT * EXCLUDE (e), CASE WHEN e > silent + 800 THEN CASE WHEN ns IS NULL THEN silent + 800 ELSE least(silent + 800, ns - 105) END ELSE e END AS e FROM p7b),
  p7d AS (SELECT *, lag(e) OVER w AS pe FROM p7c WINDOW w AS (PARTITION BY media_id, lang ORDER BY cue_no)),
  p7 AS (SELECT media_id, lang, cue_no, CASE WHEN s - said > 100 AND (pe IS NULL OR said - pe >= 105) THEN said ELSE s END AS s, e FROM p7d),
  x AS (SELECT c.*, ws, we, confidence, row_number() OVER w AS k, lag(we) OVER w AS pe, lead(ws) OVER w AS ns
    FROM p7 c JOIN w v ON v.media_id = c.media_id AND ws BETWEEN s - 50 AND e + 50 WINDOW w AS (PARTITION BY c.media_id, lang, c.cue_no ORDER BY ws, word_no)),
  a AS (SELECT media_id, lang, cue_no, s, count(*) AS n, max(confidence) FILTER (k = 1) AS f, max(confidence) FILTER (k BETWEEN 2 AND 6) AS peak, min_by(ws, k) FILTER (confidence > 0.5) - 100 AS good,
    min_by(ws, k) FILTER (ws - pe > 1500 AND coalesce(ns - we <= 1500, true) AND ws - 100 - s >= 80 AND confidence >= 0.45) - 100 AS anchor FROM x GROUP BY ALL),
  late AS (SELECT media_id, lang, cue_no, CASE WHEN f < 0.4 AND peak >= 0.7 AND peak - f >= 0.3::DOUBLE THEN CASE WHEN good - s BETWEEN 80 AND 1500 THEN good END ELSE anchor END AS entry FROM a WHERE n > 1),
  p8 AS (SELECT media_id, lang, cue_no, coalesce(entry, s) AS s, e FROM p7 LEFT JOIN late USING (media_id, lang, cue_no)),
  {_SHORTEST.format("p9", "p8")} SELECT media_id, lang, cue_no, s AS start_ms, e AS end_ms FROM p9"""


@query("pace_cues", _PACE)
def _(s, d):
    slow = lambda df: df.withColumns({"start_ms": 3 * F.col("start_ms"), "end_ms": 3 * F.col("end_ms")})
    return pacing.pace(slow(A.word_cues(s, d)).withColumn("merged", F.col("cue_no") % 5 == 0), slow(A.words(s, d)).withColumn("cue_no", F.col("turn") + 1))


# Chunks of seven words in two lines, of which every third has a line of its own between them that nobody said.
_CHUNKS = f""", k AS (SELECT *, word_no - min(word_no) OVER (PARTITION BY media_id, turn) AS p FROM words),
  lines AS (SELECT media_id, turn, p // 7 AS chunk_no, string_agg(translate(text, '{A.LATIN}', '{A.LATIN.upper()}'), ' ' ORDER BY p) FILTER (p % 7 < 4) AS a, string_agg(text, ' ' ORDER BY p) FILTER (p % 7 >= 4) AS b, min(start_ms) AS s FROM k GROUP BY ALL),
  chunks AS (SELECT media_id, turn, chunk_no, CASE WHEN chunk_no % 3 = 1 THEN [a, 'unsaid 0', coalesce(b, '')] ELSE [a, coalesce(b, '')] END AS lines, s FROM lines)"""
_PLAIN = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{Nd}}]', '', 'g')"


def _chunks(words: DataFrame) -> DataFrame:
    x = words.withColumn("p", F.col("word_no") - F.min("word_no").over(Window.partitionBy("media_id", "turn")))
    x = x.groupBy("media_id", "turn", F.floor(F.col("p") / 7).alias("chunk_no")).agg(F.array_sort(F.collect_list(F.struct("p", "text")))["text"].alias("t"), F.min("start_ms").alias("start_ms"))
    first, second = F.translate(F.array_join(F.slice("t", 1, 4), " "), A.LATIN, A.LATIN.upper()), F.array_join(F.slice("t", 5, 3), " ")
    return x.withColumn("lines", F.when(F.col("chunk_no") % 3 == 1, F.array(first, F.lit("unsaid 0"), second)).otherwise(F.array(first, second)))


@query("find_words", _CHUNKS + f""", u AS (SELECT media_id, turn, string_agg({_PLAIN.format("text")}, '' ORDER BY word_no) AS whole FROM words GROUP BY ALL),
  ends AS (SELECT media_id, turn, word_no, start_ms, end_ms, sum(length({_PLAIN.format("text")})) OVER w AS e, row_number() OVER w AS i FROM words WINDOW w AS (PARTITION BY media_id, turn ORDER BY word_no)),
  n AS (SELECT c.*, whole, {_PLAIN.format("array_to_string(lines, '')")} AS t, {_PLAIN.format("lines[1]")} AS head, {_PLAIN.format("lines[-1]")} AS tail,
    greatest(list_sum(list_transform(lines, lambda x: length(x))) * 1000 // 9, 800) AS reading FROM chunks c JOIN u USING (media_id, turn)),
  h AS (SELECT *, instr(whole, t) AS pos, CASE WHEN head = '' THEN 1 ELSE instr(whole, head) END AS a,
    CASE WHEN tail = '' THEN length(whole) + 1 WHEN instr(whole, tail) = 0 THEN 0 ELSE length(whole) - instr(reverse(whole), reverse(tail)) - length(tail) + 2 END AS b FROM n),
  hit AS (SELECT *, CASE WHEN t <> '' AND pos > 0 THEN pos WHEN t <> '' AND a > 0 AND b > a THEN a END AS f, CASE WHEN t <> '' AND pos > 0 THEN pos + length(t) - 1 WHEN t <> '' AND a > 0 AND b > a THEN b + length(tail) - 1 END AS l FROM h),
  x AS (SELECT hit.*, (SELECT min(i) FROM ends e WHERE e.media_id = hit.media_id AND e.turn = hit.turn AND e.e >= f) AS i, (SELECT min(i) FROM ends e WHERE e.media_id = hit.media_id AND e.turn = hit.turn AND e.e >= l) AS j FROM hit)
  SELECT x.media_id, x.turn, chunk_no, p.word_no AS first_word, q.word_no AS last_word, coalesce(x.j - x.i + 1, 0)::INTEGER AS n_words, (coalesce(p.start_ms, s))::BIGINT AS start_ms,
    (CASE WHEN f IS NULL THEN s + reading ELSE greatest(q.end_ms, p.start_ms + reading) END)::BIGINT AS end_ms
  FROM x LEFT JOIN ends p ON p.media_id = x.media_id AND p.turn = x.turn AND p.i = x.i LEFT JOIN ends q ON q.media_id = x.media_id AND q.turn = x.turn AND q.i = x.j""")
def _(s, d):
    words = A.words(s, d)
    return wordindex.find_words(words, _chunks(words), ["media_id", "turn"], CONFIG.cps_limit)


@query("words_in_order", f""", k AS (SELECT media_id, turn, {_PLAIN.format("text")} AS v, row_number() OVER (PARTITION BY media_id, turn ORDER BY word_no) - 1 AS p FROM words),
  t AS (SELECT media_id, turn, v, row_number() OVER (PARTITION BY media_id, turn ORDER BY p) - 1 AS p FROM k WHERE v <> ''),
  w AS (SELECT media_id, turn, v, row_number() OVER (PARTITION BY media_id, turn ORDER BY p) - 1 AS i FROM (SELECT media_id, turn, p, v FROM t WHERE p % 3 <> 1 UNION ALL SELECT media_id, turn, 1e9, 'unsaid' FROM (SELECT DISTINCT media_id, turn FROM t) WHERE turn % 4 = 3)),
  r AS (SELECT DISTINCT media_id, turn, -1::BIGINT AS i, -1::BIGINT AS p FROM t
    UNION ALL SELECT r.media_id, r.turn, r.i + 1, (SELECT min(t.p) FROM t WHERE t.media_id = r.media_id AND t.turn = r.turn AND t.v = w.v AND t.p > r.p) FROM r JOIN w ON w.media_id = r.media_id AND w.turn = r.turn AND w.i = r.i + 1 WHERE r.p IS NOT NULL)
  SELECT media_id, turn, CASE WHEN bool_and(p IS NOT NULL) THEN string_agg(p::VARCHAR, ',' ORDER BY i) FILTER (i >= 0) END AS places, bool_and(p IS NOT NULL) AND max(i) >= 0 AS holds FROM r GROUP BY ALL""")
def _(s, d):
    """Two thirds of each turn's tokens, with one more that nobody said in every fourth turn."""
    tokens = A.words(s, d).withColumn("v", wordindex.letters_and_digits(F.col("text"))).where("v <> ''").groupBy("media_id", "turn").agg(F.array_sort(F.collect_list(F.struct("word_no", "v")))["v"].alias("line"))
    some = F.filter("line", lambda _, k: k % 3 != 1)
    x = tokens.withColumn("words", F.when(F.col("turn") % 4 == 3, F.array_append(some, F.lit("unsaid"))).otherwise(some))
    return x.select("media_id", "turn", F.array_join(wordindex.match_in_order("line", "words").cast("array<string>"), ",").alias("places"), wordindex.contains_in_order(F.col("line"), F.col("words")).alias("holds"))


_in = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
_NORM = "regexp_replace(lower({}), '^[!-/:-@\\[-`{{-~“”‘’]+|[!-/:-@\\[-`{{-~“”‘’]+$', '', 'g')"
_LAST = "(CASE WHEN len({0}) > 1 AND dangles AND NOT (idiom AND n - {0}[len({0})] > 0) THEN {0}[1:len({0}) - 1] ELSE {0} END)"
# The boundary that scores best between words a and b, from 1; the earlier of equal ones.
_BEST = """-(list_max(list_transform(list_filter(range(({a} + 1)::BIGINT, ({b} + 1)::BIGINT), lambda k: w[k] IS NOT NULL), lambda k: struct_pack(sc := 1000 * w[k]
  + CASE WHEN greatest(e[k - 1] - s[{a}], e[{b}] - s[k]) <= 7000 THEN 180000 WHEN greatest(e[k - 1] - s[{a}], e[{b}] - s[k]) <= 8050 THEN 80000 ELSE -120 * (greatest(e[k - 1] - s[{a}], e[{b}] - s[k]) - 8050) END
  - 9 * abs(2 * (e[k - 1] - s[{a}]) - CASE WHEN 10 * (e[{b}] - s[{a}]) <= 154000 THEN e[{b}] - s[{a}] ELSE 14000 END)
  - CASE WHEN k - {a} < 3 THEN 180000 ELSE 0 END - CASE WHEN {b} + 1 - k < 3 THEN 180000 ELSE 0 END - CASE WHEN e[k - 1] - s[{a}] < 1000 THEN 120000 ELSE 0 END - CASE WHEN e[{b}] - s[k] < 1000 THEN 120000 ELSE 0 END, neg := -k))).neg)"""
_O = overlong


@query("split_overlong", f""", t0 AS (SELECT media_id, turn, word_no, start_ms, end_ms, {STRIP.format("text")} AS t FROM words),
  t1 AS (SELECT *, {_NORM.format("t")} AS nm FROM t0 WHERE t <> ''),
  t2 AS (SELECT *, lag(t) OVER v AS pt, lag(nm) OVER v AS pn FROM t1 WINDOW v AS (PARTITION BY media_id, turn ORDER BY word_no)),
  t3 AS (SELECT *, CASE WHEN pn = '' OR nm = '' OR pn IN ({_in(_O.PREPOSITIONS + _O.ARTICLES + _O.STRANDED)}) OR nm IN ({_in(_O.PREPOSITIONS)}) THEN NULL WHEN regexp_matches(pt, '[.!?。！？…]$') THEN 1000 WHEN regexp_matches(pt, '[,;:，；：—–]$') THEN 760
    WHEN nm IN ({_in(_O.STRONG)}) THEN 900 WHEN nm IN ({_in(_O.MEDIUM)}) THEN 620 WHEN nm IN ({_in(_O.WEAK)}) THEN 420 WHEN pn IN ({_in(_O.STRONG)}) THEN 320 ELSE 100 END AS worth,
    nm IN ({_in(_O.PREPOSITIONS)}) AS dg, coalesce((pn = 'so' AND nm = 'on') OR (pn = 'thinking' AND nm = 'about') OR (pn = 'afraid' AND nm = 'of'), false) AS idm FROM t2),
  u AS MATERIALIZED (SELECT media_id, turn, list(word_no ORDER BY word_no) AS nos, list(start_ms ORDER BY word_no) AS s, list(end_ms ORDER BY word_no) AS e, list(worth ORDER BY word_no) AS w, count(*) AS n, max_by(dg, word_no) AS dangles, max_by(idm, word_no) AS idiom FROM t3 GROUP BY ALL),
  long_ AS MATERIALIZED (SELECT * FROM u WHERE e[n] - s[1] > 7000),
  roots AS (SELECT *, unnest(range(1, n + 1)) AS root, false AS must FROM long_ UNION ALL SELECT *, 1, true FROM long_),
  r AS (SELECT media_id, turn, s, e, w, root, must, root AS a, n AS b, CASE WHEN n > root AND (must OR e[n] - s[root] > 8050) THEN {_BEST.format(a="root", b="n")} END AS k FROM roots
    UNION ALL SELECT media_id, turn, s, e, w, root, must, a, b, CASE WHEN b > a AND e[b] - s[a] > 8050 THEN {_BEST.format(a="a", b="b")} END
      FROM (SELECT media_id, turn, s, e, w, root, must, CASE side WHEN 0 THEN a ELSE k END AS a, CASE side WHEN 0 THEN k - 1 ELSE b END AS b FROM r, (VALUES (0), (1)) AS sides(side) WHERE k IS NOT NULL)),
  leaves AS MATERIALIZED (SELECT media_id, turn, root, must, list(a ORDER BY a) AS cuts FROM r WHERE k IS NULL GROUP BY ALL),
  st AS (SELECT media_id, turn, 0 AS round, cuts, false AS done FROM leaves WHERE must
    UNION ALL SELECT media_id, turn, round + 1, again, again = cuts FROM (SELECT x.media_id, x.turn, round, x.cuts, now[1:len(now) - 1] || l.cuts AS again
      FROM (SELECT st.*, {_LAST.format("cuts")} AS now FROM st JOIN long_ USING (media_id, turn) WHERE NOT done AND round < 8) x JOIN leaves l ON l.media_id = x.media_id AND l.turn = x.turn AND l.root = now[len(now)] AND NOT l.must)),
  mended AS (SELECT media_id, turn, max_by(cuts, round) AS cuts FROM st GROUP BY ALL),
  final AS (SELECT u.*, CASE WHEN cuts IS NULL THEN [1] WHEN len(cuts) > 1 AND len({_LAST.format("cuts")}) < len(cuts) AND 100 * (e[n] - s[cuts[len(cuts) - 1]]) <= 1750000 THEN cuts[1:len(cuts) - 1] ELSE cuts END AS cuts FROM u LEFT JOIN mended USING (media_id, turn)),
  p AS (SELECT *, unnest(range(1, len(cuts) + 1)) AS part FROM final)
  SELECT media_id, turn, part, nos[cuts[part]] AS first_word, nos[coalesce(cuts[part + 1] - 1, n)] AS last_word, s[cuts[part]] AS start_ms, e[coalesce(cuts[part + 1] - 1, n)] AS end_ms FROM p""")
def _(s, d):
    return overlong.split_overlong(A.words(s, d), ["media_id", "turn"])


@query("part_texts")
def _(s, d):
    """Each part's share of its turn's text, which has dashes that nobody said; tested on known sentences."""
    words = A.words(s, d)
    units = A.table(s, d, "conversations").select(F.col("conv_id").alias("media_id"), "turn", F.regexp_replace("text", "([aeiou]) ", "$1 -- ").alias("text"))
    return overlong.part_texts(overlong.split_overlong(words, ["media_id", "turn"]), words, units, ["media_id", "turn"])


@query("layout_cues")
def _(s, d):
    return layout.layout(A.rule_cues(s, d), _han(s, d)[1])


@query("redistribute_word_timing", """, w AS (SELECT media_id, turn, array_agg(start_ms ORDER BY word_no)[1:1] || array_agg(end_ms ORDER BY word_no) AS b,
    array_agg(speaker ORDER BY word_no) AS sp, sum((word_no * 7919) % 100)::DOUBLE / 100 / count(*) AS c, count(*) AS n FROM words GROUP BY ALL
), t AS (SELECT *, n + 1 AS m, unnest(range(n + 1)) AS k FROM w)
SELECT media_id, turn, k, (b[k * n // m + 1] * (m - k * n % m) + b[k * n // m + 2] * (k * n % m))::DOUBLE / m AS start_ms,
  CASE WHEN k + 1 = m THEN b[n + 1] ELSE (b[(k + 1) * n // m + 1] * (m - (k + 1) * n % m) + b[(k + 1) * n // m + 2] * ((k + 1) * n % m))::DOUBLE / m END AS end_ms,
  round(c, 9) AS confidence, sp[k * n // m + 1] AS speaker FROM t""")
def _(s, d):
    w = A.words(s, d)
    counts = w.groupBy("media_id", "turn").agg((F.count(F.lit(1)) + 1).alias("m"))
    return folds.redistribute_timing(w, counts).withColumn("confidence", F.round("confidence", 9))


# Replies and what is made of them: replies are written as JSON with talk around them, and read back.


def _replies(rows: DataFrame, keys: list[str], order: str, item) -> DataFrame:
    prompts = review.payload(rows, keys, order, item)
    answers = prompts.withColumn("reply", F.concat(F.lit("Here you are:\n```json\n"), "payload", F.lit("\n```")))
    return review.ReplayResponder(answers, keys).reply(prompts.select(*keys))


@query("translate_replies", """SELECT media_id, cue_no, CASE WHEN cue_no % 5 = 0 THEN NULL ELSE text END AS text, CASE WHEN cue_no % 5 = 0 THEN 'missing' ELSE 'ok' END AS state FROM cues WHERE length(regexp_replace(text, '\\s', '', 'g')) > 0""")
def _(s, d):
    c = A.cues(s, d).where(F.length(F.regexp_replace("text", r"\s", "")) > 0).select("media_id", "cue_no", F.col("text").alias("t"))
    answered = c.where("cue_no % 5 <> 0")
    r = _replies(answered, ["media_id"], "cue_no", F.struct(F.col("cue_no").cast("int").alias("batch_index"), F.col("t").alias("text")))
    got = review.items(r, "translate", ["media_id"]).select("media_id", F.col("batch_index").cast("long").alias("cue_no"), "text")
    return review.resolve(c.select("media_id", "cue_no"), got, ["media_id", "cue_no"])


def _merge_flags(far_ms: int) -> None:
    @query("merge_flags" if far_ms == 300 else f"merge_flags_{far_ms}ms", f""", g AS (SELECT *, lead(start_ms) OVER (PARTITION BY media_id ORDER BY seq) - end_ms AS gap FROM segments)
SELECT media_id, seq, seq % 2 = 1 AND NOT {_ENDS} AND (gap IS NULL OR gap < {far_ms} OR regexp_matches({STRIP.format('lower(text)')}, '(,|，|、|\\b(and|but|or|because|that|which|of|to|the))$')) AS merge FROM g""")
    def _(s, d):
        x = A.segments(s, d)
        r = _replies(x, ["media_id"], "seq", F.struct(F.col("seq").cast("int").alias("batch_index"), (F.col("seq") % 2 == 1).alias("merge_with_next")))
        flags = review.items(r, "merge_review", ["media_id"]).select("media_id", F.col("batch_index").cast("long").alias("seq"), F.col("merge_with_next").alias("flag"))
        return review.merge_flags(x, flags, far_ms=far_ms)


for _far in (300, 800):
    _merge_flags(_far)


@query("merge_budget", "SELECT media_id, greatest(1, ceil(count(*) / 24)::BIGINT) AS budget FROM segments GROUP BY media_id")
def _(s, d):
    return review.merge_budget(A.segments(s, d))


@query("evaluate_scores", """SELECT event_id, round(overall, 9) AS overall FROM (SELECT event_id, 0.4::DOUBLE * greatest(0, least(1, value / 100)) + 0.3::DOUBLE * greatest(0, least(1, value / 50)) + 0.15::DOUBLE * 0.5 + 0.15::DOUBLE * greatest(0, least(1, (value - 50) / 50)) AS overall FROM events) WHERE overall < 0.6""")
def _(s, d):
    v = F.col("value")
    x = A.table(s, d, "events").select("event_id", (v / 100).alias("accuracy"), (v / 50).alias("fluency"), F.lit(None).cast("double").alias("consistency"), ((v - 50) / 50).alias("compression"))
    return review.overall(x).where("overall < 0.6").select("event_id", F.round("overall", 9).alias("overall"))


@query("llm_issues_except", """, f AS (SELECT rule, user_id AS cue_id, min(issue_no::VARCHAR) AS detail FROM issues WHERE run = 'current' GROUP BY ALL)
SELECT rule, cue_id, '[LLM] ' || detail AS detail FROM f WHERE NOT EXISTS (SELECT 1 FROM issues e WHERE e.run = 'baseline' AND e.issue_no % 5 = 0 AND e.rule = f.rule AND e.user_id = f.cue_id)""")
def _(s, d):
    i = A.issues(s, d)
    found = i.where("run = 'current'").select("rule", F.col("user_id").alias("cue_id"), F.col("issue_no").cast("string").alias("detail"))
    return review.new_issues(found, i.where("run = 'baseline' AND issue_no % 5 = 0").select("rule", F.col("user_id").alias("cue_id")))


@query("negation_loss", _PAIRS + f"SELECT media_id, l_cue_no, r_cue_no FROM pairs WHERE len(list_intersect(regexp_extract_all(lower(l_text), '[a-z'']+'), [{', '.join(chr(39) + w.replace(chr(39), chr(39) * 2) + chr(39) for w in review.NEGATION_WORDS)}])) > 0 AND NOT regexp_matches(CASE WHEN r_cue_no % 2 = 1 THEN translate(r_text, '不没', '') ELSE r_text END, '{review.NEGATION_ZH}')")
def _(s, d):
    pairs = qc.pairs(A.bilingual_cues(s, d))
    return review.negation_loss(pairs.withColumn("r_text", F.when(F.col("r_cue_no") % 2 == 1, F.translate("r_text", "不没", "")).otherwise(F.col("r_text"))))


@query("time_axis_overflow", """, t AS (SELECT media_id, cue_no, start_ms, end_ms, cue_no AS a, cue_no + cue_no % 2 AS b FROM bilingual WHERE lang = 'zh'),
u AS (SELECT media_id, cue_no, start_ms, end_ms FROM bilingual WHERE lang = 'en'),
w AS (SELECT t.media_id, t.cue_no, t.start_ms, t.end_ms, min(u.start_ms) AS s, max(u.end_ms) AS e FROM t JOIN u ON u.media_id = t.media_id AND u.cue_no BETWEEN a AND b GROUP BY ALL)
SELECT media_id, cue_no, start_ms < s - 50 AS early, end_ms > e + 50 AS late FROM w WHERE start_ms < s - 50 OR end_ms > e + 50""")
def _(s, d):
    c = A.bilingual_cues(s, d).withColumn("unit_id", F.col("cue_no").cast("string"))
    merged = F.when(F.col("cue_no") % 2 == 1, F.array((F.col("cue_no") + 1).cast("string")))
    return review.covered_windows(c.where("lang = 'zh'").withColumn("merged_from", merged), c.where("lang = 'en'"))


@query("shot_boundary_hard", """, cuts AS (SELECT DISTINCT user_id AS media_id, (epoch_us(ts) // 1000) % 60000 AS cut_ms FROM events),
x AS (SELECT *, lag(end_ms) OVER w AS p, lead(start_ms) OVER w AS n FROM cues WINDOW w AS (PARTITION BY media_id, lang ORDER BY cue_no))
SELECT x.media_id, lang, cue_no, min(cut_ms) AS cut_ms FROM x JOIN cuts k ON x.media_id = k.media_id AND cut_ms > start_ms AND cut_ms < end_ms AND (p <= cut_ms OR n >= cut_ms) GROUP BY ALL""")
def _(s, d):
    cuts = A.table(s, d, "events").select(F.col("user_id").alias("media_id"), (A.millis("ts") % 60_000).alias("cut_ms")).distinct()
    return review.shot_boundaries(A.cues(s, d), cuts)


@query("split_long_segments", f""", n AS (SELECT *, end_ms - start_ms AS dur, CASE WHEN end_ms - start_ms <= 2000 THEN 1 ELSE greatest(2, (end_ms - start_ms) // 2000 + 1) END AS n FROM segments),
p AS (SELECT *, greatest(1, length(text) // n) AS each FROM n), x AS (SELECT *, unnest(range(n)) AS i FROM p),
y AS (SELECT media_id, seq, i, start_ms + dur * i // n AS start_ms, start_ms + dur * (i + 1) // n AS end_ms, dur,
  CASE WHEN n = 1 THEN text ELSE {STRIP.format('substr(text, i * each + 1, CASE WHEN i = n - 1 THEN length(text) ELSE each END)')} END AS text FROM x)
SELECT media_id, seq, i, start_ms, end_ms, text FROM y WHERE text <> '' OR dur <= 2000""")
def _(s, d):
    return review.split_long(A.segments(s, d), 2000)


@query("split_long_segments_5s", f""", n AS (SELECT *, end_ms - start_ms AS dur, CASE WHEN end_ms - start_ms <= 5000 THEN 1 ELSE greatest(2, (end_ms - start_ms) // 5000 + 1) END AS n FROM segments),
p AS (SELECT *, greatest(1, length(text) // n) AS each FROM n), x AS (SELECT *, unnest(range(n)) AS i FROM p),
y AS (SELECT media_id, seq, i, start_ms + dur * i // n AS start_ms, start_ms + dur * (i + 1) // n AS end_ms, dur,
  CASE WHEN n = 1 THEN text ELSE {STRIP.format('substr(text, i * each + 1, CASE WHEN i = n - 1 THEN length(text) ELSE each END)')} END AS text FROM x)
SELECT media_id, seq, i, start_ms, end_ms, text FROM y WHERE text <> '' OR dur <= 5000""")
def _(s, d):
    return review.split_long(A.segments(s, d), 5000)


@query("transcript_text", "SELECT media_id, string_agg('[' || upper(speaker) || '] ' || text, chr(10) ORDER BY seq) AS text FROM segments GROUP BY media_id")
def _(s, d):
    return review.transcript_text(A.segments(s, d))


@query("punctuation_gate", f"SELECT media_id, avg(({_ENDS})::INTEGER) >= 0.3 AS enough FROM segments GROUP BY media_id")
def _(s, d):
    return review.punctuated_enough(A.segments(s, d))


@query("split_counts", """SELECT media_id, 'u' || (seq // 4)::VARCHAR AS grp, max(seq % 4) + 1 AS parts FROM segments GROUP BY ALL""")
def _(s, d):
    x = A.segments(s, d).withColumn("id", F.concat(F.lit("u"), F.floor(F.col("seq") / 4).cast("string"), F.lit("_"), (F.col("seq") % 4).cast("string")))
    grp, part = F.regexp_extract("id", r"^(.*)_(\d+)$", 1), F.regexp_extract("id", r"^(.*)_(\d+)$", 2).cast("long")
    return x.groupBy("media_id", grp.alias("grp")).agg((F.max(part) + 1).alias("parts"))


@query("catalog_update", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'done' ELSE c_mktsegment END AS status FROM customer WHERE c_custkey % 10 <> 0")
def _(s, d):
    rows = A.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("status"))
    changed = review.update_rows(rows, "id", rows.where("id % 3 = 0").select("id", F.lit("done").alias("status")), ["status"])
    return review.delete_rows(changed, "id", rows.where("id % 10 = 0"))


@query("chunk_listing", "SELECT l_orderkey AS video_id, l_linenumber AS chunk_index, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS position FROM lineitem")
def _(s, d):
    from pyspark.sql import Window

    over = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return A.table(s, d, "lineitem").select(F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").alias("chunk_index"), F.row_number().over(over).cast("long").alias("position"))


@query("segment_summary", """SELECT media_id, turn, count(*) AS word_count, max(end_ms) - min(start_ms) AS duration_ms, min_by(text, word_no) AS first_word, max_by(text, word_no) AS last_word,
  min(word_no) AS from_word, max(word_no) AS to_word FROM words GROUP BY ALL""")
def _(s, d):
    return artifacts.segment_summary(A.words(s, d), ["media_id", "turn"])


@query("cue_json_round_trip", "SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY cue_no) AS index, text, lang FROM cues")
def _(s, d):
    written = artifacts.cue_json(A.cues(s, d), ["media_id"])
    return subtitles.parse_cue_json(written, "content", ["media_id"]).select("media_id", "index", "text", "lang")


@query("pending_segments", "SELECT media_id, seq, unit_id FROM segments WHERE seq % 3 <> 0 OR media_id % 2 = 0")
def _(s, d):
    x = A.segments(s, d)
    finger = F.concat(F.lit("f"), (F.col("media_id") % 2).cast("string"))
    listed = F.to_json(F.struct(F.lit("f1").alias("segments_fingerprint"), F.collect_list(F.struct("unit_id", "text")).alias("cues")))
    saved = x.where("seq % 3 = 0").groupBy("media_id").agg(listed.alias("content"))
    done = artifacts.load_partial(saved, "content", ["media_id"], finger)
    return artifacts.pending(x, done, ["media_id", "unit_id"]).select("media_id", "seq", "unit_id")


# Units and their words.


@query("source_cues", "SELECT media_id, 'src_' || lpad((row_number() OVER (PARTITION BY media_id ORDER BY seq) - 1)::VARCHAR, 4, '0') AS cue_id, unit_id, start_ms, end_ms, text, 'en' AS lang, speaker FROM segments")
def _(s, d):
    return units.source_cues(A.segments(s, d), "en")


@query("slice_words", """, f AS (SELECT u.media_id, u.cue_no, count(*) AS n, min(word_no) AS a, max(word_no) AS b FROM word_cues u JOIN words w ON w.media_id = u.media_id
  AND w.start_ms >= u.start_ms + 100 - 50 AND w.end_ms <= u.end_ms - 300 + 50 GROUP BY ALL), e AS (SELECT media_id, count(*) AS n, min(word_no) AS a, max(word_no) AS b FROM words GROUP BY ALL)
SELECT u.media_id, u.cue_no::VARCHAR AS unit_id, coalesce(f.n, e.n, 0) AS n_words, coalesce(f.a, e.a) AS from_word, coalesce(f.b, e.b) AS to_word, f.n IS NULL AS whole
FROM word_cues u LEFT JOIN f USING (media_id, cue_no) LEFT JOIN e USING (media_id)""")
def _(s, d):
    u = A.word_cues(s, d).select("media_id", F.col("cue_no").cast("string").alias("unit_id"), (F.col("start_ms") + 100).alias("start_ms"), (F.col("end_ms") - 300).alias("end_ms"))
    return units.slice_words(A.words(s, d), u)


_CHAINS = """, uw AS (SELECT media_id, 'u' || (turn + 1)::VARCHAR AS unit_id, word_no, text FROM words WHERE turn % 5 <> 4), t AS (
  SELECT media_id, cue_no, ['u' || cue_no] || CASE WHEN cue_no % 2 = 1 THEN ['u' || (cue_no + 1)] ELSE [] END AS us FROM bilingual WHERE lang = 'zh'
), ch AS (SELECT media_id, cue_no, unnest(us) AS unit_id, unnest(range(len(us))) AS place FROM t) """


def _chained(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Target cues of one or two units, and the words of the units that have some."""
    unit = lambda n: F.concat(F.lit("u"), n.cast("string"))
    t = A.bilingual_cues(s, d).where("lang = 'zh'").withColumn("unit_id", unit(F.col("cue_no"))).withColumn("merged_from", F.when(F.col("cue_no") % 2 == 1, F.array(unit(F.col("cue_no") + 1))))
    w = A.words(s, d).where("turn % 5 <> 4").select("media_id", unit(F.col("turn") + 1).alias("unit_id"), "word_no", "text")
    return t, w


@query("attach_words", _CHAINS + "SELECT media_id, cue_no, string_agg(text, ' ' ORDER BY place, word_no) AS words FROM ch JOIN uw USING (media_id, unit_id) GROUP BY ALL")
def _(s, d):
    return units.attach_words(*_chained(s, d)).select("media_id", "cue_no", F.array_join("texts", " ").alias("words"))


@query("matched_by_units", _CHAINS + """, own AS (SELECT media_id, unit_id, trim(string_agg(text, '' ORDER BY word_no)) AS own FROM uw GROUP BY ALL),
m AS (SELECT media_id, cue_no, string_agg(own, ' ' ORDER BY place) AS source_text FROM ch JOIN own USING (media_id, unit_id) WHERE own <> '' GROUP BY ALL)
SELECT media_id, cue_no, source_text FROM t LEFT JOIN m USING (media_id, cue_no)""")
def _(s, d):
    return units.matched_by_units(*_chained(s, d))


@query("unmatched_by_units", _CHAINS + """SELECT media_id, cue_no FROM t WHERE NOT EXISTS (SELECT 1 FROM ch JOIN uw USING (media_id, unit_id) WHERE ch.media_id = t.media_id AND ch.cue_no = t.cue_no AND text <> '')""")
def _(s, d):
    return units.unresolved(*_chained(s, d)).select("media_id", "cue_no")


@query("timestamp_mismatches", """SELECT media_id, unit_id, abs((seq % 5) * 1000 - 500) AS off_ms FROM segments WHERE abs((seq % 5) * 1000 - 500) > 3000""")
def _(s, d):
    x = A.segments(s, d)
    return units.timestamp_mismatches(x.withColumn("start_ms", F.col("start_ms") + (F.col("seq") % 5) * 1000 - 500), x)


@query("split_bilingual", f"""SELECT media_id, cue_no, CASE WHEN k = 3 THEN {STRIP.format('text')} || chr(10) || '你好' ELSE {STRIP.format('text')} END AS target, CASE k WHEN 0 THEN 'Marked  text' WHEN 1 THEN 'Blank line' WHEN 2 THEN 'last line' ELSE '' END AS source
FROM (SELECT *, cue_no % 5 AS k FROM bilingual WHERE lang = 'zh' AND {STRIP.format('text')} <> '' AND NOT contains(text, chr(10)))""")
def _(s, d):
    x = A.bilingual_cues(s, d).where((F.col("lang") == "zh") & (T.strip(F.col("text")) != "") & ~F.contains("text", F.lit("\n"))).withColumn("k", F.col("cue_no") % 5)
    tail = F.when(F.col("k") == 0, "\n<<EN>>\nMarked  text ").when(F.col("k") == 1, "\n\nBlank line").when(F.col("k") == 2, "\n last line").when(F.col("k") == 3, "\n<<EN>>\n你好").otherwise("")
    one, two = units.split_bilingual(F.concat(T.strip(F.col("text")), tail))
    return x.select("media_id", "cue_no", one.alias("target"), two.alias("source"))


@query("mean_confidence", "SELECT media_id, turn, round(avg(confidence), 9) AS confidence, count(*) FILTER (word_no % 4 = 0) AS changed FROM words GROUP BY ALL")
def _(s, d):
    w = A.words(s, d)
    return units.mean_confidence(w, _corrected(w)).withColumn("confidence", F.round("confidence", 9))


def _corrected(words: DataFrame) -> DataFrame:
    """Every second word again, of which every other one has been changed."""
    return words.where("word_no % 2 = 0").select("media_id", "word_no", F.concat("text", F.when(F.col("word_no") % 4 == 0, "!").otherwise("")).alias("text"))


@query("correction_log", "SELECT media_id, word_no, text AS before, text || CASE WHEN word_no % 4 = 0 THEN '!' ELSE '' END AS after, word_no % 4 = 0 AS changed FROM words")
def _(s, d):
    w = A.words(s, d)
    return units.correction_log(w, _corrected(w))


@query("compose_json_round_trip", "SELECT media_id, unit_id, start_ms, end_ms, text, speaker FROM segments")
def _(s, d):
    return units.read_compose_json(units.compose_json(A.segments(s, d), ["media_id"]), "content", ["media_id"])


@query("raw_cues_json", "SELECT media_id, seq AS cue_no, unit_id, speaker, seq % 3 = 0 AS merged FROM (SELECT media_id, seq, unit_id, CASE WHEN seq % 4 <> 0 THEN speaker END AS speaker FROM segments)")
def _(s, d):
    x = A.segments(s, d).withColumnRenamed("seq", "cue_no").withColumn("speaker", F.when(F.col("cue_no") % 4 != 0, F.col("speaker")))
    x = units.raw_cues_json(x.withColumn("merged_from", F.when(F.col("cue_no") % 3 == 0, F.array("unit_id")).otherwise(F.array().cast("array<string>"))))
    return x.select("media_id", "cue_no", F.get_json_object("json", "$.unit_id").alias("unit_id"), F.get_json_object("json", "$.speaker").alias("speaker"), F.contains("json", F.lit('"merged_from"')).alias("merged"))


# Runs, files and the catalog.


@query("issues_by_severity", "SELECT issue_no, rule, severity, CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS severity_rank FROM issues")
def _(s, d):
    return runs.by_severity(A.issues(s, d)).select("issue_no", "rule", "severity", F.col("severity_rank").cast("int").alias("severity_rank"))


@query("regression_verdict", """, r AS (SELECT rule, count(*) FILTER (run = 'baseline') AS b, count(*) FILTER (run = 'current') AS c, {0} FROM issues GROUP BY rule),
t AS (SELECT {1}, sum(greatest(c - b, 0))::BIGINT AS new_issues, string_agg('strict rule ' || rule || ': ' || b || ' to ' || c, '; ' ORDER BY 'strict rule ' || rule || ': ' || b || ' to ' || c) FILTER (rule IN ('click', 'purchase') AND c > b) AS s FROM r)
SELECT errors_delta, warnings_delta, suggestions_delta, new_issues, errors_delta > 0 OR s IS NOT NULL AS degraded,
  array_to_string(list_filter([CASE WHEN errors_delta > 0 THEN 'errors: +' || errors_delta END, s, CASE WHEN new_issues > 0 THEN new_issues || ' new issues' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM t""".format(
    ", ".join(f"count(*) FILTER (severity = '{v}' AND run = 'current') - count(*) FILTER (severity = '{v}' AND run = 'baseline') AS {v}" for v in runs.SEVERITIES), ", ".join(f"sum({v})::BIGINT AS {v}s_delta" for v in runs.SEVERITIES)))
def _(s, d):
    return runs.verdict(A.issues(s, d), ["click", "purchase"])


_PLAN = ["download", "transcribe", "correct", "translate", "layout", "export"]
_STEPS = f"""[{_quoted(_PLAN)}]"""
_RUNS = f""", ev AS (SELECT user_id AS run, event_id AS seq, CASE event_id % 11 WHEN 0 THEN 'failed' WHEN 1 THEN 'interrupted' WHEN 2 THEN 'done' WHEN 3 THEN 'running' WHEN 4 THEN 'running' WHEN 5 THEN 'running' ELSE 'completed' END AS kind,
  CASE WHEN event_id % 11 = 2 THEN NULL ELSE {_STEPS}[(event_id // 3 % 6 + 1)::INTEGER] END AS step FROM events
), st AS (SELECT run, max_by(kind, seq) FILTER (kind IN ('running', 'failed', 'interrupted', 'done')) AS lk, max_by(kind, seq) FILTER (kind IN ('running', 'failed', 'interrupted')) AS fk,
  max_by(step, seq) FILTER (kind IN ('running', 'failed', 'interrupted')) AS fs, max_by(kind, seq) FILTER (kind IN ('running', 'done')) AS ck,
  max_by(coalesce(step, ''), seq) FILTER (kind IN ('running', 'done')) AS cs, coalesce(list_sort(list(DISTINCT step) FILTER (kind = 'completed')), []) AS completed FROM ev GROUP BY run
), state AS (SELECT run, CASE WHEN lk = 'done' THEN 'completed' ELSE coalesce(lk, 'running') END AS status, CASE WHEN ck = 'running' THEN cs END AS current_step, CASE WHEN fk <> 'running' THEN fs END AS failed_step, completed FROM st) """


def _states(s: SparkSession, d: str) -> DataFrame:
    """Events as the steps of runs."""
    e, m = A.table(s, d, "events"), F.col("event_id") % 11
    kind = F.when(m == 0, "failed").when(m == 1, "interrupted").when(m == 2, "done").when(m <= 5, "running").otherwise("completed")
    step = F.when(m != 2, F.get(F.array(*map(F.lit, _PLAN)), (F.floor(F.col("event_id") / 3) % 6).cast("int")))
    return runs.run_state(e.select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), kind.alias("kind"), step.alias("step")))


@query("run_states", _RUNS + "SELECT run, status, current_step, failed_step, array_to_string(completed, ',') AS completed FROM state")
def _(s, d):
    return _states(s, d).withColumn("completed", F.array_join("completed", ","))


@query("resume_steps", _RUNS + f"""SELECT run, coalesce(list_position({_STEPS}, CASE WHEN status = 'interrupted' AND current_step IS NOT NULL THEN current_step ELSE coalesce(failed_step, current_step) END) - 1,
  list_filter(range(6), lambda i: NOT list_contains(completed, {_STEPS}[(i + 1)::INTEGER]))[1], 6)::BIGINT AS step_no FROM state""")
def _(s, d):
    return runs.resume_step(_states(s, d), _PLAN)


@query("missing_artifacts", "SELECT o_custkey AS run, o_orderstatus AS step, o_orderkey::VARCHAR AS path FROM orders WHERE o_orderkey % 4 = 0")
def _(s, d):
    x = A.table(s, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderstatus").alias("step"), F.col("o_orderkey").cast("string").alias("path"))
    return runs.missing_artifacts(x, x.where(F.col("path").cast("long") % 4 != 0))


@query("glossary_override", "SELECT p_partkey, p_brand || '-own' AS brand, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS type, p_name AS container FROM part")
def _(s, d):
    own = F.create_map(F.lit("brand"), F.concat("p_brand", F.lit("-own")), F.lit("container"), F.col("p_name"))
    auto = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type")))
    x = A.table(s, d, "part").select("p_partkey", runs.override(auto, own).alias("m"))
    return x.select("p_partkey", *(F.try_element_at("m", F.lit(k)).alias(k) for k in ("brand", "type", "container")))


@query("first_hints", "SELECT l_suppkey AS curr_unit_id, l_linenumber AS next_unit_id, min(l_orderkey) AS hint FROM lineitem GROUP BY ALL")
def _(s, d):
    x = A.table(s, d, "lineitem").select(F.col("l_suppkey").alias("curr_unit_id"), F.col("l_linenumber").alias("next_unit_id"), F.col("l_orderkey").alias("hint"))
    return runs.first_of_pair(x, ("curr_unit_id", "next_unit_id"), ["hint"])


_FILES = """, files AS (SELECT o_custkey AS dir, CASE o_orderkey % 9 WHEN 0 THEN 'talk_p1.mp4' WHEN 1 THEN 'talk_p2.mp4' WHEN 2 THEN 'talk.mkv' WHEN 3 THEN 'talk_p1.zh.srt' WHEN 4 THEN 'talk.en.vtt'
    WHEN 5 THEN 'zh.srt' WHEN 6 THEN 'bilingual.ass' WHEN 7 THEN 'talk.annotations.vtt' ELSE 'notes.txt' END AS name FROM orders GROUP BY ALL
), stems AS (SELECT *, regexp_replace(name, '\\.[^.]*$', '') AS stem FROM files), v0 AS (
  SELECT dir, name AS video, stem, regexp_extract(stem, '_p(\\d+)$', 1) AS part FROM stems WHERE regexp_matches(name, '\\.(mp4|webm|mkv)$')
), v AS (SELECT *, count(*) OVER (PARTITION BY dir) AS n FROM (SELECT *, bool_or(part <> '') OVER (PARTITION BY dir) AS parts FROM v0) WHERE NOT parts OR part <> ''
), subs AS (SELECT dir, name AS subtitle, stem AS sub_stem FROM stems WHERE regexp_matches(name, '(?i)\\.(srt|vtt|ass)$')
), own AS (SELECT v.dir, video, CASE WHEN part <> '' THEN 'p' || part ELSE '' END AS segment, subtitle, CASE WHEN sub_stem = stem THEN subtitle ELSE substr(subtitle, length(stem) + 2) END AS key
  FROM subs s JOIN v ON s.dir = v.dir AND (sub_stem = stem OR starts_with(sub_stem, stem || '.'))
), lone AS (SELECT v.dir, video, CASE WHEN part <> '' THEN 'p' || part ELSE '' END AS segment, subtitle, subtitle AS key FROM subs s JOIN v ON s.dir = v.dir AND n = 1 WHERE NOT ends_with(lower(subtitle), '.ass')
  AND NOT EXISTS (SELECT 1 FROM own o WHERE o.dir = v.dir AND o.video = v.video AND o.key = s.subtitle)
), bare AS (SELECT dir, '' AS video, '' AS segment, subtitle, subtitle AS key FROM subs WHERE NOT ends_with(lower(subtitle), '.ass') AND dir NOT IN (SELECT dir FROM v)
), found AS (SELECT * FROM own UNION ALL SELECT * FROM lone UNION ALL SELECT * FROM bare), chunks AS (
  SELECT * FROM found UNION ALL SELECT dir, video, CASE WHEN part <> '' THEN 'p' || part ELSE '' END, NULL, NULL FROM v WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.dir = v.dir AND f.video = v.video)) """


def _library(s: SparkSession, d: str) -> DataFrame:
    m = F.col("o_orderkey") % 9
    name = F.lit("notes.txt")
    for k, n in enumerate(["talk_p1.mp4", "talk_p2.mp4", "talk.mkv", "talk_p1.zh.srt", "talk.en.vtt", "zh.srt", "bilingual.ass", "talk.annotations.vtt"]):
        name = F.when(m == k, n).otherwise(name)
    return A.table(s, d, "orders").select(F.col("o_custkey").alias("dir"), name.alias("name")).distinct()


@query("library_chunks", _FILES + "SELECT dir, video, segment, subtitle, key FROM chunks")
def _(s, d):
    return runs.discover(_library(s, d))


@query("subtitle_paths", _FILES + """, k AS (SELECT dir, video, min(subtitle) FILTER (key = 'zh.srt') AS a, min(subtitle) FILTER (ends_with(key, '.zh.srt')) AS b FROM chunks GROUP BY ALL)
SELECT * FROM (SELECT k.dir, k.video, coalesce(a, b, (SELECT min(name) FROM files f WHERE f.dir = k.dir AND name = 'zh.srt'), (SELECT min(name) FROM files f WHERE f.dir = k.dir AND name = regexp_replace(k.video, '\\.[^.]*$', '') || '.zh.srt')) AS path FROM k) WHERE path IS NOT NULL""")
def _(s, d):
    files = _library(s, d)
    return runs.resolve_subtitle(runs.discover(files), files, "zh", "srt")


@query("subtitle_languages", _FILES + """SELECT dir, name, CASE WHEN NOT (contains(name, '.annotations.') OR starts_with(name, 'annotations.') OR starts_with(name, 'bilingual'))
  THEN lower(coalesce(nullif(regexp_extract(name, '(?i)^([a-z]{2})\\.(?:srt|vtt|ass)$', 1), ''), nullif(regexp_extract(name, '(?i)\\.([a-z]{2})\\.(?:srt|vtt|ass)$', 1), ''))) END AS lang FROM files""")
def _(s, d):
    return _library(s, d).select("dir", "name", runs.subtitle_language(F.col("name")).alias("lang"))


# Chinese words by a dictionary: the cues without their spaces, with a line end in the middle, and their own words.

_HAN = """, spaced AS (SELECT media_id, lang, cue_no, text, replace(text, ' ', '') AS t FROM cues WHERE lang = 'zh'),
  han AS (SELECT media_id, lang, cue_no, left(t, length(t) // 2) || chr(10) || substr(t, length(t) // 2 + 1) AS text FROM spaced),
  dict AS (SELECT word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(text, '[一-鿿]+')) AS word FROM spaced) GROUP BY word HAVING count(*) > 2)"""
_CUT = """, runs AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[一-鿿]{2,}')) AS run FROM texts),
  known AS (SELECT word, round(ln(freq / (SELECT sum(freq) FROM dict)) * 1000000)::BIGINT AS w FROM dict),
  ats AS (SELECT run, unnest(range(1, length(run) + 1)) AS i FROM runs),
  spans AS (SELECT run, i, unnest(range(1, least((SELECT max(length(word)) FROM dict), length(run) - i + 1) + 1)) AS n FROM ats),
  dag AS MATERIALIZED (SELECT run, i, list(struct_pack(w := coalesce(w, round(ln(1 / (SELECT sum(freq) FROM dict)) * 1000000)::BIGINT), n := n)) AS c
    FROM spans LEFT JOIN known ON word = substr(run, i, n) WHERE w IS NOT NULL OR n = 1 GROUP BY run, i),
  route AS MATERIALIZED (SELECT run, length(run) + 1 AS i, [0::BIGINT] AS s, []::BIGINT[] AS p, (SELECT max(length(word)) FROM dict) AS m FROM runs
    UNION ALL SELECT run, i, list_prepend(b.w, s)[1:m], list_prepend(b.n, p), m FROM (
      SELECT r.run, d.i, s, p, m, list_max(list_transform(c, lambda x: struct_pack(w := x.w + s[x.n], n := x.n))) AS b FROM route r JOIN dag d ON d.run = r.run AND d.i = r.i - 1)),
  walk AS (SELECT run, p, 1::BIGINT AS k FROM route WHERE i = 1 UNION ALL SELECT run, p, k + p[k] FROM walk WHERE k + p[k] <= length(run)),
  pieces AS (SELECT * EXCLUDE (text, ps), unnest(ps) AS piece, unnest(range(len(ps))) AS place FROM (SELECT *, regexp_extract_all(text, '(?s)[一-鿿]+|[A-Za-z0-9]+|.') AS ps FROM texts)),
  placed AS (SELECT *, sum(length(piece)) OVER (PARTITION BY rule, media_id, cue_no, sub_no ORDER BY place) - length(piece) AS off FROM pieces),
  cut AS (SELECT * EXCLUDE (piece, place, off, run, p, k), substr(run, k, p[k]) AS word, off + k - 1 AS first FROM placed JOIN walk ON run = piece
    UNION ALL SELECT * EXCLUDE (piece, place, off), piece, off FROM placed WHERE NOT regexp_full_match(piece, '[一-鿿]{2,}'))"""
_BORDERS = f""", near AS (SELECT *, {STRIP.format("string_split(text, chr(10))[1]")} AS head, {STRIP.format("string_split(prev_text, chr(10))[-1]")} AS tail
  FROM (SELECT *, string_split(text, chr(10)) AS lines, lag(cue_no) OVER w AS prev_no, lag(text) OVER w AS prev_text FROM han WINDOW w AS (PARTITION BY media_id, lang ORDER BY cue_no)))"""


def _han(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Chinese cues without spaces, and the words that they have more than twice."""
    cues = A.cues(s, d).where("lang = 'zh'")
    t = F.replace("text", F.lit(" "), F.lit(""))
    half = F.floor(F.length(t) / 2).cast("int")
    han = cues.select("media_id", "lang", "cue_no", F.concat(F.left(t, half), F.lit("\n"), F.substr(t, half + 1)).alias("text"))
    words = cues.select(F.explode(F.regexp_extract_all("text", F.lit(f"{T.HAN_BASIC}+"), 0)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    return han, words.where("freq > 2")


@query("segment_han", f"{_HAN}, texts AS (SELECT '' AS rule, media_id, cue_no, 0 AS sub_no, text FROM han){_CUT} SELECT media_id, cue_no, first::INTEGER AS first, word FROM cut")
def _(s, d):
    han, words = _han(s, d)
    return segmentation.segment(han, ["media_id", "cue_no"], words).select("media_id", "cue_no", "first", "word")


_STATES = """, spread AS (SELECT freq, length(word) AS n, unnest(regexp_extract_all(word, '(?s).')) AS char, unnest(range(length(word))) AS p FROM dict WHERE regexp_full_match(word, '[一-鿿]+')),
  each AS (SELECT *, CASE WHEN n = 1 THEN 'S' WHEN p = 0 THEN 'B' WHEN p = n - 1 THEN 'E' ELSE 'M' END AS st, CASE WHEN n = 1 OR p = n - 1 THEN NULL WHEN p = n - 2 THEN 'E' ELSE 'M' END AS nx FROM spread),
  tot AS (SELECT st, sum(freq) AS t FROM each GROUP BY st),
  emit AS MATERIALIZED (SELECT char, max(w) FILTER (st = 'B') AS b, max(w) FILTER (st = 'M') AS m, max(w) FILTER (st = 'E') AS e, max(w) FILTER (st = 'S') AS s
    FROM (SELECT st, char, round(ln(sum(freq)::DOUBLE / any_value(t)) * 1000000)::BIGINT AS w FROM each JOIN tot USING (st) GROUP BY st, char) GROUP BY char),
  step_ AS (SELECT st, nx, round(ln(sum(freq)::DOUBLE / any_value(t)) * 1000000)::BIGINT AS w FROM each JOIN tot USING (st) WHERE nx IS NOT NULL GROUP BY ALL),
  word_ AS (SELECT st, round(ln(t::DOUBLE / (SELECT sum(t) FROM tot WHERE st IN ('B', 'S'))) * 1000000)::BIGINT AS w FROM tot WHERE st IN ('B', 'S')),
  k AS MATERIALIZED (SELECT -1000000000000 AS never, coalesce((SELECT w FROM word_ WHERE st = 'B'), never) AS wb, coalesce((SELECT w FROM word_ WHERE st = 'S'), never) AS ws, coalesce((SELECT w FROM step_ WHERE st = 'B' AND nx = 'E'), never) AS be,
    coalesce((SELECT w FROM step_ WHERE st = 'B' AND nx = 'M'), never) AS bm, coalesce((SELECT w FROM step_ WHERE st = 'M' AND nx = 'E'), never) AS me, coalesce((SELECT w FROM step_ WHERE st = 'M' AND nx = 'M'), never) AS mm),
  parts AS (SELECT run, k AS pos, p[k] AS n, row_number() OVER (PARTITION BY run ORDER BY k) AS r FROM walk),
  lone AS (SELECT *, r - row_number() OVER (PARTITION BY run ORDER BY pos) AS g FROM parts WHERE n = 1),
  gaps AS MATERIALIZED (SELECT run, pos, t FROM (SELECT run, min(pos) AS pos, substr(run, min(pos), count(*)) AS t FROM lone GROUP BY run, g HAVING count(*) > 1) WHERE t NOT IN (SELECT word FROM dict)),
  distinct_gaps AS (SELECT DISTINCT t FROM gaps),
  hmm AS (SELECT t, 1 AS i, wb + coalesce(b, never) AS vb, 2 * never + CASE WHEN m IS NULL THEN 0 ELSE m - never END AS vm, 2 * never + CASE WHEN e IS NULL THEN 0 ELSE e - never END AS ve, ws + coalesce(s, never) AS vs, 'B' AS pb, 'M' AS pm, 'E' AS pe, 'S' AS ps
      FROM distinct_gaps LEFT JOIN emit ON char = substr(t, 1, 1), k
    UNION ALL SELECT t, i + 1, CASE WHEN vs >= ve THEN vs ELSE ve END + wb + coalesce(b, never), CASE WHEN vm + mm >= vb + bm THEN vm + mm ELSE vb + bm END + coalesce(m, never), CASE WHEN vm + me >= vb + be THEN vm + me ELSE vb + be END + coalesce(e, never),
      CASE WHEN vs >= ve THEN vs ELSE ve END + ws + coalesce(s, never), CASE WHEN vs >= ve THEN ps ELSE pe END || 'B', CASE WHEN vm + mm >= vb + bm THEN pm ELSE pb END || 'M', CASE WHEN vm + me >= vb + be THEN pm ELSE pb END || 'E', CASE WHEN vs >= ve THEN ps ELSE pe END || 'S'
      FROM hmm LEFT JOIN emit ON char = substr(t, i + 1, 1), k WHERE i < length(t)),
  told AS (SELECT t, CASE WHEN vs >= ve THEN ps ELSE pe END AS states FROM hmm WHERE i = length(t)),
  ends AS (SELECT t, j, lag(j, 1, 0) OVER (PARTITION BY t ORDER BY j) AS before FROM (SELECT t, states, unnest(range(1, length(t) + 1)) AS j FROM told) WHERE substr(states, j, 1) IN ('E', 'S')),
  guessed AS (SELECT run, pos + before AS pos, j - before AS n FROM gaps JOIN ends USING (t)),
  final AS (SELECT run, pos, n FROM parts ANTI JOIN (SELECT run, unnest(range(pos, pos + length(t))) AS pos FROM gaps) USING (run, pos) UNION ALL SELECT run, pos, n FROM guessed)
  SELECT media_id, cue_no, (off + pos - 1)::INTEGER AS first, substr(run, pos, n) AS word FROM placed JOIN final ON run = piece
    UNION ALL SELECT media_id, cue_no, off::INTEGER, piece FROM placed WHERE NOT regexp_full_match(piece, '[一-鿿]{2,}')"""


@query("segment_unseen", f"{_HAN}, texts AS (SELECT '' AS rule, media_id, cue_no, 0 AS sub_no, text FROM han){_CUT}{_STATES}".replace(", text FROM han)", ", replace(text, chr(10), '') AS text FROM han)"))
def _(s, d):
    """As ``segment_han`` without line ends, with the states of the dictionary's own words."""
    han, words = _han(s, d)
    han = han.withColumn("text", F.replace("text", F.lit("\n"), F.lit("")))
    return segmentation.segment(han, ["media_id", "cue_no"], words, states=segmentation.word_states(words)).select("media_id", "cue_no", "first", "word")


@query("break_han_lines")
def _(s, d):
    """Chinese cues as their text stands; tested against a plain search over all places."""
    lines = hanlines.han_lines(A.cues(s, d).where("lang = 'zh'"), ["media_id", "cue_no"], _han(s, d)[1])
    return lines.select("media_id", "cue_no", F.posexplode("lines").alias("line_no", "line"))


@query("split_words", f"""{_HAN}{_BORDERS}, by_line AS (SELECT *, unnest(lines) AS line, unnest(range(len(lines))) AS k FROM near), texts AS (
  SELECT 'CompoundWords' AS rule, media_id, lang, cue_no, 0::BIGINT AS sub_no, list_transform(range(1, len(lines)), lambda k: length(array_to_string(lines[1:k], ''))) AS breaks, array_to_string(lines, '') AS text FROM near WHERE len(lines) > 1
  UNION ALL SELECT 'ParticleLine', media_id, lang, cue_no, k, [], {STRIP.format('line')} FROM by_line WHERE k > 0 AND regexp_matches({STRIP.format('line')}, '^[{segmentation.PARTICLES}]')
  UNION ALL SELECT 'ParticleCue', media_id, lang, prev_no, 0, [], head FROM near WHERE prev_no IS NOT NULL AND regexp_matches(head, '^[{segmentation.PARTICLES}]')
  UNION ALL SELECT 'TokenAcrossCues', media_id, lang, prev_no, 0, [length(tail)], tail || head FROM near WHERE tail <> '' AND head <> ''){_CUT}
  SELECT rule, media_id, lang, cue_no, (CASE WHEN rule = 'CompoundWords' THEN first ELSE sub_no END)::INTEGER AS sub_no, word FROM cut
  WHERE CASE WHEN rule LIKE 'Particle%' THEN first = 0 AND length(word) = 1
    ELSE length(word) > 1 AND len(list_filter(breaks, lambda b: b > first AND b < first + length(word))) > 0 AND (rule = 'TokenAcrossCues' OR regexp_full_match(word, '[一-鿿]+')) END""")
def _(s, d):
    return segmentation.split_words(*_han(s, d))


@query("mend_words", f"""{_HAN}{_BORDERS}, texts AS (SELECT 'm' AS rule, media_id, lang, cue_no, length(tail) AS sub_no, tail || head AS text FROM near WHERE tail <> '' AND head <> ''){_CUT},
  moved AS (SELECT media_id, cue_no, substr(word, 1, (sub_no - first)::BIGINT) AS moved FROM cut WHERE first + length(word) > sub_no AND sub_no - first >= 2 AND first > 0)
  SELECT media_id, lang, cue_no, coalesce(moved, '') || CASE WHEN gone IS NULL THEN text ELSE rtrim(left(rtrim(text), length(rtrim(text)) - length(gone))) END AS text
  FROM (SELECT han.*, moved, lead(moved) OVER (PARTITION BY media_id, lang ORDER BY cue_no) AS gone FROM han LEFT JOIN moved USING (media_id, cue_no))""")
def _(s, d):
    return segmentation.mend_words(*_han(s, d))


_ENDS_OF = f"""regexp_extract(string_split(prev_text, chr(10))[-1], '([{R.LETTERS}]{{3,}})\\s*$', 1) AS trail, regexp_extract(string_split(text, chr(10))[1], '^\\s*([{R.LETTERS}]+)', 1) AS lead"""


@query("english_across_cues", f"""SELECT media_id, lang, prev_no AS cue_no, trail || lead AS word FROM (SELECT *, {_ENDS_OF} FROM (
  SELECT media_id, 'zh' AS lang, cue_no, text, lag(cue_no) OVER w AS prev_no, lag(text) OVER w AS prev_text FROM (
    SELECT media_id, cue_no, regexp_replace(text, '[.,]+$', '') AS text FROM cues WHERE lang = 'en') WINDOW w AS (PARTITION BY media_id ORDER BY cue_no)))
  WHERE trail <> '' AND lead <> '' AND lower(trail) NOT IN ({_quoted(R.SAFE_ENGLISH)})""")
def _(s, d):
    cues = A.cues(s, d).where("lang = 'en'").withColumns({"lang": F.lit("zh"), "text": F.regexp_replace("text", "[.,]+$", "")})
    return segmentation.english_across_cues(cues)


_LAST_OF = STRIP.format("string_split(cur, chr(10))[-1]")
_HEAD_OF = STRIP.format("string_split(n.text, chr(10))[1]")


@query("mend_names", f""", t AS (SELECT media_id, lang, cue_no, regexp_replace(text, '[.,]+$', '') AS t FROM cues WHERE lang = 'en'),
  n AS (SELECT media_id, lang, cue_no, regexp_extract(t, '(?s)^(.*) ', 1) || chr(10) || translate(regexp_extract(t, ' ([^ ]*)$', 1), '{A.LATIN}', '{A.LATIN.upper()}') AS text, row_number() OVER (PARTITION BY media_id ORDER BY cue_no) AS k FROM t),
  r AS (SELECT media_id, k, NULL::BIGINT AS done_no, NULL::VARCHAR AS done, cue_no, text AS cur FROM n WHERE k = 1
    UNION ALL SELECT media_id, k, before, CASE WHEN move THEN coalesce(nullif(array_to_string(list_filter(string_split(cur, chr(10))[:-2], lambda x: {STRIP.format('x')} <> ''), chr(10)), ''), ' ') ELSE cur END, cue_no,
      CASE WHEN move THEN array_to_string(list_prepend(name || ' ' || head, string_split(text, chr(10))[2:]), chr(10)) ELSE text END
    FROM (SELECT *, length(name) BETWEEN 1 AND 6 AND regexp_full_match(name, '[A-Z][\\x00-\\x7F]*') AND NOT regexp_matches(name, '[.!?,;:]$') AND regexp_matches(head, '^\\p{{Lu}}') AS move
      FROM (SELECT n.*, r.cue_no AS before, r.cur, {_LAST_OF} AS name, {_HEAD_OF} AS head FROM r JOIN n ON n.media_id = r.media_id AND n.k = r.k + 1)))
  SELECT media_id, 'en' AS lang, done_no AS cue_no, done AS text FROM r WHERE done_no IS NOT NULL
  UNION ALL SELECT media_id, 'en', max_by(cue_no, k), max_by(cur, k) FROM r GROUP BY media_id""")
def _(s, d):
    t = F.regexp_replace("text", "[.,]+$", "")
    text = F.concat(F.regexp_extract(t, "(?s)^(.*) ", 1), F.lit("\n"), F.translate(F.regexp_extract(t, r" ([^ ]*)\z", 1), A.LATIN, A.LATIN.upper()))
    return segmentation.mend_names(A.cues(s, d).where("lang = 'en'").withColumn("text", text))


@query("entry_points", """, c AS (SELECT media_id, lang, cue_no, 3 * start_ms AS s, 3 * end_ms AS e FROM word_cues),
  x AS (SELECT c.*, 3 * start_ms AS ws, 3 * end_ms AS we, confidence, row_number() OVER w AS k, 3 * lag(end_ms) OVER w AS pe, 3 * lead(start_ms) OVER w AS ns
    FROM c JOIN words v ON v.media_id = c.media_id AND 3 * v.start_ms BETWEEN s - 50 AND e + 50 WINDOW w AS (PARTITION BY c.media_id, lang, cue_no ORDER BY start_ms, word_no)),
  a AS (SELECT media_id, lang, cue_no, s, count(*) AS n, max(confidence) FILTER (k = 1) AS f, max(confidence) FILTER (k BETWEEN 2 AND 6) AS peak, min_by(ws, k) FILTER (confidence > 0.5) - 100 AS good,
    min_by(ws, k) FILTER (ws - pe > 1500 AND coalesce(ns - we <= 1500, true) AND ws - 100 - s >= 80 AND confidence >= 0.45) - 100 AS anchor FROM x GROUP BY ALL),
  b AS (SELECT *, f < 0.4 AND peak >= 0.7 AND peak - f >= 0.3::DOUBLE AS cliff FROM a WHERE n > 1)
  SELECT media_id, lang, cue_no, CASE WHEN cliff THEN good ELSE anchor END AS start_ms, CASE WHEN cliff THEN 'cliff' ELSE 'gap' END AS reason FROM b WHERE CASE WHEN cliff THEN good - s BETWEEN 80 AND 1500 ELSE anchor IS NOT NULL END""")
def _(s, d):
    slow = lambda df: df.withColumns({"start_ms": 3 * F.col("start_ms"), "end_ms": 3 * F.col("end_ms")})
    return entry.entry_points(slow(A.words(s, d)), slow(A.word_cues(s, d)))


# Replies by language models, aligned by differences: tested on fixtures.


@query("correct_words")
def _(s, d):
    """Replies with every fifth word spelled otherwise, a word more where the turn is odd."""
    words = A.words(s, d)
    token = F.when(F.col("word_no") % 5 == 0, F.upper("text")).otherwise(F.col("text"))
    tokens = words.groupBy("media_id", "turn").agg(F.array_sort(F.collect_list(F.struct("word_no", token.alias("t"))))["t"].alias("tokens"))
    return corrections.correct_words(words, tokens.withColumn("tokens", F.when(F.col("turn") % 2 == 1, F.array_append("tokens", F.lit("more"))).otherwise(F.col("tokens"))))


@query("restore_punctuation", """SELECT media_id, turn, word_no, CASE WHEN word_no > min(word_no) OVER (PARTITION BY media_id, turn) THEN ' ' ELSE '' END || t || CASE WHEN word_no % 4 = 0 AND t <> '' THEN '?' ELSE '' END AS text
  FROM (SELECT *, regexp_replace(text, '[^\\p{L}]', '', 'g') AS t FROM words)""")
def _(s, d):
    words = A.words(s, d).withColumn("text", F.regexp_replace("text", r"[^\p{L}]", ""))
    marked = F.concat("text", F.when((F.col("word_no") % 4 == 0) & (F.col("text") != ""), "?").otherwise(""))
    replies = words.groupBy("media_id", "turn").agg(F.array_join(F.array_sort(F.collect_list(F.struct("word_no", marked.alias("t"))))["t"], " ").alias("reply"))
    first = F.min("word_no").over(Window.partitionBy("media_id", "turn"))
    return corrections.restore_punctuation(words.withColumn("text", F.when(F.col("word_no") > first, F.concat(F.lit(" "), "text")).otherwise(F.col("text"))), replies)
