"""The driver's tables seen as timed text: words, cues, sessions, usage and issues.

``conversations`` become media: turns are cues, their words get times by integer arithmetic, so any
engine makes the same rows. Media with an even id are put into Chinese characters, letter by letter.
``SQL`` holds the same views as common table expressions for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Which character stands for each Latin letter.
LATIN, HAN = "abcdefghijklmnopqrstuvwxyz", "的地得了着过吗呢吧啊么嘛呗不没是在有我你他这那们个人"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(column: str) -> Column:
    """Milliseconds since 1970 of a time stamp without zone, whatever the session's zone is."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(column).cast("timestamp_ntz"))


def _lang_and_text(df: DataFrame) -> DataFrame:
    zh = F.col("media_id") % 2 == 0
    return df.withColumn("lang", F.when(zh, "zh").otherwise("en")).withColumn("text", F.when(zh, F.translate(F.lower("text"), LATIN, HAN)).otherwise(F.col("text")))


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media_id, lang, cue_no, speaker, text, start_ms, end_ms), close together and overlapping."""
    x = _lang_and_text(table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "media_id").withColumn("dur", (400 + 30 * F.least(F.length("text"), F.lit(180))).cast("long")))
    before = Window.partitionBy("media_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("dur") + (F.col("turn") * 137) % 400 - 60).over(before), F.lit(0).cast("long"))
    x = x.withColumn("start_ms", start)
    return x.select("media_id", "lang", (F.col("turn") + 1).alias("cue_no"), F.col("role").alias("speaker"), "text", "start_ms", (F.col("start_ms") + F.col("dur")).alias("end_ms"))


#: Texts that rules look for, by kind of cue: what stands before, whether the cue's text follows, and what stands after.
VARIANTS: dict[int, tuple[str, bool, str]] = {
    0: ("", False, ""), 1: ("ab!", False, ""), 2: ("好人", False, ""), 3: ("well ", True, ""), 4: ("。", True, "\n！行"), 5: ("你好AB\nCD世界", False, ""), 6: ("共12\n34个", False, ""),
    7: ("看Transforme\nrnet吧", False, ""), 8: ("I\nthink therefore it is what we said", False, ""), 9: ("moreover it is so", False, ""), 10: ("这是  什么吗", False, ""), 11: ("对。你好 此外 我们", False, ""),
    12: ("", True, "\nx"), 13: ("the quick brown foxes jumped", False, ""), 14: ("quick brown foxes jumped again", False, ""), 15: ("我们如果", False, ""), 16: ("如果他们", False, ""),
    17: ("only Latin words here okay", False, ""), 18: ("他们", False, ""), 19: ("你", False, ""), 20: ("行\n这是一个很长的第二行文字", False, ""),
}
#: Lengths in milliseconds by kind, where they are not those of the text.
LENGTHS = {1: 500, 5: 789, 9: 8000, 13: 9500}
KINDS = 23


def rule_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cues`` with what each rule looks for put into some of them, and speakers now and then unknown."""
    x = cues(spark, sf_dir).withColumn("k", (F.col("media_id") * 5 + F.col("cue_no")) % KINDS)
    text, length = F.col("text"), F.col("end_ms") - F.col("start_ms")
    for k, (before, keep, after) in VARIANTS.items():
        text = F.when(F.col("k") == k, F.concat(F.lit(before), F.col("text") if keep else F.lit(""), F.lit(after))).otherwise(text)
    for k, ms in LENGTHS.items():
        length = F.when(F.col("k") == k, F.lit(ms).cast("long")).otherwise(length)
    speaker = F.when(F.col("k") % 4 != 0, F.col("speaker"))
    return x.select("media_id", "lang", "cue_no", speaker.alias("speaker"), text.alias("text"), "start_ms", (F.col("start_ms") + length).alias("end_ms"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media_id, turn, speaker, word_no, text, start_ms, end_ms, confidence)."""
    tok = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("media_id"), "turn", F.col("role").alias("speaker"), F.posexplode(F.split("text", " ")).alias("p", "text"))
    order = Window.partitionBy("media_id").orderBy("turn", "p")
    wd = 20 * F.least(F.length("text"), F.lit(12))
    gap = F.when(F.col("p") % 11 == 10, 700).otherwise(60 + (F.col("p") * 53) % 90)
    x = tok.withColumn("word_no", F.row_number().over(order).cast("long")).withColumn("wd", wd.cast("long")).withColumn("step", (F.col("wd") + gap).cast("long"))
    x = x.withColumn("start_ms", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("step"))
    return x.select("media_id", "turn", "speaker", "word_no", "text", "start_ms", (F.col("start_ms") + F.col("wd")).alias("end_ms"), ((F.col("word_no") * 7919) % 100 / 100).alias("confidence"))


def word_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues around the words of each turn, a little off at both ends; columns as of ``cues``."""
    spans = words(spark, sf_dir).groupBy("media_id", "turn").agg(F.min("start_ms").alias("s"), F.max("end_ms").alias("e"))
    text = _lang_and_text(table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "media_id"))
    x = text.join(spans, ["media_id", "turn"])
    return x.select("media_id", "lang", (F.col("turn") + 1).alias("cue_no"), F.col("role").alias("speaker"), "text", (F.col("s") + (F.col("turn") * 137) % 400 - 200).alias("start_ms"), (F.col("e") + (F.col("turn") * 211) % 400 - 200).alias("end_ms"))


def bilingual_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source cues in English and, 300 ms later, the same cues in Chinese; every seventh has none."""
    x = cues(spark, sf_dir).where("lang = 'en'")
    zh = x.where("cue_no % 7 <> 0").select("media_id", F.lit("zh").alias("lang"), "cue_no", "speaker", F.translate(F.lower("text"), LATIN, HAN).alias("text"), (F.col("start_ms") + 300).alias("start_ms"), (F.col("end_ms") + 300).alias("end_ms"))
    return x.unionByName(zh)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media_id, seq, unit_id, speaker, text, start_ms, end_ms) of cues, numbered as translation units."""
    unit = F.concat(F.lit("u"), F.lpad(F.col("cue_no").cast("string"), 4, "0"))
    return cues(spark, sf_dir).select("media_id", F.col("cue_no").alias("seq"), unit.alias("unit_id"), "speaker", "lang", "text", "start_ms", "end_ms")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token usage by pipeline step, out of line items."""
    x = table(spark, sf_dir, "lineitem")
    prompt = (F.col("l_quantity") * 100).cast("long")
    hit = F.when(F.col("l_linenumber") % 3 != 0, (F.col("l_quantity") * 40).cast("long"))
    cost = F.when(F.col("l_linenumber") == 1, F.col("l_tax"))
    model = F.when(F.col("l_suppkey") % 10 == 0, "unlisted").when(F.col("l_suppkey") % 2 == 0, "deepseek-v4-pro").otherwise("deepseek-v4-flash")
    return x.select(F.col("l_returnflag").alias("step"), model.alias("model"), prompt.alias("prompt_tokens"), hit.alias("cache_hit_tokens"), (prompt - hit).alias("cache_miss_tokens"), (F.col("l_quantity") * 10).cast("long").alias("completion_tokens"), cost.alias("cost_usd"))


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, issue_no, rule, severity): events of the first half of the month are the baseline run."""
    severity = F.when(F.col("value") < 20, "error").when(F.col("value") < 60, "warning").otherwise("suggestion")
    run = F.when(F.dayofmonth("ts") <= 15, "baseline").otherwise("current")
    return table(spark, sf_dir, "events").select(run.alias("run"), F.col("event_id").alias("issue_no"), F.col("event_type").alias("rule"), severity.alias("severity"), "user_id")


def _variant_sql() -> str:
    text = " ".join(f"WHEN {k} THEN '{before}' || {'text' if keep else chr(39) * 2} || '{after}'" for k, (before, keep, after) in VARIANTS.items())
    length = " ".join(f"WHEN {k} THEN {ms}" for k, ms in LENGTHS.items())
    return (
        f"SELECT media_id, lang, cue_no, CASE WHEN k % 4 <> 0 THEN speaker END AS speaker, CASE k {text} ELSE text END AS text, start_ms, "
        f"start_ms + CASE k {length} ELSE end_ms - start_ms END AS end_ms FROM (SELECT *, (media_id * 5 + cue_no) % {KINDS} AS k FROM cues)"
    )


SQL = f"""
base AS (
  SELECT conv_id AS media_id, turn, role AS speaker, CASE WHEN conv_id % 2 = 0 THEN 'zh' ELSE 'en' END AS lang,
    CASE WHEN conv_id % 2 = 0 THEN translate(lower(text), '{LATIN}', '{HAN}') ELSE text END AS text,
    400 + 30 * least(length(text), 180) AS dur
  FROM conversations
), cues AS (
  SELECT media_id, lang, turn + 1 AS cue_no, speaker, text, s AS start_ms, s + dur AS end_ms
  FROM (SELECT *, coalesce(sum(dur + turn * 137 % 400 - 60) OVER (PARTITION BY media_id ORDER BY turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM base)
), rule_cues AS (
  {_variant_sql()}
), tok AS (
  SELECT conv_id AS media_id, turn, role AS speaker, unnest(string_split(text, ' ')) AS text,
    unnest(range(len(string_split(text, ' ')))) AS p FROM conversations
), num AS (
  SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY turn, p) AS word_no, 20 * least(length(text), 12) AS wd,
    CASE WHEN p % 11 = 10 THEN 700 ELSE 60 + p * 53 % 90 END AS gap FROM tok
), words AS (
  SELECT media_id, turn, speaker, word_no, text, s AS start_ms, s + wd AS end_ms, (word_no * 7919 % 100) / 100 AS confidence
  FROM (SELECT *, coalesce(sum(wd + gap) OVER (PARTITION BY media_id ORDER BY word_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM num)
), word_cues AS (
  SELECT b.media_id, b.lang, b.turn + 1 AS cue_no, b.speaker, b.text, s + b.turn * 137 % 400 - 200 AS start_ms,
    e + b.turn * 211 % 400 - 200 AS end_ms
  FROM base b JOIN (SELECT media_id, turn, min(start_ms) AS s, max(end_ms) AS e FROM words GROUP BY ALL) USING (media_id, turn)
), bilingual AS (
  SELECT * FROM cues WHERE lang = 'en'
  UNION ALL SELECT media_id, 'zh', cue_no, speaker, translate(lower(text), '{LATIN}', '{HAN}'), start_ms + 300, end_ms + 300
  FROM cues WHERE lang = 'en' AND cue_no % 7 <> 0
), segments AS (
  SELECT media_id, cue_no AS seq, 'u' || lpad(cue_no::VARCHAR, 4, '0') AS unit_id, speaker, lang, text, start_ms, end_ms FROM cues
), usage AS (
  SELECT l_returnflag AS step, CASE WHEN l_suppkey % 10 = 0 THEN 'unlisted' WHEN l_suppkey % 2 = 0 THEN 'deepseek-v4-pro'
    ELSE 'deepseek-v4-flash' END AS model, (l_quantity * 100)::BIGINT AS prompt_tokens,
    CASE WHEN l_linenumber % 3 <> 0 THEN (l_quantity * 40)::BIGINT END AS cache_hit_tokens,
    (l_quantity * 100)::BIGINT - CASE WHEN l_linenumber % 3 <> 0 THEN (l_quantity * 40)::BIGINT END AS cache_miss_tokens,
    (l_quantity * 10)::BIGINT AS completion_tokens, CASE WHEN l_linenumber = 1 THEN l_tax END AS cost_usd
  FROM lineitem
), issues AS (
  SELECT CASE WHEN day(ts) <= 15 THEN 'baseline' ELSE 'current' END AS run, event_id AS issue_no, event_type AS rule,
    CASE WHEN value < 20 THEN 'error' WHEN value < 60 THEN 'warning' ELSE 'suggestion' END AS severity, user_id FROM events
)
"""
